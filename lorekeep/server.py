"""The query surface as tools, resources and prompts over JSON-RPC, a message a line."""

from __future__ import annotations

import inspect
import json
from typing import IO

from . import api
from .errors import NotFoundError, ValidationError
from .operators.search import Filters

#: Tools by name: what each is for, and which of its arguments are filters of a search.
TOOLS = {
    "search_history": "Ranked full-text search with citations; pages by cursor.",
    "list_sessions": "Sessions, latest first, with what tells them apart.",
    "get_session": "Events of one session, by page or around a line.",
    "get_event": "One event by line or offset.",
    "export_session": "A whole session as Markdown or JSONL.",
    "recall_answer": "Hits with the lines around them, each line once.",
    "history_doctor": "Latest event of each tool, and with deep the size of every table.",
}
FILTERED = ("search_history", "recall_answer")
FILTERS = ("tool", "session", "cwd", "since", "canonical_type", "include_deltas", "file", "command", "ref")
HIDDEN = ("self", "filters", "files", "checkpoints", "store_bytes", "window")
PROMPTS = {
    "recall_project_history": "Search this project's history with search_history before going on. Read around a hit with get_session and its line, and cite tool, session and line.",
    "prepare_handoff_summary": "Collect what a successor needs with recall_answer, or walk sessions with list_sessions and get_session, and write a short summary that cites tool, session and line.",
}
RESOURCES = {"lorekeep://sessions": "Recent sessions", "lorekeep://schema/tools": "Arguments of the tools"}
TEMPLATE = "lorekeep://sessions/{tool}/{session_id}"
_TYPES = {"int": "integer", "bool": "boolean", "str": "string"}


def descriptions() -> list[dict]:
    """Name, purpose and arguments of each tool, as its method has them."""
    out = []
    for name, purpose in TOOLS.items():
        own = {k: p for k, p in inspect.signature(getattr(api.History, name)).parameters.items() if k not in HIDDEN}
        kinds = {k: {"type": _TYPES.get(str(p.annotation).split(" | ")[0], "string")} for k, p in own.items()}
        if name == "get_session":
            kinds |= {k: {"type": "integer"} for k in ("limit", "after_raw_line", "around_raw_line", "before", "after")} | {"include_deltas": {"type": "boolean"}}
        if name in FILTERED:
            kinds |= {k: {"type": "boolean" if k == "include_deltas" else "string"} for k in FILTERS}
        required = [k for k, p in own.items() if p.default is inspect.Parameter.empty and p.kind is not inspect.Parameter.VAR_KEYWORD]
        out.append({"name": name, "description": purpose, "inputSchema": {"type": "object", "properties": kinds, "required": required, "additionalProperties": False}})
    return out


def call(history: api.History, name: str, arguments: dict) -> dict:
    """A tool's answer, or the error it raised as one."""
    try:
        known = next((d["inputSchema"] for d in descriptions() if d["name"] == name), None)
        if known is None:
            raise NotFoundError(f"no tool {name}")
        if (odd := set(arguments) - set(known["properties"])) or (odd := set(known["required"]) - set(arguments)):
            raise ValidationError(f"arguments of {name}: {', '.join(sorted(odd))}")
        for key, value in arguments.items():
            wanted = {"integer": int, "boolean": bool, "string": str}[known["properties"][key]["type"]]
            if value is not None and (not isinstance(value, wanted) or (wanted is int and isinstance(value, bool))):
                raise ValidationError(f"{key} must be of type {known['properties'][key]['type']}")
        given = dict(arguments)
        if name in FILTERED:
            picked = {k: given.pop(k) for k in FILTERS if k in given}
            given["filters"] = Filters(**picked)
        answer = getattr(history, name)(**given)
        return answer if isinstance(answer, dict) else {"text": answer}
    except Exception as e:
        return api.failure(e)


def resource(history: api.History, uri: str) -> dict:
    if uri == "lorekeep://sessions":
        return history.list_sessions()
    if uri == "lorekeep://schema/tools":
        return {"tools": descriptions()}
    head, _, rest = uri.partition("lorekeep://sessions/")
    tool, _, session = rest.partition("/")
    if head or not session:
        raise ValidationError(f"unknown resource: {uri}")
    return history.get_session(tool, session)


def _text(value) -> list[dict]:
    return [{"type": "text", "text": json.dumps(value, ensure_ascii=False, default=str)}]


def answer(history: api.History, request: dict) -> dict | None:
    """The response to one request; none to a notification."""
    method, given, number = request.get("method"), request.get("params") or {}, request.get("id")
    if number is None:
        return None
    listings = {
        "ping": lambda: {},
        "initialize": lambda: {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}, "prompts": {}}, "serverInfo": {"name": "lorekeep", "version": "1"}},
        "tools/list": lambda: {"tools": descriptions()},
        "resources/list": lambda: {"resources": [{"uri": u, "name": n, "mimeType": "application/json"} for u, n in RESOURCES.items()]},
        "resources/templates/list": lambda: {"resourceTemplates": [{"uriTemplate": TEMPLATE, "name": "Events of a session", "mimeType": "application/json"}]},
        "resources/read": lambda: {"contents": [{"uri": given.get("uri"), "mimeType": "application/json", "text": json.dumps(resource(history, given.get("uri", "")), ensure_ascii=False, default=str)}]},
        "prompts/list": lambda: {"prompts": [{"name": n, "arguments": []} for n in PROMPTS]},
        "prompts/get": lambda: {"messages": [{"role": "user", "content": {"type": "text", "text": PROMPTS[given.get("name")]}}]},
    }
    if method == "tools/call":
        out = call(history, given.get("name", ""), given.get("arguments") or {})
        return {"jsonrpc": "2.0", "id": number, "result": {"content": _text(out), "isError": "error" in out}}
    if method not in listings:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"no method {method}"}}
    try:
        return {"jsonrpc": "2.0", "id": number, "result": listings[method]()}
    except Exception as e:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": -32602, "message": str(e)}}


def serve(history: api.History, source: IO[str], sink: IO[str]) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            out = answer(history, json.loads(line))
        except ValueError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if out is not None:
            sink.write(json.dumps(out, ensure_ascii=False, default=str) + "\n")
            sink.flush()
