"""Search documents and identity of events: one Arrow UDF call per event walks its payload, whatever its shape and depth.

Objects are walked in order of their keys. Rules by canonical type say which keys feed which column.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..schema import TEXT_COLUMNS

# Which keys feed which column of an event of each type.
_TALK = ("text", "message", "content", "delta", "summary")
RULES: dict[str, dict[str, tuple[str, ...]]] = {
    "user.message": {"user_text": ("prompt", "text", "message", "content", "input")},
    "assistant.delta": {"assistant_text": _TALK},
    "assistant.message": {"assistant_text": _TALK},
    "tool.call": {"tool_intent": ("tool_name", "command", "description", "input", "arguments")},
    "tool.result": {"tool_intent": ("tool_name", "command", "status", "exit_code"), "tool_output": ("output", "stderr", "stdout", "error", "result")},
    "file.changed": {"metadata_text": ("file", "file_path", "path", "diff", "operation")},
    "compaction.before": {"assistant_text": ("summary", "text", "content", "reason"), "metadata_text": ("trigger",)},
    "compaction.after": {"assistant_text": ("summary", "text", "content", "reason"), "metadata_text": ("trigger",)},
    "session.ended": {"metadata_text": ("message", "reason", "summary", "usage_summary")},
    "error": {"metadata_text": ("error", "message", "reason", "text", "details")},
}
USAGE_KEYS = ("usage", "usage_metadata")
WRAPPER_KEYS = ("workdir", "yield_time_ms", "timeout_ms", "with_escalated_permissions", "env")
NARRATION_KEYS = ("justification", "description")
VOLATILE = {
    "captured_at", "timestamp", "created_at", "updated_at", "tool_version", "session_id", "filename_session_id", "project_root", "cwd", "source",
    "source_event_type", "source_event_id", "hook_event_name", "event", "type", "dedupe_key", "raw_file", "raw_offset", "raw_line", "message_id",
    "event_id", "turn_id", "id",
}
PATH_KEYS = {"file", "file_path", "filepath", "path", "source_path", "transcript_path"}
PATH_ENDS, PATH_STARTS = ("_file", "_path"), ("/", "./", "../", "~/")

Walk = Iterator[str]


def _children(value) -> Iterator[tuple[str | None, object]]:
    if isinstance(value, dict):
        yield from sorted(value.items())
    elif isinstance(value, list):
        yield from ((None, v) for v in value)


def _strings(value, skip: Callable[[str], bool]) -> Walk:
    """Every string below value but those under keys to skip."""
    if isinstance(value, str):
        yield value
    for key, child in _children(value):
        if key is None or not skip(key):
            yield from _strings(child, skip)


def _under(value, keys: tuple[str, ...], take: Callable[[str, object], Walk]) -> Walk:
    """What take yields for each value under one of keys, at any depth; below such a value no key is sought."""
    for key, child in _children(value):
        yield from take(key, child) if key in keys else _under(child, keys, take)


def _not_type(key: str) -> bool:
    return key == "type"


def _plain(_key: str, value) -> Walk:
    return _strings(value, _not_type)


def wrapped_command(value) -> str | None:
    """The command line of an execution envelope: an object with a command and a key of the envelope."""
    if not isinstance(value, dict) or not any(k in value for k in WRAPPER_KEYS):
        return None
    command = value.get("command")
    if isinstance(command, list):
        command = " ".join(x for v in command if isinstance(v, str) and (x := v.strip()))
    return (command.strip() or None) if isinstance(command, str) else None


def _intent(_key: str, value) -> Walk:
    inner = value
    if isinstance(value, str):
        try:
            inner = json.loads(value.strip())
        except ValueError:
            inner = None
    command = wrapped_command(inner)
    if command is None:
        yield from [value] if isinstance(value, str) else _strings(value, _not_type)
        return
    yield command
    yield from (inner[k] for k in NARRATION_KEYS if isinstance(inner.get(k), str))


def _scalars(key: str, value) -> Walk:
    if isinstance(value, bool):
        yield f"{key} {str(value).lower()}"
    elif isinstance(value, str | int | float):
        yield f"{key} {value}"
    for name, child in _children(value):
        yield from _scalars(key if name is None else name, child)


def _lines(found: Walk) -> str:
    """Trimmed, without empty and repeated ones, a line each."""
    return "\n".join(dict.fromkeys(x for v in found if (x := v.strip())))


def _joined(parts) -> str:
    return "\n".join(x for v in parts if (x := v.strip()))


def document(canonical_type: str, payload) -> dict[str, str]:
    """The five text columns of an event."""
    out = dict.fromkeys(TEXT_COLUMNS, "")
    for column, keys in RULES.get(canonical_type, {}).items():
        out[column] = _lines(_under(payload, keys, _intent if column == "tool_intent" else _plain))
    if canonical_type == "session.ended":
        out["metadata_text"] = _joined([out["metadata_text"], _lines(_under(payload, USAGE_KEYS, _scalars))])
    if not any(v.strip() for v in out.values()):
        out["metadata_text"] = _lines(_strings(payload, VOLATILE.__contains__))
    return out


def file_paths(payload) -> list[str]:
    """Sorted distinct strings that are paths by their key, which lists pass on, or by their look."""
    found = set()

    def walk(value, key: str | None) -> None:
        if isinstance(value, str):
            named = key is not None and (key in PATH_KEYS or key.endswith(PATH_ENDS))
            if (named or value.strip().startswith(PATH_STARTS)) and value.strip():
                found.add(value.strip())
        for name, child in _children(value):
            walk(child, key if name is None else name)

    walk(payload, None)
    return sorted(found)


def _stable(value):
    if isinstance(value, dict):
        return {k: _stable(v) for k, v in value.items() if k not in VOLATILE}
    return [_stable(v) for v in value] if isinstance(value, list) else value


def content_hash(doc: dict[str, str], payload) -> str:
    """Hash of the document's lines, or of the payload without what varies between captures where there are none."""
    lines = "\n".join(x for line in _joined(doc.values()).splitlines() if (x := line.strip()))
    body = lines or json.dumps(_stable(payload), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(body.encode()).hexdigest()


SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in (*TEXT_COLUMNS, "searchable_text", "content_hash", "command", "tool_name")] + [T.StructField("paths", T.ArrayType(T.StringType()))])


@F.pandas_udf(SCHEMA)
def _document(kinds: pd.Series, payloads: pd.Series) -> pd.DataFrame:
    rows = []
    for kind, raw in zip(kinds, payloads, strict=True):
        try:
            payload = json.loads(raw) if raw is not None else None
        except ValueError:
            payload = raw
        doc = document(kind or "", payload)
        own = payload if isinstance(payload, dict) else {}
        top = lambda k, own=own: own[k] if isinstance(own.get(k), str) else None
        rows.append((*doc.values(), _joined(doc.values()), content_hash(doc, payload), top("command"), top("tool_name"), file_paths(payload)))
    return pd.DataFrame(rows, columns=SCHEMA.names)


#: First part of every dedupe key. To keep keys of an existing store, pass its own.
DOMAIN = "event-dedupe-v2"


def dedupe_key(tool: Column, session_id: Column, canonical_type: Column, source_event_id: Column, sequence: Column, content: Column, domain: str = DOMAIN) -> Column:
    """sha256 over parts that each end in a zero byte: the source's own id, or the content and its place."""
    end = lambda c: F.concat(c, F.lit("\u0000"))
    place = F.when(sequence.isNotNull(), F.concat(end(F.lit("sequence")), end(sequence.cast("string")))).otherwise(end(F.lit("unsequenced")))
    tail = F.when(source_event_id.isNotNull(), F.concat(end(F.lit("native-id")), end(source_event_id))).otherwise(F.concat(end(F.lit("content")), end(content), place))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(end(F.lit(domain)), end(tool), end(session_id), end(canonical_type), tail), 256))


def with_documents(events: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """events with text columns, searchable_text, paths, command, tool_name and dedupe_key."""
    rows = events.withColumn("__doc", _document("canonical_type", "payload"))
    for c in SCHEMA.names:
        rows = rows.withColumn("doc_tool_name" if c == "tool_name" else c, F.col(f"__doc.{c}"))
    key = dedupe_key(F.col("tool"), F.col("session_id"), F.col("canonical_type"), F.col("source_event_id"), F.col("sequence"), F.col("content_hash"), domain)
    return rows.drop("__doc").withColumn("dedupe_key", key)


def message_text() -> Column:
    """What an event says: the user's or the assistant's words, or a tool's output, else its intent."""
    kind = F.col("canonical_type")
    output = F.when(F.trim("tool_output") != "", F.col("tool_output")).otherwise(F.col("tool_intent"))
    return F.when(kind == "user.message", F.col("user_text")).when(kind.isin("assistant.delta", "assistant.message"), F.col("assistant_text")).when(kind == "tool.result", output).otherwise("")


def rendered() -> Column:
    return text.join_non_empty(*(F.col(c) for c in TEXT_COLUMNS))
