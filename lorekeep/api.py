"""The query surface: one class over a store's tables, with answers as plain values that fit a size limit."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import NotFoundError, UnavailableError, ValidationError
from .functions import redact, text
from .operators import corroborate, derive, document, maintain, search, sessions, vector
from .schema import TOOLS

#: Bytes of an answer as JSON, and of the store beyond which deep health checks are refused.
MOST_BYTES, DEEP_BYTES = 256 * 1024, 500 * 1024 * 1024
CODES = {ValidationError: "invalid_argument", NotFoundError: "not_found", UnavailableError: "unavailable"}
HINTS = {"invalid_argument": "Check the names and ranges of the arguments.", "not_found": "List sessions to see what is there.", "unavailable": "Use lexical mode, or embed the units first."}


def size(value) -> int:
    return len(json.dumps(value, ensure_ascii=False, default=str).encode())


def fitted(answer: dict, rows: str, most: int = MOST_BYTES) -> dict:
    """answer with as many of its first rows as fit; a single row too large for it has its longest text cut."""
    if size(answer) <= most:
        return answer
    kept, left = [], most - size(answer | {rows: [], "truncated": True}) - 64
    for row in answer[rows]:
        left -= size(row) + 2
        if left < 0:
            break
        kept.append(row)
    if not kept and answer[rows]:
        row = dict(answer[rows][0])
        name = max((k for k, v in row.items() if isinstance(v, str)), key=lambda k: len(row[k]), default=None)
        if name is not None:
            whole = row[name]
            low, high = 0, len(whole.encode())
            while low < high:
                middle = (low + high + 1) // 2
                fits = size(answer | {rows: [row | {name: text.utf8_prefix(whole, middle)}], "truncated": True}) <= most
                low, high = (middle, high) if fits else (low, middle - 1)
            kept = [row | {name: text.utf8_prefix(whole, low)}]
    return answer | {rows: kept, "truncated": True}


def failure(error: Exception) -> dict:
    code = next((c for kind, c in CODES.items() if isinstance(error, kind)), "internal")
    return {"error": {"code": code, "message": str(error), "hint": HINTS.get(code)}}


class History:
    """events: the table that document.with_documents() gives, with raw_file, raw_line and raw_offset."""

    def __init__(self, events: DataFrame, lines: DataFrame | None = None, units: DataFrame | None = None, embedder: vector.Embedder | None = None, tables: search.Tables | None = None):
        """tables: what a store keeps beside its events; without them all are derived at each answer."""
        self.lines, self.embedder = lines, embedder
        if tables is not None:
            tables.units = units
        self.kept = tables is not None
        self.tables = tables or search.Tables(events, events.select("tool", "session_id", "filename_session_id").distinct(), derive.event_files(events), derive.tool_events(events), derive.event_refs(events), units)

    @classmethod
    def of(cls, envelopes: DataFrame, **more) -> History:
        return cls(document.with_documents(envelopes), **more)

    def _tool(self, tool: str) -> str:
        if tool not in TOOLS:
            raise ValidationError(f"tool must be one of {', '.join(TOOLS)}")
        return tool

    def search_history(self, query: str, filters: search.Filters | None = None, mode: str = "auto", limit: int = 10, cursor: int = 0, max_snippet_chars: int = 240, expand_concepts: bool = False,
                       redacted: bool = False, include_payload: bool = False, check_repository: bool = False) -> dict:
        search.bounded("limit", limit, strict=True)
        search.bounded("max_snippet_chars", max_snippet_chars, strict=True)
        search.bounded("cursor", cursor, strict=True)
        page = search.search(self.tables, query, filters, mode, limit, cursor, max_snippet_chars, expand_concepts, self.embedder, redacted)
        rows = [r.asDict(True) for r in page.rows.collect()]
        if include_payload and rows:
            payloads = {r.dedupe_key: r.payload for r in search.hydrate(page.rows.select("dedupe_key"), self.tables.events).collect()}
            rows = [r | {"payload": redact.redact_line(payloads[r["dedupe_key"]] or "") if redacted else payloads[r["dedupe_key"]]} for r in rows]
        if check_repository:
            keys = page.rows.select("dedupe_key")
            whole = {r.dedupe_key: r for r in self.tables.events.join(F.broadcast(keys), "dedupe_key", "left_semi").select("dedupe_key", "searchable_text", "cwd", "project_root").collect()}
            rows = [r | {"corroboration": corroborate.corroborate((w := whole[r["dedupe_key"]]).searchable_text or "", w.cwd, w.project_root)} for r in rows]
        answer = fitted({"mode": page.mode, "results": rows, "total_estimated": page.total, "truncated": False}, "results")
        shown = len(answer["results"])
        answer["next_cursor"] = cursor + shown if shown < len(rows) else page.next_cursor
        return answer

    def list_sessions(self, tool: str | None = None, cwd: str | None = None, since: str | None = None, limit: int = 20) -> dict:
        search.bounded("sessions", limit, strict=True)
        found = sessions.triage(self.tables.events, self.tables.tools, self.tables.files, tool, cwd, since, limit, self.tables.sessions if self.kept else None)
        return fitted({"sessions": [r.asDict(True) for r in found.collect()]}, "sessions")

    def get_session(self, tool: str, session_id: str, redacted: bool = False, **window) -> dict:
        page, truncated, after = sessions.session_page(self.tables.events, self._tool(tool), session_id, **window)
        said = redact.redact(F.col("searchable_text")) if redacted else F.col("searchable_text")
        rows = [r.asDict(True) for r in page.select("raw_file", "raw_line", "raw_offset", "captured_at", "canonical_type", said.alias("text")).collect()]
        answer = fitted({"events": rows, "truncated": truncated}, "events")
        if len(answer["events"]) < len(rows) and answer["events"]:
            after = answer["events"][-1]["raw_line"]
        return answer | {"next_after_raw_line": after}

    def get_event(self, tool: str, session_id: str, raw_line: int | None = None, raw_offset: int | None = None, redacted: bool = False) -> dict:
        row = sessions.get_event(self.tables.events, self._tool(tool), session_id, raw_line, raw_offset).select("raw_file", "raw_line", "raw_offset", "canonical_type", "searchable_text", "payload").head()
        if row is None:
            raise NotFoundError("no event at this pointer")
        event = row.asDict(True)
        if redacted:
            event |= {"searchable_text": redact.redact_text(event["searchable_text"] or ""), "payload": redact.redact_line(event["payload"] or "")}
        return fitted({"events": [event]}, "events")

    def export_session(self, tool: str, session_id: str, form: str = "markdown", redacted: bool = True) -> str:
        """The whole session; JSONL keeps every line as it is but for secrets."""
        if form == "markdown":
            blocks = maintain.export_markdown(self.tables.events, self._tool(tool), session_id, redacted).toLocalIterator()
            return "\n".join([maintain.markdown_head(tool, session_id, redacted), *(r.value for r in blocks)])
        if form != "jsonl" or self.lines is None:
            raise ValidationError("form must be markdown, or jsonl where the raw lines are at hand")
        from .sources.raw import same_file, session_file

        file = session_file(self.tables.events, self._tool(tool), session_id)
        own = maintain.export_jsonl(self.lines, file, redacted)
        ended = self.lines.where(same_file(F.col("raw_file"), file)).agg(F.max_by("complete", "raw_line")).head()[0]
        out = "\n".join(r.value for r in own.toLocalIterator())
        return out + "\n" * bool(ended)

    def recall_answer(self, query: str, filters: search.Filters | None = None, limit: int = 5, before: int = 2, after: int = 2) -> dict:
        found = sessions.recall_answer(self.tables, query, filters, limit, before, after, MOST_BYTES)
        return fitted({"hits": [r.asDict(True) for r in found.collect()]}, "hits")

    def history_doctor(self, files: DataFrame | None = None, checkpoints: DataFrame | None = None, deep: bool = False, store_bytes: int = 0) -> dict:
        """Latest event of each tool; deep adds counts of every table, which a large store refuses."""
        if deep and store_bytes > DEEP_BYTES:
            raise ValidationError(f"a deep check reads the whole store; it has more than {DEEP_BYTES} bytes")
        out: dict = {"latest": [r.asDict() for r in sessions.latest_per_tool(self.tables.events).collect()]}
        if files is not None and checkpoints is not None:
            out["freshness"] = [r.asDict() for r in maintain.freshness(files, checkpoints).collect()]
        if deep:
            t = self.tables
            counted = maintain.table_counts({"events": t.events, "sessions": t.sessions, "event_files": t.files, "tool_events": t.tools, "event_refs": t.refs, "messages": derive.messages(t.events)})
            out["tables"] = {r.name: r.n for r in counted.collect()}
        return out
