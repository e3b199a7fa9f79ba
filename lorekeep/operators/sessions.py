"""Sessions: counts and bounds, triage lists, pages, context windows and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotFoundError, ValidationError
from ..functions import text, times
from . import search

TOP, PROMPT = 5, 200
SESSION = ["tool", "session_id"]


def counts(events: DataFrame) -> DataFrame:
    """Events, messages, tool events and compactions of each session."""
    is_message = F.col("canonical_type").isin("user.message", "assistant.delta", "assistant.message", "tool.result")
    return events.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(is_message).alias("message_count"),
        F.count_if(F.col("canonical_type").isin("tool.call", "tool.result")).alias("tool_event_count"),
        F.count_if(F.col("canonical_type").isin("compaction.before", "compaction.after")).alias("compaction_count"),
    )


def bounds(events: DataFrame) -> DataFrame:
    """First and last capture of each session, and the first root, folder and file that arrived."""
    arrival = F.struct("raw_file", "raw_line")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), arrival)).alias(c)
    return events.groupBy(*SESSION).agg(F.min("captured_at").alias("started_at"), F.max("captured_at").alias("updated_at"), first("project_root"), first("cwd"), first("raw_file"))


def first_prompts(events: DataFrame) -> DataFrame:
    """The first user message of each session by sequence (none last), then arrival; cut to PROMPT characters."""
    at = F.struct(F.col("sequence").isNull(), "sequence", "raw_file", "raw_line")
    return events.where("canonical_type = 'user.message'").groupBy(*SESSION).agg(F.min_by("user_text", at).alias("p")).select(*SESSION, text.ellipsis(F.col("p"), PROMPT).alias("first_user_prompt"))


def last_types(events: DataFrame) -> DataFrame:
    at = F.struct("captured_at", "raw_line", F.coalesce("raw_offset", F.lit(-1)))
    return events.groupBy(*SESSION).agg(F.max_by("canonical_type", at).alias("last_event_type"))


def partials(events: DataFrame) -> DataFrame:
    """Facts of each session in a batch of events, in a form that merges with those of other batches: counts, and extremes with where they stand."""
    kind = F.col("canonical_type")
    optional = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    arrival = [F.col("raw_file").alias("f"), F.col("raw_line").alias("l")]
    first = lambda c: F.min(F.when(optional(c).isNotNull(), F.struct(*arrival, optional(c).alias("v")))).alias(c)
    prompt = F.struct(F.col("sequence").isNull().alias("none"), F.col("sequence").alias("s"), *arrival, F.col("user_text").alias("v"))
    last = F.struct(F.col("captured_at").alias("t"), F.col("raw_line").alias("l"), F.coalesce("raw_offset", F.lit(-1)).alias("o"), kind.alias("v"))
    return events.groupBy(*SESSION).agg(
        F.min("filename_session_id").alias("filename_session_id"), F.count(F.lit(1)).alias("event_count"), F.count_if(kind.isin("user.message", "assistant.delta", "assistant.message", "tool.result")).alias("message_count"),
        F.count_if(kind.isin("tool.call", "tool.result")).alias("tool_event_count"), F.count_if(kind.isin("compaction.before", "compaction.after")).alias("compaction_count"),
        F.min("captured_at").alias("started_at"), F.max("captured_at").alias("updated_at"), first("project_root"), first("cwd"), first("raw_file"),
        F.min(F.when(kind == "user.message", prompt)).alias("prompt"), F.max(last).alias("last"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """Sessions from the facts of their batches."""
    sums = [F.sum(c).alias(c) for c in ("event_count", "message_count", "tool_event_count", "compaction_count")]
    least = [F.min(c).alias(c) for c in ("filename_session_id", "started_at", "project_root", "cwd", "raw_file", "prompt")]
    out = parts.groupBy(*SESSION).agg(*sums, *least, F.max("updated_at").alias("updated_at"), F.max("last").alias("last"))
    return out.select(
        *SESSION, "filename_session_id", "event_count", "message_count", "tool_event_count", "compaction_count", "started_at", "updated_at", F.col("project_root.v").alias("project_root"), F.col("cwd.v").alias("cwd"),
        F.col("raw_file.v").alias("raw_file"), text.ellipsis(F.col("prompt.v"), PROMPT).alias("first_user_prompt"), F.col("last.v").alias("last_event_type"),
    )


def latest_per_tool(events: DataFrame) -> DataFrame:
    at = F.struct("captured_at", "raw_file", "raw_line")
    return events.groupBy("tool").agg(F.max(F.struct(at.alias("at"), F.col("session_id"), F.col("canonical_type"))).alias("m")).select("tool", "m.session_id", "m.at.captured_at", "m.at.raw_line", "m.canonical_type")


def top_values(rows: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """(session, column, n): the k most frequent values of each session, ties by value. Counts come before the window, so it holds
    a row for each distinct value."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(*SESSION, column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*SESSION).orderBy(F.desc("n"), column)
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def listed(values: DataFrame, column: str, name: str) -> DataFrame:
    one = F.format_string("%s=%d", F.col(column), F.col("n"))
    return values.groupBy(*SESSION).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", one.alias("v")))), lambda x: x["v"]), ",").alias(name))


def triage(events: DataFrame, tools: DataFrame | None = None, files: DataFrame | None = None, tool: str | None = None, cwd: str | None = None, since: str | None = None, limit: int = 50, kept: DataFrame | None = None) -> DataFrame:
    """Sessions, latest first, with what one needs to tell them apart; one grouped pass for each fact instead of a query a session. kept: facts of
    sessions that a store keeps, so that events need not be read."""
    limit = search.bounded("sessions", limit)
    facts = ["event_count", "message_count", "tool_event_count", "compaction_count", "started_at", "updated_at", "project_root", "cwd", "raw_file"]
    out = counts(events).join(bounds(events), SESSION) if kept is None else kept.select(*SESSION, *facts, "first_user_prompt", "last_event_type")
    if tool and tool != "all":
        out = out.where(F.col("tool") == tool)
    if cwd:
        out = out.where(F.col("cwd") == cwd)
    if since:
        out = out.where(F.col("updated_at") >= times.threshold(since))
    out = out.orderBy(F.desc("updated_at"), *SESSION).limit(limit)
    for more in (first_prompts(events), last_types(events)) if kept is None else ():
        out = out.join(more, SESSION, "left")
    if kept is not None:  # a page of sessions meets the tables
        page = F.broadcast(out.select(*SESSION))
        tools, files = (x if x is None else x.join(page, SESSION, "left_semi") for x in (tools, files))
    if tools is not None:
        out = out.join(listed(top_values(tools, "tool_name"), "tool_name", "top_tools"), SESSION, "left")
    if files is not None:
        out = out.join(listed(top_values(files.where("relationship = 'edited'"), "path"), "path", "top_files"), SESSION, "left")
    return out.orderBy(F.desc("updated_at"), *SESSION)


def session_page(events: DataFrame, tool: str, session_id: str, limit: int = 100, after_raw_line: int | None = None, around_raw_line: int | None = None, before: int = 0, after: int = 0,
                 include_deltas: bool = False) -> tuple[DataFrame, bool, int | None]:
    """(rows, truncated, next_after_raw_line): a session's events in order of line. A window of lines around one wins over the cursor."""
    rows = events.where((F.col("tool") == tool) & (F.col("session_id") == session_id))
    if rows.isEmpty():
        raise NotFoundError(f"no session {session_id} of {tool}")
    if not include_deltas:
        rows = rows.where("canonical_type <> 'assistant.delta'")
    if around_raw_line is not None:
        before, after = search.bounded("context", before), search.bounded("context", after)
        rows = rows.where(F.col("raw_line").between(max(1, around_raw_line - before), around_raw_line + after))
        return rows.orderBy("raw_line", F.asc_nulls_first("raw_offset")), False, None
    limit = search.bounded("session_limit", limit)
    if after_raw_line is not None:
        rows = rows.where(F.col("raw_line") > after_raw_line)
    page = rows.orderBy("raw_line", F.asc_nulls_first("raw_offset")).limit(limit + 1)
    lines = [r.raw_line for r in page.select("raw_line").collect()]
    truncated = len(lines) > limit
    return page.limit(limit), truncated, lines[limit - 1] if truncated else None


def get_event(events: DataFrame, tool: str, session_id: str, raw_line: int | None = None, raw_offset: int | None = None) -> DataFrame:
    """The event at a line, an offset, or both."""
    if raw_line is None and raw_offset is None:
        raise ValidationError("raw_line or raw_offset is required")
    rows = events.where((F.col("tool") == tool) & (F.col("session_id") == session_id))
    if raw_line is not None:
        rows = rows.where(F.col("raw_line") == raw_line)
    if raw_offset is not None:
        rows = rows.where(F.col("raw_offset") == raw_offset)
    return rows.orderBy("raw_line", F.asc_nulls_first("raw_offset")).limit(1)


def merged_windows(hits: DataFrame, before: int, after: int) -> DataFrame:
    """(session, start_line, end_line): windows around hits, those that overlap or touch as one."""
    w = hits.select(*SESSION, F.greatest(F.col("raw_line") - before, F.lit(1)).alias("start"), (F.col("raw_line") + after).alias("end"))
    order = Window.partitionBy(*SESSION).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    w = w.withColumn("new", F.when(F.col("start") <= reached + 1, 0).otherwise(1))
    w = w.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return w.groupBy(*SESSION, "island").agg(F.min("start").alias("start_line"), F.max("end").alias("end_line")).drop("island")


def context(hits: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """(hit_rank, event columns): events in the hits' windows, each once, with its best-ranked hit. hits are a page, so they are
    broadcast and the band join keeps events where they lie."""
    h = hits.select(*SESSION, F.col("rank").alias("hit_rank"), F.col("raw_line").alias("hit_line"))
    near = events.where("canonical_type <> 'assistant.delta'").join(F.broadcast(h), SESSION).where(F.col("raw_line").between(F.greatest(F.col("hit_line") - before, F.lit(1)), F.col("hit_line") + after))
    w = Window.partitionBy(*SESSION, "raw_line").orderBy("hit_rank")
    return near.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def recall_answer(t: search.Tables, query: str, filters: search.Filters | None = None, limit: int = 5, before: int = 2, after: int = 2, max_bytes: int | None = None) -> DataFrame:
    """Hits with the lines around them: (rank, session, raw_line, score, snippet, context array). max_bytes keeps the best hits that fit."""
    page = search.search(t, query, filters, limit=min(limit, 10), max_snippet_chars=240)
    hits = page.rows.withColumn("rank", F.row_number().over(Window.orderBy(*search.order())))
    around = context(hits, t.events, before, after).groupBy("hit_rank").agg(F.array_sort(F.collect_list(F.struct("raw_line", "canonical_type", "searchable_text"))).alias("context"))
    out = hits.join(around, F.col("rank") == F.col("hit_rank"), "left").drop("hit_rank")
    if max_bytes is not None:
        size = F.octet_length(F.to_json(F.struct(*out.columns)))
        out = out.withColumn("__sum", F.sum(size).over(Window.orderBy("rank"))).where(F.col("__sum") <= max_bytes).drop("__sum")
    return out.orderBy("rank")
