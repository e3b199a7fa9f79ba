"""Native transcripts, streams and server payloads as records ready for canonicalization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.pointers import at, parsed, raw_at, text_at
from ..functions.text import is_uuid
from ..operators import canonical
from .raw import lines

_RECORD = ["tool", "source_path", "byte_offset", "payload"]


def candidate(tool: str, path: "F.Column") -> "F.Column":
    """Whether a file of a tool's folder holds events."""
    stem = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)
    if tool == "claude":
        return path.endswith(".jsonl") & (is_uuid(stem) | (stem == "transcript") | stem.startswith("agent-"))
    return path.rlike(r"\.jsonl?$")


def storage_kind(path: "F.Column") -> "F.Column":
    """message, part or session from .../storage/<kind>/..."""
    return F.nullif(F.regexp_extract(path, "/storage/(message|part|session)/", 1), F.lit(""))


def files(spark: SparkSession, tool: str, root: str, since: str | None = None) -> DataFrame:
    """(source_path, size, modified) of the candidates under root, changed after since if given; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if since:
        reader = reader.option("modifiedAfter", since)
    found = reader.load(root).select(F.col("path").alias("source_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.where(candidate(tool, F.col("source_path")))


def jsonl_records(spark: SparkSession, tool: str, *paths: str) -> DataFrame:
    """A record for each line that is not blank; a line that is no JSON becomes an error record that keeps it."""
    found = lines(spark, *paths).where(F.trim("line") != "")
    bad = F.to_json(
        F.struct(F.lit("parse_error").alias("type"), F.col("raw_file").alias("source_path"), F.col("raw_offset").alias("byte_offset"), F.lit("malformed JSON").alias("parse_error"), F.col("line").alias("raw_line"))
    )
    payload = F.when(F.try_parse_json("line").isNull(), bad).otherwise(F.col("line"))
    return found.select(F.lit(tool).alias("tool"), F.col("raw_file").alias("source_path"), F.col("raw_offset").alias("byte_offset"), payload.alias("payload"))


def _elements(value: "F.Column") -> "F.Column":
    return F.from_json(value, "array<string>")


def json_records(spark: SparkSession, tool: str, *paths: str) -> DataFrame:
    """Whole-file JSON: a list gives its items, an object with messages these (with its session id where they have none), another
    object itself, a scalar nothing."""
    rows = _items(spark, ("messages",), *paths)
    own, outer = raw_at(F.col("payload"), "session_id"), F.col("outer")
    lacks = F.col("nested") & own.isNull() & outer.isNotNull() & F.col("payload").startswith("{")
    return rows.select(F.lit(tool).alias("tool"), "source_path", F.col("byte_offset").cast("long"), F.when(lacks, _with_session(F.col("payload"), outer)).otherwise(F.col("payload")).alias("payload"), F.when(lacks, outer).alias("outer_session"))


def _with_session(payload: "F.Column", session: "F.Column") -> "F.Column":
    """An object's JSON text with a session id put before its other members."""
    quoted = F.regexp_extract(F.to_json(F.struct(session.alias("s"))), r"(?s)^\{\"s\":(.*)\}$", 1)
    rest = F.regexp_replace(payload, r"^\s*\{\s*", "")
    return F.concat(F.lit('{"session_id":'), quoted, F.when(rest.startswith("}"), F.lit("")).otherwise(F.lit(",")), rest)


def _items(spark: SparkSession, boxes: tuple[str, ...], *paths: str) -> DataFrame:
    """(source_path, outer: the file's own session id, nested, byte_offset: place, payload) of whole JSON files: a list gives its items, an
    object those of the first box that holds a list, another object itself, a scalar nothing. An item does not carry its file's text."""
    whole = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.trim("value").alias("value"))
    box = F.coalesce(*(F.when(raw_at(F.col("value"), b).startswith("["), raw_at(F.col("value"), b)) for b in boxes))
    whole = whole.withColumn("box", F.when(F.col("value").startswith("{"), box))
    items = F.when(F.col("value").startswith("["), _elements(F.col("value"))).when(F.col("box").isNotNull(), _elements(F.col("box"))).when(F.col("value").startswith("{"), F.array("value")).otherwise(F.array().cast("array<string>"))
    whole = whole.select("source_path", raw_at(F.col("value"), "session_id").alias("outer"), F.col("box").isNotNull().alias("nested"), items.alias("items"))
    return whole.select("source_path", "outer", "nested", F.posexplode("items").alias("byte_offset", "payload"))


def path_session_id(path: "F.Column") -> "F.Column":
    """A UUID at the end of the file's stem, else the stem, else a hash of the path."""
    stem = F.trim(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))
    tail = F.substring(stem, -36, 36)
    return F.when(is_uuid(tail), tail).when(stem != "", stem).otherwise(F.concat(F.lit("source-"), F.substring(F.sha2(path, 256), 1, 16)))


def named(records: DataFrame, worktrees: DataFrame | None = None) -> DataFrame:
    """records with session_id and source_event_type. worktrees (session_id, worktree) fill root and folder where payloads lack them."""
    records = records.withColumn(canonical.PARSED, parsed(F.col("payload")))
    p, tool, path = F.col(canonical.PARSED), F.col("tool"), F.col("source_path")
    kind = storage_kind(path)
    meta = F.when((tool == "codex") & (at(p, "type") == "session_meta"), text_at(p, "payload.id"))
    stored = F.when((tool == "opencode") & (kind == "session"), text_at(p, *canonical.STORAGE_SESSION_PATHS))
    outer = [F.col("outer_session")] if "outer_session" in records.columns else []
    session = F.coalesce(stored, text_at(p, *canonical.SESSION_PATHS), *outer, meta, path_session_id(path))
    part = text_at(p, *canonical.PART_TYPE_PATHS)
    part_name = F.when(part.isin("tool", "tool-call"), "tool.execute.before").when(part.isin("tool-result", "tool_result"), "tool.execute.after").otherwise(F.coalesce(part, F.lit("message.part.updated")))
    fallback = (
        F.when(tool == "claude", F.concat(F.lit("claude."), F.coalesce(text_at(p, "type"), F.lit("unknown"))))
        .when(tool == "codex", F.coalesce(text_at(p, "type"), F.lit("codex.unknown")))
        .otherwise(F.when(kind == "session", "session.created").when(kind == "part", part_name).otherwise("message.updated"))
    )
    rows = records.withColumn("session_id", session).withColumn("source_event_type", F.coalesce(canonical.event_name(p), fallback))
    out = canonical.from_records(rows)
    if worktrees is not None:
        trees = worktrees.dropDuplicates(["session_id"])
        out = out.join(trees, "session_id", "left").withColumn("project_root", F.coalesce("project_root", "worktree")).withColumn("cwd", F.coalesce("cwd", "project_root")).drop("worktree")
    return out


def opencode_worktrees(records: DataFrame) -> DataFrame:
    """(session_id, worktree) from session files; the first file of a session counts."""
    p = F.col(canonical.PARSED)
    rows = records.where(storage_kind(F.col("source_path")) == "session").withColumn(canonical.PARSED, parsed(F.col("payload")))
    found = rows.select(F.coalesce(text_at(p, *canonical.STORAGE_SESSION_PATHS), text_at(p, "id")).alias("session_id"), text_at(p, *canonical.WORKTREE_PATHS).alias("worktree"), "source_path")
    return found.where("worktree is not null").groupBy("session_id").agg(F.min_by("worktree", "source_path").alias("worktree"))


def codex_stream(spark: SparkSession, source: str, *paths: str) -> DataFrame:
    """Envelopes of an exec or app-server stream: JSONL, or a JSON list, or an object with events or notifications. A record without a
    session id has that of the record before it."""
    whole = [p for p in paths if p.endswith(".json")]
    lined = [p for p in paths if not p.endswith(".json")]
    tables = ([jsonl_records(spark, "codex", *lined)] if lined else []) + (
        [_items(spark, ("events", "notifications"), *whole).select(F.lit("codex").alias("tool"), "source_path", F.col("byte_offset").cast("long"), "payload")] if whole else []
    )
    records = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    return codex_records(records, source)


#: Bytes of a stream file in which a session id is carried forward by one task.
SPAN = 64 << 20


def carried(records: DataFrame, own: str, span: int = SPAN) -> DataFrame:
    """records (source_path, byte_offset, ..) with `carried`: the last `own` that is not null at or before each record of its file.

    A segmented scan: each range of `span` bytes gives its last id, a pass over these, one row a range, gives what each range begins with,
    and ids are filled in within ranges. So a file of any size is dealt over tasks by its ranges.
    """
    rows = records.withColumn("__range", F.floor(F.col("byte_offset") / span))
    place = F.when(F.col(own).isNotNull(), F.col("byte_offset"))
    ends = rows.groupBy("source_path", "__range").agg(F.max_by(own, place).alias("__end"))
    before = Window.partitionBy("source_path").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select("source_path", "__range", F.last("__end", True).over(before).alias("__begin"))
    within = Window.partitionBy("source_path", "__range").orderBy("byte_offset").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.join(begins, ["source_path", "__range"])
    return filled.withColumn("carried", F.coalesce(F.last(own, True).over(within), F.col("__begin"))).drop("__range", "__begin")


def codex_records(records: DataFrame, source: str, span: int = SPAN) -> DataFrame:
    """Envelopes of stream records (tool, source_path, byte_offset, payload)."""
    p = F.col(canonical.PARSED)
    name = F.coalesce(text_at(p, *canonical.STREAM_NAME_PATHS), F.lit("codex.unknown"))
    own = F.coalesce(text_at(p, *canonical.STREAM_SESSION_PATHS), F.when(F.col("source_event_type").isin("thread.started", "thread/started"), text_at(p, "id", "params.id")))
    rows = records.withColumn(canonical.PARSED, parsed(F.col("payload"))).withColumn("source_event_type", name).withColumn("own", own).drop(canonical.PARSED)
    rows = carried(rows, "own", span)
    return canonical.from_records(rows.withColumn("session_id", F.coalesce("carried", path_session_id(F.col("source_path")))).drop("own", "carried"), source)


def opencode_server(payloads: DataFrame, fallback_session: str) -> DataFrame:
    """Envelopes of server answers (payload): a row for a message that has text of its own or no parts, and one for each part."""
    p, v = F.col("payload"), F.col(canonical.PARSED)
    box = F.coalesce(*(raw_at(p, x) for x in ("messages", "data", "result")))
    inner = F.when(box.startswith("{"), raw_at(box, "messages")).otherwise(box)
    items = F.when(F.trim(p).startswith("["), _elements(p)).when(inner.startswith("["), _elements(inner)).otherwise(F.array(p))
    messages = payloads.select(F.posexplode(items).alias("i", "payload")).withColumn(canonical.PARSED, parsed(p))
    parts = F.coalesce(*(F.when(raw_at(p, x).startswith("["), _elements(raw_at(p, x))) for x in ("parts", "message.parts", "payload.parts")), F.array().cast("array<string>"))
    has_text = text_at(v, "text", "content", "message", "summary").isNotNull()
    session = F.coalesce(text_at(v, "session_id", "sessionID", "sessionId", "message.sessionID", "payload.session_id"), F.lit(fallback_session))
    messages = messages.withColumn("session_id", session).withColumn("parts", parts).withColumn("whole", has_text | (F.size("parts") == 0))
    whole = messages.where("whole").select("session_id", F.col("i").cast("long").alias("byte_offset"), "payload", F.lit("message.updated").alias("source_event_type"))
    each = messages.select("session_id", F.posexplode("parts").alias("byte_offset", "payload")).withColumn(canonical.PARSED, parsed(p))
    each = each.withColumn("source_event_type", F.coalesce(text_at(v, *canonical.PART_TYPE_PATHS), F.lit("message.part.updated"))).drop(canonical.PARSED)
    rows = whole.unionByName(each.withColumn("byte_offset", F.col("byte_offset").cast("long")))
    return canonical.from_records(rows.withColumn("tool", F.lit("opencode")))


def bench_events(spark: SparkSession, path: str) -> DataFrame:
    """(tool, payload) of a file of hook payloads; the tool is claude where none is named."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.coalesce(raw_at(F.col("value"), "tool"), F.lit("claude")).alias("tool"), F.col("value").alias("payload"))


# What a file's source may be called, and the folders below the user's home that each tool's transcripts lie in.
FILE_SOURCES = ("exec_json", "app_server", "transcript_tail", "event_stream", "sdk_session_store", "backfill", "hook")
STREAM_SOURCES = ("exec_json", "app_server")
NATIVE_ROOTS = {"codex": (".codex/sessions", ".codex/archived_sessions"), "claude": (".claude/projects",), "opencode": (".local/share/opencode",)}


def ingest_file(spark: SparkSession, tool: str, path: str, source: str = "backfill") -> DataFrame:
    """Envelopes of one file. Stream sources are Codex's alone; others are read by the file's ending."""
    if source not in FILE_SOURCES:
        raise ValidationError(f"unknown source: {source}")
    if source in STREAM_SOURCES:
        if tool != "codex":
            raise ValidationError(f"{source} is a source of codex only")
        return codex_stream(spark, source, path)
    records = json_records(spark, tool, path) if path.endswith(".json") else jsonl_records(spark, tool, path)
    return named(records).withColumn("source", F.lit(source))


def source_kind(tool: "F.Column", path: "F.Column") -> "F.Column":
    """What a source file is: a transcript, or of opencode an export of its server, else a raw log."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    export = name.contains("server") | name.contains("api")
    return F.when(tool != "opencode", "transcript").when(export, "api_export").otherwise("raw_jsonl")


def native_records(spark: SparkSession, home: str, tools: tuple[str, ...] = ("claude", "codex", "opencode"), since: str | None = None) -> DataFrame | None:
    """Envelopes of every tool's transcripts below a user's home; folders that are not there are passed over, None if there are none."""
    jvm = spark._jvm.org.apache.hadoop.fs
    out = None
    for tool in tools:
        there = [f"{home}/{r}" for r in NATIVE_ROOTS[tool] if jvm.Path(f"{home}/{r}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(f"{home}/{r}"))]
        for root in there:
            found = [r.source_path for r in files(spark, tool, root, since).select("source_path").collect()]  # a listing, as the reader makes one
            lined, whole = ([f for f in found if f.endswith(e)] for e in (".jsonl", ".json"))
            parts = ([jsonl_records(spark, tool, *lined)] if lined else []) + ([json_records(spark, tool, *whole)] if whole else [])
            for records in parts:
                trees = opencode_worktrees(records) if tool == "opencode" else None
                rows = named(records, trees)
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def dry_run(records: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an import of keyed envelopes would do: for each file and session its records on disk, captured and missing and whether it is
    captured in part; and the records that would be imported."""
    known = stored.select("dedupe_key").distinct().withColumn("__there", F.lit(True))
    joined = records.join(known, "dedupe_key", "left").withColumn("__there", F.coalesce("__there", F.lit(False)))
    counted = joined.groupBy("source_path", "tool", "session_id").agg(F.count(F.lit(1)).alias("on_disk"), F.count_if("__there").alias("captured"))
    report = counted.withColumn("missing", F.col("on_disk") - F.col("captured")).withColumn("partial", (F.col("captured") > 0) & (F.col("missing") > 0))
    preview = joined.where("not __there").select("source_path", "session_id", "canonical_type", "source_event_type", "source_event_id", "sequence", "captured_at")
    return report, preview


def merged(reports: DataFrame) -> DataFrame:
    """One row for all files and sessions of dry_run() reports: sums, files, sessions and how many are captured in part."""
    sums = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("on_disk", "captured", "missing"))
    return reports.agg(*sums, F.count_distinct("source_path").alias("files"), F.count_distinct("tool", "session_id").alias("sessions"), F.count_if("partial").alias("partial"))
