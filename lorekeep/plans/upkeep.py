"""Queries of stores and their upkeep: logs written, scanned, indexed, purged and reported on, each in a folder of its own."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import paths
from ..operators import corroborate, derive, document, maintain, search, sessions, vector
from ..operators.store import Home
from ..sources import native, raw
from ..streaming import incremental, tailing
from . import payloads, views
from .queries import query

_TOOL = views.TOOL_SQL.format("event_id")
_K = views._K


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as the executors name it."""
    base = paths.shared_folder(spark)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as keyed envelopes: a session for each type, so few logs with many lines."""
    id_ = F.col("event_id").cast("string")
    return views.table(spark, sf_dir, "events").select(
        "event_id", F.lit(1).alias("schema_version"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("captured_at"), views._tool("event_id").alias("tool"), F.col("event_type").alias("session_id"),
        F.col("event_type").alias("filename_session_id"), F.lit("hook").alias("source"), F.lit("UserPromptSubmit").alias("source_event_type"), F.lit("user.message").alias("canonical_type"),
        F.concat(F.lit("sha256:"), F.sha2(id_, 256)).alias("dedupe_key"), F.col("event_id").alias("sequence"), F.concat(F.lit('{"prompt":"é '), id_, F.lit('"}')).alias("payload"),
    )


def home(spark: SparkSession, rows: DataFrame | None = None) -> Home:
    made = Home(spark, folder(spark, "home"))
    made.init()
    if rows is not None:
        made.append(rows)
    return made


def _by_session(events: DataFrame) -> DataFrame:
    return events.groupBy("tool", "session_id").agg(F.count(F.lit(1)).alias("events"), F.max("raw_line").alias("last_line"), F.min("captured_at").alias("first"), F.count_distinct("raw_offset").alias("offsets"))


def _by_session_sql(where: str = "TRUE") -> str:
    return f"SELECT {_TOOL} AS tool, event_type AS session_id, count(*) AS events, count(*) AS last_line, min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) AS first, count(*) AS offsets FROM events WHERE {where} GROUP BY ALL"


@query("raw_scan_pointers", """WITH l AS (SELECT event_type AS name, event_id, repeat('é', event_id % 9) || event_id AS line FROM events)
  SELECT event_id, row_number() OVER w AS raw_line, coalesce(sum(strlen(line) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS raw_offset, line FROM l WINDOW w AS (PARTITION BY name ORDER BY event_id)""")  # fmt: skip
def raw_scan_pointers(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_type", "event_id", F.concat(F.repeat(F.lit("é"), (F.col("event_id") % 9).cast("int")), F.col("event_id").cast("string")).alias("value"))
    path = folder(spark, "scan")
    rows.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(path)
    found = raw.lines(spark, f"{path}/*/*.txt")
    return found.select(F.regexp_extract("line", "([0-9]+)$", 1).cast("long").alias("event_id"), "raw_line", "raw_offset", "line")


@query("raw_line_at", f"SELECT event_id, event_type AS session_id, row_number() OVER (PARTITION BY {_TOOL}, event_type ORDER BY event_id) AS raw_line FROM events QUALIFY raw_line = 3 AND {_TOOL} = 'claude' AND event_type = 'click'")
def raw_line_at(spark, sf_dir):
    made = home(spark, envelopes(spark, sf_dir))
    found = raw.scan_home(spark, made.path)
    by_line = raw.line_at(found, "claude_click.jsonl", 3).select("raw_offset").head()
    row = raw.envelopes(raw.line_at(found, "claude_click.jsonl", 3, by_line.raw_offset))
    return row.select(F.col("sequence").alias("event_id"), "session_id", "raw_line")


@query("grouped_append", f"SELECT {_TOOL} || '_' || event_type || '.jsonl' AS name, count(*) AS lines, true AS new_only FROM events GROUP BY ALL")
def grouped_append(spark, sf_dir):
    """Half of the events, then all of them, of which only the rest is new."""
    rows = envelopes(spark, sf_dir)
    made = home(spark, rows.where("event_id % 2 = 0"))
    second = made.append(rows)
    odd = rows.where("event_id % 2 = 1").count()
    counted = raw.scan_home(spark, made.path).groupBy(F.regexp_extract("raw_file", "([^/]*)$", 1).alias("name")).agg(F.count(F.lit(1)).alias("lines"))
    return counted.withColumn("new_only", F.lit(second.agg(F.sum("lines")).head()[0] == odd))


@query("dedupe_keys_table", f"SELECT {_TOOL} || '_' || event_type || '.jsonl' AS name, count(*) AS keys FROM events GROUP BY ALL")
def dedupe_keys_table(spark, sf_dir):
    made = home(spark, envelopes(spark, sf_dir))
    return made.keys().groupBy(F.regexp_extract("raw_file", "([^/]*)$", 1).alias("name")).agg(F.count_distinct("dedupe_key").alias("keys"))


@query("index_once", _by_session_sql())
def index_once(spark, sf_dir):
    made = home(spark, envelopes(spark, sf_dir))
    incremental.index_once(spark, made.path, made.store)
    return _by_session(made.store.events())


@query("index_resume", "SELECT count(*) FILTER (WHERE event_id % 2 = 0) AS first_events, count(*) FILTER (WHERE event_id % 2 = 1) AS second_events, count(*) FILTER (WHERE event_id % 2 = 1) AS second_lines, 0 AS third_files, count(*) AS stored FROM events")
def index_resume(spark, sf_dir):
    """Passes over growing logs read what is new; a pass over unchanged ones opens none."""
    rows = envelopes(spark, sf_dir)
    made = home(spark, rows.where("event_id % 2 = 0"))
    first = incremental.index_once(spark, made.path, made.store)
    made.append(rows)
    second, third = (incremental.index_once(spark, made.path, made.store) for _ in range(2))
    return spark.createDataFrame([(first["events"], second["events"], second["lines"], third["files"], made.store.events().count())], "first_events long, second_events long, second_lines long, third_files int, stored long")


@query("watch_growing_logs", _by_session_sql())
def watch_growing_logs(spark, sf_dir):
    """A stream over logs that grow between its runs; the second run starts from what the first one left."""
    rows = envelopes(spark, sf_dir)
    made = home(spark, rows.where("event_id % 2 = 0"))
    checkpoint = folder(spark, "watch")
    tailing.watch(spark, made.path, made.store, checkpoint, once=True).awaitTermination()
    made.append(rows)
    tailing.watch(spark, made.path, made.store, checkpoint, once=True).awaitTermination()
    return _by_session(made.store.events())


@query("store_views", f"""SELECT {_TOOL} AS tool, event_type AS session_id, count(*) AS event_count, count(*) AS message_count, 0 AS tool_event_count, min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) AS started_at, max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) AS updated_at,
  'é ' || min(event_id) AS first_user_prompt, 'user.message' AS last_event_type FROM events WHERE NOT ({_TOOL} = 'codex' AND event_type = 'view') GROUP BY ALL""")  # fmt: skip
def store_views(spark, sf_dir):
    """Sessions as three passes over growing logs and a purge leave them, from what each pass derived of its own events."""
    rows = envelopes(spark, sf_dir)
    made = home(spark)
    for k in range(3):
        made.append(rows.where(F.col("event_id") % 3 == k))
        incremental.index_once(spark, made.path, made.store)
    made.purge("codex", "view")
    return made.store.view("sessions").select("tool", "session_id", "event_count", "message_count", "tool_event_count", "started_at", "updated_at", "first_user_prompt", "last_event_type")


@query("index_drain", "SELECT count(*) AS added FROM events")
def index_drain(spark, sf_dir):
    made = home(spark, envelopes(spark, sf_dir))
    return spark.createDataFrame([(incremental.drain(spark, made.path, made.store),)], "added long")


@query("purge_session_files", _by_session_sql(f"NOT ({_TOOL} = 'codex' AND event_type = 'view')"))
def purge_session_files(spark, sf_dir):
    made = home(spark, envelopes(spark, sf_dir))
    incremental.index_once(spark, made.path, made.store)
    made.purge("codex", "view")
    return _by_session(made.store.events())


@query("purge_before_files", f"SELECT {_TOOL} || '_' || event_type || '.jsonl' AS name, count(*) AS lines, count(*) AS events FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') >= '2024-01-02T00:00:00Z' GROUP BY ALL")
def purge_before_files(spark, sf_dir):
    made = home(spark, envelopes(spark, sf_dir))
    incremental.index_once(spark, made.path, made.store)
    made.purge(before="2024-01-02")
    name = F.regexp_extract("raw_file", "([^/]*)$", 1).alias("name")
    logs = raw.scan_home(spark, made.path).groupBy(name).agg(F.count(F.lit(1)).alias("lines"))
    return logs.join(made.store.events().groupBy(name).agg(F.count(F.lit(1)).alias("events")), "name", "left")


@query("purge_all_plan", "SELECT * FROM (VALUES ('raw', 'authoritative', 'would remove'), ('blobs', 'authoritative', 'would remove'), ('index', 'derived', 'would remove'), ('spool', 'derived', 'would remove'), ('logs', 'derived', 'would remove'), ('backups', 'derived', 'would remove'), ('models', 'model', 'kept'), ('config.json', 'config', 'would remove')) t(name, tier, action)")
def purge_all_plan(spark, sf_dir):
    made = home(spark)
    return spark.createDataFrame([(x["name"], x["tier"], x["action"]) for x in made.purge_all(True, ("model",))], "name string, tier string, action string")


@query("store_health", "SELECT * FROM (VALUES ('storage', true), ('structure', true), ('indexed', true), ('lines', true), ('keys', true)) t(name, ok)")
def store_health(spark, sf_dir):
    made = home(spark, envelopes(spark, sf_dir))
    incremental.index_once(spark, made.path, made.store)
    return spark.createDataFrame(list(made.health(True).items()), "name string, ok boolean")


@query("index_freshness", f"SELECT {_TOOL} AS tool, true AS all_indexed, 0 AS pending_files FROM events GROUP BY ALL")
def index_freshness(spark, sf_dir):
    made = home(spark, envelopes(spark, sf_dir))
    incremental.index_once(spark, made.path, made.store)
    own = made.store.checkpoints()
    fresh = maintain.freshness(own.select("tool", "source_path", F.col("source_size").alias("size")), own)
    return fresh.select("tool", (F.col("raw_bytes") == F.col("indexed_bytes")).alias("all_indexed"), "pending_files")


@query("checkpoint_upkeep", "SELECT event_type AS session_id, CASE event_type WHEN 'click' THEN 7 ELSE count(*) END AS byte_offset FROM events WHERE event_type <> 'view' GROUP BY event_type")
def checkpoint_upkeep(spark, sf_dir):
    store = incremental.Store(spark, folder(spark, "store"))
    rows = views.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("byte_offset"))
    null = {f.name: F.lit(None).cast(f.dataType) for f in store.checkpoints().schema}
    shaped = lambda r: r.select(*(c.alias(k) for k, c in (null | {"tool": F.lit("claude"), "source_path": F.concat(F.lit("/logs/"), F.col("event_type")), "session_id": F.col("event_type"), "byte_offset": F.col("byte_offset")}).items()))
    store.put(shaped(rows))
    store.put(shaped(rows.where("event_type = 'click'").withColumn("byte_offset", F.lit(7).cast("long"))))
    store.drop("claude", "/logs/view")
    return store.under("/logs").select("session_id", "byte_offset")


@query("discontinuities", "SELECT event_id, 'source.' || (CASE event_id % 3 WHEN 0 THEN 'truncated' ELSE 'rotated' END) || ':/raw/claude/' || event_id || ':9:4' AS source_event_id, 'source.discontinuity' AS canonical_type, 'claude' AS tool FROM events WHERE event_id % 3 < 2")
def discontinuities(spark, sf_dir):
    state = F.element_at(F.array(F.lit("truncated"), F.lit("rotated"), F.lit("grown")), (F.col("event_id") % 3 + 1).cast("int"))
    files = views.table(spark, sf_dir, "events").select(F.concat(F.lit("/raw/claude/"), F.col("event_id").cast("string")).alias("raw_file"), F.lit("s").alias("known_session"), F.lit(9).cast("long").alias("byte_offset"), F.lit(4).cast("long").alias("size"), state.alias("state"))
    out = incremental.discontinuities(files)
    return out.select(F.regexp_extract("raw_file", "([0-9]+)$", 1).cast("long").alias("event_id"), "source_event_id", "canonical_type", "tool")


@query("deleted_sources", "SELECT event_type AS source_path FROM events GROUP BY event_type HAVING event_type NOT IN ('click', 'error')")
def deleted_sources(spark, sf_dir):
    known = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("source_path")).distinct()
    return maintain.deleted_sources(known, known.where("source_path in ('click', 'error')"))


@query("follow_landed", f"SELECT DISTINCT 'user-' || user_id || ':' || (event_id % 5) AS said FROM events")
def follow_landed(spark, sf_dir):
    """A stream over landed files: repeated payloads are one event, whichever file brings them."""
    base = folder(spark, "landing")
    payload = F.concat(F.lit('{"hook_event_name":"UserPromptSubmit","session_id":"user-'), F.col("user_id").cast("string"), F.lit('","prompt":"user-'), F.col("user_id").cast("string"), F.lit(":"), (F.col("event_id") % 5).cast("string"), F.lit('"}'))
    views.table(spark, sf_dir, "events").select(F.lit("claude").alias("tool"), payload.alias("payload")).write.json(f"{base}/in")
    store = incremental.Store(spark, f"{base}/store")
    incremental.follow(spark, f"{base}/in", store, f"{base}/checkpoint").awaitTermination()
    return store.events().select(F.col("user_text").alias("said"))


# imports


@query("jsonl_records", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'parse_error' ELSE 'user' END AS type, event_id % 7 = 0 AS keeps_line FROM events WHERE event_id % 5 > 0")
def jsonl_records(spark, sf_dir):
    """Blank lines are nothing, lines that are no JSON are errors that keep them."""
    id_ = F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 5 == 0, "  ").when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"id":'), id_, F.lit(', broken'))).otherwise(F.concat(F.lit('{"type":"user","id":'), id_, F.lit("}")))
    path = folder(spark, "jsonl")
    views.table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    p = F.col("payload")
    found = native.jsonl_records(spark, "claude", f"{path}/*.txt")
    return found.select(F.regexp_extract("payload", '"id\\\\*":([0-9]+)', 1).cast("long").alias("event_id"), F.get_json_object(p, "$.type").alias("type"), F.get_json_object(p, "$.raw_line").isNotNull().alias("keeps_line"))


@query("json_records", """SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'outer' WHEN 2 THEN 'own' END AS session_id FROM events WHERE event_id % 4 < 3""")
def json_records(spark, sf_dir):
    """Whole files: lists, objects with messages that inherit a session, and scalars, which hold nothing."""
    n = F.col("event_id") % 4
    item = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.when(n == 2, F.lit(',"session_id":"own"')).otherwise(F.lit("")), F.lit(',"deep":{"a":[1]}}'))
    base = folder(spark, "json")
    grouped = views.table(spark, sf_dir, "events").groupBy((F.col("event_id") % 64).alias("g"), n.alias("n")).agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("items"))
    whole = F.when(F.col("n") == 0, F.concat(F.lit("["), F.col("items"), F.lit("]"))).when(F.col("n") == 3, F.lit("5")).otherwise(F.concat(F.lit('{"session_id":"outer","messages":['), F.col("items"), F.lit("]}")))
    grouped.select("g", "n", whole.alias("value")).repartition("g", "n").write.partitionBy("g", "n").text(base)
    found = native.json_records(spark, "claude", f"{base}/*/*/*.txt")
    p = F.col("payload")
    return found.select(F.get_json_object(p, "$.id").cast("long").alias("event_id"), F.get_json_object(p, "$.session_id").alias("session_id"))


@query("bench_events", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'codex' ELSE 'claude' END AS tool FROM events")
def bench_events(spark, sf_dir):
    path = folder(spark, "bench")
    tool = F.when(F.col("event_id") % 2 == 0, ',"tool":"codex"').otherwise("")
    views.table(spark, sf_dir, "events").select(F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), tool, F.lit("}")).alias("value")).write.text(path)
    return native.bench_events(spark, path).select(F.get_json_object("payload", "$.id").cast("long").alias("event_id"), "tool")


@query("ingest_codex_stream", "SELECT event_type AS session_id, 'exec_json' AS source, count(*) AS records FROM events GROUP BY ALL")
def ingest_codex_stream(spark, sf_dir):
    """One stream file of each type; records after the first have its thread's id."""
    base = folder(spark, "stream")
    w = Window.partitionBy("event_type").orderBy("event_id")
    rows = views.table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w))
    line = F.when(F.col("n") == 1, F.concat(F.lit('{"type":"thread.started","id":"'), F.col("event_type"), F.lit('"}'))).otherwise(F.concat(F.lit('{"type":"turn.completed","turn_id":"'), F.col("event_id").cast("string"), F.lit('"}')))
    rows.select("event_type", "n", line.alias("value")).repartition("event_type").sortWithinPartitions("event_type", "n").select("event_type", "value").write.partitionBy("event_type").text(base)
    return native.ingest_file(spark, "codex", f"{base}/*/*.txt", "exec_json").groupBy("session_id", "source").agg(F.count(F.lit(1)).alias("records"))


_PLAIN = f"event_id % {len(payloads.RECORDS)} <> 10"


def _planned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Imported records whose keys are their own, a third of them captured already."""
    rows = paths.staged(document.with_documents(native.named(payloads.records(spark, sf_dir).where(_PLAIN))), "planned")
    return rows, rows.where("event_id % 3 = 0")


_PLANNED = f"""{payloads._RECORDED}, r AS (SELECT event_id, path AS source_path, tool, {payloads._RECORD_SESSION} AS session_id FROM e WHERE {_PLAIN}),
  d AS (SELECT source_path, tool, session_id, count(*) AS on_disk, count(*) FILTER (WHERE event_id % 3 = 0) AS captured FROM r GROUP BY ALL),
  p AS (SELECT *, on_disk - captured AS missing, captured > 0 AND on_disk > captured AS partial FROM d)"""


@query("backfill_dry_run", f"{_PLANNED} SELECT * FROM p")
def backfill_dry_run(spark, sf_dir):
    return native.dry_run(*_planned(spark, sf_dir))[0]


@query("backfill_preview", f"{_PLANNED} SELECT source_path, session_id, count(*) AS n FROM r WHERE event_id % 3 > 0 GROUP BY ALL")
def backfill_preview(spark, sf_dir):
    return native.dry_run(*_planned(spark, sf_dir))[1].groupBy("source_path", "session_id").agg(F.count(F.lit(1)).alias("n"))


@query("backfill_report_merge", f"{_PLANNED} SELECT sum(on_disk)::BIGINT AS on_disk, sum(captured)::BIGINT AS captured, sum(missing)::BIGINT AS missing, count(DISTINCT source_path) AS files, count(DISTINCT (tool, session_id)) AS sessions, count(*) FILTER (WHERE partial) AS partial FROM p")
def backfill_report_merge(spark, sf_dir):
    return native.merged(native.dry_run(*_planned(spark, sf_dir))[0])


# derived tables


@query("spill_payloads", "SELECT event_id, CASE WHEN strlen(props) > 9 THEN 'sha256:' || sha256(props) END AS payload_ref, CASE WHEN strlen(props) <= 9 THEN props END AS payload FROM events")
def spill_payloads(spark, sf_dir):
    return derive.spilled(views.events(spark, sf_dir), 9)[0].select("event_id", "payload_ref", "payload")


@query("resolve_payloads", "SELECT event_id, props AS payload FROM events")
def resolve_payloads(spark, sf_dir):
    kept, blobs = derive.spilled(views.events(spark, sf_dir), 9)
    return derive.resolved(kept, blobs).select("event_id", "payload")


_UNITS = f"WITH {views.CONVERSATIONS}, u AS (SELECT dedupe_key, trim(searchable_text) AS t FROM ev WHERE trim(searchable_text) <> '')"


@query("units_pending", f"{_UNITS} SELECT DISTINCT sha256(t) AS text_hash FROM u WHERE sha256(t) >= '8'")
def units_pending(spark, sf_dir):
    units = vector.embedding_units(views.conversations(spark, sf_dir))
    return vector.pending(units, units.where("text_hash < '8'")).select("text_hash")


@query("units_missing", f"{_UNITS} SELECT dedupe_key, sha256(t) AS text_hash FROM u WHERE dedupe_key NOT IN (SELECT dedupe_key FROM ev WHERE raw_line % 2 = 0)")
def units_missing(spark, sf_dir):
    rows = views.conversations(spark, sf_dir)
    return derive.missing_units(rows, vector.embedding_units(rows.where("raw_line % 2 = 0"))).select("dedupe_key", "text_hash")


@query("units_orphaned", f"{_UNITS} SELECT DISTINCT sha256(t) AS text_hash FROM u WHERE sha256(t) NOT IN (SELECT sha256(trim(searchable_text)) FROM ev WHERE raw_line % 2 = 0)")
def units_orphaned(spark, sf_dir):
    rows = views.conversations(spark, sf_dir)
    units = vector.embedding_units(rows)
    left = vector.embedding_units(maintain.surviving(rows, rows.where("raw_line % 2 = 0"), "dedupe_key"))
    return maintain.orphans(units.select("text_hash").distinct(), left, "text_hash")


@query("embed_units", f"{_UNITS} SELECT count(DISTINCT t) AS embedded, 0 AS again, count(DISTINCT t) AS stored FROM u")
def embed_units(spark, sf_dir):
    """All units embedded in chunks, once."""
    units, path = vector.embedding_units(views.conversations(spark, sf_dir)), folder(spark, "vectors")
    first, again = (vector.embed_pending(units, path, vector.HashingEmbedder(32), 2000) for _ in range(2))
    return spark.createDataFrame([(first, again, spark.read.parquet(path).select("text_hash").distinct().count())], "embedded long, again int, stored long")


@query("vector_normalized", "WITH v AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) + 0 AS first, round(e[32] / sqrt(list_dot_product(e, e)), 6) + 0 AS last FROM v")
def vector_normalized(spark, sf_dir):
    v = vector.normalized(F.col("embedding"), 32)
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", (F.round(F.col("v")[0], 6) + 0.0).alias("first"), (F.round(F.col("v")[31], 6) + 0.0).alias("last"))


@query("sessions_without_events", "SELECT DISTINCT 'user-' || user_id AS session_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def sessions_without_events(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    return maintain.orphans(rows.select("session_id").distinct(), rows.where("canonical_type = 'file.changed'"), "session_id")


@query("table_counts", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations")
def table_counts(spark, sf_dir):
    return maintain.table_counts({n: views.table(spark, sf_dir, n) for n in ("events", "documents", "conversations")})


@query("coverage_totals", f"WITH {views.EVENTS}, c AS (SELECT tool, session_id, count(*) AS a, count(*) FILTER (WHERE value > 10) AS b FROM ev GROUP BY ALL) SELECT sum(a)::BIGINT AS on_disk, sum(b)::BIGINT AS captured, sum(a - b)::BIGINT AS missing, count(*) FILTER (WHERE b > 0 AND a > b) AS partial_sessions, count(*) AS sessions FROM c")
def coverage_totals(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    return maintain.totals(maintain.coverage(rows, rows.where("value > 10")))


# search and sessions


@query("search_filter_cwd", f"WITH {views.EVENTS} SELECT event_id FROM ev WHERE cwd = '/work/2'")
def search_filter_cwd(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    return search.apply_filters(rows, search.Filters(cwd="/work/2"), search.Tables(rows)).select("event_id")


def _with_deltas(rows: DataFrame) -> DataFrame:
    return rows.withColumn("canonical_type", F.when(F.col("canonical_type") == "tool.result", "assistant.delta").otherwise(F.col("canonical_type")))


@query("search_filter_deltas", f"WITH {views.EVENTS} SELECT event_id, canonical_type <> 'tool.result' AS without_deltas FROM ev")
def search_filter_deltas(spark, sf_dir):
    rows = _with_deltas(views.events(spark, sf_dir))
    kept = search.apply_filters(rows, search.Filters(), search.Tables(rows)).select("event_id", F.lit(True).alias("kept"))
    every = search.apply_filters(rows, search.Filters(include_deltas=True), search.Tables(rows)).select("event_id")
    return every.join(kept, "event_id", "left").select("event_id", F.coalesce("kept", F.lit(False)).alias("without_deltas"))


@query("session_page_without_deltas", f"WITH {views.EVENTS} SELECT event_id, raw_line FROM ev WHERE tool = 'claude' AND session_id = 'user-100' AND canonical_type <> 'tool.result' ORDER BY raw_line LIMIT 500")
def session_page_without_deltas(spark, sf_dir):
    return sessions.session_page(_with_deltas(views.events(spark, sf_dir)), "claude", "user-100", limit=500)[0].select("event_id", "raw_line")


@query("event_pointer", f"WITH {views.EVENTS} SELECT event_id, raw_line FROM ev WHERE tool = 'claude' AND session_id = 'user-100' AND raw_line = 3")
def event_pointer(spark, sf_dir):
    return sessions.get_event(views.events(spark, sf_dir), "claude", "user-100", 3).select("event_id", "raw_line")


@query("search_hydrate", f"WITH {views.EVENTS} SELECT dedupe_key, payload FROM ev WHERE event_id < 20")
def search_hydrate(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    return search.hydrate(rows.where("event_id < 20").select("dedupe_key"), rows).select("dedupe_key", "payload")


@query("corroboration_claims", f"""WITH {views.documents_sql(True)}, c AS (SELECT doc_id, 'pr' AS kind, '#' || unnest(regexp_extract_all(searchable_text, '(?i)\\b(?:PR\\s*)?#([0-9]{{1,8}})\\b', 1)) AS reference FROM ev
  UNION SELECT doc_id, 'pr', '#' || unnest(regexp_extract_all(searchable_text, '(?i)\\bpull/([0-9]{{1,8}})\\b', 1)) FROM ev
  UNION SELECT doc_id, 'commit', unnest(regexp_extract_all(searchable_text, '(?i)(?:^|[^0-9a-f])([0-9a-f]{{7,40}})(?:[^0-9a-f]|$)', 1)) FROM ev) SELECT DISTINCT * FROM c""")  # fmt: skip
def corroboration_claims(spark, sf_dir):
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [list(c) for c in corroborate.claims(t) if c[0] in ("pr", "commit")])

    rows = views.documents(spark, sf_dir, True).select("doc_id", F.explode(found("searchable_text")).alias("c"))
    return rows.select("doc_id", F.col("c")[0].alias("kind"), F.col("c")[1].alias("reference"))
