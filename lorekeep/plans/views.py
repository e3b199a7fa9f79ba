"""The driver tables seen through the event model, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import TEXT_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tool(col: str) -> "F.Column":
    return F.element_at(F.array(F.lit("codex"), F.lit("claude"), F.lit("opencode")), (F.col(col) % 3 + 1).cast("int"))


TOOL_SQL = "CASE {0} % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' ELSE 'opencode' END"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events: what a role says lies in its own text column."""
    t = table(spark, sf_dir, "conversations")
    role = F.col("role")
    return t.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session_id"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("filename_session_id"),
        _tool("conv_id").alias("tool"),
        (F.col("turn") + 1).alias("raw_line"),
        F.lit(None).cast("long").alias("raw_offset"),
        F.lit("conversations").alias("raw_file"),
        F.when(role == "user", "user.message").when(role == "assistant", "assistant.message").otherwise("session.started").alias("canonical_type"),
        F.format_string("2024-01-%02dT%02d:%02d:00Z", 1 + F.col("conv_id") % 28, F.col("turn") % 24, F.col("conv_id") % 60).alias("captured_at"),
        F.when(role == "user", F.col("text")).alias("user_text"),
        F.when(role == "assistant", F.col("text")).alias("assistant_text"),
        F.lit(None).cast("string").alias("tool_intent"),
        F.lit(None).cast("string").alias("tool_output"),
        F.when(~role.isin("user", "assistant"), F.col("text")).alias("metadata_text"),
        F.col("text").alias("searchable_text"),
        F.col("turn").alias("sequence"),
        F.lit(None).cast("string").alias("cwd"),
        F.lit(None).cast("string").alias("project_root"),
        F.concat_ws(":", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("dedupe_key"),
    )


CONVERSATIONS = f"""ev AS (SELECT 'conv-' || conv_id AS session_id, {TOOL_SQL.format('conv_id')} AS tool, turn + 1 AS raw_line,
  CASE role WHEN 'user' THEN 'user.message' WHEN 'assistant' THEN 'assistant.message' ELSE 'session.started' END AS canonical_type,
  printf('2024-01-%02dT%02d:%02d:00Z', 1 + conv_id % 28, turn % 24, conv_id % 60) AS captured_at,
  CASE WHEN role = 'user' THEN text END AS user_text, CASE WHEN role = 'assistant' THEN text END AS assistant_text,
  CASE WHEN role NOT IN ('user', 'assistant') THEN text END AS metadata_text, text AS searchable_text, turn AS sequence,
  'conv:' || conv_id || ':' || turn AS dedupe_key FROM conversations)"""

#: What is added to documents so that references, secrets and concepts occur; the same text on both sides.
DECORATED = (
    "concat(coalesce(text, ''), ' see #', cast(doc_id as string), ' commit ', substr(sha256(coalesce(text, '')), 1, 10), ' Bearer ', sha256(coalesce(text, '')),"
    " case when doc_id % 5 = 0 then ' login error' when doc_id % 5 = 1 then ' failure' when doc_id % 5 = 2 then ' signin' else '' end)"
)


def documents(spark: SparkSession, sf_dir: str, decorated: bool = False) -> DataFrame:
    """Documents as events of one session for each language, their text in the metadata column."""
    t = table(spark, sf_dir, "documents")
    said = F.expr(DECORATED.replace("sha256(coalesce(text, ''))", "sha2(coalesce(text, ''), 256)")) if decorated else F.col("text")
    empty = [F.lit(None).cast("string").alias(c) for c in TEXT_COLUMNS if c != "metadata_text"]
    return t.select(
        "doc_id", F.col("lang").alias("session_id"), F.col("lang").alias("filename_session_id"), _tool("doc_id").alias("tool"), (F.col("doc_id") + 1).alias("raw_line"), F.lit("documents").alias("raw_file"),
        F.lit("file.changed").alias("canonical_type"), F.format_string("2024-%02d-%02dT00:00:00Z", 1 + F.col("doc_id") % 12, 1 + F.col("doc_id") % 28).alias("captured_at"), *empty,
        said.alias("metadata_text"), said.alias("searchable_text"), F.col("doc_id").cast("string").alias("dedupe_key"),
    )


def documents_sql(decorated: bool = False) -> str:
    said = DECORATED if decorated else "text"
    return f"""ev AS (SELECT doc_id, lang AS session_id, {TOOL_SQL.format('doc_id')} AS tool, doc_id + 1 AS raw_line, 'file.changed' AS canonical_type,
  printf('2024-%02d-%02dT00:00:00Z', 1 + doc_id % 12, 1 + doc_id % 28) AS captured_at, {said} AS metadata_text, {said} AS searchable_text,
  cast(doc_id AS VARCHAR) AS dedupe_key FROM documents)"""


EVENT_TYPES = {"click": "tool.call", "view": "tool.result", "purchase": "file.changed", "signup": "session.started", "error": "error"}
_K = "cast(json_extract_string(props, '$.k') AS BIGINT)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as sessions of users; lines count in order of time."""
    t = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    name = F.lit(None).cast("string")
    for a, b in EVENT_TYPES.items():
        name = F.when(kind == a, b).otherwise(name)
    k = F.get_json_object("props", "$.k").cast("long")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tooled = kind.isin("click", "view")
    return t.select(
        "event_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("session_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("filename_session_id"), _tool("user_id").alias("tool"),
        F.row_number().over(w).cast("long").alias("raw_line"), F.lit(None).cast("long").alias("raw_offset"), F.lit("events").alias("raw_file"), name.alias("canonical_type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("captured_at"), F.col("props").alias("payload"), "value", k.alias("k"),
        F.when(tooled, F.concat(F.lit("tool-"), (k % 10).cast("string"))).alias("tool_name"), F.when(kind == "click", F.concat(F.lit("Run --k="), k.cast("string"))).alias("command"),
        F.when(kind == "purchase", F.concat(F.lit("/data/part_"), (k % 7).cast("string"), F.lit(".csv"))).alias("path"), F.lit("edited").alias("relationship"),
        F.lit(None).cast("string").alias("project_root"), F.when(k % 2 == 0, F.concat(F.lit("/work/"), (k % 4).cast("string"))).alias("cwd"),
        F.lit(None).cast("string").alias("user_text"), F.lit(None).cast("long").alias("sequence"), F.col("event_id").cast("string").alias("dedupe_key"),
    )


EVENTS = f"""ev AS (SELECT event_id, 'user-' || user_id AS session_id, {TOOL_SQL.format('user_id')} AS tool, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS raw_line,
  CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_TYPES.items())} END AS canonical_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS captured_at, props AS payload, value, {_K} AS k,
  CASE WHEN event_type IN ('click', 'view') THEN 'tool-' || ({_K} % 10) END AS tool_name, CASE WHEN event_type = 'click' THEN 'Run --k=' || {_K} END AS command,
  CASE WHEN event_type = 'purchase' THEN '/data/part_' || ({_K} % 7) || '.csv' END AS path, CASE WHEN {_K} % 2 = 0 THEN '/work/' || ({_K} % 4) END AS cwd,
  cast(event_id AS VARCHAR) AS dedupe_key FROM events)"""
