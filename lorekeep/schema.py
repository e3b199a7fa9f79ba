"""The event model: envelope and table schemas, closed value sets, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed sets of the event model.
TOOLS = ("codex", "claude", "opencode")
SOURCES = ("hook", "event_stream", "transcript_tail", "sdk_session_store", "backfill", "exec_json", "app_server")
CANONICAL_TYPES = (
    "session.started", "session.resumed", "session.ended", "user.message", "assistant.delta", "assistant.message", "tool.call", "tool.result",
    "permission.requested", "permission.replied", "file.changed", "compaction.before", "compaction.after", "source.discontinuity", "error",
)
SUMMARY_KINDS = {"session.started": "session_start", "session.ended": "session_end", "compaction.after": "compaction"}
SCHEMA_VERSION = 1
SPILL_BYTES = 16 * 1024 * 1024
TEXT_COLUMNS = ("user_text", "assistant_text", "tool_intent", "tool_output", "metadata_text")
#: Weight of each text column in ranking.
WEIGHTS = dict(zip(TEXT_COLUMNS, (8.0, 6.0, 4.0, 1.0, 0.5), strict=True))

ENVELOPE = T.StructType(
    [T.StructField("schema_version", T.IntegerType())]
    + [
        T.StructField(n, T.StringType())
        for n in (
            "captured_at", "tool", "tool_version", "session_id", "filename_session_id", "turn_id", "message_id", "project_root", "cwd",
            "source", "source_event_type", "canonical_type", "source_event_id", "dedupe_key",
        )
    ]
    + [T.StructField("sequence", T.LongType()), T.StructField("raw_file", T.StringType()), T.StructField("raw_offset", T.LongType())]
    + [T.StructField("payload", T.StringType()), T.StructField("payload_ref", T.StringType())]
)


def envelope_faults(events: DataFrame) -> DataFrame:
    """events with `fault`: null for a valid envelope, else the first rule it breaks."""
    filled = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    sanitized = sanitize_session_id(F.col("session_id"))
    rules = [
        ("schema_version", F.col("schema_version") == SCHEMA_VERSION),
        ("tool", F.col("tool").isin(*TOOLS)),
        ("session_id", filled("session_id")),
        ("filename_session_id", F.col("filename_session_id") == sanitized),
        ("source_event_type", filled("source_event_type")),
        ("canonical_type", F.col("canonical_type").isin(*CANONICAL_TYPES)),
        ("dedupe_key", F.col("dedupe_key").startswith("sha256:")),
    ]
    fault = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        fault = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(fault)
    return events.withColumn("fault", fault)


def sanitize_session_id(col: "F.Column") -> "F.Column":
    """Anything but ASCII letters, digits, dot, underscore and hyphen becomes an underscore, per code point; empty becomes one."""
    out = F.regexp_replace(col, "[^A-Za-z0-9._-]", "_")
    return F.when(out == "", F.lit("_")).otherwise(out)
