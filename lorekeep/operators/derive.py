"""Tables derived from events, and first-wins identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import refs
from . import canonical, document, vector

MESSAGES = ("user.message", "assistant.delta", "assistant.message", "tool.result")


def first_wins(events: DataFrame, key: str = "dedupe_key", order: tuple[str, ...] = ("raw_file", "raw_line")) -> DataFrame:
    """One row for each key, the first that arrived. Rows that share a key are combined before they are shuffled, however many there are."""
    row = F.struct(*events.columns)
    return events.groupBy(F.col(key).alias("__key")).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def new_events(events: DataFrame, stored: DataFrame, key: str = "dedupe_key") -> DataFrame:
    return events.join(stored.select(key), key, "left_anti")


def messages(events: DataFrame) -> DataFrame:
    kind = F.col("canonical_type")
    return events.where(kind.isin(*MESSAGES)).select("dedupe_key", canonical.role(kind).alias("role"), document.message_text().alias("text"), (kind == "assistant.delta").alias("is_delta"), "sequence")


def tool_events(events: DataFrame) -> DataFrame:
    kind = F.col("canonical_type")
    rows = events.where(kind.isin("tool.call", "tool.result"))
    return rows.select(
        "dedupe_key", "tool", "session_id", F.col("doc_tool_name").alias("tool_name"), "command", canonical.tool_status(kind).alias("status"), F.lit(None).cast("long").alias("duration_ms"),
        F.col("tool_intent").alias("input_text"), F.col("tool_output").alias("output_text"),
    )


def event_files(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("canonical_type") == "file.changed", "edited").otherwise("mentioned")
    return events.select("dedupe_key", "tool", "session_id", kind.alias("relationship"), F.explode("paths").alias("path")).dropDuplicates(["dedupe_key", "path", "relationship"])


def event_refs(events: DataFrame) -> DataFrame:
    return events.select("dedupe_key", "tool", "session_id", F.explode(refs.extract(F.col("searchable_text"))).alias("r")).select("dedupe_key", "tool", "session_id", "r.kind", "r.value").dropDuplicates(["dedupe_key", "kind", "value"])


def compactions(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("canonical_type").isin("compaction.before", "compaction.after"))
    return rows.select("dedupe_key", "tool", "session_id", F.get_json_object("payload", "$.trigger").alias("trigger"), "raw_file", "raw_line", "raw_offset", F.col("captured_at").alias("created_at"))


def vector_units(events: DataFrame) -> DataFrame:
    return vector.embedding_units(events)


def missing_units(events: DataFrame, units: DataFrame) -> DataFrame:
    """Units of events that have none yet."""
    return vector_units(events.join(units.select("dedupe_key"), "dedupe_key", "left_anti"))


def spilled(events: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(events with large payloads as references, blobs (payload_ref, payload))."""
    large = F.octet_length("payload") > most
    ref = F.concat(F.lit("sha256:"), F.sha2("payload", 256))
    kept = events.withColumn("payload_ref", F.when(large, ref)).withColumn("payload", F.when(~large, F.col("payload")))
    return kept, events.where(large).select(ref.alias("payload_ref"), "payload").dropDuplicates(["payload_ref"])


def resolved(events: DataFrame, blobs: DataFrame) -> DataFrame:
    """events with payloads in place of references; a reference that is no sha256 has none."""
    own = blobs.select(F.col("payload_ref").alias("__ref"), F.col("payload").alias("__payload"))
    joined = events.join(own, (F.col("payload_ref") == F.col("__ref")) & F.col("payload_ref").startswith("sha256:"), "left")
    return joined.withColumn("payload", F.coalesce("payload", "__payload")).drop("__ref", "__payload")
