"""Export, purge, coverage, freshness and health."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotFoundError
from ..functions import redact as secrets
from ..functions import times
from ..paths import staged
from ..sources.raw import same_file


@F.pandas_udf(T.StringType())
def redacted_lines(lines: pd.Series) -> pd.Series:
    return lines.map(secrets.redact_line, na_action="ignore")


def export_jsonl(lines: DataFrame, raw_file: str, redacted: bool = False) -> DataFrame:
    """(raw_line, value): a session's log as it is, or with secrets replaced line by line."""
    own = lines.where(same_file(F.col("raw_file"), raw_file))
    if own.isEmpty():
        raise NotFoundError(f"no log {raw_file}")
    value = redacted_lines("line") if redacted else F.col("line")
    return own.select("raw_line", value.alias("value")).orderBy("raw_line")


def markdown_block(text: Column) -> Column:
    """One event as Markdown: a heading with its citation, then what it says."""
    return F.concat(F.lit("## "), F.col("canonical_type"), F.lit(" "), F.coalesce("raw_file", F.lit("")), F.lit(":"), F.col("raw_line").cast("string"), F.lit("\n\n"), text, F.lit("\n"))


def export_markdown(events: DataFrame, tool: str, session_id: str, redacted: bool = False) -> DataFrame:
    """(raw_line, value): a session as Markdown blocks in order of line."""
    own = events.where((F.col("tool") == tool) & (F.col("session_id") == session_id))
    if own.isEmpty():
        raise NotFoundError(f"no session {session_id} of {tool}")
    said = secrets.redact(F.col("searchable_text")) if redacted else F.col("searchable_text")
    return own.select("raw_line", markdown_block(said).alias("value")).orderBy("raw_line")


def markdown_head(tool: str, session_id: str, redacted: bool) -> str:
    note = "Secrets are redacted." if redacted else "May contain secrets."
    return f"# {tool} session {session_id}\n\n_{note}_\n"


def purge_session(events: DataFrame, tool: str, session_id: str) -> DataFrame:
    return events.where(~((F.col("tool") == tool) & (F.col("session_id") == session_id)))


def purge_before(events: DataFrame, before: str) -> DataFrame:
    """Events captured at or after an instant, compared as stored text."""
    return events.where(F.col("captured_at") >= times.threshold(before, "before"))


def surviving(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Derived rows whose event is still there."""
    return rows.join(kept.select(key), key, "left_semi")


def orphans(blobs: DataFrame, events: DataFrame, key: str = "payload_ref") -> DataFrame:
    """Blobs that no event refers to any more."""
    return blobs.join(events.where(F.col(key).isNotNull()).select(key), key, "left_anti")


def coverage(parsed: DataFrame, captured: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """For each session of the sources: records there, captured and missing, and whether only a part is captured."""
    own = captured.select(key).distinct().withColumn("__there", F.lit(True))
    counted = parsed.join(own, key, "left").groupBy("tool", "session_id").agg(F.count(F.lit(1)).alias("on_disk"), F.count_if("__there").alias("captured"))
    missing = F.col("on_disk") - F.col("captured")
    return counted.withColumn("missing", missing).withColumn("partial", (F.col("captured") > 0) & (missing > 0))


def totals(covered: DataFrame) -> DataFrame:
    """Sums of coverage() over sessions."""
    return covered.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("on_disk", "captured", "missing")), F.count_if("partial").alias("partial_sessions"), F.count(F.lit(1)).alias("sessions"))


def freshness(files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """For each tool: bytes there, bytes indexed (no more than a file has), and files with more to index."""
    own = checkpoints.select("tool", "source_path", "byte_offset")
    rows = files.join(own, ["tool", "source_path"], "left")
    done = F.least(F.coalesce("byte_offset", F.lit(0)), F.col("size"))
    return rows.groupBy("tool").agg(F.sum("size").alias("raw_bytes"), F.sum(done).alias("indexed_bytes"), F.count_if(done < F.col("size")).alias("pending_files"))


def deleted_sources(checkpoints: DataFrame, files: DataFrame) -> DataFrame:
    return checkpoints.join(files.select("source_path"), "source_path", "left_anti")


def footprint(spark: SparkSession, *paths: str) -> DataFrame:
    """(folder, files, bytes) by a listing; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length")
    return found.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of every table in one job."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest_rank(values: list[float], share: float) -> float:
    """The sorted value at index ceil((n - 1) * share)."""
    return sorted(values)[math.ceil((len(values) - 1) * share)]


#: Points of the sketch that brackets a rank, and rows that a bracket is narrowed down to.
GRID, FEW = 200, 100_000


def _beside(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the facts of their group, in which a null key is a group like any other."""
    other = facts.select(*(F.col(k).alias(f"{k}_of") for k in keys), *(c for c in facts.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    return rows.join(other, same).drop(*(f"{k}_of" for k in keys))


def _brackets(rows: DataFrame, keys: list[str], ranks: dict[str, Column], known: DataFrame | None = None) -> DataFrame:
    """(keys, lo_i, hi_i, rank_i, inside_i) for the i-th of the ranks (from 0, of the sorted __v of a group, as expressions of its size n):
    the rank's value lies in [lo, hi], whose inside rows it is the rank-th of. A null bound leaves that side open. known: more columns of a
    group that ranks use. Both aggregates combine before they shuffle, so a group of any size moves a sketch a task."""
    number = F.when(~F.isnan(F.col("__v").cast("double")), F.col("__v"))
    points = F.percentile_approx(number, [i / GRID for i in range(GRID + 1)], F.lit(10 * GRID))
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("m"), points.alias("q"))
    if known is not None:
        sketch = _beside(sketch, known, keys)
    for i, rank in enumerate(ranks.values()):
        at = F.col(f"rank_{i}") / F.greatest(F.col("m") - 1, F.lit(1)) * GRID
        sketch = sketch.withColumn(f"rank_{i}", rank.cast("long"))
        sketch = sketch.withColumn(f"lo_{i}", F.get("q", (F.floor(at) - 1).cast("int")))
        sketch = sketch.withColumn(f"hi_{i}", F.get("q", (F.ceil(at) + 1).cast("int")))
    bounds = sketch.select(*keys, *(f"{c}_{i}" for c in ("lo", "hi", "rank") for i in range(len(ranks))))
    joined = _beside(rows.select(*keys, "__v"), bounds, keys)
    v, aggs = F.col("__v"), []
    for i in range(len(ranks)):
        under = F.coalesce(v < F.col(f"lo_{i}"), F.lit(False))
        over = F.coalesce(v > F.col(f"hi_{i}"), F.lit(False))
        aggs += [F.first(c).alias(c) for c in (f"lo_{i}", f"hi_{i}", f"rank_{i}")] + [F.count_if(under).alias(f"under_{i}"), F.count_if(~under & ~over).alias(f"inside_{i}"), F.count(F.lit(1)).alias(f"n_{i}")]
    found = joined.groupBy(*keys).agg(*aggs)
    for i in range(len(ranks)):
        rank, under, inside = (F.col(f"{c}_{i}") for c in ("rank", "under", "inside"))
        good = (rank >= under) & (rank < under + inside)  # else the sketch missed the rank, and the bracket stays open
        found = found.withColumns({f"lo_{i}": F.when(good, F.col(f"lo_{i}")), f"hi_{i}": F.when(good, F.col(f"hi_{i}")), f"rank_{i}": F.when(good, rank - under).otherwise(rank), f"inside_{i}": F.when(good, inside).otherwise(F.col(f"n_{i}"))})
    return found.drop(*(f"{c}_{i}" for c in ("under", "n") for i in range(len(ranks))))


def nearest_rank_by_group(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], few: int | None = None) -> DataFrame:
    """Exact percentiles by nearest rank for each group: the value at index ceil((n - 1) * share) of a group's sorted values without nulls.

    Ranks of all groups are closed in upon at once: a mergeable sketch names two values around each rank, a count says how many rows lie
    below and between them, and the rows between go on to the next round, until no bracket of two different values holds over `few`
    rows. Only these are sorted. A round leaves some 3 / GRID of the rows, so ten to the twelve rows take four.
    """
    few = FEW if few is None else few
    own = [f"__k{i}" for i in range(len(keys))]
    left = rows.where(F.col(value).isNotNull()).select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col(value).alias("__v"))
    known, grouped = None, own
    ranks = {name: F.ceil((F.col("n") - 1) * F.lit(share)) for name, share in shares.items()}
    narrowed = None
    while True:
        found = staged(_brackets(left, grouped, ranks, known), "ranks")
        each = F.array(*(F.struct(F.lit(name).alias("name"), *(F.col(f"{c}_{i}").alias(c) for c in ("lo", "hi", "rank", "inside"))) for i, name in enumerate(ranks)))
        flat = found.select(*own, F.explode(each).alias("b")) if known is None else found.select(*own, F.struct(F.col("__s").alias("name"), *(F.col(f"{c}_0").alias(c) for c in ("lo", "hi", "rank", "inside"))).alias("b"))
        boxes = flat.select(*own, F.col("b.name").alias("__s"), "b.lo", "b.hi", "b.rank", "b.inside")
        kept = _beside(left, boxes, grouped).where("(lo is null or __v >= lo) and (hi is null or __v <= hi)").select(*own, "__s", "__v", "rank")
        most = boxes.where("lo is null or hi is null or lo < hi").agg(F.max("inside")).head()[0] or 0
        if most <= few or most == narrowed:
            break
        narrowed = most
        left = staged(kept, "between")
        known = left.groupBy(*own, "__s").agg(F.first("rank").alias("wanted"))
        left, grouped, ranks = left.drop("rank"), [*own, "__s"], {"": F.col("wanted")}
    counted = kept.groupBy(*own, "__s", "__v").agg(F.count(F.lit(1)).alias("n"), F.first("rank").alias("rank"))
    upto = F.sum("n").over(Window.partitionBy(*own, "__s").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", upto).where(F.col("upto") > F.col("rank"))
    return placed.groupBy(*(F.col(o).alias(k) for k, o in zip(keys, own, strict=True))).agg(*(F.min(F.when(F.col("__s") == name, F.col("__v"))).alias(name) for name in shares))


def precision_recall(ranked: DataFrame, relevant: DataFrame, key: str, k: int) -> DataFrame:
    """(query, precision, recall) at k of (query, key, rank) against (query, key)."""
    top = ranked.where(F.col("rank") <= k)
    hits = top.join(relevant.select("query", key), ["query", key], "left_semi").groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    wanted = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("wanted"))
    joined = wanted.join(hits, "query", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return joined.select("query", (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("wanted")).alias("recall"))
