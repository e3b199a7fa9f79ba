"""Quality by importance resampling.

Two generative models over hashed n-grams, one of the target (documents labelled as good) and one of the raw corpus, give each
document a log weight, the log ratio of its probabilities under them: the sum over its n-grams. Documents are sampled without
replacement by Gumbel top-k: a draw from the Gumbel law is added to each log weight and the k largest win, so one document is
drawn before another with the odds of their weights. k is a share of the documents with words; where none is given it is the
share of good ones among the table's labelled documents, so as many are drawn as the corpus has good ones.

Counts of the raw model cover all rows of the table; the target model is fitted on at most TARGET_DOCS labelled documents. Log
ratios are whole multiples of 1 / UNIT, so sums are exact in any order. Texts that are null or hold no word have no weight and are
not drawn. Rows that repeat a doc_id are weighed each and share their draw; equal keys go to larger doc_ids first. Other columns
are ignored. Without labels all rows with words are drawn. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples, work
from .langid import runs
from .shingles import mix, span_hashes

BUCKETS = 1 << 14
TARGET_DOCS = 12_000
UNIT = 1 << 20
SEED = 20240131
#: Rows of the last, undecided part that are sorted at once.
LAST = 50_000


_AGAIN = mix(np.arange(7, 9, dtype=np.uint64))


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unigram and bigram, and the n+1 offsets of the documents' n-grams. A word is a run of letters, digits or marks."""
    starts, ends = runs(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    h = span_hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    last = np.zeros(len(h), bool)
    last[(at[1:] - 1)[np.diff(at) > 0]] = True
    two = np.empty_like(h)
    two[:-1] = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    two[-1] = 0
    # all repetitions at once, and all after one word between, count as one n-gram each
    third = np.ones(len(h), bool)  # another word of the same text stands two places on
    third[-2:] = False
    third[:-1] &= ~last[1:]
    third &= ~last
    two[:-2][(h[:-2] == h[2:]) & third[:-2]] = _AGAIN[1]
    two[:-1][h[:-1] == h[1:]] = _AGAIN[0]
    grams = np.stack([h, two], axis=1).ravel()
    keep = np.ones(len(grams), bool)
    keep[1::2] = ~last
    many = np.concatenate(([0], np.cumsum(keep)))
    return (grams[keep] >> np.uint64(50)).astype(np.int64), many[2 * at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, raw, target) counts of this task."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in work.small_batches(batches):
        grams, at = buckets(*work.text_buffers(batch.column(1)))
        raw += np.bincount(grams, minlength=BUCKETS)
        good = np.array([x == 1 for x in batch.column(2).to_pylist()], bool)
        target += np.bincount(grams[np.repeat(good, np.diff(at))], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, raw[some], target[some])], ["bucket", "raw", "target"])


class Model:
    """Log ratio of each bucket in multiples of 1 / UNIT."""

    def __init__(self, ratio: np.ndarray):
        self.ratio = np.round(ratio * UNIT).astype(np.int64)

    def weigh(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log ratios and number of n-grams of each text."""
        grams, at = buckets(data, offsets)
        total = np.concatenate(([0], np.cumsum(self.ratio[grams])))
        return (total[at[1:]] - total[at[:-1]]) / UNIT, np.diff(at)


def train(docs: DataFrame, labels: DataFrame, fold: Column) -> Model:
    spark = docs.sparkSession
    work.prepare(spark)
    folder = work.work_folder(spark)
    ids = work.staged(samples.labelled(labels, "quality", {1: TARGET_DOCS}, fold), folder, "ids")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left")
    counted = own.select("doc_id", "text", "label").mapInArrow(_count, "bucket long, raw long, target long")
    raw, target = np.full(BUCKETS, 1.0), np.full(BUCKETS, 1.0)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # BUCKETS rows
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return Model(ratio if target.sum() > BUCKETS else np.zeros(BUCKETS))


def good_share(docs: DataFrame, labels: DataFrame) -> float:
    """Share of good ones among the labelled documents of docs; 1 without any."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().dropDuplicates(["doc_id"])
    here = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    share = here.agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0]
    return 1.0 if share is None else float(share)


def _weighed(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work.small_batches(batches):
            total, n = model.weigh(*work.text_buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(n, pa.int64())], ["doc_id", "log_ratio", "n_grams"])

    return run


def gumbel(doc_id: Column) -> Column:
    """A draw for each id, alike on every run."""
    even = (F.pmod(F.xxhash64(doc_id, F.lit(SEED)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return -F.log(-F.log(even))


def _id() -> Column:
    """doc_id, none before all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))


def edge_of(rows: DataFrame, key: str, k: int, last: int = LAST) -> tuple[float, int] | None:
    """The kth largest (key, doc_id); None if there are no k. Bounds of the undecided part narrow by counts over its range, and only
    what is left, at most about `last` rows, is sorted."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0  # rows over high
    col = F.col(key)
    inside = rows.count()
    if k <= 0 or k > inside:
        return None
    closed = True
    while inside > last and high > low:
        step, was = (high - low) / 1000, (closed, above)
        part = F.least(F.floor((col - low) / step), F.lit(999)).cast("int")
        within = (col >= low) & ((col <= high) if closed else (col < high))
        counts = sorted(((r.part, r.n) for r in rows.where(within).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        for part_no, n in counts:
            if above + n >= k:
                break
            above += n
        new_low, new_high = low + part_no * step, low + (part_no + 1) * step
        if part_no == 999:
            new_high = high
        else:
            closed = False
        if n == inside and (new_low, new_high) == (low, high):
            break
        if n == inside or new_high <= new_low:
            break
        # counts are taken anew, so rounding at the bounds cannot lose a row
        inside, above = rows.agg(F.count_if((col >= new_low) & ((col <= new_high) if closed else (col < new_high))), F.count_if((col > new_high) if closed else (col >= new_high))).first()
        if not above < k <= above + inside:
            closed, above = was
            break
        low, high = new_low, new_high
    within = (col >= low) & ((col <= high) if closed else (col < high))
    # of rows that share key and id all are drawn
    value, doc = rows.where(within).orderBy(F.desc(key), F.desc(_id())).select(key, _id().alias("doc_id")).offset(k - above - 1).limit(1).collect()[0]
    return value, doc


def top_k(rows: DataFrame, key: str, k: int, last: int = LAST) -> DataFrame:
    """rows with a boolean `kept` for the k largest (key, doc_id)."""
    edge = edge_of(rows, key, k, last)
    if edge is None:
        return rows.withColumn("kept", F.lit(k > 0))
    value, doc = F.lit(edge[0]), F.lit(edge[1])
    return rows.withColumn("kept", (F.col(key) > value) | ((F.col(key) == value) & (_id() >= doc)))


def drawn(docs: DataFrame, model: Model, share: float) -> tuple[DataFrame, int]:
    """(doc_id, log_ratio, n_grams, key) of each row, key null without words, and how many are drawn."""
    work.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_weighed(model), "doc_id long, log_ratio double, n_grams long")
    rows = rows.withColumn("key", F.when(F.col("n_grams") > 0, F.col("log_ratio") + gumbel(_id())))
    rows = work.staged(rows, work.work_folder(docs.sparkSession), "weights")
    return rows, math.ceil(share * rows.where("n_grams > 0").count())


def sample(docs: DataFrame, model: Model, share: float) -> DataFrame:
    """(doc_id, log_ratio, n_grams, key, kept) of each row."""
    rows, k = drawn(docs, model, share)
    return top_k(rows.where("n_grams > 0"), "key", k).unionByName(rows.where("n_grams = 0").withColumn("kept", F.lit(False)))


def select(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """docs without those that the sampling leaves out. Draws and exact weights come from the row itself, so the last key drawn is all
    that is shared."""
    model = train(docs, labels, work.crc_mod4() != 2)
    rows, k = drawn(docs, model, good_share(docs, labels) if share is None else share)
    edge = edge_of(rows.where("n_grams > 0"), "key", k)
    text_at, draw = docs.columns.index("text"), "__lorekeep_draw"
    with_draw = docs.withColumns({draw: gumbel(_id()), f"{draw}_id": _id()})

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work.small_batches(batches) if k else ():
            total, n = model.weigh(*work.text_buffers(batch.column(text_at)))
            gone = n == 0
            if edge is not None:
                key = total + batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
                gone |= (key < edge[0]) | ((key == edge[0]) & (batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) < edge[1]))
            yield batch.filter(pa.array(~gone)).select(batch.schema.names[:-2])

    return with_draw.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = work.table(spark, sf_dir, "documents"), work.table(spark, sf_dir, "labels")
    return sample(docs, train(docs, labels, work.crc_mod4() != 2), good_share(docs, labels))
