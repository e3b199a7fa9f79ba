"""Exact top-k by inner product of integer vectors, with a KD-tree for each shard.

Components become floor(256 * x). Rows are dealt to shards; each shard builds a tree by splits at the median of the widest
dimension, each node with its tight bounding box. A query descends best first: a node's bound is the largest inner product that
its box allows, and it is left when that is under the query's kth score so far. The first shard gives each query k scores, and
the least of them goes to the other shards as their first bound.

Queries go in blocks, so a task holds one shard and one block. Vectors that are null, empty or hold null or non-finite
components take no part; vectors meet only those of their own dimension. Products that double precision cannot hold exactly are
taken in whole numbers, and a score beyond a long is given as the longest one. Rows that repeat a vec_id are rows of their own, and a
query leaves out all rows of its own id. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import work

K, EVERY = 5, 50
LONGEST = (1 << 63) - 1
#: Rows of a shard and of a leaf, and queries of a block.
SHARD, LEAF, QUERIES = 16_384, 128, 2048


class Tree:
    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.order = np.arange(len(x))
        self.low, self.high, self.span, self.child = [], [], [], []
        self.whole = x.dtype == object  # whole numbers of any size; boxes are in double precision, a little wider
        if len(x):
            self._build(0, len(x), leaf)
            self.low, self.high = np.array(self.low), np.array(self.high)
            self.rows = x[self.order]

    def _build(self, a: int, b: int, leaf: int) -> int:
        own = self.x[self.order[a:b]]
        low, high = own.min(0).astype(np.float64), own.max(0).astype(np.float64)
        node = len(self.span)
        self.low.append(low)
        self.high.append(high)
        self.span.append((a, b))
        self.child.append(None)
        if b - a > leaf and (high > low).any():
            d = int((high / 2 - low / 2).argmax())
            m = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, d], m)]
            self.child[node] = (self._build(a, a + m, leaf), self._build(a + m, b, leaf))
        return node

    def search(self, q: np.ndarray, own_id: int, ids: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """(score, id) of the k best at or over floor, best first; ties to smaller ids. ids are in the order of rows."""
        if not len(self.x):
            return []
        at = q.astype(np.float64)
        with np.errstate(all="ignore"):
            parts = np.maximum(at * self.low, at * self.high)
            bounds = parts.sum(1)
            if self.whole:
                bounds = bounds + 1e-9 * np.abs(parts).sum(1) + 1
                bounds[np.isnan(bounds)] = np.inf
        heap = [(-float(bounds[0]), 0)]
        best: list[tuple[int, int]] = []  # least first: (score, -id)
        while heap:
            bound, node = heapq.heappop(heap)
            bound = -bound
            least = best[0][0] if len(best) == k else floor
            if least is not None and bound < least:
                break
            if self.child[node]:
                for c in self.child[node]:
                    if least is None or bounds[c] >= least:
                        heapq.heappush(heap, (-float(bounds[c]), c))
                continue
            a, b = self.span[node]
            scores = self.rows[a:b] @ q
            others = ids[a:b] != own_id
            some = np.flatnonzero(others & (scores >= least).astype(bool) if least is not None else others)
            if len(some) > 4 * k:
                # ties at the kth score stay in
                cut = np.partition(scores[some], len(some) - k)[len(some) - k]
                some = some[scores[some] >= cut]
            for i in some.tolist():
                item = (int(scores[i]), -int(ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, width, far, body): proper vectors as integers; those with a component beyond a long (far) as decimal numbers."""
    for batch in batches:
        out = []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):  # 256 times a finite double may be none
                whole = np.floor(256 * x)
            far = bool(np.abs(whole).max() >= 2.0**62)
            body = b",".join(str(256 * int(v) if abs(v) > 2.0**60 else int(np.floor(256 * v))).encode() for v in x) if far else whole.astype(np.int64).tobytes()
            out.append((i, len(x), far, body))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["vec_id", "width", "far", "body"])


def _numbers(bodies: list[bytes], far: list[bool], width: int) -> np.ndarray:
    """The vectors in double precision if that holds every product and sum of them exactly, else as whole numbers of any size."""
    if not any(far):
        x = np.frombuffer(b"".join(bodies), np.int64).reshape(len(bodies), width)
        if float(np.abs(x.astype(np.float64)).max(initial=0)) ** 2 * width < 2.0**53:
            return x.astype(np.float64)
        return x.astype(object)
    rows = [[int(v) for v in b.split(b",")] if f else np.frombuffer(b, np.int64).tolist() for b, f in zip(bodies, far, strict=True)]
    return np.array(rows, dtype=object).reshape(len(bodies), width)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in work.grouped(batches, ["width", "shard", "block"]):
            width = t["width"][0].as_py()
            query = np.array(t["query"].to_pylist(), bool)
            ids = t["vec_id"].to_numpy()
            floors = t["floor"].to_pylist()
            x = _numbers(t["body"].to_pylist(), t["far"].to_pylist(), width)
            rows = np.flatnonzero(~query)
            tree = Tree(x[rows])
            in_order = ids[rows][tree.order]
            out = []
            for i in np.flatnonzero(query).tolist():
                out += [(int(ids[i]), max(-LONGEST, min(LONGEST, s)), other) for s, other in tree.search(x[i], int(ids[i]), in_order, k, floors[i])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "score", "vec_id"])

    return run


def top_k(vectors: DataFrame, is_query: "F.Column", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows, its own left out. Sums of products of integers are exact in double
    precision up to 2^53."""
    spark = vectors.sparkSession
    work.prepare(spark)
    folder = work.work_folder(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = work.staged(rows.mapInArrow(_whole, "vec_id long, width int, far boolean, body binary"), folder, "whole")
    n, n_queries = whole.count(), whole.where(is_query).select("vec_id").distinct().count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // QUERIES))
    placed = whole.withColumn("shard", F.pmod(F.xxhash64("vec_id", "body"), F.lit(shards)).cast("int")).withColumn("query", F.lit(False)).withColumn("floor", F.lit(None).cast("long"))
    asked = whole.where(is_query).dropDuplicates(["vec_id", "width"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("query", F.lit(True))
    columns = ["width", "shard", "block", "query", "vec_id", "far", "body", "floor"]

    def searched(queries: DataFrame, own: DataFrame) -> DataFrame:
        spread = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        both = spread.select(*columns).unionByName(queries.select(*columns))
        cells = both.repartition("width", "shard", "block").sortWithinPartitions("width", "shard", "block", "query", "vec_id", "body")
        return cells.mapInArrow(_search(k), "query_id long, score long, vec_id long")

    none = F.lit(None).cast("long")
    first = work.staged(searched(asked.withColumn("shard", F.lit(0)).withColumn("floor", none), placed.where("shard = 0")), folder, "first")
    found = first
    if shards > 1:
        floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        further = asked.join(floors, F.col("vec_id") == F.col("query_id"), "left").withColumn("floor", F.col("least")).withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))))
        found = first.unionByName(searched(further, placed.where("shard > 0")))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows by comparing each query with all.
ORACLE_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % {EVERY} = 0)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= {K}"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(work.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
