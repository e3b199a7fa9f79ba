"""Exact nearest neighbours by cosine, and embedding units."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import paths
from ..errors import ValidationError

UNIT_KINDS = ("user_text", "assistant_text", "tool_intent", "metadata_text")
DIMENSIONS = 256
# What a model's input begins with.
DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "
BUCKETS = (64, 128, 256, 512, 1024, 2048)
#: Chunks of texts that are embedded, and appended, at once.
WAVE = 32


class Embedder(Protocol):
    """Anything that turns texts into vectors; must be picklable."""

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashingEmbedder:
    """A deterministic stand-in for a model: signed hashed words, unit length."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def _one(self, text: str) -> list[float]:
        import re
        import zlib

        v = np.zeros(self.dimensions)
        for w in re.findall(r"\w+", text.lower()):
            h = zlib.crc32(w.encode())
            v[h % self.dimensions] += 1 if h & 0x80000000 else -1
        return truncate_and_normalize(v.tolist(), self.dimensions)

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self._one(text)


def truncate_and_normalize(vector: list[float], dimensions: int = DIMENSIONS) -> list[float]:
    """The first components at unit length; a zero vector stays zero."""
    if len(vector) < dimensions:
        raise ValidationError(f"a vector of {len(vector)} components has no {dimensions}")
    v = np.array(vector[:dimensions], np.float64)
    if not np.isfinite(v).all():
        raise ValidationError("a vector's components must be finite")
    norm = float(np.sqrt((v * v).sum()))
    return (v / norm if norm else v).tolist()


def to_blob(vector: list[float]) -> bytes:
    """Single precision, least byte first."""
    return np.asarray(vector, "<f4").tobytes()


def from_blob(blob: bytes) -> list[float]:
    if len(blob) % 4:
        raise ValidationError("a vector's bytes come in fours")
    return np.frombuffer(blob, "<f4").astype(float).tolist()


def normalized(col: Column, dimensions: int = DIMENSIONS) -> Column:
    """truncate_and_normalize() of a column; null where a vector is too short or not finite."""
    first = F.transform(F.slice(col, 1, dimensions), lambda x: x.cast("double"))
    good = (F.size(col) >= dimensions) & F.forall(first, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(dot(first, first))
    return F.when(good, F.when(norm > 0, F.transform(first, lambda x: x / norm)).otherwise(first))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(units: DataFrame, query: list[float], k: int, embedding: str = "embedding", key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k nearest rows with `distance` and `score` = 1 / (1 + distance). Filters come first, so k rows pass them if there are k."""
    rows = units if where is None else units.where(where)
    point = F.array(*(F.lit(float(x)) for x in query))
    near = rows.withColumn("distance", cosine_distance(F.col(embedding), point)).orderBy("distance", key).limit(k)
    return near.withColumn("score", 1 / (1 + F.col("distance")))


def adaptive_k(fetch: int, n_filters: int) -> list[int]:
    """Numbers of units to try for `fetch` events: an event may have several units, and filters leave fewer events."""
    least = min(fetch, 1000)
    start = least * (4 if n_filters else 2)
    out = [start]
    while out[-1] < least * 4:
        out.append(min(out[-1] * 2, least * 4))
    return out


def embedding_units(events: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """(key, unit_kind, unit_index, text, text_hash) of each text that is worth a vector; tool output is none."""
    each = F.array(*(F.struct(F.lit(c).alias("unit_kind"), F.trim(F.coalesce(F.col(c), F.lit(""))).alias("text")) for c in UNIT_KINDS))
    rows = events.select(key, F.explode(each).alias("u")).select(key, "u.unit_kind", F.lit(0).alias("unit_index"), "u.text")
    return rows.where("text <> ''").withColumn("text_hash", F.sha2("text", 256))


def length_bucket(col: Column) -> Column:
    """Batch size class of a text by its estimated tokens: words, or a quarter of its characters."""
    words = F.size(F.filter(F.split(col, r"\s+"), lambda x: x != ""))
    estimate = F.greatest(words, F.ceil(F.char_length(col) / 4).cast("int"))
    out = F.lit(BUCKETS[-1])
    for b in reversed(BUCKETS[:-1]):
        out = F.when(estimate <= b, b).otherwise(out)
    return out


def pending(units: DataFrame, embedded: DataFrame) -> DataFrame:
    """One text for each hash that has no vector yet."""
    return units.join(embedded.select("text_hash"), "text_hash", "left_anti").select("text_hash", "text").dropDuplicates(["text_hash"])


def embed(texts: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """(text_hash, embedding) of pending(); texts of like length go together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            for i in range(0, len(frame), batch):
                vectors += embedder.embed_documents([DOCUMENT_PREFIX + t for t in frame["text"].iloc[i : i + batch]])
            yield pd.DataFrame({"text_hash": frame["text_hash"], "embedding": vectors})

    return texts.withColumn("__b", length_bucket(F.col("text"))).sortWithinPartitions("__b").select("text_hash", "text").mapInPandas(run, "text_hash string, embedding array<double>")


def progress(done: int, total: int, seconds: float) -> dict[str, float | int | None]:
    """How far embedding is: texts a second, and seconds left, rounded up; null before the first."""
    rate = done / seconds if seconds > 0 else 0.0
    left = max(0, total - done)
    return {"done": done, "total": total, "rate": rate, "eta_seconds": math.ceil(left / rate) if rate > 0 else None if left else 0}


def embed_pending(units: DataFrame, path: str, embedder: Embedder | None, chunk: int = 100_000, report: Callable[[dict], None] | None = None) -> int:
    """Append vectors of the texts that have none to the table at path, in waves of WAVE tasks that take some `chunk` texts each; a run that
    stopped goes on behind its last whole wave. What has no vector is looked up once and dealt to waves, so a wave reads its own texts only.
    Returns how many were embedded, 0 without an embedder."""
    if embedder is None:
        return 0
    spark, began, done = units.sparkSession, time.monotonic(), 0
    schema = "text_hash string, embedding array<double>"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    left = paths.staged(pending(units, spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)), "pending")
    total = left.count()
    waves = math.ceil(total / (chunk * WAVE))
    folder = f"{paths.shared_folder(spark)}/waves-{uuid.uuid4().hex}"
    if waves > 1:
        dealt = left.withColumn("wave", F.pmod(F.xxhash64("text_hash"), F.lit(waves)))
        dealt.repartitionByRange("wave", "text_hash").write.partitionBy("wave").parquet(folder)
        numbers = sorted(r.wave for r in dealt.select("wave").distinct().collect())
    for wave in numbers if waves > 1 else range(waves):
        own = spark.read.schema(left.schema).parquet(f"{folder}/wave={wave}") if waves > 1 else left
        n = own.count()
        embed(own.repartition(math.ceil(n / chunk), "text_hash"), embedder).write.mode("append").parquet(path)
        done += n
        if report:
            report(progress(done, total, time.monotonic() - began))
    return done
