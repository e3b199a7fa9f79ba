"""A table of keys that grows by generations: hash buckets, and a Bloom filter for each.

Folder: keys/gen=<g>/bucket=<b>/ and filters/gen=<g>/ (bucket, n, bits). Which generations count is for the owner's manifest to say, so that
keys appear together with what they stand for. A lookup tests its keys against the filters of their buckets and opens only buckets of which a
filter admits one; it counts what it opens, so a damaged bucket is found before it is trusted.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import paths
from ..errors import DamagedError

#: Keys of a bucket; bits of a filter for each key and places tested; generations of a tier that are merged; buckets named one by one.
PER, BITS, PROBES, FAN, NAMED = 1_000_000, 12, 6, 4, 2000


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    k = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((h1.view(np.uint64)[None] + k * (h2.view(np.uint64) | np.uint64(1))[None]) % np.uint64(bits)).astype(np.int64)


def _filter(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    n = table.num_rows
    bits = np.zeros(max(64, -(-n * BITS // 8) * 8), bool)
    bits[_places(table.column("h1").to_numpy(), table.column("h2").to_numpy(), len(bits)).ravel()] = True
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _admitted(_key: tuple[pa.Scalar, ...], asked: pa.Table, filters: pa.Table) -> pa.Table:
    """The asked keys that a bucket's filter does not rule out."""
    out = asked.select(["gen", "bucket", "key"])
    if not filters.num_rows or not asked.num_rows:
        return out.slice(0, 0)
    bits = np.unpackbits(np.frombuffer(filters.column("bits")[0].as_py(), np.uint8)).astype(bool)
    there = bits[_places(asked.column("h1").to_numpy(), asked.column("h2").to_numpy(), len(bits))].all(0)
    return out.filter(pa.array(there))


class KeyTable:
    def __init__(self, spark: SparkSession, path: str, columns: str = "key string"):
        self.spark, self.path, self.columns = spark, path.rstrip("/"), columns

    def _read(self, paths_: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{self.columns}, gen string, bucket int").option("basePath", f"{self.path}/keys").parquet(*paths_)

    def rows(self, gens: dict[str, dict]) -> DataFrame:
        if not gens:
            return self.spark.createDataFrame([], self.columns)
        return self._read([f"{self.path}/keys/gen={g}" for g in gens]).drop("gen", "bucket")

    def add(self, rows: DataFrame, gens: dict[str, dict], n: int | None = None) -> dict[str, dict]:
        """The generations with one more, of these rows; tiers that are full become one. n: how many, of rows that are staged."""
        gen = uuid.uuid4().hex
        if n is None:
            with paths.Scratch(self.spark) as scratch:
                aside = scratch.staged(rows, "keys")
                return self.add(aside, gens, aside.count())
        if not n:
            return dict(gens)
        buckets = 1 << max(0, math.ceil(math.log2(n / PER)))
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
        dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/keys/gen={gen}")
        written = self._read([f"{self.path}/keys/gen={gen}"])
        written.select("bucket", *_hashes(F.col("key"))).groupBy("bucket").applyInArrow(_filter, "bucket int, n long, bits binary").write.parquet(f"{self.path}/filters/gen={gen}")
        out = dict(gens) | {gen: {"n": n, "buckets": buckets}}
        tiers: dict[int, list[str]] = {}
        for g, x in out.items():
            tiers.setdefault(int(math.log(max(x["n"], 1), FAN)), []).append(g)
        full = next((own for own in tiers.values() if len(own) >= FAN), None)
        if full is None:
            return out
        return self.add(self.rows({g: out[g] for g in full}), {g: x for g, x in out.items() if g not in full})

    def _seen(self, asked: DataFrame, gens: dict[str, dict]) -> DataFrame | None:
        """(gen, bucket, key) of the keys that filters admit; None where they admit none."""
        n = asked.count()
        salts = max(1, -(-n // PER))
        places = F.array(*(F.struct(F.lit(g).alias("gen"), F.pmod(F.col("h1"), F.lit(x["buckets"])).cast("int").alias("bucket")) for g, x in gens.items()))
        spread = asked.select("key", *_hashes(F.col("key"))).withColumn("p", F.explode(places)).select("key", "h1", "h2", "p.gen", "p.bucket", F.pmod("h2", F.lit(salts)).alias("salt"))
        filters = self.spark.read.schema("bucket int, n long, bits binary, gen string").option("basePath", f"{self.path}/filters").parquet(*(f"{self.path}/filters/gen={g}" for g in gens))
        filters = filters.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
        by = ["gen", "bucket", "salt"]
        admitted = spread.groupBy(*by).cogroup(filters.groupBy(*by)).applyInArrow(_admitted, "gen string, bucket int, key string")
        admitted = paths.staged(admitted, "admitted")
        return None if admitted.isEmpty() else admitted

    def opened(self, admitted: DataFrame, gens: dict[str, dict]) -> DataFrame:
        """The buckets that hold admitted keys, counted against their filters."""
        named = [(r.gen, r.bucket) for r in admitted.select("gen", "bucket").distinct().limit(NAMED + 1).collect()]
        want = self.spark.read.schema("bucket int, n long, bits binary, gen string").option("basePath", f"{self.path}/filters").parquet(*(f"{self.path}/filters/gen={g}" for g in gens)).select("gen", "bucket", "n")
        want = want.join(admitted.select("gen", "bucket").distinct(), ["gen", "bucket"], "left_semi")
        try:
            found = self._read([f"{self.path}/keys/gen={g}/bucket={b}" for g, b in named] if len(named) <= NAMED else [f"{self.path}/keys/gen={g}" for g in gens])
            odd = found.groupBy("gen", "bucket").count().join(want, ["gen", "bucket"], "right").where("count is null or count <> n")
            damaged = not odd.isEmpty()
        except Exception as e:
            if not any(x in str(e) for x in ("PATH_NOT_FOUND", "CANNOT_READ_FILE", "FAILED_READ_FILE", "not a Parquet file", "FileNotFound")):
                raise
            damaged = True
        if damaged:
            raise DamagedError(f"keys in {self.path} are not what was written")
        return found

    def unseen(self, rows: DataFrame, gens: dict[str, dict], key: str = "key") -> DataFrame:
        """Rows whose key no generation holds. Rows are read twice, so stage what is dear."""
        if not gens:
            return rows
        admitted = self._seen(rows.select(F.col(key).alias("key")).where("key is not null").distinct(), gens)
        if admitted is None:
            return rows
        known = self.opened(admitted, gens).select(F.col("key").alias("__known")).join(admitted.select(F.col("key").alias("__known")).distinct(), "__known", "left_semi").distinct()
        return rows.join(known, F.col(key) == F.col("__known"), "left_anti")

    def without(self, keys: DataFrame, gens: dict[str, dict]) -> dict[str, dict]:
        """The generations less these keys; only generations that may hold one are written anew."""
        admitted = self._seen(keys.select("key").distinct(), gens) if gens else None
        if admitted is None:
            return dict(gens)
        touched = [r.gen for r in admitted.select("gen").distinct().collect()]
        out = {g: x for g, x in gens.items() if g not in touched}
        return self.add(self.rows({g: gens[g] for g in touched}).join(keys.select("key").distinct(), "key", "left_anti"), out)

    def sweep(self, gens: dict[str, dict]) -> None:
        """Delete generations that are not among these."""
        for name in ("keys", "filters"):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName().removeprefix("gen=") not in gens:
                    fs.delete(s.getPath(), True)
