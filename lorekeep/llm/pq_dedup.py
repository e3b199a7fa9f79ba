"""Near-duplicate vectors by product quantisation.

Equal vectors become one class with a count. A coarse codebook assigns each class, at unit length and in double precision, to its
nearest centroid's list. What the centroid leaves of a vector is coded in SUBSPACES codes, one of WORDS each, and the angle
between the vector and what its codes rebuild is kept with them.

* Probes: the members of list c lie nearer to its centroid than to that of v's own list, which is a half-space; v probes c if
  the angle between v and that half-space allows a link, however the vectors lie.
* A unit is a list, or a part of one that is long; a home is some units whose vectors stand together. Only codes travel: each
  unit's codes go to the homes that probe its list. There table lookups give each query's product with what the codes rebuild,
  and the kept angle turns the limit into a bound on it, so no pair at or over the limit is lost.
* The vectors of what passes go to a cell for each home and unit, are compared exactly there, and each link counts for both
  sides. Cells give counts and enough links to connect what they connect, never all pairs.

Each pair of classes meets once. Codebooks are fitted on at most FIT_VECTORS vectors, or FIT_LIST for each list; lists grow with
the vectors up to MOST_LISTS, then they lengthen. All vectors are coded and compared.
Vectors that are null, empty, zero or hold null or non-finite components link with nothing and stand alone. Vectors of different
dimensions never link. Rows that repeat a vec_id count as vectors of their own, sharing the id. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import work
from .components import connected_components

LIMIT = 0.95
SUBSPACES, WORDS, ROUNDS = 16, 64, 8
#: Vectors that codebooks are fitted on: so many, or so many for each list.
FIT_VECTORS, FIT_LIST = 20_000, 8
#: Vectors a list holds on average, lists at most, vectors of a unit, and lists of a home.
PER_LIST, MOST_LISTS, PART, HOME = 256, 16_384, 1024, 8
#: What single precision may lose in a sum of lookups.
SLACK = 1e-5

_APART = float(np.sqrt(1 - LIMIT * LIMIT))
_ANGLE = float(np.arccos(LIMIT))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length in double precision; rows hold finite numbers, not all zero."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 9) -> np.ndarray:
    r = np.random.default_rng(seed)
    centers = x[np.sort(r.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        counts = np.bincount(own, minlength=len(centers))
        sums = np.stack([np.bincount(own, x[:, d], len(centers)) for d in range(x.shape[1])], axis=1)
        some = counts > 0
        centers[some] = sums[some] / counts[some, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, block: int = 4096) -> np.ndarray:
    half = 0.5 * (centers * centers).sum(1)
    return np.concatenate([(x[i : i + block] @ centers.T - half).argmax(1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Unit centroids of the lists and the codebooks of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, n_lists: int):
        centers = kmeans(sample, n_lists)
        norms = np.sqrt((centers * centers).sum(1))
        self.centers = centers[norms > 1e-9] / norms[norms > 1e-9, None]
        if not len(self.centers):
            self.centers = sample[:1]
        self.width = sample.shape[1]
        self.cuts = np.linspace(0, self.width, min(SUBSPACES, self.width) + 1).astype(int)
        residuals = (sample - self.centers[self.lists(sample)])[:FIT_VECTORS]
        self.books = [kmeans(residuals[:, a:b], WORDS) for a, b in self.subspaces()]

    def subspaces(self) -> list[tuple[int, int]]:
        return list(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True))

    def lists(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[i : i + 4096] @ self.centers.T).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def codes(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and for each vector v the least product with what its codes rebuild that a vector linked with v has."""
        rebuilt = self.centers[own]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for s, (a, b) in enumerate(self.subspaces()):
            codes[:, s] = nearest(x[:, a:b] - rebuilt[:, a:b], self.books[s])
            rebuilt[:, a:b] += self.books[s][codes[:, s]]
        size = np.sqrt((rebuilt * rebuilt).sum(1))
        cosine = np.divide((x * rebuilt).sum(1), size, out=np.ones(len(x)), where=size > 0)
        angle = np.arccos(np.clip(cosine, -1, 1)) + _ANGLE
        least = size * np.where(angle < np.pi, np.cos(np.minimum(angle, np.pi)), -1)
        return codes, (least - SLACK * (1 + size)).astype(np.float32)

    def probes(self, near_own: np.ndarray, own: np.ndarray, near: np.ndarray, to: int) -> np.ndarray:
        """Which rows may be linked with a member of list `to`; near and near_own are their cosines with its centroid and their own."""
        apart = np.sqrt(np.maximum(2 - 2 * self.centers[own] @ self.centers[to], 0))
        return near >= near_own - _APART * apart - 1e-9

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each subspace the products of its words with the queries."""
        return [(self.books[s] @ q[:, a:b].T).astype(np.float32) for s, (a, b) in enumerate(self.subspaces())]


def lookup(tables: list[np.ndarray], codes: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Products of what codes rebuild (rows) with queries (columns); near: the queries' products with the list's centroid."""
    out = np.repeat(near.astype(np.float32)[None], len(codes), axis=0)
    for table, code in zip(tables, codes.T, strict=True):
        out += table.take(code, axis=0)
    return out


def goes(a: np.ndarray, b: int) -> np.ndarray:
    """Of two lists or parts, whether the vectors of a look among those of b, and not the other way."""
    return (a < b) != ((a + b) % 2 == 0)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, body): the vector's bytes, or null for what links with nothing."""
    for batch in batches:
        column = batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        values = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
        at = np.cumsum(lengths) - lengths
        bodies: list[bytes | None] = [None] * len(lengths)
        for width in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == width)
            x = values[at[rows][:, None] + np.arange(width)]
            for i in np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1)).tolist():
                bodies[rows[i]] = x[i].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["vec_id", "body"])


def _matrix(bodies: list[bytes], kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(bodies), kind).reshape(len(bodies), -1))


def _coded(indexes: dict[int, tuple[int, Index]], kind: str):
    """Classes with their list, codes and bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, bodies = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for width in np.unique(widths).tolist():
                first, index = indexes[width]
                at = np.flatnonzero(widths == width)
                x = _matrix([bodies[i] for i in at], kind)
                own = index.lists(x)
                codes, least = index.codes(x, own)
                packed = [c.tobytes() for c in codes]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(first + own, pa.int64()), batch.column(2).take(pa.array(at)), pa.array(packed, pa.binary()), pa.array(least)],
                    ["cid", "width", "list", "body", "codes", "least"],
                )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each unit."""
    for t in work.grouped(batches, ["list", "part"]):
        body = t["cid"].to_numpy().tobytes() + t["least"].to_numpy().tobytes() + b"".join(t["codes"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([t[k][0].as_py()], kind) for k, kind in (("list", pa.int64()), ("part", pa.int32()))] + [pa.array([t.num_rows], pa.int32()), pa.array([body], pa.binary())], ["list", "part", "n", "unit"])


def _index_of(indexes: dict[int, tuple[int, Index]], list_no: int) -> tuple[int, Index]:
    return next((first, index) for first, index in indexes.values() if first <= list_no < first + MOST_LISTS)


def _probed(indexes: dict[int, tuple[int, Index]], kind: str):
    """(home, list): the lists that a home's vectors probe, their own included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in work.grouped(batches, ["home"]):
            own = t["list"].to_numpy()
            first, index = _index_of(indexes, int(own[0]))
            own = own - first
            found = np.zeros(len(index.centers), bool)
            found[own] = True
            bodies = t["body"].to_pylist()
            for i in range(0, len(own), 1024):
                x, a = _matrix(bodies[i : i + 1024], kind), own[i : i + 1024]
                near_own = (x * index.centers[a]).sum(1)
                for to in np.flatnonzero(~found).tolist():
                    some = goes(a, to)
                    if some.any() and index.probes(near_own[some], a[some], x[some] @ index.centers[to], to).any():
                        found[to] = True
            to = first + np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), t["home"][0].as_py()), pa.int64()), pa.array(to, pa.int64())], ["home", "list"])

    return run


class _Home:
    """The vectors of a home as queries."""

    def __init__(self, index: Index, own: np.ndarray, part: np.ndarray, cid: np.ndarray, x: np.ndarray):
        self.index, self.own, self.part, self.cid, self.x = index, own, part, cid, x
        self.near_own = (x * index.centers[own]).sum(1)
        self.tables = index.tables(x)

    def candidates(self, to: int, part: int, cid: np.ndarray, least: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Queries and members of a unit that may be linked, and whether the unit is one of the home's own."""
        near = self.x @ self.index.centers[to]
        some = goes(self.own, to) & self.index.probes(self.near_own, self.own, near, to)
        mine = self.own == to
        some |= mine & ((self.part == part) | goes(self.part, part))
        rows = np.flatnonzero(some)
        same = bool((mine & (self.part == part)).any())
        q, m = np.zeros(len(self.cid), bool), np.zeros(len(cid), bool)
        for i in range(0, len(rows), 512):
            r = rows[i : i + 512]
            hit = lookup([t[:, r] for t in self.tables], codes, near[r]) >= least[:, None]
            if hit.any():
                b, a = np.nonzero(hit)
                a = r[a]
                other = ~((self.own[a] == to) & (self.part[a] == part) & (self.cid[a] >= cid[b]))
                q[a[other]] = m[b[other]] = True
        return np.flatnonzero(q), np.flatnonzero(m), same


_FOUND = "home long, list long, part int, side int, cid long"


def _searched(indexes: dict[int, tuple[int, Index]], kind: str):
    """Rows of a home, first its vectors, then the units that it probes: what of each may be linked. Units pass one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, now, rows = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or r["home"] != now:
                    home, now, rows = None, r["home"], []
                if r["unit"] is None:
                    rows.append((r["list"], r["part"], r["cid"], r["body"]))
                    continue
                if home is None:
                    own = np.array([x[0] for x in rows])
                    first, index = _index_of(indexes, int(own[0]))
                    home = _Home(index, own - first, np.array([x[1] for x in rows]), np.array([x[2] for x in rows]), _matrix([x[3] for x in rows], kind))
                    rows = []
                n, raw = r["n"], r["unit"]
                cid, least = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.float32, n, 8 * n)
                codes = np.frombuffer(raw, np.uint8, -1, 12 * n).reshape(n, -1)
                q, m, same = home.candidates(r["list"] - first, r["part"], cid, least, codes)
                if len(q):
                    mine = (home.own[q] == r["list"] - first) & (home.part[q] == r["part"])
                    sides = np.concatenate([np.where(mine & same, 2, 0), np.ones(len(m), np.int64)])
                    k = len(sides)
                    ids = np.concatenate([home.cid[q], cid[m]])
                    columns = [np.full(k, now), np.full(k, r["list"]), np.full(k, r["part"]), sides, ids]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["home", "list", "part", "side", "cid"])
        work.tidy()

    return run


def _linked(kind: str):
    """In each cell: how many vectors each class links with, and for each linked class the least class connected with it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in work.grouped(batches, ["home", "list", "part"]):
            side, cid, many = t["side"].to_numpy(), t["cid"].to_numpy(), t["many"].to_numpy()
            x = _matrix(t["body"].to_pylist(), kind)
            q, m = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
            links = np.empty((len(q), len(m)), bool)
            for i in range(0, len(q), 1024):
                links[i : i + 1024] = x[q[i : i + 1024]] @ x[m].T >= LIMIT
            own = np.flatnonzero(side[q] == 2)
            links[own] &= cid[q[own]][:, None] < cid[m][None]
            if not links.any():
                continue
            nodes, at = np.unique(cid, return_inverse=True)
            counts = np.zeros(len(nodes), np.int64)
            np.add.at(counts, at[q], links @ many[m])
            np.add.at(counts, at[m], many[q] @ links)
            label = np.arange(len(nodes))
            while True:  # least labels run along links
                before = label.copy()
                np.minimum.at(label, at[m], np.where(links, label[at[q]][:, None], len(nodes)).min(0))
                np.minimum.at(label, at[q], np.where(links, label[at[m]][None], len(nodes)).min(1))
                label = label[label]
                if (label == before).all():
                    break
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some], pa.int64()), pa.array(nodes[label[some]], pa.int64()), pa.array(counts[some], pa.int64())], ["src", "dst", "n"])

    return run


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    spark = vectors.sparkSession
    work.prepare(spark)
    folder = work.work_folder(spark)
    element = getattr(vectors.schema["embedding"].dataType, "elementType", None)
    kind, size, cast = ("<f4", 4, "array<float>") if isinstance(element, T.FloatType) else ("<f8", 8, "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(cast).alias("embedding")).mapInArrow(_bodies, "vec_id long, body binary")
    rows = work.staged(rows.withColumns({"h": F.xxhash64("body"), "g": F.xxhash64(F.lit(1), "body")}), folder, "rows")
    classes = rows.where("body is not null").groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("many"), F.first("body").alias("body"))
    classes = work.staged(classes.withColumns({"cid": F.monotonically_increasing_id(), "width": (F.length("body") / size).cast("int")}), folder, "classes")
    indexes: dict[int, tuple[int, Index]] = {}
    for r in sorted(classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()):
        lists = max(1, min(MOST_LISTS, r.n // PER_LIST))
        some = classes.where(F.col("width") == r.width).orderBy("h", "g").limit(max(FIT_VECTORS, FIT_LIST * lists)).select("body").collect()
        indexes[r.width] = (len(indexes) * MOST_LISTS, Index(_matrix([bytes(s.body) for s in some], kind), lists))
    if not indexes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    coded = work.staged(classes.select("cid", "width", "body").mapInArrow(_coded(indexes, kind), "cid long, width int, list long, body binary, codes binary, least float"), folder, "coded")
    # a row for each list, MOST_LISTS for each dimension at most
    parts = coded.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    placed = coded.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    alone = F.lit(1 << 50) + F.col("list") * (1 << 24) + F.col("part")
    placed = placed.withColumn("home", F.when(F.col("parts") == 1, F.floor(F.col("list") / HOME)).otherwise(alone).cast("long"))
    homes = work.staged(placed.select("home", "list", "part", "cid", "body").repartition("home").sortWithinPartitions("home"), folder, "homes")
    units = placed.select("list", "part", "cid", "codes", "least").repartition("list", "part").sortWithinPartitions("list", "part").mapInArrow(_packed, "list long, part int, n int, unit binary")
    units = work.staged(units, folder, "units")
    probed = homes.select("home", "list", "body").repartition("home").sortWithinPartitions("home").mapInArrow(_probed(indexes, kind), "home long, list long")
    sent = probed.join(units, "list").select("home", "list", "part", F.lit(None).cast("long").alias("cid"), F.lit(None).cast("binary").alias("body"), "n", "unit")
    both = homes.select("home", "list", "part", "cid", "body", F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("unit")).unionByName(sent)
    searched = both.withColumn("late", F.col("unit").isNotNull()).repartition("home").sortWithinPartitions("home", "late").mapInArrow(_searched(indexes, kind), _FOUND)
    found = work.staged(searched, folder, "found")
    cells = found.join(classes.select("cid", "body", "many"), "cid").repartition("home", "list", "part").sortWithinPartitions("home", "list", "part", "side", "cid")
    linked = work.staged(cells.select("home", "list", "part", "side", "cid", "many", "body").mapInArrow(_linked(kind), "src long, dst long, n long"), folder, "linked")
    components = connected_components(linked.select("src", "dst"), folder, "component").withColumnRenamed("id", "cid")
    counts = linked.groupBy(F.col("src").alias("cid")).agg(F.sum("n").alias("n"))
    members = classes.select("cid", "h", "g", "id", "many").join(counts, "cid", "left").join(components, "cid", "left")
    least = members.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    named = members.join(least, "component", "left").select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n"), F.coalesce("least", "id").alias("found"))
    out = rows.select("vec_id", "h", "g", F.col("body").isNotNull().alias("good")).join(named, ["h", "g"], "left")
    component = F.when(F.col("good"), F.col("found")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("good"), F.col("n")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


#: The same rows by comparing all pairs, for a table without repeated vec_id.
ORACLE_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  s AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
  l AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= {LIMIT}),
  r AS (SELECT vec_id AS src, vec_id AS dst FROM embeddings UNION SELECT r.src, l.dst FROM r JOIN l ON l.src = r.dst),
  c AS (SELECT src AS vec_id, min(dst) AS component_id FROM r GROUP BY src), n AS (SELECT src AS vec_id, count(*) AS n_links FROM l GROUP BY src)
  SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(work.table(spark, sf_dir, "embeddings"))
