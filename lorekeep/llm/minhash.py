"""Near-duplicates by b-bit MinHash.

1. Each text gives its set of distinct 5-word shingles, HASHES minima over it, band keys of some rows of them, and the low BITS bits
   of every minimum packed into words. Texts with equal sets become one class at once.
2. Classes that share a band key form a bucket. A bucket's member with most bucket mates over all its bands leads it; members
   and leader are candidates. In a bucket of two the packed bits decide at once: agreements are counted in bit operations and
   corrected for the chance that low bits agree anyway. Larger buckets stay whole, so no link between two followers is lost.
3. Candidates join into clumps, outside which no link can lie. In each clump texts are compared on their full sets, beginning
   with the text that overlaps most, until those left apart have been compared with all others. A clump over BLOCK classes or SHINGLES shingles is
   first thinned by comparing its members with their leaders, dealt over many tasks, and then cut into blocks; each pair of
   blocks is a task, and texts that are already connected are not compared again.

Links: 100 * intersection >= percent * union, always confirmed on full sets; percent is PERCENT unless the caller asks for another,
and the bands and the looseness of estimates follow from it.
Texts that are null, empty or without words have an empty set and link with nothing, as do rows without doc_id, which are kept and
have no component. Rows that repeat a doc_id count as one document. Other columns are ignored. An empty table gives no rows. Long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .components import connected_components
from .shingles import mix, shingle_sets

WIDTH, PERCENT = 5, 85
HASHES, BITS = 128, 4
#: Share of pairs at the very limit that may meet in no band.
MISSED = 1e-4
#: Classes and shingles that one block holds; a task compares two blocks.
BLOCK, SHINGLES = 2000, 2_000_000

_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
_BAND = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

SIGNED = "doc_id long, n long, hi long, lo long, bands array<long>, packed array<long>"


def band_rows(percent: int) -> int:
    """Most minima of a band key with which a pair at the limit shares one of the bands: 6 (21 bands) for 85, 5 (25 bands) for 80."""
    alike = percent / 100
    return max([1, *(n for n in range(1, HASHES) if (1 - alike**n) ** (HASHES // n) <= MISSED)])


def loose(percent: int) -> float:
    """Pairs of a bucket of two go on if their corrected estimate is at least this: the limit less 8 standard deviations."""
    alike = percent / 100
    return round(alike - 8 * (alike * (1 - alike) / HASHES) ** 0.5, 2)


def minima(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES minima of each set that is not empty, as 32-bit numbers."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((HASHES, len(starts)), np.uint64)
    buffer = np.empty(len(flat), np.uint64)
    for j in range(HASHES):
        np.multiply(flat, _FACTORS[j], out=buffer)
        np.right_shift(buffer, np.uint64(32), out=buffer)
        np.minimum.reduceat(buffer, starts, out=out[j])
    return out


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    keys = np.empty((HASHES // rows, least.shape[1]), np.uint64)
    for b in range(len(keys)):
        keys[b] = mix((mix(least[b * rows : (b + 1) * rows]) * _BAND[:rows, None]).sum(0, dtype=np.uint64) + np.uint64(b))
    return keys.T.astype(np.int64)


def packed_bits(least: np.ndarray) -> np.ndarray:
    """Low BITS bits of the minima, 64 / BITS to a word."""
    per = 64 // BITS
    low = least & np.uint64((1 << BITS) - 1)
    shifts = (np.arange(HASHES, dtype=np.uint64) % np.uint64(per)) * np.uint64(BITS)
    return np.bitwise_or.reduce((low << shifts[:, None]).reshape(HASHES // per, per, -1), axis=1).T.astype(np.int64)


def _sign(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work.small_batches(batches):
            flat, offsets = shingle_sets(*work.text_buffers(batch.column(1)), WIDTH)
            sizes = np.diff(offsets)
            some = np.flatnonzero(sizes)
            hi, lo = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            bands, packed = np.zeros((0, HASHES // rows), np.int64), np.zeros((0, HASHES * BITS // 64), np.int64)
            if len(some):
                starts = offsets[:-1][some]
                hi[some] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                lo[some] = np.bitwise_xor.reduceat(mix(flat + np.uint64(0x1234567)), starts)
                least = minima(flat, offsets)
                bands, packed = band_keys(least, rows), packed_bits(least)
            full = np.concatenate(([0], np.cumsum(sizes > 0)))
            lists = [pa.ListArray.from_arrays(pa.array(full * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (bands, packed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hi.astype(np.int64)), pa.array(lo.astype(np.int64)), *lists], ["doc_id", "n", "hi", "lo", "bands", "packed"])

    return run


def estimate(a: str, b: str) -> "F.Column":
    """Similarity from packed bits: agreeing groups of BITS by bit counts, corrected for agreement by chance."""
    words = HASHES * BITS // 64
    lowest = sum(1 << i for i in range(0, 64, BITS))
    lowest -= (lowest >> 63) << 64
    apart = None
    for i in range(words):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for step in (1, 2)[: BITS.bit_length() - 1]:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        count = F.bit_count(x.bitwiseAND(F.lit(lowest)))
        apart = count if apart is None else apart + count
    chance = 2.0**-BITS
    return ((1 - apart / HASHES) - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def spanning_links(flat: np.ndarray, offsets: np.ndarray, known: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links, enough to connect what is connected. known: texts with equal marks are connected already.

    A text is compared with all others at once: marks on its shingles, summed over the others' sets. This ends when all texts
    outside the largest component have been compared with all.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    _, inside = np.unique(flat, return_inverse=True)
    common = np.bincount(inside)
    order = np.argsort(-np.add.reduceat(common[inside], offsets[:-1]) / sizes, kind="stable")
    component = np.unique(known, return_inverse=True)[1].astype(np.int64)
    counts = np.bincount(component, minlength=n)
    alive = int((counts > 0).sum())
    mark = np.zeros(len(common), np.int64)
    links: list[tuple[int, int]] = []
    for p in order.tolist():
        if alive == 1:
            break
        own = component[p]
        # the largest component's texts need no turn of their own, but the first text may join much at once
        if counts[own] == counts.max() and (links or counts[own] > 1) and counts[own] * 2 > n:
            continue
        mark[inside[offsets[p] : offsets[p + 1]]] = 1
        both = np.add.reduceat(mark[inside], offsets[:-1])
        mark[inside[offsets[p] : offsets[p + 1]]] = 0
        hit = np.flatnonzero(100 * both >= percent * (sizes + sizes[p] - both))
        for other in np.unique(component[hit]).tolist():
            if other != own:
                q = int(hit[component[hit] == other][0])
                links.append((p, q))
                counts[own] += counts[other]
                counts[other] = 0
                component[component == other] = own
                alive -= 1
    return links


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, set) of texts whose set is still the class's."""
    for batch in work.small_batches(batches):
        flat, offsets = shingle_sets(*work.text_buffers(batch.column(1)), WIDTH)
        bodies = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bodies, pa.binary())], ["id", "clump", "body"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
            if keep:
                yield batch.select(["src", "dst"]).take(pa.array(keep))

    return run


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in work.grouped(batches, ["clump", "cell"]):
            ids = t["id"].to_numpy()
            if len(ids) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t["body"].to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            links = spanning_links(np.concatenate(sets), offsets, t["known"].to_numpy(), percent)
            if links:
                a, b = (ids[np.array(x)] for x in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])

    return run


def near_duplicates(docs: DataFrame, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; texts alike by percent or more are linked."""
    spark = docs.sparkSession
    work.prepare(spark)
    folder = work.work_folder(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = work.staged(docs.mapInArrow(_sign(band_rows(percent)), SIGNED), folder, "signed")
    classes = work.staged(
        signed.where("n > 0 and doc_id is not null").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("packed").alias("packed")), folder, "classes"
    )
    keyed = classes.select("id", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    mates = work.staged(keyed.join(buckets, "band"), folder, "mates")
    fame = mates.groupBy("id").agg(F.sum("size").alias("fame"))
    leaders = mates.join(fame, "id").groupBy("band").agg(F.max(F.struct("fame", (-F.col("id")).alias("minus"))).alias("top")).select("band", (-F.col("top.minus")).alias("leader"))
    pairs = mates.join(leaders, "band").where("id <> leader").groupBy(F.col("leader").alias("src"), F.col("id").alias("dst")).agg(F.max("size").alias("size"))
    bits = classes.select("id", "packed")
    pairs = pairs.join(bits.select(F.col("id").alias("src"), F.col("packed").alias("a")), "src").join(bits.select(F.col("id").alias("dst"), F.col("packed").alias("b")), "dst")
    candidates = work.staged(pairs.select("src", "dst", "size", estimate("a", "b").alias("alike")).where(f"size > 2 or alike >= {loose(percent)}"), folder, "candidates")
    work.forget(spark, f"{folder}/mates")
    clumps = connected_components(candidates, folder, "clump").withColumnRenamed("component", "clump")
    members = docs.join(clumps, F.col("doc_id") == F.col("id")).select("doc_id", "text", "clump")
    sets = work.staged(members.mapInArrow(_sets, "id long, clump long, body binary").groupBy("id", "clump").agg(F.min("body").alias("body")), folder, "sets")
    sizes = sets.groupBy("clump").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.length("body")) / (8 * SHINGLES))).cast("int").alias("blocks"))
    large = sizes.where("blocks > 1")
    known = sets.select("id", F.col("id").alias("known")).limit(0)
    links = []
    if not large.isEmpty():
        in_large = sets.join(large, "clump").select("id", "body")
        led = candidates.select("src", "dst").join(in_large.select(F.col("id").alias("dst"), F.col("body").alias("b")), "dst")
        # a leader may have any number of followers: its set is dealt to as many salts as they need
        salts = led.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("salts"))
        lead = in_large.select(F.col("id").alias("src"), F.col("body").alias("a")).join(salts, "src").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        led = led.join(salts, "src").withColumn("salt", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int"))
        confirmed = led.join(lead, ["src", "salt"]).select("src", "dst", "a", "b").mapInArrow(_confirm(percent), "src long, dst long")
        first = work.staged(confirmed, folder, "led")
        links.append(first)
        known = connected_components(first, folder, "led").withColumnRenamed("component", "known")
    dealt = sets.join(sizes, "clump").join(known, "id", "left").withColumn("known", F.coalesce("known", "id"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least("own", j) * F.col("blocks") + F.greatest("own", j))
    dealt = dealt.withColumn("cell", F.explode(cells)).select("clump", "cell", "id", "known", "body")
    compared = dealt.repartition("clump", "cell").sortWithinPartitions("clump", "cell", "id").mapInArrow(_compare(percent), "src long, dst long")
    links.append(work.staged(compared, folder, "compared"))
    edges = links[0] if len(links) == 1 else links[0].union(links[1])
    components = connected_components(edges, folder, "component")
    named = classes.select("hi", "lo", "n", "id").join(components, "id", "left").select("hi", "lo", "n", F.coalesce("component", "id").alias("found"))
    out = signed.select("doc_id", "n", "hi", "lo").join(named, ["hi", "lo", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: The same rows by counting the shingles that each two documents share, for a table without repeated doc_id.
ORACLE_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  k AS (SELECT src, dst FROM p JOIN n a ON a.doc_id = src JOIN n b ON b.doc_id = dst WHERE 100 * common >= {PERCENT} * (a.n + b.n - common)),
  l AS (SELECT src, dst FROM k UNION ALL SELECT dst, src FROM k),
  r AS (SELECT doc_id AS src, doc_id AS dst FROM documents UNION SELECT r.src, l.dst FROM r JOIN l ON l.src = r.dst),
  c AS (SELECT src AS doc_id, min(dst) AS component_id FROM r GROUP BY src)
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(work.table(spark, sf_dir, "documents"))
