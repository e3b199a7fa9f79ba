"""Content-addressed store of token ids.

Ids of each document are cut where a rolling hash of the last 16 ids meets a condition, so equal passages give equal chunks.
A chunk lies in the store once, under its digest; a recipe names each document's chunks in order; each recipe has the root of
a Merkle tree over them and the manifest a root over the recipes of each of its parts, with their ids, starts and sizes. Reading
verifies chunks, recipes and manifest, and fails where one does not match.

Folder: chunks/ (digest, n, size, body: ids as little-endian unsigned 16- or 32-bit numbers, zstd), recipes/ (doc_id, start,
n_tokens, chunks: digests back to back, root; ascending doc_id over and within its parts) and manifest/ (part, n_docs, root).

Null and empty texts hold the end id alone. Rows that repeat a doc_id count as documents of their own. Other columns are
ignored. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .bpe import Encoder

#: Ids of a chunk: none below, none above, and one cut in so many positions between.
LEAST, MOST, SPACING = 64, 8192, 512
DIGEST = 16
RECIPES = "part int, doc_id long, start long, n_tokens long, chunks binary, root binary"
_GEAR = np.random.default_rng(20240131).integers(0, 2**32, 1 << 16, dtype=np.uint32)


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each position a hash of the 16 ids that end there."""
    h = _GEAR[ids & 0xFFFF]
    for step in (1, 2, 4, 8):
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h = nxt
    return h


def cuts(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For each document the positions where its chunks end."""
    marks = np.flatnonzero((rolling(ids) >> np.uint32(20)) % np.uint32(SPACING) == 0) + 1 if len(ids) else np.zeros(0, np.int64)
    first = np.searchsorted(marks, ends[:-1], side="right")
    last = np.searchsorted(marks, ends[1:], side="left")
    out = []
    marks = marks.tolist()
    for a, b, i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), first.tolist(), last.tolist(), strict=True):
        at, own = a, []
        for m in marks[i:j]:
            while m - at > MOST:
                at += MOST
                own.append(at)
            if m - at >= LEAST:
                at = m
                own.append(at)
        while b - at > MOST:
            at += MOST
            own.append(at)
        if b > at:
            own.append(b)
        out.append(own)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up alone."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=DIGEST).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=DIGEST).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.blake2b(b"\2", digest_size=DIGEST).digest()


def digest_of(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=DIGEST).digest()


def _cutter(tokenizer: str, end_id: int):
    """Rows of (doc_id, n_tokens, chunks) for documents and (digest, ...) for each chunk that is new to the task's recent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, squeeze = Encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        seen: set[bytes] = set()
        for batch in work.small_batches(batches, most=8_000_000):
            data, offsets = work.text_buffers(batch.column(1))
            ids, ends = encoder.encode(data, offsets)
            with_end = np.insert(ids, ends[1:], end_id).astype("<u4")
            ends = ends + np.arange(len(ends))
            raw = memoryview(with_end).cast("B")
            narrow = with_end.astype("<u2")
            wide = bool(len(with_end)) and int(with_end.max()) > 0xFFFF
            packed = raw if wide else memoryview(narrow).cast("B")
            size = 4 if wide else 2
            recipes, rows = [], []
            for at, own in zip(ends[:-1].tolist(), cuts(with_end, ends), strict=True):
                names = []
                for to in own:
                    piece = raw[4 * at : 4 * to]
                    name = hashlib.blake2b(piece, digest_size=DIGEST).digest()
                    names.append(name)
                    if name not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(name)
                        rows.append((name, to - at, size, zlib.crc32(piece), squeeze.compress(packed[size * at : size * to])))
                    at = to
                recipes.append(b"".join(names))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ends[1:] - ends[:-1], pa.int64()), pa.array(recipes, pa.binary()), *(pa.nulls(n, t) for t in (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                ["doc_id", "n_tokens", "chunks", "digest", "n", "size", "crc32", "body"],
            )
            if rows:
                m = len(rows)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True))],
                    ["doc_id", "n_tokens", "chunks", "digest", "n", "size", "crc32", "body"],
                )

    return run


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> str:
    """Encode whole texts and write the store; each distinct chunk lies in it once."""
    spark = docs.sparkSession
    work.prepare(spark)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _cutter(tokenizer, end_id), "doc_id long, n_tokens long, chunks binary, digest binary, n int, size int, crc32 long, body binary"
    )
    # chunks and recipes leave the same pass; a digest's rows meet in one partition, recipes are spread by id
    dealt = cut.repartition(F.coalesce(F.col("digest"), F.xxhash64("doc_id").cast("string").cast("binary")))
    both = dealt.mapInArrow(_split_once, cut.schema).withColumn("kind", F.when(F.col("digest").isNull(), "recipe").otherwise("chunk"))
    both.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/pass")
    spread = spark.read.schema(both.schema).parquet(f"{folder}/pass").where("kind = 'recipe'").select("doc_id", "n_tokens", "chunks")
    ordered = spread.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    work.staged(ordered.withColumn("part", F.spark_partition_id()), folder, "ordered")
    parts = spark.read.parquet(f"{folder}/ordered")
    # one row for each part, so what the driver gets grows with parts, not rows
    sums = sorted((r.part, r.n) for r in parts.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    at, firsts = 0, []
    for part, n in sums:
        firsts.append((part, at))
        at += n
    base = spark.createDataFrame(firsts, "part int, base long")
    recipes = parts.repartition("part").sortWithinPartitions("part", "doc_id", "n_tokens", "chunks").join(F.broadcast(base), "part")
    recipes.mapInArrow(_place, RECIPES).write.mode("overwrite").parquet(f"{folder}/recipes")
    done = spark.read.parquet(f"{folder}/recipes")
    part_roots(done).write.mode("overwrite").parquet(f"{folder}/manifest")
    work.forget(spark, f"{folder}/ordered")
    work.forget(spark, f"{folder}/pass/kind=recipe")
    return folder


def _split_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, x in enumerate(batch.column(3).to_pylist()):
            if x is None or x not in seen:
                keep.append(i)
                if x is not None:
                    seen.add(x)
        if keep:
            yield batch.take(pa.array(keep))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """start of each document and the root over its chunks; rows come by part in ascending doc_id."""
    part, at = None, 0
    for batch in batches:
        parts, base, sizes = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("part", "base", "n_tokens"))
        chunks = batch.column(batch.schema.get_field_index("chunks")).to_pylist()
        starts, roots = [], []
        for p, b, n, c in zip(parts, base, sizes, chunks, strict=True):
            if p != part:
                part, at = p, b
            starts.append(at)
            at += n
            roots.append(merkle_root([c[i : i + DIGEST] for i in range(0, len(c), DIGEST)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("part")), batch.column(batch.schema.get_field_index("doc_id")), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(chunks, pa.binary()), pa.array(roots, pa.binary())],
            ["part", "doc_id", "start", "n_tokens", "chunks", "root"],
        )


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in work.grouped(batches, ["part"]):
        places = np.stack([t[k].to_numpy() for k in ("doc_id", "start", "n_tokens")], axis=1).astype("<i8")
        root = merkle_root([place.tobytes() + root for place, root in zip(places, t["root"].to_pylist(), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array([t["part"][0].as_py()], pa.int32()), pa.array([t.num_rows], pa.int64()), pa.array([root], pa.binary())], ["part", "n_docs", "root"])


def part_roots(recipes: DataFrame) -> DataFrame:
    """(part, n_docs, root): a root over each part's recipes, their ids, starts and sizes."""
    rows = recipes.select("part", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "start", "n_tokens", "root")
    return rows.repartition("part").sortWithinPartitions("part", "start").mapInArrow(_part_roots, "part int, n_docs long, root binary")


def verify_manifest(spark: SparkSession, folder: str) -> None:
    """Compare the recipes with the manifest: a root for each part, no part missing or added."""
    recipes = spark.read.schema(RECIPES).parquet(f"{folder}/recipes")
    known = spark.read.schema("part int, n_docs long, root binary").parquet(f"{folder}/manifest")
    wrong = part_roots(recipes).withColumn("n", F.lit(1)).unionByName(known.withColumn("n", F.lit(-1))).groupBy("part", "n_docs", "root").agg(F.sum("n").alias("n")).where("n <> 0")
    if not wrong.isEmpty():
        raise ValueError("the recipes do not match the manifest")


def chunk_table(spark: SparkSession, folder: str) -> DataFrame:
    schema = "doc_id long, n_tokens long, chunks binary, digest binary, n int, size int, crc32 long, body binary, kind string"
    return spark.read.schema(schema).parquet(f"{folder}/pass").where("kind = 'chunk'").select("digest", "n", "size", "crc32", "body")


def _opened(body: bytes, size: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), f"<u{size}").astype("<u4")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decode each chunk of the store, compare it with its digest and sum it up."""
    for batch in batches:
        names, sizes, bodies = (batch.column(i).to_pylist() for i in (0, 2, 4))
        n, crc = [], []
        for name, size, body in zip(names, sizes, bodies, strict=True):
            ids = _opened(body, size)
            if digest_of(ids) != name:
                raise ValueError(f"chunk {name.hex()} does not match its digest")
            n.append(len(ids))
            crc.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["digest", "n", "crc32"])


_MAPS: list[np.ndarray] = []


def _mapped(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, as what it makes of each value of each byte, applied to many crcs."""
    out = table[0][crc & 0xFF]
    for k in (1, 2, 3):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & 0xFF]
    return out


def _map(k: int) -> np.ndarray:
    """What 2^k bytes of zeros make of a crc32."""
    while len(_MAPS) <= k:
        if _MAPS:
            _MAPS.append(np.stack([_mapped(_MAPS[-1], t) for t in _MAPS[-1]]))
            continue
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = (byte >> 1) ^ np.where(byte & 1, np.uint32(0xEDB88320), np.uint32(0))
        # one zero byte shifts the crc down and folds its lowest byte in
        high = [np.arange(256, dtype=np.uint32) << np.uint32(8 * (j - 1)) for j in (1, 2, 3)]
        _MAPS.append(np.stack([byte, *high]))
    return _MAPS[k]


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each crc32 becomes if `after` bytes of zeros follow."""
    out, after, k = crc.astype(np.uint32), after.astype(np.int64), 0
    while (after >> k).any():
        some = (after >> k) & 1 == 1
        out[some] = _mapped(_map(k), out[some])
        k += 1
    return out


def crc32_of_parts(crcs: np.ndarray, sizes: np.ndarray) -> int:
    """crc32 of byte strings one after the other, from the crc32 and the size of each."""
    after = sizes.sum() - np.cumsum(sizes)
    return int(np.bitwise_xor.reduce(shifted(crcs, after))) if len(crcs) else 0


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by recipe and place: number of ids and crc32 of each document. Its chunks must be there, its root that of the recipe and its
    number of ids that of the manifest. Documents of a batch are summed up at once; one that runs on waits for its end."""

    def done(t: pa.Table) -> pa.RecordBatch:
        if t["digest"].null_count or t["n"].null_count:
            raise ValueError("the store lacks a chunk that a recipe names")
        starts, sizes = t["start"].to_numpy(), 4 * t["n"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], starts[1:] != starts[:-1])))
        ends = np.append(first[1:], len(starts))
        total = np.add.reduceat(sizes, first)
        upto = np.cumsum(sizes)
        after = np.repeat(upto[ends - 1], ends - first) - upto
        crc = np.bitwise_xor.reduceat(shifted(t["crc32"].to_numpy(), after), first)
        digests, roots, ids = t["digest"].to_pylist(), t["root"].take(first).to_pylist(), t["n_tokens"].to_numpy()[first]
        for a, b, root in zip(first.tolist(), ends.tolist(), roots, strict=True):
            if merkle_root(digests[a:b]) != root:
                raise ValueError("a recipe does not match its root")
        if (total != 4 * ids).any():
            raise ValueError("a document's chunks do not add up to its ids")
        return pa.RecordBatch.from_arrays([t["doc_id"].take(first).combine_chunks(), pa.array(starts[first]), pa.array(ids), pa.array(crc.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column(batch.schema.get_field_index("start")).to_numpy()
        last = int(np.searchsorted(starts, starts[-1], side="left")) if (starts[1:] >= starts[:-1]).all() else int(np.flatnonzero(starts != starts[-1])[-1]) + 1
        if held and held[-1].column(held[-1].schema.get_field_index("start"))[-1].as_py() != starts[0]:
            yield done(pa.Table.from_batches(held))
            held = []
        if last:
            yield done(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield done(pa.Table.from_batches(held))


def _named_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each chunk that a recipe names, with its place."""
    recipes = spark.read.schema(RECIPES).parquet(f"{folder}/recipes")
    at = F.explode(F.sequence(F.lit(0), F.expr(f"cast(length(chunks) / {DIGEST} as int) - 1")))
    return recipes.withColumn("place", at).withColumn("digest", F.expr(f"substring(chunks, place * {DIGEST} + 1, {DIGEST})")).select("part", "doc_id", "start", "n_tokens", "root", "place", "digest")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the chunks in the store.

    Each chunk is decoded and verified once; sums of documents come from those of their chunks, so no body is moved again.
    """
    work.prepare(spark)
    verify_manifest(spark, folder)
    chunks = chunk_table(spark, folder).mapInArrow(_verified, "digest binary, n long, crc32 long")
    joined = _named_chunks(spark, folder).join(chunks, "digest", "left")
    return joined.repartition("start").sortWithinPartitions("part", "start", "place").mapInArrow(_summed, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in work.grouped(batches, ["part", "start"]):
        if t["body"].null_count:
            raise ValueError("the store lacks a chunk that a recipe names")
        for name, body, size in zip(t["digest"].to_pylist(), t["body"].to_pylist(), t["size"].to_pylist(), strict=True):
            if digest_of(_opened(body, size)) != name:
                raise ValueError(f"chunk {name.hex()} does not match its digest")
        if merkle_root(t["digest"].to_pylist()) != t["root"][0].as_py():
            raise ValueError("a recipe does not match its root")
        ids = np.concatenate([_opened(b, s) for b, s in zip(t["body"].to_pylist(), t["size"].to_pylist(), strict=True)])
        yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks()[:1], t["start"].combine_chunks()[:1], pa.array([ids.tolist()], pa.list_(pa.int64()))], ["doc_id", "start", "ids"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of each document, rebuilt from its chunks."""
    work.prepare(spark)
    verify_manifest(spark, folder)
    joined = _named_chunks(spark, folder).join(chunk_table(spark, folder), "digest", "left")
    return joined.repartition("start").sortWithinPartitions("part", "start", "place").mapInArrow(_assembled, "doc_id long, start long, ids array<long>")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every document's start, number of ids and crc32, as read back from the store written for this query."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = write_store(work.table(spark, sf_dir, "documents"), work.work_folder(spark), tokenizer)
    return read_digests(spark, folder)
