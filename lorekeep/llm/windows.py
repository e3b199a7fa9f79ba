"""Packing by concatenation: the ids of all documents as one stream, cut into windows of a fixed length.

Pass one encodes each part of the table (what one task reads) and keeps the ids with the tokens that stand before them in their part; the
parts' totals, summed in two levels, tell where each part begins in the stream. Pass two cuts at the multiples of the length. A
window that a part does not hold whole is a boundary record: its pieces come from different parts and meet by their sequence.

What is left behind the last whole window is cut by the binary digits of its length, largest first, so no sequence needs padding.

Null and empty texts hold the end id alone. Rows that repeat a doc_id, or have none, are documents of their own. Other columns are
ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import packing, work
from .bpe import Encoder

LENGTH, END = 2048, 1
#: Parts whose totals are summed by one task; only the sums of such blocks meet in one.
BLOCK = 4096
#: Distinct pieces of text whose ids a task keeps.
CACHE = 250_000
#: Bytes of text encoded at once.
BATCH = 4_000_000


def _encoded(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, before = Encoder(tokenizer, CACHE), TaskContext.get().partitionId(), 0
        for batch in work.small_batches(batches, most=BATCH):
            data, offsets = work.text_buffers(batch.column(1))
            ids, ends = encoder.encode(data, offsets)
            ids, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
            wide = bool(int(ids.max()) > 0xFFFF)
            size = 4 if wide else 2
            body = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends * size), pa.py_buffer(ids.astype("<u4" if wide else "<u2"))])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part), pa.int64()), pa.array(before + ends[:-1], pa.int64()), batch.column(0), pa.array(np.diff(ends), pa.int64()), body.cast(pa.binary())], ["part", "before", "doc_id", "doc_tokens", "body"]
            )
            before += int(ends[-1])

    return run


def cuts(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the sequences behind the last whole window: the binary digits of what is left, largest first."""
    at, left = total // length * length, total % length
    out = []
    while left:
        size = 1 << (left.bit_length() - 1)
        out.append((at, size))
        at, left = at + size, left - size
    return out


def bounds(a: int, b: int, total: int, length: int) -> list[tuple[int, int, int]]:
    """(sequence, from, to) of the ids a to b of the stream."""
    whole = total // length
    out = [(w, max(a, w * length), min(b, (w + 1) * length)) for w in range(a // length, min(-(-b // length), whole))]
    if b > whole * length:
        out += [(whole + k, max(a, at), min(b, at + size)) for k, (at, size) in enumerate(cuts(total, length)) if at < b and at + size > a]
    return out


def _begins(sequence: int, total: int, length: int) -> tuple[int, int]:
    """Where a sequence begins and ends in the stream."""
    whole = total // length
    at, size = (sequence * length, length) if sequence < whole else cuts(total, length)[sequence - whole]
    return at, at + size


def _pieces(total: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("doc_id", "at", "doc_tokens", "first", "last"))
            for doc, at, n, first, last, body in zip(*columns, batch.column(batch.schema.get_field_index("body")), strict=True):
                raw = memoryview(body.as_buffer())
                ids = raw if len(raw) == 4 * n else memoryview(np.frombuffer(raw, "<u2").astype("<u4")).cast("B")
                for sequence, a, b in bounds(at, at + n, total, length):
                    begin, end = _begins(sequence, total, length)
                    rows.append((doc, a - at, b - a, zlib.crc32(ids[4 * (a - at) : 4 * (b - at)]), n, sequence, a - begin, begin < first or end > last))
            if rows:
                kinds = (*(pa.int64(),) * 7, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], PIECES)

    return run


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"]


def _filled(total: int, length: int):
    """Whole sequences of runs of documents that follow each other in the stream; what begins or ends inside a sequence comes as a part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now, begun, size = None, 0, 0  # the sequence being filled, where its held ids begin, how many they are

        def flush(rows):
            if size:
                begin, end = _begins(now, total, length)
                rows.append((now, begun - begin, np.concatenate(held).astype(np.int64), size == end - begin))

        for batch in batches:
            rows: list[tuple] = []
            columns = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("at", "doc_tokens"))
            for at, n, body in zip(*columns, batch.column(batch.schema.get_field_index("body")), strict=True):
                raw = body.as_buffer()
                ids = np.frombuffer(raw, "<u4" if raw.size == 4 * n else "<u2")
                for sequence, a, b in bounds(at, at + n, total, length):
                    if sequence != now or a != begun + size:
                        flush(rows)
                        held, now, begun, size = [], sequence, a, 0
                    held.append(ids[a - at : b - at])
                    size += b - a
            if rows:
                yield _sequences(rows)
        rows = []
        flush(rows)
        if rows:
            yield _sequences(rows)

    return run


def _sequences(rows: list[tuple]) -> pa.RecordBatch:
    names, offsets, ids, whole = zip(*rows, strict=True)
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int64()), pa.array(offsets, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(whole, pa.bool_())], ["sequence_id", "offset", "ids", "whole"]
    )


@dataclass
class Stream:
    """Encoded documents with their places in the stream of all ids."""

    rows: DataFrame
    total: int
    length: int

    def pieces(self) -> DataFrame:
        """One row for each piece of a document: where it lies in its document and in which sequence, and at which place, it lands.
        `boundary` tells the pieces of windows that their part does not hold whole."""
        return self.rows.mapInArrow(_pieces(self.total, self.length), ", ".join(f"{c} {'boolean' if c == 'boundary' else 'long'}" for c in PIECES))

    def sequences(self) -> DataFrame:
        """(sequence_id, ids). Tasks make whole what they can; only boundary records are shuffled, at most `length` to a sequence."""
        made = self.rows.mapInArrow(_filled(self.total, self.length), "sequence_id long, offset long, ids array<long>, whole boolean")
        made = work.staged(made, work.work_folder(made.sparkSession), "sequences")
        joined = made.where("not whole").groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
        return made.where("whole").select("sequence_id", "ids").unionByName(joined)


def concatenated(docs: DataFrame, tokenizer: str, end_id: int = END, length: int = LENGTH) -> Stream:
    """Encode whole texts, each followed by the end id, and lay them out one behind the other."""
    spark = docs.sparkSession
    work.prepare(spark)
    folder = work.work_folder(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = work.staged(texts.mapInArrow(_encoded(tokenizer, end_id), "part long, before long, doc_id long, doc_tokens long, body binary"), folder, "ids")
    totals = work.staged(ids.groupBy("part").agg(F.sum("doc_tokens").alias("tokens")), folder, "totals").withColumn("block", F.expr(f"part div {BLOCK}"))
    before = lambda *by: F.coalesce(F.sum("tokens").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = totals.groupBy("block").agg(F.sum("tokens").alias("tokens")).select("block", before("block").alias("base"))
    first = (F.col("base") + before("block", "part")).alias("first")
    places = work.staged(totals.join(blocks, "block").select("part", first, (first + F.col("tokens")).alias("last")), folder, "places")
    total = places.agg(F.max("last")).head()[0] or 0
    rows = ids.join(places, "part").withColumn("at", F.col("first") + F.col("before"))
    return Stream(rows.select("doc_id", "at", "doc_tokens", "first", "last", "body"), total, length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concatenated(work.table(spark, sf_dir, "documents"), packing.default_tokenizer()).pieces()
