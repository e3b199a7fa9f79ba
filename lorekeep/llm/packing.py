"""Bounded-space online best-fit packing of tokenized documents.

Each packer keeps a fixed number of open sequences, indexed by free space in one bitset: the sequence with the least room that
still holds the piece takes it. When no open one does and all places are taken, the fullest closes. A document longer than a
sequence is cut; its first piece takes the odd rest so that all others fill a sequence each.

Null and empty texts hold the end id alone. Rows that repeat a doc_id are documents of their own. Other columns are ignored.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .bpe import Encoder

LENGTH, OPEN = 1024, 4096
#: Distinct pieces of text whose ids a task keeps; few, as earlier stages' memory may still be held by its worker.
CACHE = 250_000
#: Pieces that one packer takes; each packer leaves at most OPEN sequences part empty.
PACKER_PIECES = 400_000


class BestFit:
    """Open sequences keyed by free space."""

    def __init__(self, length: int, most_open: int):
        self.length, self.most = length, most_open
        self.bits, self.at = 0, {}
        self.open, self.next = 0, 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            names = self.at[free]
            name = names.pop()
            if not names:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            if self.open == self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.at[fullest].pop()
                if not self.at[fullest]:
                    self.bits ^= 1 << fullest
                self.open -= 1
            name, free = self.next, self.length
            self.next += 1
        left = free - size
        if left:
            self.at.setdefault(left, []).append(name)
            self.bits |= 1 << left
            self.open += 1
        return name, self.length - free


def _pieces(tokenizer: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, CACHE)
        for batch in work.small_batches(batches, most=6_000_000):
            data, offsets = work.text_buffers(batch.column(1))
            ids, ends = encoder.encode(data, offsets)
            raw = memoryview(np.insert(ids, ends[1:], end_id).astype("<u4")).cast("B")
            ends = (ends + np.arange(len(ends))).tolist()
            rows = []
            for doc, a, b in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                at, to, piece = a, a + ((b - a) % length or length), 0
                while at < b:
                    rows.append((doc, piece, at - a, to - at, zlib.crc32(raw[4 * at : 4 * to])))
                    at, to, piece = to, to + length, piece + 1
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _packer(length: int, most_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, packer = BestFit(length, most_open), None
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("length")).to_pylist()
            packers = batch.column(batch.schema.get_field_index("packer")).to_pylist()
            names, places = [], []
            for p, n in zip(packers, sizes, strict=True):
                if p != packer:
                    fit, packer = BestFit(length, most_open), p
                name, place = fit.place(n)
                names.append((p << 40) | name)
                places.append(place)
            keep = [batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(names, pa.int64()), pa.array(places, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, most_open: int = OPEN, packer_pieces: int = PACKER_PIECES) -> DataFrame:
    """One row for each piece: where it lies in its document and in which sequence, and at which place, it lands."""
    spark = docs.sparkSession
    work.prepare(spark)
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, end_id, length), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = work.staged(pieces, work.work_folder(spark), "pieces")
    packers = max(1, -(-pieces.count() // packer_pieces))
    dealt = pieces.withColumn("packer", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(packers)))
    # the order is total, so a task that runs again places each piece where it did before
    order = ["packer", F.xxhash64("doc_id"), "doc_id", "piece", "length", "ids_crc32"]
    packed = dealt.repartition(packers, "packer").sortWithinPartitions(*order)
    return packed.mapInArrow(_packer(length, most_open), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _fill(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in work.small_batches(batches):
            data, offsets = work.text_buffers(batch.column(1))
            ids, ends = encoder.encode(data, offsets)
            ids, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
            starts, lengths = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = [ids[ends[i] + s : ends[i] + s + n].tolist() for i, (s, n) in enumerate(zip(starts, lengths, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(5), pa.array(out, pa.list_(pa.int64()))], ["sequence_id", "offset", "ids"])

    return run


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids. doc_id must be unique."""
    work.prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    filled = pieces.join(texts, "doc_id").select("doc_id", "text", "start", "length", "sequence_id", "offset").mapInArrow(_fill(tokenizer, end_id), "sequence_id long, offset long, ids array<long>")
    return filled.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(work.table(spark, sf_dir, "documents"), default_tokenizer())
