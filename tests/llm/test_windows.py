"""Concatenate and cut against the library's own ids."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import windows

P = pytest.importorskip("public_tokenizers")
BPE = P.path("byte_bpe_50k.json")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3, 4) for i, t in rows], "doc_id long, text string, part string, before int, at int")


def rows_of(n, seed=1):
    r = random.Random(seed)
    rows = [(1, None), (2, ""), (3, "don't <|endoftext|> été"), (3, "don't <|endoftext|> été"), (4, " ".join(f"w{r.randrange(999)}" for _ in range(9000))), (None, "no id"), (5, "\n \t")]
    return rows + [(10 + i, " ".join(r.choice(["alpha", "beta", "gamma", "ñu"]) for _ in range(r.randrange(60)))) for i in range(n)]


def encoded(rows, end=1):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    return [(i, tok.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in rows]


@pytest.mark.parametrize("length", [2048, 16])
@pytest.mark.parametrize("block", [4096, 2])
def test_pieces(spark, monkeypatch, length, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    rows = rows_of(80)
    want = sorted((i if i is not None else -1, ids) for i, ids in encoded(rows))
    total = sum(len(ids) for _, ids in want)
    stream = windows.concatenated(documents(spark, rows).repartition(7), BPE, length=length)
    assert stream.total == total
    pieces = stream.pieces().collect()
    whole = {r.sequence_id: r.ids for r in stream.sequences().collect()}
    # each sequence is full or a power of two, and its pieces lie in it without gaps
    assert sum(map(len, whole.values())) == total and all(len(x) == length or len(x) & (len(x) - 1) == 0 for x in whole.values())
    assert len(whole) <= total // length + length.bit_length()
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    assert by.keys() == whole.keys()
    documents_seen = []
    for s, own in by.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            ids = whole[s][at : at + p.length]
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
            documents_seen.append((p.doc_id, p.doc_tokens, p.start, s, at, ids))
            at += p.length
        assert at == len(whole[s])
    # a document's pieces follow each other in the stream, so its ids read on from sequence to sequence
    got, open_ = [], None
    for i, n, start, _s, _at, ids in sorted(documents_seen, key=lambda x: (x[3], x[4])):
        if start == 0:
            open_ = []
        assert len(open_) == start
        open_ = open_ + ids
        if len(open_) == n:
            got.append((i if i is not None else -1, open_))
    assert sorted(got) == want
    assert any(p.boundary for p in pieces) and (length > 1000 or not all(p.boundary for p in pieces))


def test_rest_is_cut_by_its_digits():
    assert windows.cuts(2048 * 3, 2048) == [] and windows.cuts(0, 2048) == []
    assert windows.cuts(2048 + 11, 2048) == [(2048, 8), (2056, 2), (2058, 1)]
    assert windows.bounds(2040, 2059, 2059, 2048) == [(0, 2040, 2048), (1, 2048, 2056), (2, 2056, 2058), (3, 2058, 2059)]
    assert windows.bounds(5, 9, 2059, 2048) == [(0, 5, 9)]


def test_empty_and_small_tables(spark):
    empty = windows.concatenated(documents(spark, []), BPE)
    assert empty.pieces().collect() == [] and empty.sequences().collect() == []
    one = windows.concatenated(documents(spark, [(9, None)]), BPE)
    assert [tuple(r)[:7] for r in one.pieces().collect()] == [(9, 0, 1, zlib.crc32(struct.pack("<I", 1)), 1, 0, 0)]


def test_query(spark, sf_dir):
    from lorekeep.llm import registry

    got = registry.queries()["op11_concatenate_and_cut"](spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {i: ids for i, ids in encoded([tuple(r) for r in rows])}
    for r in got.collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    assert got.agg(F.sum("length")).head()[0] == sum(map(len, want.values()))
