"""Runs of words against brute force and SQL."""

import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import periodic, registry


def brute(s, least=2, exponent=2):
    """(start, length, period) of all maximal runs, by trying every period."""
    n, out = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return {(i, m, q) for (i, m), q in out.items() if m >= max(least, exponent * q)}


@given(st.integers(1, 4).flatmap(lambda a: st.lists(st.integers(0, a - 1), min_size=1, max_size=60)))
@settings(max_examples=300, deadline=None)
def test_runs(s):
    assert set(zip(*(x.tolist() for x in periodic.runs(np.array([*s, 99]))), strict=True)) == brute(s)


def test_runs_of_famous_words():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    thue = [bin(i).count("1") % 2 for i in range(256)]
    for s in (fib[-1], thue, [0] * 200, [i % 7 for i in range(200)], ([1, 2, 1, 2, 3] * 8 + [1, 2]) * 3):
        assert set(zip(*(x.tolist() for x in periodic.runs(np.array([*s, 99]))), strict=True)) == brute(s)


def test_blocks_and_squares():
    """Blocks are the longest pieces seen further left; every square has its kind or a rotation of it among the first ones."""
    r = random.Random(3)
    for _ in range(60):
        s = [r.randrange(2) for _ in range(30)] + [9]
        names = periodic.Names(np.array(s))
        at = periodic.blocks(names).tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            seen = lambda w, to: any(s[k : k + len(w)] == w for k in range(to))
            assert b == a + 1 or seen(s[a:b], a)
            assert b == len(s) or not seen(s[a : b + 1], a)
        starts, halves = periodic.first_squares(names)
        kinds = {tuple(s[i : i + k]) for i, k in zip(starts.tolist(), halves.tolist(), strict=True) if s[i : i + k] == s[i + k : i + 2 * k]}
        assert len(kinds) <= len(starts)
        tree = periodic.Tree(np.unique(s, return_inverse=True)[1], names)
        found = {tuple(s[tree.first[v] : tree.first[v] + d]) for v, d in tree.vocabulary(starts, halves)}
        assert found == {tuple(s[i : i + 2 * k]) for k in range(1, 16) for i in range(len(s) - 2 * k + 1) if s[i : i + k] == s[i + k : i + 2 * k]}


def test_stretches_lose_no_run():
    r = random.Random(4)
    for _ in range(200):
        docs = []
        for _ in range(3):
            own = [r.randrange(12) for _ in range(r.randrange(40))]
            at, q = r.randrange(len(own) + 1), r.randrange(1, 4)
            own[at:at] = [r.randrange(12) for _ in range(q)] * r.randrange(1, 8)
            docs.append(own)
        codes, document = np.array(sum(docs, []), np.int64), np.repeat(np.arange(3), [len(d) for d in docs])
        first, length, period = periodic.document_runs(codes, document)
        before = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        got = {(i - before[document[i]], m, q, document[i]) for i, m, q in zip(first.tolist(), length.tolist(), period.tolist(), strict=True)}
        assert got == {(i, m, q, d) for d, own in enumerate(docs) for i, m, q in brute(own, 6, 4)}


def odd_rows():
    r = random.Random(9)
    line = [f"w{r.randrange(30)}" for _ in range(20)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x " * 5), (5, "x y x y " * 4), (5, "x y x y " * 4), (None, "a b a b a b a b c"), (6, "the  the\nthe the\tthe the"), (7, "é ê " * 30 + "A a " * 10)]
    rows += [(100 + i, " ".join(line[: r.randrange(1, 20)] * r.randrange(1, 9) + line)) for i in range(150)]
    return rows + [(900, " ".join(f"u{r.randrange(400)}" for _ in range(30_000)) + " lorem ipsum" * 3000), (901, "z" * 200_000)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, runs string, n_words int")


@pytest.mark.parametrize("batch", [2_000_000, 3000])
def test_periodic_runs(spark, monkeypatch, batch):
    monkeypatch.setattr(periodic, "BATCH", batch)
    rows = [r for r in odd_rows() if r[0] != 900]
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        own = sorted(brute(w, 6, 4), key=lambda x: (x[0], x[2]))
        gone = {k for s, m, q in own for k in range(s + q, s + m)}
        want.append((i or 0, len(w), own, " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(documents(spark, rows).coalesce(1)).collect()]
    assert sorted(got) == sorted(want) and periodic.periodic_runs(documents(spark, [])).collect() == []


def test_query_on_odd_rows_equals_sql(spark, tmp_path):
    documents(spark, [r for r in odd_rows() if r[0] is not None]).write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet", 100)


def test_query_equals_sql(spark, sf_dir):
    compare(spark, sf_dir, f"{sf_dir}/documents.parquet", 20)


def compare(spark, folder, files, least):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    shown = lambda rows: sorted(tuple("" if x is None else str(x) for x in r) for r in rows)
    want = shown(con.sql(f"SELECT {', '.join(names)} FROM ({registry.oracle_sql()['op12_periodic_runs']})").fetchall())
    got = shown(tuple(r[n] for n in names) for r in registry.queries()["op12_periodic_runs"](spark, folder).collect())
    assert got == want and sum(r[1] != "0" for r in got) >= least


def test_documents_without_an_id_keep_their_words():
    assert periodic.planted(None, 5) is None and periodic.planted(3, 0) is None
    planted = [i for i in range(1000) if periodic.planted(i, 50) is not None]
    assert 60 < len(planted) < 140 and all(periodic.planted(i, 50).max() < 50 for i in planted)
