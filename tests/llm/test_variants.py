"""Spelling variants against brute force and SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import registry, variants


def apart(a, b):
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(rows, changed=True):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{w}".encode())
            if changed and i is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 2}


def brute(n):
    near = {w: [u for u in n if apart(u, w)] for w in n}
    best = {w: min(us, key=lambda u: (-n[u], u)) for w, us in near.items() if us}
    form = {w: u for w, u in best.items() if n[u] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def rows_of(seed=1):
    """Frequent words with variants of variants, anagrams, doubled letters, letters beyond ASCII, long words and runs beside digits."""
    r = random.Random(seed)
    stems = ["retention", "ainting", "elleçons", "vièlement", "aaaaaaaa", "abababab", "ôùîïÀÿÿ×÷"]
    rows = [(1, None), (2, ""), (3, "123 short a"), (4, "x" * 4_000 + " y " + "x" * 3_999 + " " + "x" * 4_000), (4, "x" * 4_000 + " y " + "x" * 3_999), (None, "retention retentio Retention RETENTION"), (5, "retentiom " * 40), (6, "retentiomm " * 3)]
    for i in range(300):
        words = []
        for _ in range(40):
            w = r.choice(stems)
            for _ in range(r.choice([0] * 15 + [1, 1, 2, 3])):
                at, c = r.randrange(len(w)), r.choice("abenté")
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((10 + i, r.choice([" ", "-", "1", "\n"]).join(words)))
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, word string, n int")


@pytest.mark.parametrize("large", [500, 3])
@pytest.mark.parametrize("changed", [None, variants.misspelled])
def test_variants(spark, large, changed):
    rows = rows_of()
    n = counts(rows, changed is not None)
    got = [tuple(r) for r in variants.variants(documents(spark, rows), large=large, changed=changed).collect()]
    want = brute(n)
    assert len(got) == len(n) > 200 and set(got) == want
    assert any(x[1] not in (None, x[2]) for x in want)


@pytest.mark.parametrize("large", [500, 4])
def test_near_words_of_hot_keys(spark, large):
    """Anagrams of one another, and words of all letters in one place, share keys; each pair is found once."""
    r = random.Random(2)
    words = {"".join(r.sample("abcdefgh", 8)) for _ in range(300)} | {f"aaaa{c}aaa" for c in "abcdefghijklmnopqrstuvwxyzéèà"} | {"a" * k for k in range(7, 12)} | {"abcdefg" + c for c in "hijk"} | {"abcdefgg", "abcdefggg"}
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = [(x.word, x.other) for x in variants.near(df, large).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if apart(a, b)}


@given(st.lists(st.text(alphabet="Aabé1 À×ß\n.", max_size=40), max_size=6))
@settings(max_examples=40, deadline=None)
def test_runs_of_letters(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = Counter()
    for out in variants._counted(2, None)(iter([batch])):
        got.update(dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)))
    want = Counter(w.translate({c: c + 32 for c in range(65, 91)}) for t in texts for w in re.findall("[A-Za-zÀ-ÿ]+", t) if len(w) >= 2)
    assert got == want


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(20)] + [("x", "w05"), ("y", "z")], "word string, form string")
    got = {r.word: r.root for r in variants.roots(chain).collect()}
    assert got == {f"w{i:02d}": "w20" for i in range(20)} | {"x": "w20", "y": "z"}


def test_empty(spark):
    assert variants.variants(documents(spark, [])).collect() == [] and variants.variants(documents(spark, [(1, None)])).collect() == []


@pytest.mark.parametrize("odd", [True, False])
def test_query_equals_sql(spark, sf_dir, tmp_path, odd):
    files = f"{sf_dir}/documents.parquet"
    if odd:
        sf_dir, files = str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet"
        documents(spark, [r for r in rows_of() if len(r[1] or "") < 10_000]).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    want = set(con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({registry.oracle_sql()['op13_spelling_variants']})").fetchall())
    got = [tuple(r) for r in registry.queries()["op13_spelling_variants"](spark, sf_dir).collect()]
    assert len(got) == len(want) > 100 and set(got) == want
