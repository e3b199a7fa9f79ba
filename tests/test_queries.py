"""Every query with SQL against DuckDB on the smallest tables, and BM25 against SQLite's FTS5."""

import glob
import os
import sqlite3

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import lexical
from lorekeep.operators import index as indexes
from lorekeep.operators.index import Index
from lorekeep import plans
from lorekeep.plans import views

SF = "/root/testdata/sf0.001"
#: Needs sessions that the smallest tables lack.
LARGER = {"session_page", "session_window", "session_page_without_deltas", "event_pointer", "purge_session"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    shown = lambda x: "NULL" if x is None or x is pd.NA or (isinstance(x, float) and x != x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(plans.ORACLES) - LARGER))
def test_query_equals_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_document_is_normalized(spark):
    out = plans.QUERIES["normalize_ref"](spark, SF)
    assert out.count() == views.table(spark, SF, "documents").count() > 100


def test_whole_texts_are_sanitized(spark, tmp_path):
    ends = [(1, "a" * 45 + " b"), (2, "a" * 45 + "_b"), (3, "a" * 45 + "-b")]
    spark.createDataFrame(ends, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.name for r in plans.QUERIES["sanitize_session_id"](spark, str(tmp_path)).collect()}
    assert got[1] == got[2] != got[3]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """An index in two segments, and a third that was never finished."""
    t = views.conversations(spark, SF).select("dedupe_key", "user_text", "assistant_text", "metadata_text")
    built = Index(spark, str(tmp_path_factory.mktemp("index")), ("user_text", "assistant_text", "metadata_text"))
    built.add(t.where("crc32(dedupe_key) % 3 = 0"))
    built.add(t.where("crc32(dedupe_key) % 3 > 0"))
    t.withColumn("__doc", F.lit(1).cast("long")).write.parquet(f"{built.path}/rows/seg=3")
    return Index(spark, built.path, built.columns)


@pytest.mark.parametrize("indexed", [True, False])
def test_bm25_equals_fts5(spark, parts, indexed):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(a, b, c)")
    t = views.conversations(spark, SF).select("dedupe_key", "user_text", "assistant_text", "metadata_text")
    data = t.collect()
    con.executemany("INSERT INTO f(rowid, a, b, c) VALUES (?, ?, ?, ?)", [(i, r[1], r[2], r[3]) for i, r in enumerate(data)])
    for terms in (["the"], ["with", "the", "with"], ["of_the"], ["absent", "from"], ["in_the_the", "the", "of_the", "of_the"], ["absent"], ["__"]):
        match = " OR ".join(f'"{x}"' for x in terms if x != "__") or '"nothingatall"'
        want = {data[i][0]: -s for i, s in con.execute("SELECT rowid, bm25(f, 8.0, 6.0, 0.5) FROM f WHERE f MATCH ?", (match,))}
        found = parts.rank(terms) if indexed else lexical.rank(lexical.tokenized(t, ("user_text", "assistant_text", "metadata_text")), terms)
        got = {r.dedupe_key: r.score for r in found.collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_index_of_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a a a b", None), ("", "b a"), (None, None), ("Été ÉTÉ", "été"), ("a " * 5000, "")], "user_text string, metadata_text string")
    built = Index(spark, str(tmp_path / "i"), ("user_text", "metadata_text"))
    assert built.stats() == {}
    built.add(rows)
    built.add(rows.limit(0))
    built.add(rows.where("false").union(spark.createDataFrame([(None, "--")], rows.schema)))
    plain = lexical.tokenized(rows.unionByName(spark.createDataFrame([(None, "--")], rows.schema)), ("user_text", "metadata_text"))
    for terms in (["a"], ["a_a"], ["ete", "b"], ["b_a", "a"]):
        got, want = (sorted((r.user_text or "", r.metadata_text or "", round(r.score, 9)) for r in x.collect()) for x in (built.rank(terms), lexical.rank(plain, terms)))
        assert got == want and got


def test_index_reads_only_the_words_folders(spark, parts):
    plan = parts.rank(["with"])._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "/postings" in line)
    assert "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0] and "term" in scan.split("PushedFilters: [")[1].split("]")[0]


def test_phrases_overlap(spark):
    df = spark.createDataFrame([("a a a b",), ("",), (None,)], "t string")
    got = df.select(lexical.occurrences(text.tokens(F.col("t")), ["a", "a"]).alias("n")).collect()
    assert [r.n for r in got] == [2, 0, 0]


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
