"""The inverted index: block-max retrieval, filters, deletions, tiers and the files that a page reads."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.errors import UnavailableError
from lorekeep.operators import index, lexical, search
from lorekeep.operators.index import Index

COLUMNS = ("user_text", "assistant_text")
SCHEMA = "dedupe_key string, tool string, session_id string, filename_session_id string, cwd string, canonical_type string, captured_at string, raw_line long, user_text string, assistant_text string, searchable_text string"
QUERIES = [["red"], ["red", "blue", "red"], ["red_blue"], ["red_blue", "green", "x"], ["rare", "red"], ["absent", "blue"]]


def events(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = lambda: " ".join(r.choice(["red", "blue", "green", "x", "y", "z"] * 6 + ["rare"]) for _ in range(r.randrange(12)))
        text = (words(), words() if r.random() < 0.7 else None)
        time = None if r.random() < 0.05 else f"2024-01-{r.randrange(1, 28):02d}"
        kind = r.choice(["user.message", "assistant.delta", "assistant.message", None])
        out.append((f"k{seed}-{i}", r.choice(["codex", "claude"]), f"s{r.randrange(9)}", f"f{r.randrange(9)}", r.choice(["/a", "/b", None]), kind, time, r.randrange(50), *text, " ".join(filter(None, text))))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(events(900), SCHEMA).repartition(6).cache()


@pytest.fixture(scope="module")
def small_shards():
    patch = pytest.MonkeyPatch()
    patch.setattr(index, "SHARD_BITS", 5)
    patch.setattr(index, "BLOCK", 4)
    yield
    patch.undo()


@pytest.fixture(scope="module")
def built(spark, table, tmp_path_factory, small_shards):
    """Two segments of many small shards, some rows deleted."""
    made = Index(spark, str(tmp_path_factory.mktemp("index")), COLUMNS)
    made.add(table.where("crc32(dedupe_key) % 3 > 0"))
    made.add(table.where("crc32(dedupe_key) % 3 = 0"))
    assert made.delete(table.where("crc32(dedupe_key) % 7 = 0").union(table.limit(0))) == table.where("crc32(dedupe_key) % 7 = 0").count()
    assert made.delete(table.where("crc32(dedupe_key) % 7 = 0")) == 0
    return made


@pytest.fixture(scope="module")
def left(table):
    return table.where("crc32(dedupe_key) % 7 <> 0").cache()


def shown(rows):
    return [(round(r.score, 9), r.captured_at, r.raw_line, r.session_id) for r in rows]


def keyed(df):
    return {r.dedupe_key: round(r.score, 9) for r in df.collect()}


@pytest.mark.parametrize("terms", QUERIES, ids=str)
def test_all_rows_equal_tokens(built, left, terms):
    assert keyed(built.rank(terms)) == keyed(lexical.rank(lexical.tokenized(left, COLUMNS), terms))


@pytest.mark.parametrize("terms", QUERIES, ids=str)
@pytest.mark.parametrize("first", [1, 3, 1000])
def test_top_equals_sorted_rows(built, left, terms, first):
    want = shown(search.top(lexical.rank(lexical.tokenized(left, COLUMNS), terms), 10).orderBy("rank").collect())
    found = built.best(terms, 10, first=first)
    got = shown(search.top(built.fetched(found), 10).orderBy("rank").collect()) if found else []
    assert got == want


FILTERS = [
    search.Filters(tool="claude"), search.Filters(canonical_type="user.message"), search.Filters(since="2024-01-10"), search.Filters(include_deltas=True), search.Filters(canonical_type="none.such"),
    search.Filters(session="s3"), search.Filters(cwd="/a", tool="codex"), search.Filters(ref="#4", since="2024-01-02"),
]


@pytest.mark.parametrize("filters", FILTERS, ids=str)
@pytest.mark.parametrize("terms", [["red", "rare"], ["red_blue", "green"]], ids=str)
def test_filters_beside_postings(spark, built, left, filters, terms, monkeypatch):
    monkeypatch.setattr(index, "FIRST", 2)
    refs = left.where("raw_line < 10").select("dedupe_key", F.lit("pr").alias("kind"), F.lit("4").alias("value"))
    t = search.Tables(left, sessions=left.select("tool", "session_id", "filename_session_id").distinct(), refs=refs, index=built)
    ranked = lexical.rank(lexical.tokenized(left, COLUMNS), terms)
    want = shown(search.top(search.apply_filters(ranked, filters, t), 8).orderBy("rank").collect())
    found = search.indexed(t, terms, filters, 8)
    assert shown(search.top(built.fetched(found), 8).orderBy("rank").collect() if found else []) == want


def test_ranges_bound_scores(spark, built, left):
    """No row of a shard scores more than the shard's bound."""
    for terms in (["red", "blue", "rare"], ["red_blue"]):
        q = built._asked(terms, None)
        bounds = {(r.seg, r.shard): r.bound for r in built.shard_bounds(q, list(built.stats())).collect()}
        for r in built.scores(terms).withColumn("shard", F.shiftright("__doc", index.SHARD_BITS)).collect():
            assert r.score <= bounds[r.seg, r.shard] + 1e-9
    assert len(bounds) > 20


def test_ties_without_end(spark, tmp_path, small_shards):
    """All rows alike: the order of numbers decides, and a page comes from the first of them."""
    rows = spark.createDataFrame([(f"k{i:03d}", "codex", "s", "s", None, "user.message", f"2024-02-{1 + i % 28:02d}", i, "red", None, "red") for i in range(300)], SCHEMA).repartition(5)
    made = Index(spark, str(tmp_path), COLUMNS)
    made.add(rows)
    got = search.top(made.fetched(made.best(["red"], 7, first=1)), 7).orderBy("rank").collect()
    assert shown(got) == shown(search.top(lexical.rank(lexical.tokenized(rows, COLUMNS), ["red"]), 7).orderBy("rank").collect()) and len(got) == 7


def test_a_page_reads_rows_of_its_keys_only(spark, built):
    found = built.best(["rare", "red"], 5, first=2)
    plan = built.fetched(found)._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/rows" in line]
    assert scans and all("__doc" in line.split("PushedFilters: [")[1] for line in scans)
    assert all("/rows" not in line for line in built._run(built._asked(["rare"], None), list(built.stats()), 5)._jdf.queryExecution().toString().splitlines() if "FileScan" in line)


def test_tiers(spark, tmp_path, monkeypatch, small_shards):
    """Ten appends and deletions: merges keep the segments few, and scores are those of a fresh index."""
    monkeypatch.setattr(index, "TIER", 40)
    made = Index(spark, str(tmp_path / "a"), COLUMNS)
    rows = [spark.createDataFrame(events(40, seed), SCHEMA) for seed in range(10, 20)]
    for df in rows:
        made.add(df)
        made.compact()
    assert len(made.stats()) <= 4 and sum(s.n for s in made.stats().values()) == 400
    everything = rows[0]
    for df in rows[1:]:
        everything = everything.unionByName(df)
    gone = everything.where("dedupe_key like '%3'")
    n = made.delete(gone)
    stays = everything.join(gone.select("dedupe_key"), "dedupe_key", "left_anti")
    plain = lexical.tokenized(stays, COLUMNS)
    before = keyed(made.rank(["red", "rare"]))
    assert n == 40 and before == keyed(lexical.rank(plain, ["red", "rare"]))
    made.delete(everything.where("dedupe_key like 'k1%' and dedupe_key not like '%3' and raw_line > 12"))
    taken = made.compact()
    stays = stays.where("not (dedupe_key like 'k1%' and raw_line > 12)")
    assert taken >= 0 and keyed(made.rank(["red_blue", "rare"])) == keyed(lexical.rank(lexical.tokenized(stays, COLUMNS), ["red_blue", "rare"]))
    swept = made.sweep()
    assert swept > 0 and keyed(Index(spark, made.path, COLUMNS).rank(["red"])) == keyed(lexical.rank(lexical.tokenized(stays, COLUMNS), ["red"]))


def test_two_writers_and_unfinished_segments(spark, tmp_path):
    a = Index(spark, str(tmp_path / "i"), COLUMNS)
    rows = spark.createDataFrame(events(5), SCHEMA)
    a.add(rows)
    b = Index(spark, a.path, COLUMNS)
    assert b.stats().keys() == {1}
    a.note(seen=3)
    with pytest.raises(UnavailableError):
        b.add(rows)
    assert Index(spark, a.path, COLUMNS).manifest()[2] == {"seen": 3} and len(Index(spark, a.path, COLUMNS).stats()) == 1
    c = Index(spark, a.path, COLUMNS)
    c.add(rows.withColumn("dedupe_key", F.concat("dedupe_key", F.lit("x"))))
    assert sorted(c.stats()) == [1, 3] and c.rows().count() == 10  # 2 is what the failed writer left


def test_codes_of_tools_and_types(spark):
    df = spark.createDataFrame(list(itertools.product(["codex", "opencode", "vim", None], ["error", "assistant.delta", "odd", None])), "tool string, canonical_type string")
    for tool, kind, deltas in itertools.product([None, "codex"], [None, "error"], [True, False]):
        fits = index.allowed_kinds(tool, kind, deltas)
        for r in df.withColumn("code", index.kind_code(df.columns)).collect():
            want = (tool is None or r.tool == tool) and (kind is None or r.canonical_type == kind) and (deltas or r.canonical_type not in (None, "assistant.delta"))
            assert fits[r.code] == want
