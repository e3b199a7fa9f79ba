"""Learned operators and vector operators: held-out accuracy, brute force, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import boosting, components, kd_topk, langid, pq_dedup, quality, toxicity, work

SYLLABLES = {"xa": "ka lo mi ne".split(), "yb": "stru grom blik vern".split(), "zc": "éa où ñi çu".split()}


def prose(lang, n, r):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(n=260):
    """(doc_id, text, lang, toxic, quality): toxic ones hold insults, poor ones marks after every word."""
    r, rows = random.Random(5), []
    for i in range(n):
        lang = r.choice(sorted(SYLLABLES))
        text, toxic, good = prose(lang, r.randint(20, 60), r), int(i % 5 == 0), int(i % 4 != 1)
        if not good:
            text = text.replace(" ", "### ")
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "scum"]))
            text = " ".join(w)
        rows.append((i, text, lang, toxic, good))
    return rows


ODD = [(1000, None), (1001, ""), (1002, " \n"), (1003, "123 !!"), (1004, "a" * 50_000), (1004, "a" * 50_000)]


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang, _, _ in rows] + [(i, t, None, "s", 1) for i, t in ODD], "doc_id long, text string, lang string, label string, n long")
    labels = spark.createDataFrame([(i, q, t) for i, _, _, t, q in rows], "doc_id long, quality int, toxic int")
    return docs.cache(), labels.cache(), {r[0]: r for r in rows}


def test_toxicity(spark, tables):
    docs, labels, rows = tables
    model = toxicity.train(docs, labels, work.crc_mod4() != 2)
    got = toxicity.score(docs, model, work.crc_mod4() == 2).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in rows]
    assert np.mean([r.predicted == rows[r.doc_id][3] for r in held]) > 0.9
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id in rows} == {r.doc_id for r in got if r.doc_id in rows and not r.predicted}


def test_toxicity_without_labels(spark, tables):
    docs, labels, _ = tables
    model = toxicity.train(docs, labels.limit(0), work.crc_mod4() != 2)
    assert len({round(r.score, 6) for r in toxicity.score(docs, model, F.lit(False)).collect()}) == 1
    assert toxicity.score(docs.limit(0), model, F.lit(False)).collect() == []


def test_language(spark, tables):
    docs, _, rows = tables
    model = langid.train(docs, work.crc_mod4() != 2)
    got = langid.identify(docs, model, work.crc_mod4() == 2).collect()
    held = [r for r in got if r.held_out and r.doc_id in rows]
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) > 0.95
    odd = {r.doc_id: r for r in got if r.doc_id >= 1000}
    assert [odd[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und"] * 4 and odd[1004].lang_pred in SYLLABLES and all(0 <= r.score <= 1 for r in got)
    none = langid.train(docs.where("lang is null"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, none, F.lit(False)).collect()} == {"und"}


def test_gradients():
    """Backpropagation through time against differences."""
    r = np.random.default_rng(2)
    net = langid.Network(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, n, y = r.integers(97, 105, (5, 6)).astype(np.uint8), np.array([6, 5, 3, 3, 1]), np.array([0, 2, 1, 0, 2])

    def loss():
        logp, real, _ = net.forward(words, n)
        return -(logp[np.arange(5), :, y] * real).sum() / real.sum()

    grads = {}
    seen = langid.Network.learn

    before = {k: v.copy() for k, v in net.p.items()}
    logp, real, (both, mirror, flipped, kf, kb) = net.forward(words, n, True)
    d = np.exp(logp)
    d[np.arange(5), :, y] -= 1
    d = d * real[:, :, None] / real.sum()
    grads = {k: np.zeros_like(x) for k, x in net.p.items()}
    up = d @ net.p["o"].T
    net.back("f", words, kf, up[:, :, :4].transpose(1, 0, 2), grads)
    net.back("b", flipped, kb, np.take_along_axis(up[:, :, 4:], mirror[:, :, None], 1).transpose(1, 0, 2), grads)
    for key, at in (("fh", (1, 2)), ("fh", (0, 9)), ("bh", (3, 5)), ("bx", (100, 3)), ("fc", (7,))):
        net.p = {k: v.copy() for k, v in before.items()}
        net.p[key][at] += 1e-3
        high = loss()
        net.p[key][at] -= 2e-3
        assert abs((high - loss()) / 2e-3 - grads[key][at]) < 2e-4
    assert seen is langid.Network.learn


def test_fast_reading_equals_network():
    net = langid.Network(3)
    model = langid.Identifier(net, ["a", "b", "c"])
    words = [b"abc", b"x", b"hello", b"y" * 100, "é".encode()]
    got = model.word_sums(words)
    for w, s in zip(words, got, strict=True):
        want = np.zeros(3)
        for k in range(0, len(w), langid.SPAN):
            part = np.frombuffer(w[k : k + langid.SPAN], np.uint8)[None]
            want += net.forward(part, np.array([part.shape[1]]))[0][0].sum(0)
        assert np.allclose(s, want, atol=1e-3)


def test_quality(spark, tables):
    docs, labels, rows = tables
    model, share = quality.train(docs, labels, work.crc_mod4() != 2), quality.good_share(docs, labels)
    got = {r.doc_id: r for r in quality.sample(docs, model, share).collect()}
    assert abs(share - np.mean([r[4] for r in rows.values()])) < 1e-12
    assert np.mean([got[i].kept == bool(rows[i][4]) for i in rows]) > 0.95
    assert not any(got[i].kept for i in (1000, 1001, 1002))
    kept = quality.select(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.select(docs.limit(0), labels).collect() == [] and quality.good_share(docs, labels.limit(0)) == 1
    assert quality.select(docs, labels, 0.0).collect() == []
    assert {r.doc_id for r in quality.select(docs, labels.limit(0)).collect()} == {i for i, r in got.items() if r.n_grams}


def test_weights_against_brute_force(spark, tables):
    """Counts over all rows and the target's, and each document's sum of log ratios, n-gram by n-gram."""
    docs, labels, rows = tables
    fold = work.crc_mod4() != 2
    target_ids = {r.doc_id for r in labels.where(fold).collect() if rows[r.doc_id][4]}
    every = [(r.doc_id, r.text or "") for r in docs.collect()]
    grams = {k: quality.buckets(*work.text_buffers(pa.array([t])))[0].tolist() for k, (_, t) in enumerate(every)}
    raw, target = Counter(), Counter()
    for k, (i, _) in enumerate(every):
        raw.update(grams[k])
        if i in target_ids:
            target.update(grams[k])
    n, m = quality.BUCKETS + sum(raw.values()), quality.BUCKETS + sum(target.values())
    got = {r.doc_id: r for r in quality.sample(docs, quality.train(docs, labels, fold), 0.5).collect()}
    for k, (i, _) in enumerate(every):
        want = sum(math.log((1 + target[g]) / m) - math.log((1 + raw[g]) / n) for g in grams[k])
        assert got[i].n_grams == len(grams[k]) and abs(got[i].log_ratio - want) < 1e-4 * (1 + len(grams[k]))


def test_draws_follow_the_weights(spark):
    """Of two documents the one is drawn first with the odds of their weights, so no threshold on weights gives what is drawn."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(math.log(3)).alias("w"))
    keyed = rows.withColumn("key", F.col("w") + quality.gumbel(F.col("doc_id")))
    first = {r.doc_id: r.key for r in keyed.collect()}
    assert abs(np.mean([first[i + 1] > first[i] for i in range(0, 4000, 2)]) - 0.75) < 0.03
    kept = {r.doc_id for r in quality.top_k(keyed, "key", 2000, last=50).where("kept").collect()}
    assert len(kept) == 2000 and kept == {i for i, _ in sorted(first.items(), key=lambda x: (-x[1], -x[0]))[:2000]}
    heavy = sum(i % 2 for i in kept)
    assert 1200 < heavy < 1500


@pytest.mark.parametrize("last", [5, 1000])
def test_exact_top_k(spark, last):
    r = random.Random(3)
    rows = [(i, float(r.choice([r.gauss(0, 1), 0.5, 0.5]))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, key double")
    for k in (0, 1, 57, 200, 399, 400, 500):
        got = {x.doc_id for x in quality.top_k(df, "key", k, last).where("kept").collect()}
        assert got == {i for i, _ in sorted(rows, key=lambda x: (-x[1], -x[0]))[:k]}
    assert quality.top_k(df.limit(0), "key", 3).collect() == []


def test_isotonic():
    at, levels = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert at.tolist() == [1, 1, 2, 3, 4, 4] and levels.tolist() == [0, 0, 0.5, 0.5, 1, 1]


VECTORS = "vec_id long, embedding array<float>, label int, id string"


def vectors(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(60):
        rows.append((1000 + i, (base[3] + 0.05 * r.normal(size=16) * (1 + i % 3)).tolist()))
    rows += [(2000, base[5].tolist()), (2001, base[5].tolist()), (2001, base[5].tolist()), (2002, (2 * base[5]).tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [None] * 16), (3005, [1.0, 2.0]), (3006, [1.0, 2.01])]
    return rows, spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS)


def proper(rows):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all()]


def test_vector_near_duplicates(spark):
    rows, df = vectors(spark)
    good = [(i, v) for i, v in proper(rows) if v.any()]
    links, parent = dict.fromkeys((i for i, _ in rows), 0), {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    counts = [0] * len(good)
    for k, (i, v) in enumerate(good):
        for n, (j, w) in enumerate(good[:k]):
            if len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.95:
                counts[k] += 1
                counts[n] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    links |= {i: n for (i, _), n in zip(good, counts, strict=True)}
    got = pq_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.component_id, r.kept) for r in got} == {i: (find(i), find(i) == i) for i in links}
    assert {r.vec_id: r.n_links for r in got} == links
    assert pq_dedup.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize(("per_list", "part", "home"), [(16, 40, 2), (64, 1024, 8)])
def test_vector_links_of_a_low_rank_group(spark, monkeypatch, per_list, part, home):
    """Links inside a tight group of few dimensions, and pairs near the limit, cross many lists, parts and homes; none is lost."""
    for name, value in (("PER_LIST", per_list), ("PART", part), ("HOME", home)):
        monkeypatch.setattr(pq_dedup, name, value)
    r = np.random.default_rng(11)
    hot = 0.2 * r.normal(size=(800, 6)) @ np.linalg.qr(r.normal(size=(64, 6)))[0].T + r.normal(size=64) / 8
    u = r.normal(size=(600, 64))
    u /= np.sqrt((u * u).sum(1))[:, None]
    side = r.normal(size=(600, 64))
    side -= (side * u).sum(1)[:, None] * u
    side /= np.sqrt((side * side).sum(1))[:, None]
    cosine = r.uniform(0.945, 0.955, (600, 1))
    x = np.concatenate([hot, u, cosine * u + np.sqrt(1 - cosine**2) * side, 1e200 * u[:3]])
    got = pq_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    v = pq_dedup.unit(x)
    near = v @ v.T >= 0.95
    assert near[:800, :800].sum() > 5000 and 250 < near[800:1400, 1400:2000].sum() < 350 and near[800, 2000]
    assert {q.vec_id: q.n_links for q in got} == dict(enumerate((near.sum(1) - 1).tolist()))


def test_lookup_bounds_the_cosine():
    r = np.random.default_rng(1)
    x = pq_dedup.unit(np.concatenate([r.normal(size=(500, 16)), 1 + 0.2 * r.normal(size=(200, 16))]))
    index = pq_dedup.Index(x, 8)
    own = index.lists(x)
    for k in np.unique(own):
        m = np.flatnonzero(own == k)
        codes, least = index.codes(x[m], own[m])
        near = pq_dedup.lookup(index.tables(x), codes, x @ index.centers[k])
        linked = x[m] @ x.T >= 0.95
        assert (near >= least[:, None])[linked].all() and linked.sum() >= len(m)
        assert index.probes((x * index.centers[own]).sum(1), own, x @ index.centers[k], int(k))[linked.any(0)].all()


@pytest.mark.parametrize("shard", [10**6, 40])
def test_top_k_products(spark, shard, monkeypatch):
    monkeypatch.setattr(kd_topk, "SHARD", shard)
    rows, df = vectors(spark)
    good = [(i, np.floor(256 * v).astype(int)) for i, v in proper(rows)]
    want, asked = set(), set()
    for i, q in good:
        if i % 50 == 0 and i not in asked:
            asked.add(i)
            found = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:5]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    got = [tuple(r) for r in kd_topk.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert kd_topk.top_k(df.limit(0), F.lit(True)).collect() == []


@pytest.mark.parametrize("copies", [2, 7])
def test_top_k_of_a_repeated_query(spark, copies):
    """A query's own rows take no place from its neighbours."""
    r = np.random.default_rng(5)
    x = r.normal(size=(120, 8))
    x[0] *= 10
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * (copies - 1), "vec_id long, embedding array<double>")
    whole = np.floor(256 * x).astype(int)
    found = sorted((-int(whole[0] @ whole[j]), j) for j in range(1, 120))[:5]
    got = {tuple(q) for q in kd_topk.top_k(df, F.col("vec_id") == 0).collect()}
    assert got == {(0, n + 1, j, -s) for n, (s, j) in enumerate(found)}


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e12, 1e17, 1e300])
@pytest.mark.parametrize("shard", [10**6, 40])
def test_top_k_of_large_components(spark, monkeypatch, scale, shard):
    """Products beyond double precision are exact; scores beyond a long are the longest."""
    monkeypatch.setattr(kd_topk, "SHARD", shard)
    r = np.random.default_rng(6)
    x = scale * r.normal(size=(120, 6))
    x[7] = x[3]
    x[9] = x[3] * (1 + 2**-50)
    whole = [[256 * int(v) if abs(v) > 2.0**60 else math.floor(256 * v) for v in row] for row in x.tolist()]
    most = (1 << 63) - 1
    want = set()
    for i in range(0, 120, 50):
        found = sorted((-sum(a * b for a, b in zip(whole[i], whole[j], strict=True)), j) for j in range(120) if j != i)[:5]
        want |= {(i, j, max(-most, min(most, -s))) for s, j in found}
    got = kd_topk.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    if scale < 1e7:
        assert {(q.query_id, q.vec_id, q.score) for q in got} == want
    assert sorted((q.query_id, q.rank, q.score) for q in got) == sorted((i, k, s) for i in (0, 50, 100) for k, s in enumerate(sorted((w[2] for w in want if w[0] == i), reverse=True), 1))


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf])
@pytest.mark.parametrize("scale", [1.0, 1e17])
def test_top_k_leaves_out_vectors_that_are_not_finite(spark, tmp_path, bad, scale):
    """First in a batch, after large vectors, next to each other, last, and as queries: none takes part, and SQL agrees."""
    r = np.random.default_rng(8)
    x = (scale * r.normal(size=(220, 6))).tolist()
    for i in (0, 1, 50, 60, 61, 150, 219):
        x[i][i % 6] = bad
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").coalesce(1)
    whole = {i: [256 * int(c) if abs(c) > 2.0**60 else math.floor(256 * c) for c in v] for i, v in enumerate(x) if all(map(math.isfinite, v))}
    most = (1 << 63) - 1
    want = set()
    for i in (100, 200):
        found = sorted((-sum(a * b for a, b in zip(whole[i], w, strict=True)), j) for j, w in whole.items() if j != i)[:5]
        want |= {(i, n, j, max(-most, min(most, -s))) for n, (s, j) in enumerate(found, 1)}
    got = {tuple(q) for q in kd_topk.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert {(q[0], q[1], q[3]) for q in got} == {(q[0], q[1], q[3]) for q in want} and {q[2] for q in got} <= set(whole)
    if scale == 1:
        assert got == want
        import duckdb

        df.write.parquet(str(tmp_path / "e"))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
        assert set(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({kd_topk.ORACLE_SQL})").fetchall()) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7), (200, 150)]
    got = components.connected_components(spark.createDataFrame(chain, "src long, dst long"), work.work_folder(spark), "c").collect()
    assert {r.id: r.component for r in got} == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
