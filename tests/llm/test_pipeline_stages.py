"""The corpus pipeline: what each stage drops, keeps and writes, against plain versions, on odd and on empty tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import minhash, packing, pii, quality, toxicity, work

from .test_models import corpus
from .test_text_operators import brute_ids, sets

SF = "/root/testdata/sf0.001"
#: Columns that operators use inside clash with those of the table.
SCHEMA = "doc_id long, text string, label string, id long, component_id long, kept string, key double, h long, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(i, t) for i, t, _, _, _ in corpus()]
    r = random.Random(3)
    for i in range(0, 40, 2):  # exact and near copies
        w = rows[i][1].split()
        w[r.randrange(len(w))] = "changed"
        rows += [(2000 + i, rows[i][1]), (3000 + i, " ".join([*w, *rows[i][1].split() * 3])), (4000 + i, " ".join([*rows[i][1].split(), *rows[i][1].split() * 3]))]
    rows += [(5000 + i, f"{rows[i][1]} call +1 (415) 555-{1000 + i} or 415 555 {1000 + i} or u.x{i}@mail.example.com") for i in range(41, 80)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "123 !!"), (1004, "ka lo " * 20_000), (1004, "ka lo " * 20_000), (None, "ka lo mi ne"), (None, None)]
    folder = str(tmp_path_factory.mktemp("odd"))
    data = [(i, t, "x", 1, 2, "y", 0.5, 3, None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, q, t) for i, _, _, t, q in corpus()] + [(None, 1, 0), (7, None, None), (99_999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(name, spark, docs, folder):
    """What a stage keeps or writes, row by row."""
    rows = docs.collect()
    labels = work.table(spark, folder, "labels")
    if name == "toxicity":
        model = toxicity.train(docs, labels, work.crc_mod4() != 2)
        bad = {(r.doc_id, r.predicted) for r in toxicity.score(docs, model, F.lit(False)).collect()}
        return [tuple(r) for r in rows if (r.doc_id, 0) in bad]
    if name == "quality":
        model, share = quality.train(docs, labels, work.crc_mod4() != 2), quality.good_share(docs, labels)
        draw = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("g")).collect()}
        keyed = []
        for r in rows:
            grams = quality.buckets(*work.text_buffers(pa.array([r.text])))[0]
            if len(grams):
                keyed.append((float(model.ratio[grams].sum()) / quality.UNIT + draw[r.doc_id], -(1 << 63) if r.doc_id is None else r.doc_id, r))
        keyed.sort(key=lambda x: (-x[0], -x[1]))
        k = int(np.ceil(share * len(keyed)))
        return [tuple(r) for key, i, r in keyed if (key, i) >= keyed[k - 1][:2]]
    if name == "near_dedup":
        texts = {r.doc_id: sets(r.text) for r in rows if r.doc_id is not None}
        least = {i: i for i in texts}
        for a in sorted(texts):
            for b in sorted(texts):
                if a < b and texts[a] and 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b]):
                    old, new = max(least[a], least[b]), min(least[a], least[b])
                    least = {i: new if c == old else c for i, c in least.items()}
        return list(dict.fromkeys(tuple(r) for r in rows if r.doc_id is not None and least[r.doc_id] == r.doc_id)) + [tuple(r) for r in rows if r.doc_id is None]
    field, out = pii.fit_on(docs.select("doc_id", "text")), []
    for r in rows:
        row = r.asDict()
        for kind, a, b in sorted(pii.all_spans(r.text or "", field)[1], key=lambda s: -s[1]):
            row["text"] = row["text"][:a] + f"[{pii.KINDS[kind].upper()}]" + row["text"][b:]
        out.append(tuple((row | {"n_chars": len(row["text"]) if row["text"] != r.text else r.n_chars}).values()))
    return out


def test_stages_against_plain_versions(spark, odd):
    docs, folder = work.table(spark, odd, "documents"), work.work_folder(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_dedup", "pii", "packing"]
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = work.staged(stage(spark, docs, odd), folder, name)
        assert out.columns == columns and as_rows(out) == sorted(plain(name, spark, docs, odd), key=repr), name
        sizes.append(out.count())
        if name == "pii":
            found = [r.text for r in out.collect() if r.doc_id is not None and r.doc_id >= 5000]
            assert found and all("[PHONE]" in t and "[EMAIL]" in t for t in found)
        docs = out
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 100
    pieces = corpus_pipeline.packing_stage(spark, docs, odd).collect()
    want = brute_ids([(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()], 2)
    own = {}
    for p in pieces:
        own.setdefault(p.doc_id, []).append(p)
    for i, ids in want:
        mine = sorted(own[i], key=lambda p: p.start)
        assert sum(p.length for p in mine) == len(ids) and [p.piece for p in mine] == list(range(len(mine)))
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in mine)
    lanes = {}
    for p in pieces:
        lanes.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all(a + n == b for lane in lanes.values() for (a, n), (b, _) in zip(sorted(lane), [*sorted(lane)[1:], (sum(x for _, x in lane), 0)], strict=True))
    assert all(sum(n for _, n in lane) <= packing.LENGTH for lane in lanes.values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, odd).drop("sequence_id", "offset").collect()), key=repr) == sorted((tuple(p)[:5] for p in pieces), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, tmp_path, name):
    folder = str(tmp_path)
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)
    assert name != "packing" or corpus_pipeline.run(spark, folder).collect() == []


def test_smallest_tables(spark):
    docs, folder = work.table(spark, SF, "documents"), work.work_folder(spark)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = work.staged(stage(spark, docs, SF), folder, name)
    kept = {r.doc_id for r in minhash.near_duplicates(docs, percent=corpus_pipeline.ALIKE).where("kept").collect()}
    assert kept == {r.doc_id for r in docs.collect()} and len(kept) > 50
