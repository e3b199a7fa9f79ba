"""Text operators against brute force on small tables with odd rows."""

import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import bpe, minhash, packing, pii, shingles, token_store, unigram, work

P = pytest.importorskip("public_tokenizers")
BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) + str(r.randrange(40)) for _ in range(n)]


def odd_rows():
    """Nulls, empty, white space, ties, repeated rows, one very long text, groups of near copies."""
    base = words(120, 1)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE Two "), (6, "x"), (7, " ".join(base)), (8, " ".join(base).upper()), (8, " ".join(base).upper())]
    for i in range(40):
        own = list(base)
        for k in range(1 + i % 4):
            own[(i * 7 + k * 29) % len(own)] = f"new{i}-{k}"
        rows.append((100 + i, " ".join(own)))
    rows.append((500, " ".join(words(30_000, 2))))
    rows += [(600 + i, " ".join(words(60, 10 + i))) for i in range(20)]
    return rows


def table(spark, rows):
    """documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 7.0, "n") for i, t in rows], "doc_id long, text string, id string, score double, n string")


def sets(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """doc_id to (n_shingles, component) by comparing all pairs."""
    texts = {}
    for i, t in rows:
        texts[i] = sets(t)
    ids = sorted(texts)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(texts[a] & texts[b])
            if texts[a] and texts[b] and 100 * both >= 85 * len(texts[a] | texts[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(texts[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [2000, 6])
def test_near_duplicates(spark, block):
    rows = odd_rows()
    want = components(rows)
    got = minhash.near_duplicates(table(spark, rows), block).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


@pytest.mark.parametrize("block", [2000, 6])
def test_near_dedup_stage_at_four_fifths(spark, block, monkeypatch):
    """The pipeline's stage links at 0.8: of each group of texts alike by that much, the one with the least id stays."""
    import corpus_pipeline

    plain = minhash.near_duplicates
    monkeypatch.setattr(minhash, "near_duplicates", lambda docs, **given: plain(docs, block, **given))
    rows = [r for r in odd_rows() if r[0] < 100]
    for i in range(30):  # one, two or three words of 60 to 119 replaced: similarity from 0.66 to 0.92
        base = words(60 + i * 2, 900 + i)
        rows.append((2000 + 10 * i, " ".join(base)))
        for n in (1, 2, 3):
            own = list(base)
            for k in range(n):
                own[10 + 20 * k] = f"other{k}"
            rows.append((2000 + 10 * i + n, " ".join(own)))
    texts = {i: sets(t) for i, t in rows}
    least = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and texts[a] and 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b]):
                old, new = max(least[a], least[b]), min(least[a], least[b])
                least = {i: new if c == old else c for i, c in least.items()}
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, table(spark, rows), "").collect())
    assert kept == sorted(i for i, c in least.items() if i == c)
    assert len(kept) < len({r.component_id for r in plain(table(spark, rows)).collect()})


def test_bands_follow_the_limit():
    assert [minhash.band_rows(p) for p in (85, 80)] == [6, 5] and [minhash.loose(p) for p in (85, 80)] == [0.6, 0.52]


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicates(table(spark, [])).collect() == []
    assert [tuple(r) for r in minhash.near_duplicates(table(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]


@given(st.lists(st.text(alphabet="aB é\n\t.🙂x", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_shingle_sets_by_count(texts):
    flat, at = shingles.shingle_sets(*work.text_buffers(pa.array(texts, pa.string())))
    assert np.diff(at).tolist() == [len(sets(t)) for t in texts]
    own = {}
    for i, t in enumerate(texts):
        own.setdefault(frozenset(sets(t)), set()).add(flat[at[i] : at[i + 1]].tobytes())
    assert all(len(v) == 1 for v in own.values()) and len({next(iter(v)) for v in own.values()}) == len(own)


def test_bits_estimate_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 4000, dtype=np.uint64))
    b = np.concatenate([a[:3600], np.unique(r.integers(0, 2**63, 400, dtype=np.uint64))])
    least = minhash.minima(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]))
    x, y = minhash.packed_bits(least).astype(np.uint64)
    agree = sum(((int(x[i]) >> s) & 15) == ((int(y[i]) >> s) & 15) for i in range(len(x)) for s in range(0, 64, 4)) / minhash.HASHES
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((agree - 1 / 16) / (15 / 16) - true) < 0.15


@given(st.lists(st.text(alphabet=" \n\tabAZéß019.,!?-'×🙂中", max_size=25), max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_equal_whole_text(texts):
    encoder = _encoder()
    ids, at = encoder.encode(*work.text_buffers(pa.array(texts, pa.string())))
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in want]


def test_added_tokens_equal_the_library(spark):
    """Texts that hold an added token, against a tokenizer as its file gives it."""
    from tokenizers import Tokenizer

    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endof", "text|> no token", "plain", ""]
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [505, 220, 50256, 734]
    ids, at = _encoder().encode(*work.text_buffers(pa.array(texts)))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want
    rows = list(enumerate(texts))
    stored = token_store.read_digests(spark, token_store.write_store(table(spark, rows), work.work_folder(spark), BPE)).collect()
    assert {q[0]: (q[2], q[3]) for q in stored} == {i: (len(x) + 1, crc([*x, 0])) for i, x in enumerate(want)}
    pieces = packing.pack(table(spark, rows), BPE).collect()
    assert {q.doc_id: (q.length, q.ids_crc32) for q in pieces} == {i: (len(x) + 1, crc([*x, 2])) for i, x in enumerate(want)}


_held = []


def _encoder():
    if not _held:
        _held.append(bpe.Encoder(BPE))
    return _held[0]


def brute_ids(rows, end):
    return [(i, _encoder().tokenizer.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in sorted(rows, key=lambda r: (r[0], r[1] or ""))]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_token_store(spark):
    rows = odd_rows()
    folder = token_store.write_store(table(spark, rows), work.work_folder(spark), BPE)
    want, at = [], 0
    for i, ids in brute_ids(rows, 0):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, token_store.read_digests(spark, folder).collect())) == sorted(want)
    whole = {(r.doc_id, r.start): list(r.ids) for r in token_store.read_documents(spark, folder).collect()}
    assert sorted((i, s, len(x), crc(x)) for (i, s), x in whole.items()) == sorted(want)
    names = [bytes(r.digest) for r in token_store.chunk_table(spark, folder).select("digest").collect()]
    assert len(names) == len(set(names))


def test_token_store_finds_damage(spark):
    folder = token_store.write_store(table(spark, odd_rows()[:8]), work.work_folder(spark), BPE)
    chunks = token_store.chunk_table(spark, folder).toPandas()
    bad = chunks.assign(digest=[bytes([b[0] ^ 1]) + bytes(b[1:]) for b in chunks["digest"]])
    with pytest.raises(ValueError):
        list(token_store._verified(iter([pa.RecordBatch.from_pandas(bad, preserve_index=False)])))


@pytest.mark.parametrize("damage", ["chunks", "root", "start", "n_tokens", "lost recipe", "manifest", "lost part", "lost chunk"])
def test_token_store_verifies_recipes_and_manifest(spark, damage):
    folder = token_store.write_store(table(spark, odd_rows()[:8]), work.work_folder(spark), BPE)
    where = "manifest" if damage in ("manifest", "lost part") else "pass/kind=chunk" if damage == "lost chunk" else "recipes"
    name = f"{folder}/{where}"
    before = spark.read.parquet(name)
    rows = [r.asDict() for r in before.collect()]
    if damage.startswith("lost"):
        rows.pop()
    elif damage in ("chunks", "root", "manifest"):
        column = "root" if damage == "manifest" else damage
        rows[-1][column] = bytes([rows[-1][column][0] ^ 1]) + bytes(rows[-1][column][1:])
    else:
        rows[-1][damage] += 1
    changed = spark.createDataFrame(rows, before.schema).coalesce(1)
    changed.write.mode("overwrite").parquet(name)
    for read in (token_store.read_digests, token_store.read_documents):
        with pytest.raises(Exception, match="match|lacks a chunk|add up"):
            read(spark, folder).collect()


def test_empty_store(spark):
    folder = token_store.write_store(table(spark, []), work.work_folder(spark), BPE)
    assert token_store.read_digests(spark, folder).collect() == []


@given(st.lists(st.binary(max_size=200), max_size=9))
def test_crc_of_parts(parts):
    crcs, sizes = np.array([zlib.crc32(x) for x in parts], np.int64), np.array([len(x) for x in parts], np.int64)
    assert token_store.crc32_of_parts(crcs, sizes) == zlib.crc32(b"".join(parts))


def test_chunks_follow_content():
    r = np.random.default_rng(3)
    shared = r.integers(0, 50_000, 4000).astype(np.uint32)
    one, two = np.concatenate([r.integers(0, 50_000, 900).astype(np.uint32), shared]), np.concatenate([r.integers(0, 50_000, 333).astype(np.uint32), shared])
    names = []
    for x in (one, two):
        at, own = 0, set()
        for to in token_store.cuts(x, np.array([0, len(x)]))[0]:
            own.add(token_store.digest_of(x[at:to]))
            at = to
        assert at == len(x)
        names.append(own)
    assert len(names[0] & names[1]) >= 3


def test_packing(spark):
    rows = odd_rows()
    got = packing.pack(table(spark, rows), BPE).collect()
    seqs, docs = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    for i, ids in brute_ids(rows, 2):
        own = sorted(docs[i], key=lambda r: r.piece)
        if i == 8:
            continue
        at = 0
        for k, r in enumerate(own):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids) and (len(own) == 1) == (len(ids) <= 1024)
    total = sum(r.length for r in got)
    assert len(seqs) <= -(-total // 1024) + 2
    once = [r for r in rows if r[0] != 8]
    full = packing.sequences(table(spark, once), packing.pack(table(spark, once), BPE), BPE).collect()
    assert sum(len(r.ids) for r in full) == sum(len(ids) for _, ids in brute_ids(once, 2))
    assert packing.pack(table(spark, []), BPE).collect() == []


@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_best_fit_takes_the_least_room(sizes, most):
    fit, free = packing.BestFit(50, most), {}
    for n in sizes:
        room = {k: v for k, v in free.items() if v >= n}
        name, at = fit.place(n)
        if room:
            assert free[name] == min(room.values())
        else:
            assert name not in free
            if len(free) == most:
                gone = min(free.values())
                del free[next(k for k, v in free.items() if v == gone and not any(k in x for x in fit.at.values()))]
            free[name] = 50
        assert at == 50 - free[name]
        free[name] -= n
        if not free[name]:
            del free[name]


def test_unigram_round_trip_and_score(spark):
    """Whole texts, long ones too, against a plain Viterbi over all pieces."""
    rows = [*odd_rows()[:12], (500, " ".join(words(3000, 2))), (700, "a  b\n中文 ñ 🙂"), (701, " lead"), (702, "été token = \"0f\""), (703, "a▁b"), (704, "▁"), (705, "x" * 3000)]
    out = {r.doc_id: r for r in unigram.encode(table(spark, rows), PIECES).collect()}
    back = {r.doc_id: r.text for r in unigram.decode(unigram.encode(table(spark, rows), PIECES), PIECES).collect()}
    pieces = unigram.Pieces(PIECES)
    known = {pieces.raw[i]: s for i, s in enumerate(pieces.scores.tolist()) if i > 2 and not pieces.is_byte[i]}
    most = max(map(len, known))
    for i, t in rows:
        assert back[i] == (t or "").replace("▁", " ") and out[i].round_trip == ("▁" not in (t or "")) and out[i].ids_crc32 == crc(list(out[i].ids))
        assert out[i].n_pieces == len(out[i].ids) and out[i].n_bytes == sum(bool(pieces.is_byte[k]) for k in out[i].ids)
        if t:
            raw = (" " + t.replace("▁", " ")).encode()
            best = [0.0] + [-1e300] * len(raw)
            for a in range(len(raw)):
                if raw[a] & 0xC0 == 0x80:
                    continue
                size = next(k for k in range(1, 5) if a + k >= len(raw) or raw[a + k] & 0xC0 != 0x80)
                for b in range(a + 1, min(len(raw), a + most) + 1):
                    if raw[a:b] in known:
                        best[b] = max(best[b], best[a] + known[raw[a:b]])
                if raw[a : a + size] not in known:
                    best[a + size] = max(best[a + size], best[a] + pieces.unknown)
            assert abs(best[-1] - out[i].score) < 1e-6 * max(1, abs(best[-1]))
    assert unigram.encode(table(spark, []), PIECES).collect() == []


def test_log_scores():
    """Zipf's law sums to one over the usual pieces; a unigram file keeps its own scores."""
    pieces = unigram.Pieces(PIECES)
    usual = [s for s in pieces.scores if s < 0]
    assert abs(sum(map(math.exp, usual)) - 1) < 1e-9 and len(usual) > 30_000
    assert unigram.log_scores(np.array([0.0, -1.0, -2.0]), [False, True, True], True).tolist() == [0, -1, -2]
    got = unigram.log_scores(np.array([0.0, -7.0, -5.0]), [False, True, True], False)
    assert np.allclose(np.exp(got[1:]), [1 / 3, 2 / 3])


def test_unigram_equals_library():
    """The library's unigram model over the same pieces and log scores finds sums as large, on short and long texts."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2

    pieces = unigram.Pieces(PIECES)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1
    for p, s in zip(model.pieces, pieces.scores.tolist(), strict=True):
        p.score = s
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in [12] * 40 + [2000] * 3]
    ids, at, scores = pieces.encode(*work.text_buffers(pa.array(texts)))
    total = lambda x: sum(pieces.scores[i] for i in x)
    for k, t in enumerate(texts):
        own = total(ids[at[k] : at[k + 1]])
        assert abs(own - total(library.encode(t))) < 1e-5 * abs(own) and abs(own - scores[k]) < 1e-6 * abs(own)


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@given(st.text(alphabet="a.b@-+1 23(4)é%_", max_size=60))
@settings(max_examples=300)
def test_base_spans(t):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == brute_spans(t)


def test_pii_query_and_redaction(spark):
    card = next(f"41111111111111{i:02d}" for i in range(100) if pii.luhn(f"41111111111111{i:02d}"))
    said = f"Call +1 (017) 555-7713 or write a.b@mail.example.com from 10.0.0.1 with {card}. Again 555-7713."
    rows = [(1, said), (2, None), (3, ""), (4, "no data 4.0"), (5, "é " + said), (5, "é " + said)] + [(10 + i, f"ring +1 (2{i:02d}) 555-{1000 + i} now, {i} times, 4.{i}") for i in range(60)]
    got = {r.doc_id: r for r in pii.find(table(spark, rows)).collect()}
    for i, t in rows:
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    clean = {r.doc_id: r for r in pii.redact(table(spark, rows)).collect()}
    assert "[EMAIL]" in clean[1].text and "[PHONE]" in clean[1].text and card not in clean[1].text and clean[2].text is None and clean[4].text == "no data 4.0"
    assert pii.find(table(spark, [])).collect() == []


@pytest.fixture(scope="module")
def field():
    r = random.Random(8)
    cards = [f"4{i:015d}" for i in range(10**12, 10**12 + 4000) if pii.luhn(f"4{i:015d}")]
    texts = []
    for i in range(500):
        said = [cards[i % len(cards)], f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", f"u.{r.choice(['ann', 'bob'])}{i}@mail{i % 9}.example.com", f"{i % 250}.17.{i % 90}.9"][i % 4]
        texts.append(f"see {said} now, {i} times, 4.{i}, code 77{i:02d}, id {i:016d}, 2024-01-{i % 28:02d}, {r.randint(10**9, 10**10)}")
    return pii.fit([pii.Graph.unpacked(pii.practice(t, random.Random(i)).packed()) for i, t in enumerate(texts)])


@pytest.mark.parametrize(
    ("text", "more"),
    [
        ("Call +1 (415) 555-0134 now. My number 415 555 0134 again, or 555-0134.", ["415 555 0134", "555-0134"]),
        ("No +1 here: 415 555 0134 again 415 555 0134 and 555-0134", []),
        ("pay 4111111111111111 now. Again 4111111111111111 12345 then", ["4111111111111111"]),
        ("pay 4111111111111111 now. Again 99 12345 then", []),
        ("mail a.b34@mail7.example.com, that is a.b34@mail7 here", ["a.b34@mail7"]),
        ("mail a.b34@mail7 here and a.b34@mail7 there", []),
        ("no token", []),
    ],
)
def test_skip_edges_carry_labels(field, text, more):
    """What a pattern finds in one place is found in another form elsewhere, and nothing is without such a place."""
    base, every = pii.all_spans(text, field)
    assert [("email ip card phone".split()[k], a, b) for k, a, b in base] == brute_spans(text)
    assert [text[a:b] for k, a, b in every if (k, a, b) not in base] == more


def test_field_runs_without_a_pattern(field):
    """A card that only its shape shows is found in a document where no pattern finds anything, or not at all; counts are the base's."""
    text = "pay 4111.1111.1111.1111 now"
    base, every = pii.all_spans(text, field)
    assert base == [] and every in ([], [(2, 4, 23)])
    out = next(pii._finder(field)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])]))).to_pylist()[0]
    assert (out["n_card"], out["base_sha256"]) == (0, hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("loops", [False, True])
def test_marginals_against_enumeration(loops):
    """Exact on trees; close on small graphs with loops."""
    r = np.random.default_rng(12)
    for _ in range(20):
        f = pii.Field(r.normal(size=(5, pii.N_FEATURES)), 1.5, 0.7 * r.normal(size=(5, 5)), 0.7 * r.normal(size=(5, 5)))
        g = pii.Graph("", [])
        n = 5
        g.tokens, g.x, g.labels = range(n), r.random((n, pii.N_FEATURES)), r.integers(0, 5, n) * (r.random(n) < 0.4)
        g.edges = [(int(r.integers(0, i)), i) for i in range(1, n)]
        if loops:
            g.edges.append(next(e for e in ((0, 4), (1, 4), (2, 4)) if e not in g.edges))
        g.is_skip = [bool(x) for x in r.integers(0, 2, len(g.edges))]
        unary = g.x @ f.unary.T
        unary[g.labels > 0, g.labels[g.labels > 0]] += f.base
        want = np.zeros((n, 5))
        for labels in itertools.product(range(5), repeat=n):
            s = sum(unary[i, y] for i, y in enumerate(labels))
            p = np.exp(s + sum((f.skip if k else f.chain)[labels[a], labels[b]] for (a, b), k in zip(g.edges, g.is_skip, strict=True)))
            want[range(n), labels] += p
        want /= want.sum(1, keepdims=True)
        assert np.abs(f.marginals(g, 30) - want).max() < (0.1 if loops else 1e-9)


@given(st.text(alphabet="a.@-+ 1()é,", max_size=50))
@settings(max_examples=300)
def test_tokens_cover_every_digit_once(t):
    spans = pii.base_spans(t)
    found = pii.tokens_of(t, spans)
    assert all(a < b for _, a, b in found) and all(x[2] <= y[1] for x, y in itertools.pairwise(found))
    inside = {i for _, a, b in found for i in range(a, b)}
    assert all(i in inside for i, c in enumerate(t) if c.isascii() and c.isdigit())
    assert all((k > 0) == any(x < b and a < y for _, x, y in spans) for k, a, b in found)


def test_long_texts_cost_in_proportion(field):
    for unit in ("x", "1 ", "a@b ", ".", "中1", "1.", "+1", "1.1.1.1 "):
        seconds = []
        for n in (20_000, 80_000):
            began = time.perf_counter()
            pii.all_spans(unit * (n // len(unit)) + "7", field)
            seconds.append(time.perf_counter() - began)
        assert seconds[1] < 1 + 8 * seconds[0], unit
    assert pii.all_spans("1.2.3." + "0" * 5000 + "7", field)[0] == [(1, 0, 5007)]
