"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads a run of letters, or of other visible bytes, in both directions (A-Z as a-z; a run over SPAN bytes in spans,
all of it) and labels every byte position with log probabilities of the languages. A document pools those of all its positions.
As the state starts anew with each run, equal runs are read once in a batch, and those seen lately are not read again.

Text that is null or has no letter is `und` with score 0. Rows that repeat a doc_id are labelled alike. Other columns are
ignored. Without labelled rows every text is `und`. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples, work
from .bpe import KINDS
from .shingles import LOWER

#: Documents learned from, of each language, languages at most, and words a document gives.
FIT_DOCS, LANGUAGES, FIT_WORDS = 250, 200, 120
HIDDEN, SPAN = 8, 48
STEPS, BATCH, RATE = 450, 256, 0.015
#: Runs whose sums a worker keeps; some 100 MB.
CACHE = 400_000
#: Positions up to this many add evidence; longer texts are no surer.
EVIDENCE = 60
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights of both directions: table (byte to gate inputs), recurrent matrices, biases, and the output layer."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 3):
        r = np.random.default_rng(seed)
        h = hidden
        self.hidden = h
        self.p = {}
        for side in "fb":
            self.p[f"{side}x"] = r.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p[f"{side}h"] = r.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            self.p[f"{side}c"] = np.zeros(3 * h, np.float32)
        self.p["o"] = r.normal(0, 0.3, (2 * h, n_labels)).astype(np.float32)
        self.p["d"] = np.zeros(n_labels, np.float32)

    def run(self, side: str, bytes_: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """States at each (step, row) of rows sorted by falling length; gates too if keep."""
        h, (n, width) = self.hidden, bytes_.shape
        wx, wh, c = self.p[side + "x"], self.p[side + "h"], self.p[side + "c"]
        states = np.zeros((width, n, h), np.float32)
        kept = []
        state = np.zeros((n, h), np.float32)
        for t in range(width):
            a = int(np.searchsorted(-lengths, -t, side="left"))  # rows longer than t
            x = wx[bytes_[:a, t]] + c
            old = state[:a]
            rec = old @ wh[:, : 2 * h]
            zr = _sigmoid(x[:, : 2 * h] + rec)
            z, r = zr[:, :h], zr[:, h:]
            g = np.tanh(x[:, 2 * h :] + (r * old) @ wh[:, 2 * h :])
            new = old + z * (g - old)
            if keep:
                kept.append((a, old.copy(), z, r, g))
            state[:a] = new
            states[t, :a] = new
        return states, kept

    def back(self, side: str, bytes_: np.ndarray, kept: list, upstream: np.ndarray, grads: dict) -> None:
        """Through time from the last step to the first."""
        h = self.hidden
        wh = self.p[side + "h"]
        gx, gh, gc = grads[side + "x"], grads[side + "h"], grads[side + "c"]
        carried = np.zeros(upstream.shape[1:], np.float32)
        for t in range(len(kept) - 1, -1, -1):
            a, old, z, r, g = kept[t]
            d = upstream[t, :a] + carried[:a]
            dz, dg = d * (g - old), d * z
            d_old = d * (1 - z)
            dg = dg * (1 - g * g)
            ro = r * old
            gh[:, 2 * h :] += ro.T @ dg
            d_ro = dg @ wh[:, 2 * h :].T
            dr = d_ro * old
            d_old += d_ro * r
            dzr = np.concatenate([dz * z * (1 - z), dr * r * (1 - r)], axis=1)
            gh[:, : 2 * h] += old.T @ dzr
            d_old += dzr @ wh[:, : 2 * h].T
            every = np.concatenate([dzr, dg], axis=1)
            np.add.at(gx, bytes_[:a, t], every)
            gc += every.sum(0)
            carried[:a] = d_old

    def positions(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Log probabilities at each position of each row (rows sorted by falling length), and whether the position is real."""
        width = words.shape[1]
        real = np.arange(width)[None] < lengths[:, None]
        mirror = np.where(real, lengths[:, None] - 1 - np.arange(width)[None], np.arange(width)[None])
        flipped = np.take_along_axis(words, mirror, 1)
        return real, mirror, flipped

    def forward(self, words, lengths, keep=False):
        real, mirror, flipped = self.positions(words, lengths)
        f, kf = self.run("f", words, lengths, keep)
        b, kb = self.run("b", flipped, lengths, keep)
        b = np.take_along_axis(b.transpose(1, 0, 2), mirror[:, :, None], 1)
        both = np.concatenate([f.transpose(1, 0, 2), b], axis=2)
        logits = both @ self.p["o"] + self.p["d"]
        logits -= logits.max(2, keepdims=True)
        logits -= np.log(np.exp(logits).sum(2, keepdims=True))
        return logits, real, (both, mirror, flipped, kf, kb)

    def learn(self, words, lengths, labels, steps=STEPS, batch=BATCH, rate=RATE, seed=4):
        """Adam on the mean cross entropy over all positions."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        h = self.hidden
        for step in range(1, steps + 1):
            own = r.integers(0, len(words), batch)
            own = own[np.argsort(-lengths[own], kind="stable")]
            w, n, y = words[own][:, : lengths[own].max()], lengths[own], labels[own]
            logp, real, (both, mirror, flipped, kf, kb) = self.forward(w, n, True)
            d = np.exp(logp)
            d[np.arange(batch), :, y] -= 1
            d = (d * real[:, :, None] / real.sum()).astype(np.float32)
            grads = {k: np.zeros_like(x) for k, x in self.p.items()}
            flat = both.reshape(-1, 2 * h)
            grads["o"] = flat.T @ d.reshape(-1, d.shape[2])
            grads["d"] = d.sum((0, 1))
            up = d @ self.p["o"].T
            self.back("f", w, kf, up[:, :, :h].transpose(1, 0, 2), grads)
            # the mirror is its own inverse on real positions
            self.back("b", flipped, kb, np.take_along_axis(up[:, :, h:], mirror[:, :, None], 1).transpose(1, 0, 2), grads)
            now = rate * (0.1 if step > steps * 0.8 else 1)
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        return self


def padded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    width = int(lengths.max()) if len(lengths) else 0
    at = starts[:, None] + np.minimum(np.arange(width)[None], lengths[:, None] - 1)
    return data[at]


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of letters, digits or other marks; white space is left out."""
    kind = KINDS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    seen = kind[starts] != 0
    return starts[seen], ends[seen]


class Identifier:
    def __init__(self, network: Network | None, languages: list[str]):
        self.network, self.languages = network, languages
        self.cache: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(languages)), np.float32)

    def __getstate__(self):
        return {"network": self.network, "languages": self.languages, "cache": {}, "sums": np.zeros((0, len(self.languages)), np.float32)}

    def one_way(self, side: str, steps: np.ndarray, active: np.ndarray) -> np.ndarray:
        """What one direction adds to the scores at each (step, row); rows by falling length, active[t] of them at step t."""
        p, h = self.network.p, self.network.hidden
        table = p[side + "x"] + p[side + "c"]
        gates, inner = np.ascontiguousarray(p[side + "h"][:, : 2 * h]), np.ascontiguousarray(p[side + "h"][:, 2 * h :])
        out_w = p["o"][:h] if side == "f" else p["o"][h:]
        state = np.zeros((steps.shape[1], h), np.float32)
        out = np.zeros((*steps.shape, out_w.shape[1]), np.float32)
        for t, a in enumerate(active.tolist()):
            x = table[steps[t, :a]]
            old = state[:a]
            zr = old @ gates
            zr += x[:, : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            g = (zr[:, h:] * old) @ inner
            g += x[:, 2 * h :]
            np.tanh(g, out=g)
            g -= old
            g *= zr[:, :h]
            old += g
            out[t, :a] = old @ out_w
        return out

    def word_sums(self, words: list[bytes], block: int = 16_384) -> np.ndarray:
        """Log probabilities summed over the positions of each run."""
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        sums = np.zeros((len(words), len(self.languages)), np.float32)
        pieces = -(-lengths // SPAN)
        owner = np.repeat(np.arange(len(words)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        s = starts[owner] + nth * SPAN
        size = np.minimum(lengths[owner] - nth * SPAN, SPAN)
        order = np.argsort(-size, kind="stable")
        for k in range(0, len(order), block):
            own = order[k : k + block]
            n, at = size[own], s[own]
            width = int(n[0])
            active = np.searchsorted(-n, -np.arange(width), side="left")
            column = np.arange(width)[:, None]
            forth = data[at + np.minimum(column, n - 1)]
            back = data[at + np.maximum(n - 1 - column, 0)]
            f, b = self.one_way("f", forth, active), self.one_way("b", back, active)
            total = np.zeros((len(own), f.shape[2]), np.float32)
            for t, a in enumerate(active.tolist()):
                logits = f[t, :a] + b[n[:a] - 1 - t, np.arange(a)] + self.network.p["d"]
                logits -= logits.max(1, keepdims=True)
                logits -= np.log(np.exp(logits).sum(1, keepdims=True))
                total[:a] += logits
            np.add.at(sums, owner[own], total)
        return sums

    def looked_up(self, words: list[bytes]) -> np.ndarray:
        at = np.array([self.cache.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(at < 0)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        if len(new) < len(words):
            out[at >= 0] = self.sums[at[at >= 0]]
        if len(new):
            out[new] = self.word_sums([words[i] for i in new])
            if len(self.cache) + len(new) <= CACHE:
                self.cache |= {words[i]: len(self.sums) + k for k, i in enumerate(new)}
                self.sums = np.concatenate([self.sums, out[new]])
        return out

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each text."""
        data = LOWER[data]
        starts, ends = runs(data, offsets)
        n_docs = len(offsets) - 1
        if not len(starts):
            return np.full((n_docs, len(self.languages)), 1 / len(self.languages))
        # runs back to back without the white space, so that equal ones can be told by their bytes
        lengths = ends - starts
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        packed = data[KINDS[data] != 0]
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(packed)])
        coded = column.dictionary_encode()
        each = self.looked_up(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        at = np.searchsorted(starts, offsets)
        total = np.concatenate((np.zeros((1, each.shape[1])), np.cumsum(each, axis=0, dtype=np.float64)))
        pooled = total[at[1:]] - total[at[:-1]]
        count = np.maximum(bounds[at[1:]] - bounds[at[:-1]], 1)
        pooled = pooled / count[:, None] * np.minimum(count, EVIDENCE)[:, None]
        p = np.exp(pooled - pooled.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train(docs: DataFrame, fold: Column) -> Identifier:
    """Learn from FIT_DOCS documents of each language at most; their words, not more than FIT_WORDS of each, reach the driver."""
    work.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang").where(fold).where("lang is not null and text is not null")
    languages = sorted(r.lang for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    if not languages:
        return Identifier(None, [])
    # each task gives its lowest hashes of each language, so no language's rows meet in one task
    low = rows.withColumn("hash", F.xxhash64("doc_id")).select("lang", "hash", "doc_id", "text")
    share = low.mapInArrow(_lowest, "lang string, hash long, doc_id long, words array<binary>")
    share = work.staged(share, work.work_folder(docs.sparkSession), "share")
    found = []
    for lang in languages:
        found += [(lang, r.words) for r in share.where(F.col("lang") == lang).orderBy("hash", "doc_id").limit(FIT_DOCS).collect()]
    words, labels = [], []
    for lang, own in found:
        words += own
        labels += [languages.index(lang)] * len(own)
    if not words:
        return Identifier(None, [])
    raw = np.frombuffer(b"".join(bytes(w) for w in words), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths) - lengths
    # languages weigh alike however many words each gives
    labels = np.array(labels)
    r = np.random.default_rng(1)
    even = np.concatenate([r.choice(np.flatnonzero(labels == k), 6000) for k in np.unique(labels)])
    network = Network(len(languages)).learn(padded(raw, starts, lengths)[even], lengths[even], labels[even])
    return Identifier(network, languages)


def _lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each language the FIT_DOCS documents of this task with the lowest hashes, as words."""
    import heapq

    held: dict[str, list] = {}
    for batch in batches:
        langs, hashes, ids = (batch.column(i).to_pylist() for i in range(3))
        texts = batch.column(3)
        for i, (lang, h, d) in enumerate(zip(langs, hashes, ids, strict=True)):
            heap = held.setdefault(lang, [])
            if len(heap) < FIT_DOCS or (-h, -d) > heap[0][:2]:
                raw = LOWER[np.frombuffer(texts[i].as_py().encode(), np.uint8)]
                every = [raw[a:b].tobytes() for a, b in zip(*runs(raw, np.array([0, len(raw)])), strict=True)] if len(raw) else []
                step = max(1, len(every) // FIT_WORDS)
                item = (-h, -d, [w[:SPAN] for w in every[::step][:FIT_WORDS]])
                (heapq.heappush if len(heap) < FIT_DOCS else heapq.heapreplace)(heap, item)
    rows = [(lang, -h, -d, words) for lang, heap in held.items() for h, d, words in heap]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())), strict=True)], ["lang", "hash", "doc_id", "words"])


def _labeller(model: Identifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work.small_batches(batches, most=8_000_000):
            known = np.array([bool(t and _LETTER.search(t)) for t in batch.column(1).to_pylist()], bool)
            if model.network is None:
                best, score = [UND] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                p = model.pooled(*work.text_buffers(batch.column(1)))
                top = p.argmax(1)
                best = [model.languages[k] if ok else UND for k, ok in zip(top.tolist(), known.tolist(), strict=True)]
                score = np.where(known, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Identifier, held_out: Column) -> DataFrame:
    work.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    return rows.mapInArrow(_labeller(model), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.table(spark, sf_dir, "documents")
    return identify(docs, train(docs, work.crc_mod4() != 2), work.crc_mod4() == 2)
