"""Toxicity: gradient-boosted trees over dense features of the whole text, calibrated by isotonic regression.

Features: density and weight of lexicon words, learned ones and common insults, the same after undoing letter substitutions, second-person words and those near
a lexicon word, capitals, punctuation, digits, obfuscated and single-letter words, length. The lexicon is learned: words and word
beginnings much more frequent in toxic than in other documents of one half of the labelled sample; trees are fitted on the other
half, so they see the lexicon as new documents do. Labels come only from rows that `fold` admits.

Null and empty texts get the features of an empty text and a score like any other. Rows that repeat a doc_id are scored each.
Other columns are ignored. Without labels of both kinds each score is the share of toxic labels. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, samples, work
from .shingles import LOWER, span_hashes, word_bounds

#: Most labelled documents of each kind that are learned from, and most words of the lexicon.
FIT_TOXIC, FIT_OTHER, LEXICON = 4000, 6000, 300
THRESHOLD = 0.3
#: Bytes of the word beginnings that the lexicon may hold beside whole words.
PREFIXES = range(5, 11)
#: Standard errors taken off a word's log odds, and the least part of the best word's evidence that counts.
DOUBT, CLEAR = 3.0, 0.02
NEAR = 6
# Second-person words of English, French, German and Spanish.
SECOND_PERSON = "you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine deinen deiner ihr euch euer tú ti tus usted ustedes vosotros".split()
# Common insults of English, French, German and Spanish.
INSULTS = """idiot idiots moron morons stupid dumb loser losers trash garbage scum pathetic disgusting worthless clown clowns ugly fool jerk freak creep
imbecile imbécile crétin crétine connard connasse stupide débile ordure salaud salope pourriture minable
dumm dumme blöd trottel arschloch abschaum versager widerlich wertlos ekelhaft vollidiot depp
idiota estúpido estúpida imbécil tonto tonta basura asqueroso asquerosa patético patética perdedor escoria payaso""".split()
FEATURES = 17

_NOT_LETTER = np.array([not (chr(b).isalpha() if b < 128 else True) for b in range(256)])
_PUNCT = np.array([b < 128 and 32 < b < 127 and not chr(b).isalnum() for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGITS = np.array([48 <= b <= 57 for b in range(256)])
#: Letters that digits and signs stand for.
_UNDONE = LOWER.copy()
for _a, _b in zip("013457@$!|", "oieastasil", strict=True):
    _UNDONE[ord(_a)] = ord(_b)
_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in "013457@$!|*"]] = True


def hashed(raw: list[bytes]) -> np.ndarray:
    """Hashes of single words as they get in a text."""
    ends = np.cumsum([len(w) for w in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return span_hashes(data, ends - np.array([len(w) for w in raw]), ends) if raw else np.zeros(0, np.uint64)


class Lexicon:
    """Whole words and word beginnings with weights from 0 to 1; words come as themselves, beginnings with a hyphen."""

    def __init__(self, words: list[bytes], weights: list[float]):
        self.tables = []
        for whole in (True, False):
            some = [i for i, w in enumerate(words) if w.endswith(b"-") != whole]
            h = hashed([words[i].removesuffix(b"-") for i in some])
            order = np.argsort(h)
            self.tables.append((h[order], np.array([weights[i] for i in some], np.float64)[order]))
        self.strong = 0.5 * max(weights, default=1.0)
        self.you = np.sort(hashed([w.encode() for w in SECOND_PERSON]))
        self.insults = np.sort(hashed([w.encode() for w in INSULTS]))

    def weigh(self, h: np.ndarray, whole: bool = True) -> np.ndarray:
        hashes, weights = self.tables[0 if whole else 1]
        if not len(hashes) or not len(h):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return np.where(hashes[at] == h, weights[at], 0.0)

    def weigh_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and the largest weight of the word or one of its beginnings."""
        h = span_hashes(data, starts, ends)
        weight = self.weigh(h)
        if len(self.tables[1][0]):
            for n in PREFIXES:
                own = np.flatnonzero(ends - starts >= n)
                if len(own):
                    w = self.weigh(span_hashes(data, starts[own], starts[own] + n), False)
                    weight[own] = np.maximum(weight[own], w)
        return h, weight


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends = word_bounds(low, offsets, _NOT_LETTER)
    h, weight = lexicon.weigh_words(low, starts, ends)
    at = np.searchsorted(starts, offsets)
    words = np.maximum(np.diff(at), 1)
    insult = np.isin(h, lexicon.insults)
    hit = (weight > 0) | insult
    you = np.isin(h, lexicon.you)
    # second-person words with a lexicon word among the NEAR words on either side
    doc = np.repeat(np.arange(n), np.diff(at))
    hits = np.flatnonzero(hit)
    near = np.zeros(len(h), bool)
    if len(hits):
        mine = np.flatnonzero(you)
        k = np.searchsorted(hits, mine)
        for other in (hits[np.minimum(k, len(hits) - 1)], hits[np.maximum(k - 1, 0)]):
            near[mine[(np.abs(other - mine) <= NEAR) & (doc[other] == doc[mine])]] = True
    undone = _UNDONE[data]
    changed = (_SIGNS[data]).astype(np.int64)
    s2, e2 = word_bounds(undone, offsets, _NOT_LETTER)
    prefix = np.concatenate(([0], np.cumsum(changed)))
    odd = (prefix[e2] > prefix[s2]) & ((e2 - s2) - (prefix[e2] - prefix[s2]) >= 2)
    s2, e2 = s2[odd], e2[odd]
    h2 = span_hashes(undone, s2, e2) if len(s2) else np.zeros(0, np.uint64)
    masked = (lexicon.weigh(h2) > 0) | np.isin(h2, lexicon.insults)
    at2 = np.searchsorted(s2, offsets)
    chars = np.maximum(np.diff(offsets), 1)
    strong = weight >= lexicon.strong
    x = np.zeros((n, FEATURES))
    x[:, 0] = 100 * _sums(weight, at) / words
    x[:, 1] = np.log1p(_sums(hit, at))
    x[:, 2] = 100 * _sums(strong, at) / words
    x[:, 3] = np.log1p(_sums(strong, at))
    x[:, 4] = np.log1p(_sums(masked, at2))
    x[:, 5] = 100 * _sums(you, at) / words
    x[:, 6] = _sums(near, at)
    x[:, 7] = _sums(_UPPER[data], offsets) / chars
    x[:, 8] = 100 * _sums(data == 33, offsets) / chars
    x[:, 9] = 100 * _sums(data == 63, offsets) / chars
    x[:, 10] = _sums(_PUNCT[data], offsets) / chars
    x[:, 11] = _sums(_DIGITS[data], offsets) / chars
    x[:, 12] = np.diff(at2) / words
    x[:, 13] = _sums((ends - starts) == 1, at) / words
    x[:, 14] = np.log1p(np.diff(at))
    x[:, 15] = 100 * _sums(insult, at) / words
    x[:, 16] = np.log1p(_sums(insult, at))
    return x


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work.small_batches(batches):
            x = features(*work.text_buffers(batch.column(1)), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, other): in how many documents of this task each word stands."""
    counts = (Counter(), Counter())
    pattern = re.compile(rb"[A-Za-z\x80-\xff]+")
    for batch in batches:
        for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = {w for w in pattern.findall((text or "").encode().lower()) if len(w) > 2}
            counts[label].update(words)
            counts[label].update({w[:n] + b"-" for w in words for n in PREFIXES if len(w) >= n})
    words = [w for w in counts[1] if len(w) < 40]
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], ["word", "toxic", "other"])


class Model:
    def __init__(self, lexicon: Lexicon, trees: boosting.Trees):
        self.lexicon, self.trees = lexicon, trees

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.clip(self.trees.score(features(data, offsets, self.lexicon)), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, fold: Column) -> Model:
    """Learn from at most FIT_TOXIC and FIT_OTHER documents; only ids, word counts of them and features reach the driver."""
    spark = docs.sparkSession
    work.prepare(spark)
    folder = work.work_folder(spark)
    ids = work.staged(samples.labelled(labels, "toxic", {1: FIT_TOXIC, 0: FIT_OTHER}, fold), folder, "ids")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = own.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label")
    sample = work.staged(sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))), folder, "sample")
    first, second = (sample.where(F.col("half") == k).select("doc_id", "text", "label") for k in (0, 1))
    sizes = {r.label: r.n for r in first.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("other") + 0.5) / (other + 1.0))
    counted = first.mapInArrow(_counted, "word binary, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    # a word counts by how much likelier, at the least, it is in toxic texts, and by how many of them it explains
    doubt = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    found = counted.where(F.col("toxic") >= max(4, toxic // 100)).withColumn("weight", ratio - DOUBT * doubt).where("weight > 0.5")
    rows = found.withColumn("rank", F.col("toxic") * F.col("weight")).orderBy(F.desc("rank"), "word").limit(LEXICON).collect()
    top = max((r["rank"] for r in rows), default=1.0)
    rows = [r for r in rows if r["rank"] >= CLEAR * top]
    lexicon = Lexicon([bytes(r.word) for r in rows], [r["rank"] / top for r in rows])
    got = second.mapInArrow(_featured(lexicon), "doc_id long, label int, x array<double>").collect()
    got.sort(key=lambda r: r.doc_id)
    x = np.array([r.x for r in got]).reshape(-1, FEATURES)
    y = np.array([r.label for r in got], np.float64)
    # toxic documents are sampled more densely than others; weights restore their shares
    shares = {r.label: r.n for r in labels.where(fold).groupBy(F.col("toxic").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.where(y == 1, shares.get(1, 1) / max(1, y.sum()), shares.get(0, 1) / max(1, len(y) - y.sum()))
    return Model(lexicon, boosting.fit(x, y, np.arange(len(y)) % 4 == 0, weight))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work.small_batches(batches):
            p = model.score(*work.text_buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    work.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")


def _clean(model: Model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work.small_batches(batches):
            p = model.score(*work.text_buffers(batch.column(text_at)))
            yield batch.filter(pa.array(p < THRESHOLD))

    return run


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic."""
    model = train(docs, labels, work.crc_mod4() != 2)
    return work.kept_columns(docs, _clean(model, docs.columns.index("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.table(spark, sf_dir, "documents")
    model = train(docs, work.table(spark, sf_dir, "labels"), work.crc_mod4() != 2)
    return score(docs, model, work.crc_mod4() == 2)
