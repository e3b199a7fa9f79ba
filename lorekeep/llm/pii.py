"""Personal data: patterns, and a skip-chain conditional random field that carries their labels across a document.

Patterns give the base spans. The field's nodes are a document's tokens that hold a digit or an at sign; groups of digits that
stand together are one token, up to MOST_DIGITS digits. A chain links tokens that stand side by side, and a skip edge links each
token with the one before that repeats it or shares its last seven digits or the name before its at sign, and with the first such
one that a pattern finds, so that one supports its repetition in another form elsewhere. Loopy sum-product passing gives each token's marginals; tokens that no pattern covers and
that the field labels surely become further spans. It runs on every document with tokens.

Weights are fitted by pseudo-likelihood on all tokens of at most FIT_DOCS documents, with the patterns as labels and their votes
hidden at random. What repetition is worth is learned too: to the fitted documents, forms that no pattern finds are added, of an
entity that stands there (its label) or of other digits (no label), so shape alone decides little about them.

Null and empty texts have no spans. Rows that repeat a doc_id are treated alike. Other columns are ignored. An empty table
gives no rows. Texts cost in proportion to their length, with or without white space.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples, work

KINDS = ("email", "ip", "card", "phone")
#: Documents whose tokens the weights are fitted on.
FIT_DOCS = 600
SURE, ROUNDS = 0.9, 8
#: Digits that a token joined from groups has at most; more are no card or phone number.
MOST_DIGITS = 19

# What counts as personal data.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_NO_DIGIT = re.compile("[^0-9]")

_MARK = re.compile("[0-9@]")
_RUN = re.compile(r"[A-Za-z0-9@._%+()-]+")
_IN_RUN = _LOCAL | frozenset("@()")
_NUMBER = re.compile(r"[0-9.()+-]+")
_GAP = re.compile(r"[ ().-]{0,3}")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _is_address(dotted: str) -> bool:
    """Whether every part is at most 255, however many zeros it begins with."""
    parts = [p.lstrip("0") for p in dotted.split(".")]
    return all(len(p) < 4 and int(p or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in order of kind and start."""
    out: list[Span] = []
    at = text.find("@")
    floor = 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append((0, m.start(), m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if _is_address(m.group()):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NO_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


N_FEATURES, N_LABELS = 16, 5


def _runs(text: str) -> Iterator[Span]:
    """(0, start, end) of the runs that hold a digit or an at sign, without marks at their ends."""
    floor, found = 0, _MARK.search(text)
    while found:
        a = found.start()
        while a > floor and text[a - 1] in _IN_RUN:
            a -= 1
        floor = b = _RUN.match(text, a).end()
        while text[a] in "._%-()":
            a += 1
        while text[b - 1] in "._%+-()":
            b -= 1
        if a < b:
            yield 0, a, b
        found = _MARK.search(text, floor)


def tokens_of(text: str, spans: list[Span]) -> list[Span]:
    """(label, start, end) of the tokens; label 0, or the kind of a span that the token meets, plus one. Numbers of one span, and
    numbers outside all that stand together, are one token."""
    by_start = sorted((a, b, k + 1) for k, a, b in spans)
    starts, out, last_digits, numeric = [a for a, _, _ in by_start], [], 0, False
    upto = list(accumulate((b for _, b, _ in by_start), max))
    last_span = -1
    for _, a, b in _runs(text):
        i = bisect_left(starts, b) - 1  # the last span that starts before the run's end
        while i >= 0 and by_start[i][1] <= a:
            i = i - 1 if i and upto[i - 1] > a else -1
        label = by_start[i][2] if i >= 0 else 0
        word = text[a:b]
        digits = len(_NO_DIGIT.sub("", word))
        number = _NUMBER.fullmatch(word) is not None
        if out and i == last_span and number:
            _, first, end = out[-1]
            if i >= 0 or (numeric and word[0] != "+" and last_digits + digits <= MOST_DIGITS and _GAP.fullmatch(text, end, a)):
                out[-1] = (label, first, b)
                last_digits += digits
                continue
        out.append((label, a, b))
        last_digits, last_span, numeric = digits, i, number
    return out


class Graph:
    """Tokens of one document with features, chain and skip edges, the label that spans give each (0: none), and whether it is a pattern's."""

    def __init__(self, text: str, spans: list[Span], added: list[Span] = ()):
        found = tokens_of(text, [*spans, *added])
        self.tokens = tokens = [(a, b) for _, a, b in found]
        n = len(tokens)
        self.labels = np.array([k for k, _, _ in found], np.int64)
        edge = min((a for _, a, _ in added), default=len(text))
        self.voted = np.array([k > 0 and a < edge for k, a, _ in found], bool)
        self.x = np.zeros((n, N_FEATURES), np.float64)
        last, keys, self.edges, self.is_skip = {}, [], [], []
        for i, (a, b) in enumerate(tokens):
            word = text[a:b]
            digits = _NO_DIGIT.sub("", word)
            d = len(digits)
            dots = word.count(".")
            sign = a > 0 and text[a - 1] == "+"
            x = self.x[i]
            x[0] = 1
            x[1] = "@" in word
            x[2] = "@" in word and "." in word.rpartition("@")[2]
            x[3] = dots == 3 and d + 3 == len(word) and _is_address(word)
            x[4] = dots > 0
            x[5] = d < 4
            x[6] = 4 <= d < 8
            x[7] = 8 <= d <= 15
            x[8] = 16 <= d <= 19
            x[9] = d > 19
            x[10] = 16 <= d <= 19 and luhn(digits)
            x[11] = sign or word[0] == "+"
            x[12] = not word.isascii() or any(c.isalpha() for c in word[:64])
            x[13] = "-" in word
            beside = i > 0 and a - tokens[i - 1][1] <= 3
            x[14] = beside and not x[12]
            x[15] = d == len(word)
            if beside:
                self.edges.append((i - 1, i))
                self.is_skip.append(False)
            name = word.rpartition("@")[0]
            key = f"{name.lower()}@" if len(name) >= 3 else digits[-7:] if d >= 7 else word.lower() if len(word) >= 5 else None
            keys.append(key)
        sure: dict[str, int] = {}  # the first token of each key that a pattern finds
        for i, key in enumerate(keys):
            if key is not None and self.voted[i]:
                sure.setdefault(key, i)
        for i, key in enumerate(keys):
            if key is not None:
                for j in sorted({last.get(key, i), sure.get(key, i)} - {i}):
                    if j != i - 1 or tokens[i][0] - tokens[j][1] > 3:
                        self.edges.append((j, i))
                        self.is_skip.append(True)
                last[key] = i

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.edges, np.int64).reshape(-1, 2), np.array(self.is_skip, bool)

    def packed(self) -> bytes:
        """What fitting needs, without the text."""
        edges, is_skip = self.arrays()
        return b"".join(x.tobytes() for x in (np.array([len(self.tokens), len(edges)], np.int64), self.labels.astype(np.int8), self.voted, self.x.astype(np.int8), edges, is_skip))

    @classmethod
    def unpacked(cls, raw: bytes) -> Graph:
        g = cls.__new__(cls)
        n, m = (int(v) for v in np.frombuffer(raw, np.int64, 2))
        at = 16
        g.labels = np.frombuffer(raw, np.int8, n, at).astype(np.int64)
        g.voted = np.frombuffer(raw, bool, n, at + n)
        g.x = np.frombuffer(raw, np.int8, n * N_FEATURES, at + 2 * n).reshape(n, N_FEATURES).astype(np.float64)
        at += (2 + N_FEATURES) * n
        g.tokens = range(n)
        g.edges = np.frombuffer(raw, np.int64, 2 * m, at).reshape(m, 2)
        g.is_skip = np.frombuffer(raw, bool, m, at + 16 * m)
        return g


def _other_form(kind: int, said: str, r: random.Random) -> str:
    """An entity in a form that its pattern does not find."""
    digits = _NO_DIGIT.sub("", said)
    if kind == 0:
        return said.partition("@")[0] + "@" + said.partition("@")[2].partition(".")[0]
    if kind == 1:
        return said.replace(".", "-")
    if kind == 2:
        return r.choice((".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), digits))
    return r.choice((digits[-10:], f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-7:-4]}-{digits[-4:]}", f"{digits[-7:-4]} {digits[-4:]}"))


def practice(text: str, r: random.Random) -> Graph:
    """The graph of a text to which other forms are added: of one of its entities, or, more often, of other digits or letters."""
    spans = base_spans(text)
    if not spans:
        return Graph(text, spans)
    kind, a, b = r.choice(spans)
    said, own = text[a:b], r.random() < 0.5
    if not own:
        said = "".join(r.choice("0123456789") if c.isdigit() else r.choice("abcdefghij") if c.isalpha() else c for c in said)
    out, added = text + "\nnext", []
    for _ in range(r.randint(1, 2)):
        form = _other_form(kind, said, r)
        at = len(out) + 4
        out += f" to {form} {r.randrange(1000, 10**6)} and" if form.isdigit() else f" to {form} and"
        if own:
            added.append((kind, at, at + len(form)))
    missed = [x for x in base_spans(out)[: len(spans) + 4] if x[1] > len(text)]
    if missed:  # the new form is a pattern's own
        return Graph(text, spans)
    return Graph(out, spans, added or [(0, len(out), len(out))])


class Field:
    """Weights: a row of features for each label, what a pattern adds to its label, and potentials of chain and skip edges."""

    def __init__(self, unary, base, chain, skip):
        self.unary, self.base, self.chain, self.skip = unary, base, chain, skip

    def marginals(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        score = g.x @ self.unary.T
        has = g.labels > 0
        score[has, g.labels[has]] += self.base
        edges, is_skip = g.arrays()
        if len(edges):
            a, b = edges[:, 0], edges[:, 1]
            pair = np.exp(np.where(is_skip[:, None, None], self.skip[None], self.chain[None]))
            ab, ba = np.full((len(a), N_LABELS), 1 / N_LABELS), np.full((len(a), N_LABELS), 1 / N_LABELS)
            for _ in range(rounds):
                total = score.copy()
                np.add.at(total, b, np.log(ab))
                np.add.at(total, a, np.log(ba))
                from_a, from_b = total[a] - np.log(ba), total[b] - np.log(ab)
                from_a, from_b = (np.exp(x - x.max(1, keepdims=True)) for x in (from_a, from_b))
                ab, ba = np.einsum("ei,eij->ej", from_a, pair), np.einsum("ej,eij->ei", from_b, pair)
                ab, ba = ab / ab.sum(1, keepdims=True) + 1e-12, ba / ba.sum(1, keepdims=True) + 1e-12
            np.add.at(score, b, np.log(ab))
            np.add.at(score, a, np.log(ba))
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit(graphs: list[Graph], steps: int = 2000, rate: float = 1.0, seed: int = 5) -> Field:
    """Pseudo-likelihood by gradient ascent; the pattern's vote is hidden for most tokens, so shape and neighbours carry weight."""
    unary, base = np.zeros((N_LABELS, N_FEATURES)), 4.0
    chain, skip = np.zeros((N_LABELS, N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    unary[0, 0] = 1.0
    graphs = [g for g in graphs if g.tokens]
    if not graphs:
        return Field(unary, base, chain, skip)
    x, y = np.concatenate([g.x for g in graphs]), np.concatenate([g.labels for g in graphs])
    voted = np.concatenate([g.voted for g in graphs])
    firsts = np.cumsum([0, *(len(g.tokens) for g in graphs)])
    both = [(g.arrays(), f) for g, f in zip(graphs, firsts, strict=False)]
    edges = np.concatenate([e + f for (e, _), f in both])
    is_skip = np.concatenate([s for (_, s), _ in both])
    hidden = np.random.default_rng(seed).random(len(y)) < 0.8
    one = np.eye(N_LABELS)[y]
    for _ in range(steps):
        score = x @ unary.T
        vote = voted & ~hidden
        score[vote, y[vote]] += base
        for kind, table in ((False, chain), (True, skip)):
            e = edges[is_skip == kind]
            np.add.at(score, e[:, 1], table[y[e[:, 0]]])
            np.add.at(score, e[:, 0], table[:, y[e[:, 1]]].T)
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        miss = one - p
        unary += rate * (miss.T @ x / len(y) * 4 - 1e-4 * unary)
        for kind, table in ((False, chain), (True, skip)):
            e = edges[is_skip == kind]
            if len(e):
                grad = np.zeros_like(table)
                np.add.at(grad, y[e[:, 0]], miss[e[:, 1]])
                np.add.at(grad.T, y[e[:, 1]], miss[e[:, 0]])
                table += rate * (grad / len(e) - 1e-4 * table)
    return Field(unary, base, chain, skip)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with what the field adds, both in order of kind and start."""
    base = base_spans(text)
    graph = Graph(text, base)
    if not (graph.labels == 0).any():
        return base, base
    p = field.marginals(graph)
    more = []
    for i in np.flatnonzero((graph.labels == 0) & (p[:, 1:].max(1) >= SURE)):
        more.append((int(p[i, 1:].argmax()), *graph.tokens[i]))
    return base, sorted([*base, *more])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _practised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        graphs = [practice(t, random.Random(f"{i}")).packed() for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t]
        yield pa.RecordBatch.from_arrays([pa.array(graphs, pa.binary())], ["graph"])


def fit_on(docs: DataFrame) -> Field:
    """Weights from the documents with digits whose hashed ids are lowest, FIT_DOCS at most; their features come to the driver, not their texts."""
    ids = samples.lowest_hashed(docs.where("text rlike '[0-9]'").select(F.col("doc_id").alias("id"), F.col("doc_id")), FIT_DOCS).select("id").distinct()
    ids = work.staged(ids, work.work_folder(docs.sparkSession), "ids")
    some = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "text")
    graphs = sorted(bytes(r.graph) for r in some.mapInArrow(_practised, "graph binary").limit(2 * FIT_DOCS).collect())
    return fit([Graph.unpacked(g) for g in graphs])


def _finder(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts, digests, spans = [[0] * batch.num_rows for _ in KINDS], [empty] * batch.num_rows, [""] * batch.num_rows
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    base, every = all_spans(text, field)
                    for k, _, _ in base:
                        counts[k][i] += 1
                    if every:
                        digests[i], spans[i] = hashlib.sha256(written(base).encode()).hexdigest(), written(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find(docs: DataFrame) -> DataFrame:
    """A row for each document: counts and digest of the base spans, and all spans."""
    work.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_finder(fit_on(docs)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _covered(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind; where spans overlap, the one that starts first goes."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _redactor(field: Field, text_at: int, chars_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            sizes = batch.column(chars_at).to_pylist() if chars_at >= 0 else None
            for i, text in enumerate(texts):
                if text and (spans := all_spans(text, field)[1]):
                    texts[i] = _covered(text, spans)
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if sizes is not None:
                columns[chars_at] = pa.array(sizes, batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets, and n_chars, if there, set to the new length."""
    work.prepare(docs.sparkSession)
    names = docs.columns
    run = _redactor(fit_on(docs.select("doc_id", "text")), names.index("text"), names.index("n_chars") if "n_chars" in names else -1)
    return work.kept_columns(docs, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(work.table(spark, sf_dir, "documents"))
