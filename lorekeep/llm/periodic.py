"""Periodic runs of words, by the linear method of Gusfield and Stoye for tandem repeats.

A document is its words, numbered from 0. A run is a stretch of words with smallest period q, at least LEAST words and EXPONENT times q long,
that no neighbouring word extends. Each word of such a run occurs in it EXPONENT times or more, so words that occur less often in
their stretch of text part it, again and again until nothing changes; stretches under LEAST words go. What stays of a batch of
documents is one text with a mark of its own behind each stretch, and is searched at once:

1. its Lempel-Ziv blocks give squares by common extensions around the blocks' borders, the leftmost of every kind among them;
2. these are marked as places in the text's suffix tree, each under the leaf where it stands first;
3. from each place, suffix links lead to the place of its rotation, as long as that is a square and not marked yet: all kinds of squares;
4. the leaves under a place are its occurrences; those of squares whose halves repeat nothing shorter merge to runs where they follow
   each other.

Null and empty texts, and texts of white space, have no words and no runs. Rows that repeat a doc_id, or have none, count as documents of their
own. Other columns are ignored. An empty table gives no rows. Memory grows with the longest document, never with the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles, work

LEAST, EXPONENT = 6, 4
#: Bytes of text searched at once; a longer document is searched alone.
BATCH = 2_000_000
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Names:
    """A name for each substring whose length is a power of two: equal names, equal substrings. The last symbol must stand nowhere else."""

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        self.levels = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
        while int(self.levels[-1].max()) + 1 < n:
            own, h = self.levels[-1], 1 << (len(self.levels) - 1)
            pair = own * (n + 1)
            pair[: n - h] += own[h:] + 1
            self.levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        self.rank = self.levels[-1]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are the same."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            a, b = i + out, j + out
            same = (a < self.n) & (b < self.n)
            same[same] = self.levels[level][a[same]] == self.levels[level][b[same]]
            out[same] += 1 << level
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i and up to j are the same."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            a, b = i - out - (1 << level) + 1, j - out - (1 << level) + 1
            same = (a >= 0) & (b >= 0)
            same[same] = self.levels[level][a[same]] == self.levels[level][b[same]]
            out[same] += 1 << level
        return out


def earlier(names: Names) -> np.ndarray:
    """For each position, how long the longest substring from there on is that also begins further left."""
    n = names.n
    rank, order = names.rank.tolist(), names.order
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for i in range(n - 1, -1, -1):  # those that are linked still begin further left
        r = rank[i]
        p, q = before[r], after[r]
        left[i], right[i] = p, q
        if p >= 0:
            after[p] = q
        if q < n:
            before[q] = p
    here, best = np.arange(n), np.zeros(n, np.int64)
    for side in (left, right):
        there = (side >= 0) & (side < n)
        best[there] = np.maximum(best[there], names.forward(here[there], order[side[there]]))
    return best


def blocks(names: Names) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the end of the text."""
    length, at, out = earlier(names).tolist(), 0, []
    while at < names.n:
        out.append(at)
        at += max(1, length[at])
    return np.array([*out, names.n])


def first_squares(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of squares, the leftmost of every kind or of one of its rotations among them."""
    cuts = blocks(names)
    begins, ends = cuts[:-1], cuts[1:]
    beyond = np.append(ends[1:], names.n)
    spread = lambda counts: (np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1)
    # squares whose right half holds a block's end
    block, k = spread(ends - begins)
    h, q = ends[block], ends[block] - k
    ahead, back = names.forward(h, q), names.backward(h - 1, q - 1)
    start = np.maximum(q - back, q - k + 1)
    good = (ahead + back >= k) & (ahead > 0)
    found = [(start[good], k[good])]
    # squares whose left half holds a block's beginning
    block, k = spread(np.minimum(beyond - begins, names.n - 1 - begins))
    h, q = begins[block], begins[block] + k
    ahead, back = names.forward(h, q), names.backward(h - 1, q - 1)
    start = np.maximum(h - back, h - k + 1)
    good = (ahead + back >= k) & (ahead > 0) & (back > 0) & (start + k <= ends[block])
    found.append((start[good], k[good]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Tree:
    """Suffix tree: nodes 0 to n-1 are the leaves in order, the others follow. A place in it is (node, depth) with the node at or next below."""

    def __init__(self, text: np.ndarray, names: Names):
        n = names.n
        self.text, self.names = text, names
        order = names.order
        common = np.zeros(n + 1, np.int64)
        common[1:n] = names.forward(order[1:], order[:-1])
        depth, left, right, parent = (n - order).tolist(), list(range(n)), list(range(n)), [-1] * n
        owner = [0] * (n + 1)

        def node(d: int, a: int) -> int:
            depth.append(d)
            left.append(a)
            right.append(-1)
            parent.append(-1)
            return len(depth) - 1

        self.root = node(0, 0)
        stack = [self.root]
        shared = common.tolist()
        for i in range(n):
            d, last = shared[i], None
            while depth[stack[-1]] > d:
                closed = stack.pop()
                right[closed] = i - 1
                if last is not None:
                    parent[last] = closed
                last = closed
            if last is not None and depth[stack[-1]] < d:
                fresh = node(d, left[last])
                stack.append(fresh)
            if last is not None:
                parent[last] = stack[-1]
            owner[i] = stack[-1]
            stack.append(i)
        last = None
        while stack:
            closed = stack.pop()
            right[closed] = n - 1 if closed >= n else right[closed]
            if last is not None:
                parent[last] = closed
            last = closed
        self.depth, self.left, self.right, self.parent = depth, left, right, parent
        above = np.array(parent)
        kids = np.flatnonzero(above >= 0)
        first = order[np.array(left)]
        symbol = text[first[kids] + np.array(depth)[above[kids]]]
        self.wide = int(text.max()) + 1
        self.child = dict(zip((above[kids] * self.wide + symbol).tolist(), kids.tolist(), strict=True))
        self.first = first.tolist()
        self.link = self._links(common, np.array(owner))

    def _links(self, common: np.ndarray, owner: np.ndarray) -> list[int]:
        """For each inner node, the node of its string without the first symbol: the owner of the least common prefix between its outer leaves'
        next suffixes."""
        n = self.names.n
        inner = np.arange(n, len(self.depth))
        out = np.full(len(self.depth), self.root, np.int64)
        inner = inner[np.array([self.depth[v] > 1 for v in inner.tolist()], bool)]
        if not len(inner):
            return out.tolist()
        order, rank = self.names.order, self.names.rank
        a, b = (rank[order[np.array([side[v] for v in inner.tolist()])] + 1] for side in (self.left, self.right))
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)
        table = [np.arange(n)]
        while 2 << len(table) - 1 <= n:
            h, last = 1 << (len(table) - 1), table[-1]
            x, y = last[: len(last) - h], last[h:]
            table.append(np.where(common[x] <= common[y], x, y))
        level = np.floor(np.log2(b - a + 1)).astype(np.int64)
        least = np.empty(len(inner), np.int64)
        for at in np.unique(level).tolist():
            own = level == at
            x, y = table[at][a[own]], table[at][b[own] - (1 << at) + 1]
            least[own] = np.where(common[x] <= common[y], x, y)
        out[inner] = owner[least]
        return out.tolist()

    def places(self, starts: np.ndarray, halves: np.ndarray) -> list[tuple[int, int]]:
        """Places of squares, each climbed to from the leaf where its kind stands first."""
        n = self.names.n
        least = self._least()
        rank = self.names.rank.tolist()
        by = np.lexsort((-halves, starts))
        out, now, v = [], -1, 0
        for i, half in zip(starts[by].tolist(), halves[by].tolist(), strict=True):
            if i != now:
                now, v = i, rank[i]
            while self.depth[self.parent[v]] >= 2 * half and least[self.parent[v]] == i:
                v = self.parent[v]
            if self.depth[self.parent[v]] < 2 * half:
                out.append((v, 2 * half))
        assert all(self.depth[v] >= d for v, d in out) and n
        return out

    def _least(self) -> list[int]:
        """For each node the leftmost position under it."""
        n = self.names.n
        out = self.names.order.tolist() + [n] * (len(self.depth) - n)
        # a node closes after all below it, and deeper ones are settled first
        for v in sorted(range(len(self.depth)), key=lambda v: -self.depth[v]):
            p = self.parent[v]
            if p >= 0 and out[v] < out[p]:
                out[p] = out[v]
        return out

    def rotated(self, v: int, d: int) -> tuple[int, int] | None:
        """The place of the square whose first symbol has moved to its end, if it stands anywhere."""
        text, depth, child = self.text, self.depth, self.child
        s = self.first[v]
        x = self.link[self.parent[v]]
        while depth[x] < d - 1:
            x = child[x * self.wide + int(text[s + 1 + depth[x]])]
        moved = int(text[s])
        if depth[x] == d - 1:
            x = child.get(x * self.wide + moved, -1)
            return (x, d) if x >= 0 else None
        return (x, d) if int(text[self.first[x] + d - 1]) == moved else None

    def vocabulary(self, starts: np.ndarray, halves: np.ndarray) -> list[tuple[int, int]]:
        """Places of all kinds of squares."""
        marked = set(self.places(starts, halves))
        for place in list(marked):
            while (place := self.rotated(*place)) is not None and place not in marked:
                marked.add(place)
        return list(marked)


@lru_cache(4096)
def primes(k: int) -> tuple[int, ...]:
    """Prime divisors."""
    out, d = [], 2
    while d * d <= k:
        if k % d == 0:
            out.append(d)
            while k % d == 0:
                k //= d
        d += 1
    return (*out, k) if k > 1 else tuple(out)


def runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a text of at least twice their period; its last symbol must stand nowhere else."""
    none = (np.zeros(0, np.int64),) * 3
    if len(text) < 3:
        return none
    text = np.unique(text, return_inverse=True)[1].astype(np.int64)
    names = Names(text)
    starts, halves = first_squares(names)
    if not len(starts):
        return none
    tree = Tree(text, names)
    places = tree.vocabulary(starts, halves)
    at = np.array([tree.first[v] for v, _ in places])
    half = np.array([d // 2 for _, d in places])
    # a square whose half is a power of something shorter has that period too
    which = [(i, k // p) for i, k in enumerate(half.tolist()) for p in primes(k)]
    simple = np.ones(len(places), bool)
    if which:
        i, shorter = np.array(which).T
        simple[i[names.forward(at[i], at[i] + shorter) >= 2 * half[i] - shorter]] = False
    left, right = (np.array([side[v] for v, _ in places])[simple] for side in (tree.left, tree.right))
    half = half[simple]
    counts = right - left + 1
    period = np.repeat(half, counts)
    start = names.order[np.arange(counts.sum()) + np.repeat(left - (np.cumsum(counts) - counts), counts)]
    by = np.lexsort((start, period))
    start, period = start[by], period[by]
    new = np.concatenate(([True], (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last] - start[first] + 2 * period[first], period[first]


def stretches(codes: np.ndarray, document: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """(words, stretch): the words that may lie in a run, and the stretch of each. Every word of a stretch occurs in it `exponent` times."""
    words, stretch = np.arange(len(codes)), document.astype(np.int64)
    most = int(codes.max()) + 1 if len(codes) else 1
    while len(words):
        _, which, counts = np.unique(stretch * most + codes[words], return_inverse=True, return_counts=True)
        often = counts[which] >= exponent
        kept, before = words[often], stretch[often]
        new = np.ones(len(kept), bool)
        new[1:] = (kept[1:] != kept[:-1] + 1) | (before[1:] != before[:-1])
        own = np.cumsum(new) - 1
        long = np.bincount(own, minlength=1)[own] >= least if len(own) else np.zeros(0, bool)
        if len(kept) == len(words) and long.all():
            return words, stretch
        words, stretch = kept[long], own[long]
    return words, stretch


def document_runs(codes: np.ndarray, document: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of the runs of documents given as codes of their words, back to back."""
    words, stretch = stretches(codes, document, least, exponent)
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    n, most = int(stretch.max()) + 1, int(codes.max()) + 1
    # stretches one behind the other, each with a mark of its own at its end; words of two stretches are never the same
    new = np.concatenate(([True], stretch[1:] != stretch[:-1]))
    nth = np.cumsum(new) - 1
    place = np.arange(len(words)) + nth
    text, origin = np.full(len(words) + nth[-1] + 1, -1, np.int64), np.full(len(words) + nth[-1] + 1, -1, np.int64)
    text[place] = stretch * most + codes[words]
    origin[place] = words
    text[text < 0] = n * most + np.arange(nth[-1] + 1)
    start, length, period = runs(text)
    good = (length >= least) & (length >= exponent * period)
    return origin[start[good]], length[good], period[good]


def _word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal codes for equal words."""
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    body = data[np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)]
    column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of `counts` words each, parted by one space."""
    sizes = ends[kept] - starts[kept] + 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    take = np.arange(at[-1]) + np.repeat(starts[kept] - at[:-1], sizes)
    body = np.append(data, np.uint8(32))[np.minimum(take, len(data))]
    body[at[1:] - 1] = 32
    inside = np.ones(len(body), bool)
    last = np.cumsum(counts)[counts > 0]
    inside[at[last] - 1] = False
    bounds = at[np.concatenate(([0], np.cumsum(counts)))] - np.concatenate(([0], np.cumsum(counts > 0)))
    return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body[inside]))]).cast(pa.string())


def _found(least: int, exponent: int, sources: Callable[[int | None, int], np.ndarray | None] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work.small_batches(batches, most=BATCH):
            data, offsets = work.text_buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            starts, ends = shingles.word_bounds(data, offsets)
            at = np.searchsorted(starts, offsets)
            counts = np.diff(at)
            if sources is not None:
                which = np.arange(len(starts))
                for i, (doc, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
                    if (own := sources(doc, n)) is not None:
                        which[at[i] : at[i + 1]] = at[i] + own
                starts, ends = starts[which], ends[which]
            document = np.repeat(np.arange(len(ids)), counts)
            first, length, period = document_runs(_word_codes(data, starts, ends), document, least, exponent)
            by = np.lexsort((period, first))
            first, length, period = first[by], length[by], period[by]
            gone = np.zeros(len(starts) + 1, np.int64)
            np.add.at(gone, first + period, 1)
            np.add.at(gone, first + length, -1)
            kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            own = document[first] if len(first) else np.zeros(0, np.int64)
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (first - at[own], length, period)], ["start", "length", "period"])
            bounds = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(ids))))).astype(np.int32)
            texts = _joined(data, starts, ends, kept, np.bincount(document[kept], minlength=len(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), spans), texts], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, sources: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of whole texts: runs by start and period, and the words of which no run holds them behind its first
    period, parted by one space. `sources` may name, for a document and its number of words, the word to be read at each place."""
    work.prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_found(least, exponent, sources), FOUND)


def planted(doc: int | None, n: int) -> np.ndarray | None:
    """The documents that the query reads with a repeated tail: a tenth of them, by a checksum of the id; one without an id is read as it is."""
    if doc is None or not n:
        return None
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest (the first of equals), and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.withColumn("top", longest)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: crc32 of a list of bytes, by the table `t` of its polynomial.
CRC_TABLE = "SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)"


def crc_sql(values: str, table: str = "t") -> str:
    return f"xor(list_reduce({values}, lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295)"


#: The same rows from all pairs of equal words of a document: stretches of equal distances, the least distance of each.
ORACLE_SQL = rf"""WITH tab AS MATERIALIZED ({CRC_TABLE}),
  d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {crc_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} AS h FROM documents, tab),
  g AS (SELECT r, doc_id, w, len(w) AS n, h, h // 10 AS g FROM d),
  a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
  p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
  words AS MATERIALIZED (SELECT r, n, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
  often AS (SELECT * FROM words QUALIFY count(*) OVER (PARTITION BY r, word) >= {EXPONENT}),
  pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM often x JOIN often y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND {EXPONENT} * (y.i - x.i) <= x.n),
  isles AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM pairs),
  runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM (SELECT r, q, min(i) AS start, count(*) + q AS length FROM isles GROUP BY r, q, isle HAVING count(*) + q >= greatest({LEAST}, {EXPONENT} * q)) GROUP BY r, start, length),
  gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
  texts AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r),
  sums AS (SELECT r, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY r),
  tops AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1)
  SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, tops.start::BIGINT AS start, tops.length::BIGINT AS length, tops.period::BIGINT AS period, (1000 * tops.length // tops.period)::BIGINT AS exponent_milli,
    coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
  FROM d LEFT JOIN sums USING (r) LEFT JOIN tops USING (r) LEFT JOIN texts USING (r)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(work.table(spark, sf_dir, "documents"), sources=planted))
