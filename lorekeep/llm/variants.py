"""Spelling variants by anagram hashing.

Words are runs of letters, counted over all texts. A word's key is the sum of its letters' fifth powers, so words of the same letters have the
same key, and words one letter apart have keys that differ by the value of a letter added or removed, or by the difference of two. Keys
less the value of one of their word's letters make this an equal join: of a longer word with the keys of shorter ones (addition and
removal), and of words of the same length with each other (exchange). One letter changed leaves a half of the word as it was; that half
goes with the key, and the letter comes from the other, which keeps the letters of many words' anagrams apart.
The order of letters is verified on what meets. Keys that more than LARGE words share are not compared in pairs: they meet again
with the order of their letters in the key, the changed place left out, where at most one word for each letter of the alphabet can meet.

A word's form is its most frequent near word (of equals the first in code-point order), if that is RATIO times as frequent or more; its root is
what its form's forms end at. A form is always more frequent, so that ends.

Null and empty texts have no words. Rows that repeat a doc_id, or have none, count as documents of their own. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import periodic, shingles, work

#: Code points of a word and occurrences, at least; how many times as frequent a form is.
LEAST, SEEN, RATIO = 7, 2, 10
#: Words of one key that are compared in pairs.
LARGE = 500
#: Bytes of text whose words are counted at once.
BATCH = 4_000_000

#: A run's bytes, the letters A to Z, a to z and U+00C0 to U+00FF (their first byte is 0xC3).
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def _letters(data: np.ndarray) -> np.ndarray:
    """1 for bytes of letters, 0 for others."""
    lead = data == 0xC3
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    return inside.astype(np.uint8)


def _counted(least: int, changed: Callable | None):
    parts = np.arange(256) != 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work.small_batches(batches, most=BATCH):
            data, offsets = work.text_buffers(batch.column(1))
            starts, ends = shingles.word_bounds(_letters(data), offsets, parts)
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            sizes = points[ends] - points[starts]
            long = sizes >= least
            starts, ends, sizes = starts[long], ends[long], sizes[long]
            if not len(starts):
                continue
            document = np.searchsorted(offsets, starts, side="right") - 1
            lengths = ends - starts
            at = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
            body = shingles.LOWER[data[np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths)]]
            coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(body)]).dictionary_encode()
            words = coded.dictionary.to_pylist()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if changed is None:
                out, n = words, np.bincount(code, minlength=len(words)).tolist()
            else:
                pair, times = np.unique(document * len(words) + code, return_counts=True)
                own, which = np.divmod(pair, len(words))
                size = np.zeros(len(words), np.int64)
                size[code] = sizes
                out, n = changed(batch.column(0).to_pylist(), own.tolist(), words, which.tolist(), size.tolist(), times, least)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    return run


def misspelled(ids: list, own: list[int], words: list[bytes], which: list[int], size: list[int], times: np.ndarray, least: int) -> tuple[list[bytes], list[int]]:
    """Words as the query reads them: where 31 divides the crc32 of document and word, a letter that it names is missing. A document without
    an id is read as it is."""
    first = [None if i is None else zlib.crc32(f"{i}:".encode()) for i in ids]
    crc32 = zlib.crc32
    sums = np.array([1 if (p := first[d]) is None else crc32(words[w], p) for d, w in zip(own, which, strict=True)], np.int64)
    hit = sums % 31 == 0
    kept = np.bincount(np.array(which)[~hit], weights=times[~hit], minlength=len(words)).astype(np.int64)
    there = np.flatnonzero(kept)
    out, n = [words[w] for w in there.tolist()], kept[there].tolist()
    for k in np.flatnonzero(hit).tolist():
        w = which[k]
        if size[w] > least:
            text, at = words[w].decode(), int(sums[k]) % size[w]
            out.append((text[:at] + text[at + 1 :]).encode())
            n.append(int(times[k]))
    return out, n


def counted_words(docs: DataFrame, least: int = LEAST, seen: int = SEEN, changed: Callable | None = None) -> DataFrame:
    """(word, n) of the words of whole texts with at least `least` letters and `seen` occurrences in all. `changed` may rewrite a document's words
    before they count."""
    work.prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_counted(least, changed), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


def value(letter: Column) -> Column:
    c = F.ascii(letter).cast("long")
    return c * c * c * c * c


def anagram(word: Column) -> Column:
    """Sum of the fifth powers of the letters' code points."""
    return F.aggregate(F.transform(F.split(word, ""), value), F.lit(0).cast("long"), lambda a, b: a + b)


EXCHANGE, LONGER, PLAIN = 0, 1, 2


def keyed(words: DataFrame) -> DataFrame:
    """(key, kind, word, n): the keys of each word for the exchange of a letter, as the longer word of a pair, and as the shorter one. A key is made
    of an anagram key, the length, the side that stays and the letters of that side."""
    word = F.col("word")
    rows = words.select(word, "n", anagram(word).alias("k"), F.length(word).alias("m"))
    part = lambda a, to=None: F.substring(word, a, F.col("m") if to is None else to)
    less = lambda letters: F.transform(F.array_distinct(F.split(letters, "")), lambda c: F.col("k") - value(c))
    one, shorter = F.lit(1), F.col("m") - 1
    h, g = F.expr("m div 2").cast("int"), F.expr("(m - 1) div 2").cast("int")
    sides = [  # kind, side, length of what is common, what stays, anagram keys
        (EXCHANGE, 0, F.col("m"), part(h + 1), less(part(one, h))),
        (EXCHANGE, 1, F.col("m"), part(one, h), less(part(h + 1))),
        (LONGER, 0, shorter, part(g + 2), less(part(one, g + 1))),
        (LONGER, 1, shorter, part(one, g), less(part(g + 1))),
        (PLAIN, 0, F.col("m"), part(h + 1), F.array("k")),
        (PLAIN, 1, F.col("m"), part(one, h), F.array("k")),
    ]
    def keys(kind, side, length, stays, values):
        return F.transform(values, lambda v: F.struct(F.xxhash64(F.lit(kind == EXCHANGE), F.lit(side), length, stays, v).alias("key"), F.lit(kind).alias("kind")))

    made = [keys(*x) for x in sides]
    return rows.select("word", "n", F.explode(F.concat(*made)).alias("x")).select("x.key", "x.kind", "word", "n")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows of keyed() with the order of letters in their key too: of what is left without a letter, and for an exchange its place."""
    word = F.col("word")
    rest = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))
    places = F.sequence(F.lit(1), F.length(word))
    own = (
        F.when(F.col("kind") == EXCHANGE, F.transform(places, lambda i: F.xxhash64("key", i, rest(i))))
        .when(F.col("kind") == LONGER, F.transform(places, lambda i: F.xxhash64("key", rest(i))))
        .otherwise(F.array(F.xxhash64("key", word)))
    )
    return rows.select(F.explode(F.array_distinct(own)).alias("key"), "kind", "word", "n")


def _met(rows: DataFrame) -> DataFrame:
    """Pairs of rows of one key whose letters stand in order but for one. Where the letter could be on either side, the first counts."""
    a, b = (rows.select("key", F.col("kind").alias(f"{w}_kind"), F.col("word").alias(w), F.col("n").alias(f"{w}_n")) for w in "ab")
    same = (F.col("a_kind") == EXCHANGE) & (F.col("b_kind") == EXCHANGE) & (F.col("a") < F.col("b"))
    added = (F.col("a_kind") == PLAIN) & (F.col("b_kind") == LONGER)
    return a.join(b, "key").where((same | added) & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def near(words: DataFrame, large: int = LARGE) -> DataFrame:
    """(word, n, other, other_n): each two words that are exactly one letter apart, from both sides. words: (word, n), each once."""
    folder = work.work_folder(words.sparkSession)
    rows = work.staged(keyed(words), folder, "keyed")
    hot = work.staged(rows.groupBy("key").count().where(F.col("count") > large).select("key"), folder, "hot")
    if hot.isEmpty():
        pairs = _met(rows)
    else:
        pairs = _met(rows.join(hot, "key", "left_anti").unionByName(ordered(rows.join(hot, "key", "left_semi"))))
    # a letter next to its like, in the middle, is found from both sides
    pairs = pairs.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n"))
    return pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), each word once, without circles: forms are followed to the last, twice as far in each round."""
    folder = work.work_folder(forms.sparkSession)
    now, k = work.staged(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), folder, "roots-0"), 0
    while not now.where("moved").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        k += 1
        now = work.staged(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), folder, f"roots-{k}")
    return now.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST, seen: int = SEEN, ratio: int = RATIO, large: int = LARGE, changed: Callable | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word."""
    folder = work.work_folder(docs.sparkSession)
    words = work.staged(counted_words(docs, least, seen, changed), folder, "words")
    links = near(words, large).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    found = work.staged(links.select("word", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")), folder, "found")
    ends = roots(found.where("form is not null").select("word", "form"))
    out = words.join(found, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


#: The same rows, with near words from texts that have each letter left out or replaced by a sign.
ORACLE_SQL = rf"""WITH RECURSIVE tab AS MATERIALIZED ({periodic.CRC_TABLE}),
  found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
  runs AS (SELECT doc_id, w, count(*) AS times FROM found WHERE length(w) >= {LEAST} GROUP BY ALL),
  summed AS (SELECT w, times, {periodic.crc_sql("flatten(list_transform(string_split(doc_id::VARCHAR || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x) - 64] END))")} AS h FROM runs, tab WHERE doc_id IS NOT NULL
    UNION ALL SELECT w, times, 1 FROM runs WHERE doc_id IS NULL),
  changed AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, times FROM summed),
  words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM changed WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(times) >= {SEEN}),
  cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || '*' || substr(word, i + 2) AS starred, left(word, i) || substr(word, i + 2) AS short FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
  near AS (SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.starred = y.starred AND x.word <> y.word
    UNION SELECT u.word, u.n, c.word, c.n FROM words u JOIN cut c ON u.word = c.short UNION SELECT c.word, c.n, u.word, u.n FROM words u JOIN cut c ON u.word = c.short),
  best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word, n),
  forms AS MATERIALIZED (SELECT word, n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n FROM best),
  chain AS (SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
  ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
  SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n FROM words LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(work.table(spark, sf_dir, "documents"), changed=misspelled)
