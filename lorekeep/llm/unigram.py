"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

A space is the whitespace marker, and one stands before each text. No piece of a vocabulary that this module takes spans from
another character into a marker, so a text falls into units that start at a marker after another character; each distinct unit
of a batch is segmented once, all of them side by side in numpy, and documents gather their units' ids. The best segmentation
has the largest sum of log scores. The file at hand orders its pieces by merges and has no probabilities, and tokenizers are not
trained here, so a piece's log score follows from its place by Zipf's law: the piece of rank r has a probability in proportion to
1 / (r + 1). A vocabulary whose scores are log probabilities keeps its own. A character without a piece of its own may pass as
unknown, at the lowest score less UNKNOWN, and is written as byte pieces. Equal sums go to the last piece that starts earliest.

Null and empty texts have no pieces. A literal U+2581 is encoded as a space, as the marker is that character, and round_trip is
false for such a text; all else decodes to what it was. round_trip compares the decoded ids of the whole text with the text itself. Rows that repeat a doc_id are encoded each. Other columns are ignored. An empty table gives no rows. Long texts
are taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

MARK = "▁"
UNKNOWN = 10.0
#: Cells (units times bytes) that are segmented at once.
CELLS = 1_500_000


class DoubleArray:
    """Trie over bytes as two arrays: the child of s by byte b is base[s] + b if check there is s. value: piece at a state, or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, v in zip(keys, values, strict=True):
            node = 0
            for b in key:
                node_next = children[node].get(b)
                if node_next is None:
                    node_next = len(children)
                    children[node][b] = node_next
                    children.append({})
                    ends.append(-1)
                node = node_next
            ends[node] = v
        place = {0: 0}
        self.check[0] = -2
        self.value[0] = ends[0]
        free, hint = 1, 1
        todo = [0]
        while todo:
            node = todo.pop()
            state, kids = place[node], sorted(children[node])
            if not kids:
                continue
            if len(kids) == 1:
                # any free slot serves a single child
                free = max(free, kids[0] + 1)
                while self.check[free] != -1:
                    free += 1
                    self._grow(free + 1024)
                at = free - kids[0]
            else:
                at = 0
                while not at:
                    self._grow(hint + 8192)
                    fits = np.ones(4096, bool)
                    for b in kids:
                        fits &= self.check[hint + b : hint + b + 4096] == -1
                    if fits.any():
                        at = hint + int(fits.argmax())
                    else:
                        hint += 2048
            self.base[state] = at
            for b in kids:
                kid = children[node][b]
                self.check[at + b] = state
                self.value[at + b] = ends[kid]
                place[kid] = at + b
                todo.append(kid)
        self._grow(int(self.base.max()) + 512)

    def _grow(self, size: int) -> None:
        while len(self.check) < size:
            n = len(self.check)
            self.base = np.concatenate([self.base, np.zeros(n, np.int32)])
            self.check = np.concatenate([self.check, np.full(n, -1, np.int32)])
            self.value = np.concatenate([self.value, np.full(n, -1, np.int32)])


def log_scores(scores: np.ndarray, usual: list[bool], are_logs: bool) -> np.ndarray:
    """Log scores of the pieces: the file's own if it is a unigram model, else those of Zipf's law over the usual pieces by rank."""
    if are_logs:
        return scores
    at = np.flatnonzero(usual)
    rank = np.empty(len(at))
    rank[np.argsort(-scores[at], kind="stable")] = np.arange(1, len(at) + 1)
    out = np.zeros(len(scores))
    out[at] = -np.log(rank) - np.log((1 / rank).sum())
    return out


class Pieces:
    """Pieces, log scores and byte pieces of a vocabulary file, and the trie over the pieces with a space for the marker."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.names = [p.piece for p in model.pieces]
        self.scores = log_scores(np.array([p.score for p in model.pieces], np.float64), [p.type in (1, 4) for p in model.pieces], model.trainer_spec.model_type == 1)
        normal = [i for i, p in enumerate(model.pieces) if p.type in (1, 4)]
        self.byte_ids = np.array([self.names.index(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.is_byte = np.zeros(len(self.names), bool)
        self.is_byte[self.byte_ids] = True
        for i in normal:
            inner = self.names[i].lstrip(MARK)
            if MARK in inner:
                raise ValueError(f"piece {self.names[i]!r} holds a marker after another character")
        self.trie = DoubleArray([self.names[i].replace(MARK, " ").encode() for i in normal], normal)
        self.raw = [self.names[i].replace(MARK, " ").encode() for i in range(len(self.names))]
        for b, i in enumerate(self.byte_ids.tolist()):
            self.raw[i] = bytes([b])
        self.unknown = float(self.scores[normal].min()) - UNKNOWN
        self.sizes = np.array([len(x) for x in self.raw], np.int64)

    # decoding

    def decode(self, ids: list[int]) -> str:
        text = b"".join(self.raw[i] for i in ids).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts back to back, the marker that stands before each left out, and the n+1 offsets of the texts."""
        data = np.frombuffer(b"".join(map(self.raw.__getitem__, ids.tolist())), np.uint8)
        ends = np.concatenate(([0], np.cumsum(self.sizes[ids])))[at]
        full = ends[1:] > ends[:-1]
        first = ends[:-1][full]
        first = first[data[first] == 32]
        keep = np.ones(len(data), bool)
        keep[first] = False
        return data[keep], ends - np.searchsorted(first, ends, side="left")

    # encoding

    def segment(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all units back to back, how many each has, and each unit's score."""
        order = np.argsort(-lengths, kind="stable")
        counts, scores = np.zeros(len(lengths), np.int64), np.zeros(len(lengths))
        parts = []
        at = 0
        while at < len(order):
            width = int(lengths[order[at]])
            own = order[at : at + max(1, CELLS // (width + 1))]
            ids, n, s = self._block(data, starts[own], lengths[own])
            parts.append((own, ids, n))
            counts[own], scores[own] = n, s
            at += len(own)
        flat = np.empty(int(counts.sum()), np.int64)
        firsts = np.cumsum(counts) - counts
        for own, ids, n in parts:
            ends = np.cumsum(n)
            flat[np.arange(len(ids)) + np.repeat(firsts[own] - (ends - n), n)] = ids
        return flat, counts, scores

    def _block(self, data, starts, lengths):
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        width, rows = int(lengths[0]), len(lengths)
        steps = data[starts + np.minimum(np.arange(width)[:, None], lengths - 1)]
        best = np.full((width + 1, rows), -np.inf)
        best[0] = 0
        piece = np.full((width + 1, rows), -1, np.int32)
        before = np.zeros((width + 1, rows), np.int32)
        lead = (steps & 0xC0) != 0x80
        size = np.where(steps < 0xC0, 1, np.where(steps < 0xE0, 2, np.where(steps < 0xF0, 3, 4)))
        active = np.searchsorted(-lengths, -np.arange(width), side="left")
        for i in range(width):
            row = np.flatnonzero(lead[i, : active[i]])
            char, alone = size[i], np.zeros(rows, bool)
            start = best[i]
            node = np.zeros(len(row), np.int64)
            first = row
            d = 0
            while len(row):
                nxt = base[node] + steps[i + d, row]
                ok = check[nxt] == node
                row, node = row[ok], nxt[ok].astype(np.int64)
                d += 1
                v = value[node]
                hit = v >= 0
                if hit.any():
                    r, w = row[hit], v[hit]
                    alone[r[char[r] == d]] = True
                    s = start[r] + scores[w]
                    better = s > best[i + d, r]
                    r = r[better]
                    best[i + d, r] = s[better]
                    piece[i + d, r] = w[better]
                    before[i + d, r] = i
                if i + d >= width:
                    break
                longer = lengths[row] > i + d
                if not longer.all():
                    row, node = row[longer], node[longer]
            lost = first[~alone[first]]
            if len(lost):
                to = np.minimum(i + char[lost], lengths[lost])
                s = start[lost] + self.unknown
                better = s > best[to, lost]
                lost, to = lost[better], to[better]
                best[to, lost] = s[better]
                piece[to, lost] = -1
                before[to, lost] = i
        # back along the best path, twice: to count and to write
        every = np.arange(rows)
        counts = np.zeros(rows, np.int64)
        at, live = lengths.copy(), every
        while len(live):
            p, b = piece[at[live], live], before[at[live], live]
            counts[live] += np.where(p >= 0, 1, at[live] - b)
            at[live] = b
            live = live[b > 0]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), np.int64)
        put = ends.copy()
        at, live = lengths.copy(), every
        while len(live):
            p, b = piece[at[live], live], before[at[live], live]
            known = p >= 0
            r = live[known]
            put[r] -= 1
            out[put[r]] = p[known]
            for r, frm, to in zip(live[~known].tolist(), b[~known].tolist(), at[live[~known]].tolist(), strict=True):
                for k in range(to - 1, frm - 1, -1):
                    put[r] -= 1
                    out[put[r]] = self.byte_ids[steps[k, r]]
            at[live] = b
            live = live[b > 0]
        return out, counts, best[lengths, every]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts back to back, the n+1 offsets of the texts' ids, and their scores."""
        n = len(offsets) - 1
        full = np.diff(offsets) > 0
        if not full.any():
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(n)
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.concatenate(([0], np.cumsum(full)))
        space = data == 32
        start = np.zeros(len(data) + 1, bool)
        start[:-1] = space
        start[1:-1] &= ~space[:-1]
        start[offsets] = True
        starts = np.flatnonzero(start[:-1])
        bounds = np.append(starts, len(data)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        units = coded.dictionary
        own = np.frombuffer(units.buffers()[1], np.int64)[: len(units) + 1]
        raw = np.frombuffer(units.buffers()[2], np.uint8)
        ids, counts, scores = self.segment(raw, own[:-1], np.diff(own))
        firsts = np.cumsum(counts) - counts
        where = coded.indices.to_numpy()
        many = counts[where]
        at = np.concatenate(([0], np.cumsum(many)))
        take = np.arange(at[-1]) + np.repeat(firsts[where] - at[:-1], many)
        unit_at = np.searchsorted(starts, offsets, side="left")
        total = np.concatenate(([0.0], np.cumsum(scores[where])))
        return ids[take], at[unit_at], total[unit_at[1:]] - total[unit_at[:-1]]


def _plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffers of a column in which U+2581 is a space."""
    import pyarrow.compute as pc

    return work.text_buffers(pc.replace_substring(column, MARK, " "))


def _equal(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Which texts of two columns are equal byte for byte."""
    same = np.diff(a_at) == np.diff(b_at)
    if same.all():
        apart = np.concatenate(([0], np.cumsum(a != b)))
        return apart[a_at[1:]] == apart[a_at[:-1]]
    for i in np.flatnonzero(same).tolist():
        same[i] = np.array_equal(a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]])
    return same


def _encoder(pieces: Pieces, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work.small_batches(batches):
            data, offsets = work.text_buffers(batch.column(1))
            ids, at, scores = pieces.encode(*_plain(batch.column(1)))
            back, ends = pieces.decoded(ids, at)
            same = _equal(data, offsets, back, ends)
            fallback = np.concatenate(([0], np.cumsum(pieces.is_byte[ids])))
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [batch.column(0), pa.array(np.diff(at)), pa.array(fallback[at[1:]] - fallback[at[:-1]]), pa.array(scores), pa.array(crc, pa.int64()), pa.array(same)]
            names = ["doc_id", "n_pieces", "n_bytes", "score", "ids_crc32", "round_trip"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Pieces of each text: number, bytes among them, log score, crc32 of the ids, whether they decode to the text, and the ids if asked for."""
    work.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_pieces long, n_bytes long, score double, ids_crc32 long, round_trip boolean" + ", ids array<long>" * with_ids
    return rows.mapInArrow(_encoder(Pieces(path), with_ids), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    work.prepare(encoded.sparkSession)
    pieces = Pieces(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pieces.decode(ids) if ids is not None else None for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(work.table(spark, sf_dir, "documents"), default_vocabulary(), with_ids=False)
