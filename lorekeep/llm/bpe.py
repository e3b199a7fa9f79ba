"""Byte-level BPE over whole Arrow batches.

Pieces that start at a single space between two visible characters never share a merge with what stands before, so a text
is cut there, each distinct piece of a batch is encoded once with the tokenizers library, and the ids of the documents are
gathered from these. Ids equal those of encoding each text whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

#: Distinct pieces of under 16 bytes kept from batch to batch; some 100 MB.
CACHE = 600_000


class Encoder:
    """ids of every text of a batch, back to back, and where each text's ids end."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # pieces come once a batch, so the model's own cache only costs time
        # ids of the pieces kept, back to back, and where each piece's begin; known: place of a piece
        self.known: dict[bytes, int] = {}
        self.cache = cache
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.plain = bytes_to_chars()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start. Runs of letters, digits or other marks with the one space before them, and runs of white space, as the
        vocabulary's own pattern cuts them; only texts in ASCII and Latin letters come here."""
        kind = KINDS[data]
        n = len(data)
        start = np.zeros(n + 1, bool)
        start[1:n] = kind[1:] != kind[:-1]
        start[offsets] = True
        space = data == 32
        # the last of a run of white space goes with the visible run after it, if it is a space, and stands alone otherwise
        head = start[:n] & (kind != 0)
        head[offsets[:-1][offsets[:-1] < n]] = False
        after = np.flatnonzero(head)
        before = after - 1
        joins = space[before]
        start[after[joins]] = False
        start[before[kind[before] == 0]] = True
        return np.flatnonzero(start[:n])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slow = self.unusual(data, offsets)
        if slow.any():
            return self.mixed(data, offsets, slow)
        return self.fast(data, offsets)

    def unusual(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with apostrophes, control characters, characters beyond Latin letters or an added token: encoded whole."""
        odd = ODD[data]
        signs = np.flatnonzero((data == 0x97) | (data == 0xB7))
        odd[signs[data[signs - 1] == 0xC3]] = True  # U+00D7 and U+00F7 are no letters
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                odd[at] = True  # one that spans two texts does no harm
                at = raw.find(token, at + 1)
        if not odd.any():
            return np.zeros(len(offsets) - 1, bool)
        total = np.concatenate(([0], np.cumsum(odd)))
        return total[offsets[1:]] > total[offsets[:-1]]

    def mixed(self, data, offsets, slow):
        n = len(slow)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
        whole = np.flatnonzero(slow)
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in whole]
        for i, e in zip(whole, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        rest = np.flatnonzero(~slow)
        if len(rest):
            sizes = (offsets[1:] - offsets[:-1])[rest]
            part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in rest])
            ids, ends = self.fast(part, np.concatenate(([0], np.cumsum(sizes))))
            for k, i in enumerate(rest):
                out[i] = ids[ends[k] : ends[k + 1]]
        return np.concatenate(out), np.concatenate(([0], np.cumsum([len(x) for x in out])))

    def fast(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = self.pieces(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        where = coded.indices.to_numpy()
        own = self.places(coded.dictionary.to_pylist())
        firsts, lengths = self.ends[own], self.ends[own + 1] - self.ends[own]
        sizes = lengths[where]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        take = np.arange(ends[-1])
        take += np.repeat(firsts[where] - ends[:-1], sizes)
        return self.flat[take], ends[np.searchsorted(starts, offsets, side="left")]

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where each word's ids lie; those of words that are not kept lie there until the next call."""
        known = self.known
        own = np.array([known.get(w, -1) for w in words], np.int64)
        fresh = np.flatnonzero(own < 0).tolist()
        if fresh:
            fresh.sort(key=lambda i: len(words[i]) >= 16)  # what is kept comes first
            ids, ends, tokenize, plain, at = [], [], self.model.tokenize, self.plain, len(known)
            for n, i in enumerate(fresh):
                word = words[i]
                ids += [t.id for t in tokenize(word.decode("latin-1").translate(plain))]
                ends.append(len(ids))
                if len(word) < 16 and len(known) < self.cache:
                    known[word] = at + n
            start = int(self.ends[at])
            while len(self.flat) < start + len(ids):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while len(self.ends) < at + len(fresh) + 1:
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.flat[start : start + len(ids)] = ids
            self.ends[at + 1 : at + 1 + len(fresh)] = start + np.array(ends)
            own[fresh] = at + np.arange(len(fresh))
        return own


def bytes_to_chars() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def _kinds() -> np.ndarray:
    """White space 0, letters 1 (bytes of Latin letters too), digits 2, other marks 3."""
    kinds = np.full(256, 3, np.uint8)
    for b in range(128):
        c = chr(b)
        kinds[b] = 0 if c in " \t\n\v\f\r" else 1 if c.isalpha() else 2 if c.isdigit() else 3
    kinds[128:] = 1
    return kinds


KINDS = _kinds()
#: Apostrophes (contractions), control characters, U+0080 to U+00BF and all beyond U+024F.
ODD = np.array([b == 39 or (b < 32 and b not in (9, 10, 11, 12, 13)) or b == 127 or b in (0xC0, 0xC1, 0xC2) or b > 0xC8 for b in range(256)])
