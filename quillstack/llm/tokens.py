"""Tokenising whole texts in Arrow batches, with a bounded cache of words.

The tokenizer's vocabulary is a parameter (the path of a ``tokenizers`` JSON file). With ``split_spaces`` a text is cut
at ASCII white space first and every distinct piece is encoded once: right for tokenizers whose normaliser and
pre-tokenizer drop white space and keep letters apart from punctuation, so that no token spans two pieces
(``word_bpe_49k.json`` is one). Pieces are known by 64-bit hashes, of which a worker compares less than two million at a
time; two pieces of one hash are expected once in some 10^13 pieces that it learns.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import NOT_SPACE, WORKER_CACHES, chunks, fresh_worker, hash_words, row_chunks, word_starts

_LOADED: dict[tuple[str, bool, int], "Encoder"] = {}
WORKER_CACHES.append(_LOADED)
_MARK = "\x01"
#: What byte-level tokenizers put for the bytes that aren't printable in Latin-1: code points from 256 on, in order.
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(x for x in range(256) if x <= 0x20 or 0x7F <= x <= 0xA0 or x == 0xAD)}
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Texts (UTF-8 bytes) to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, split_spaces: bool = True, kept: int = 1_500_000):
        """``kept``: about how many distinct pieces are kept (in 25 to 40 bytes each)."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split_spaces, self.kept = split_spaces, kept
        self._forget()
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # whether a plain word can go to the model directly, past the normaliser and pre-tokenizer
        tried = ["The", "Straße", "élève", "ñandú", "Ängstlichkeiten", "x"]
        self.direct = [self._word(w.lower()) for w in tried] == self._each(tried)

    def _forget(self) -> None:
        """No piece is known: their hashes in order, the number of ids of each, where those begin in ``pool``."""
        self.hashes, self.sizes, self.begins, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _word(self, low: str) -> list[int]:
        """The ids of a plain word in lower case."""
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return [t.id for t in self.tokenizer.model.tokenize(low)]

    @staticmethod
    def _plain(word: str) -> bool:
        """Letters alone, of those that have one code point and one lower case (not so: dotted capital I)."""
        return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word))

    def _each(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces without white space: one text of them all, a mark between, costs less than a text each."""
        if self.mark is None or any(_MARK in p for p in pieces):
            return self._each(pieces)
        ids = self.tokenizer.encode(f" {_MARK} ".join(pieces), add_special_tokens=False).ids
        cuts = np.flatnonzero(np.asarray(ids, np.uint32) == self.mark).tolist()
        if len(cuts) != len(pieces) - 1:
            return self._each(pieces)
        return [ids[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)]

    def _learned(self, new: list[str]) -> list[list[int]]:
        """The ids of distinct pieces."""
        out: list = [None] * len(new)
        seen: dict[str, list[int]] = {}
        rest: dict[str, list[int]] = {}
        tails: list[tuple[int, str]] = []
        for i, w in enumerate(new):
            core = w.rstrip(_PUNCTUATION)
            if not (self.direct and self._plain(core)):
                rest.setdefault(w, []).append(i)
                continue
            low = core.lower()
            ids = seen.get(low)
            if ids is None:
                ids = seen[low] = self._word(low)
            out[i] = ids
            if len(core) < len(w):
                # ASCII punctuation after plain letters is apart from them
                tails.append((i, w[len(core) :]))
                rest.setdefault(tails[-1][1], [])
        pieces, known = list(rest), {}
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            known.update(zip(some, self._ids(some), strict=True))
        for w, places in rest.items():
            for i in places:
                out[i] = known[w]
        for i, tail in tails:
            out[i] = out[i] + known[tail]
        return out

    def _keep(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """Adds pieces (ascending hashes) to those known."""
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        begins = (len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int32)
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.sizes, self.begins = (np.insert(x, at, y) for x, y in ((self.hashes, hashes), (self.sizes, sizes), (self.begins, begins)))

    def _cut(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of concatenated rows, and the offsets of the rows in them."""
        parts, woff = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for _, _, some, own in row_chunks(data, offs):
            found, at = hash_words(some, own, NOT_SPACE, lower=False)
            parts.append(found)
            woff.append(at[1:] + woff[-1][-1])
        hashes, woff = np.concatenate(parts), np.concatenate(woff)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        order = np.argsort(hashes)
        ranked = hashes[order]
        head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        distinct, which = ranked[head], np.empty(len(order), np.int32)
        which[order] = np.cumsum(head, dtype=np.int32) - 1
        if len(self.hashes) > self.kept or len(self.pool) > 8 * self.kept:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        if not known.all():
            _, _, starts = word_starts(data, offs, NOT_SPACE)
            first = starts[order[head][~known]]
            ends = np.append(np.flatnonzero(~NOT_SPACE[data]), len(data))
            # a piece ends at white space or with its row
            last = np.minimum(ends[np.searchsorted(ends, first)], offs[np.searchsorted(offs, first, side="right")])
            raw = data.tobytes()
            self._keep(distinct[~known], self._learned([raw[a:b].decode() for a, b in zip(first.tolist(), last.tolist(), strict=True)]))
            at = np.searchsorted(self.hashes, distinct)
        sizes, begins = self.sizes[at][which], self.begins[at][which]
        ends = np.cumsum(sizes, dtype=np.int64)
        spot = np.arange(ends[-1]) + np.repeat(begins - (ends - sizes), sizes)
        return self.pool[spot], np.concatenate([[0], ends])[woff]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Rows of a string array, some at a time: first row, end row, their ids (unsigned 32-bit) and the rows' offsets."""
        for i, j, data, offs in chunks(texts, 1 << 20):  # the more text at once, the fewer merges of what is known
            if self.split_spaces:
                ids, ends = self._cut(data, offs)
            else:
                raw = data.tobytes()
                each = self._each([raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
                ids, ends = np.fromiter(chain.from_iterable(each), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
            yield i, j, ids, ends


def encoder(path: str, split_spaces: bool = True, kept: int = 1_500_000) -> Encoder:
    """One encoder a Python worker."""
    key = (path, split_spaces, kept)
    if key not in _LOADED:
        fresh_worker()
        _LOADED[key] = Encoder(path, split_spaces, kept)
    return _LOADED[key]


def with_end(ids: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of rows, with ``end_id`` after each row."""
    out = np.full(len(ids) + len(offs) - 1, end_id, "<u4")
    place = np.arange(len(ids)) + np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    out[place] = ids
    return out, offs + np.arange(len(offs))
