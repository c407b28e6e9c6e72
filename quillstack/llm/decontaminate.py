"""Benchmark decontamination by winnowing.

Of every run of ``window - k + 1`` consecutive k-grams of words, the one of smallest hash is a fingerprint. A span of
``window`` words that a document shares with an item makes both keep the same fingerprint, so none is missed. Shared
fingerprints are extended to both sides as far as the words agree; spans of at least ``window`` words are hits. An item
of fewer words has no fingerprint to rely on and is looked up whole.

The item side is broadcast in blocks of a checked size (``block_bytes`` of text); a larger benchmark takes more passes.

Defined cases: a null text has no words; an item without words, or with a null item_id, matches nothing; repeated items
count once; repeated documents get a row each; empty tables give zero hits or no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, chunks, fresh_worker, hash_words, small_batches, staged, text_buffers, word_ngrams

SPANS = "spans array<struct<begin:int,end:int>>"
_END = np.uint64(2**64 - 1)
_BITS = np.uint64((1 << 22) - 1)


def selected(grams: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Positions of fingerprints: the last smallest value of each run of ``width`` grams that ``ok`` starts."""
    n = len(ok)
    if not n:
        return np.zeros(0, np.int64)
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        g = grams[j : j + n]
        np.minimum(least, g, out=least)
    for j in range(width):
        at[grams[j : j + n] == least] = j
    return np.unique((np.arange(n) + at)[ok])


def runs_within(n_words: int, woff: np.ndarray, length: int) -> np.ndarray:
    """For each word of concatenated rows, whether ``length`` words from it lie in its row (of those that could)."""
    ends = np.repeat(woff[1:], np.diff(woff))
    return (np.arange(n_words) + length <= ends)[: max(0, n_words - length + 1)]


class ItemIndex:
    """Fingerprints of the items of a block, and the short items whole."""

    def __init__(self, items: list[tuple[str, str]], window: int, k: int):
        self.window, self.k, self.width = window, k, window - k + 1
        texts = pa.array([t for _, t in items], pa.string())
        self.words, self.woff = hash_words(*text_buffers(texts), ALNUM)
        self.names = [i for i, _ in items]
        grams = word_ngrams(self.words, k)
        at = selected(grams, runs_within(len(self.words), self.woff, window), self.width)
        order = np.argsort(grams[at], kind="stable")
        self.hashes, self.at = grams[at][order], at[order]
        self.owner = np.searchsorted(self.woff, self.at, side="right") - 1
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.diff(self.woff)
        for length in range(1, window):
            own = np.flatnonzero(sizes == length)
            if len(own):
                h = word_ngrams(self.words, length)[self.woff[own]]
                order = np.argsort(h, kind="stable")
                self.short[length] = h[order], own[order]
        self.maybe = {0: self._bits(self.hashes)} | {n: self._bits(h) for n, (h, _) in self.short.items()}

    @staticmethod
    def _bits(hashes: np.ndarray) -> np.ndarray:
        bits = np.zeros(int(_BITS) + 1, bool)
        bits[hashes & _BITS] = True
        return bits

    def matches(self, words: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end word (in the concatenated rows) and item of each hit."""
        begin, end, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n = len(words)
        if len(self.hashes) and n >= self.window:
            grams = word_ngrams(words, self.k)
            at = selected(grams, runs_within(n, woff, self.window), self.width)
            at = at[self.maybe[0][grams[at] & _BITS]]
            lo, hi = np.searchsorted(self.hashes, grams[at], "left"), np.searchsorted(self.hashes, grams[at], "right")
            spans = self._extended(words, woff, at, lo, hi)
            if spans:
                b, e, i = (np.array(x, np.int64) for x in zip(*spans, strict=True))
                begin.append(b), end.append(e), item.append(i)
        for length, (hashes, own) in self.short.items():
            grams = word_ngrams(words, length)
            at = np.flatnonzero(runs_within(n, woff, length)[: len(grams)])
            at = at[self.maybe[length][grams[at] & _BITS]]
            lo, hi = np.searchsorted(hashes, grams[at], "left"), np.searchsorted(hashes, grams[at], "right")
            many = hi - lo
            which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            b = np.repeat(at, many)
            begin.append(b), end.append(b + length), item.append(own[which])
        return np.concatenate(begin), np.concatenate(end), np.concatenate(item)

    def _extended(self, words, woff, at, lo, hi) -> list[tuple[int, int, int]]:
        found, done = [], {}
        for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            if a == b:
                continue
            row = int(np.searchsorted(woff, p, side="right")) - 1
            first, last = int(woff[row]), int(woff[row + 1])
            for x in range(a, b):
                q, who = int(self.at[x]), int(self.owner[x])
                if done.get((row, q - p, who), -1) > p:  # within a span that is found already
                    continue
                left, right = min(p - first, q - int(self.woff[who])), min(last - p, int(self.woff[who + 1]) - q)
                back = words[p - left : p] != self.words[q - left : q]
                ahead = words[p : p + right] != self.words[q : q + right]
                begin = p - left + (int(np.flatnonzero(back)[-1]) + 1 if back.any() else 0)
                end = p + (int(ahead.argmax()) if ahead.any() else right)
                done[row, q - p, who] = end
                if end - begin >= self.window:
                    found.append((begin, end, who))
        return found


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as ascending disjoint spans."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def find_hits(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 4, block_bytes: int = 16 << 20, keep: list[str] | None = None) -> DataFrame:
    """Of ``docs`` (doc_id, text): the columns ``keep`` (doc_id, where none are named), n_words, spans of words that items
    (item_id, text) hold too, and those items.

    Needs 1 <= k <= window. A row for each document, with empty arrays where nothing is found.
    """
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-int(total) // block_bytes) or 1

    def block_pass(number: int, keep: list[str]) -> DataFrame:
        tie = F.xxhash64("doc_id", "text").alias("__tie")
        rows = docs.select(*dict.fromkeys([*keep, "text"]), tie)
        names = [*keep, "__tie", "n_words", "spans", "items"]
        schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep) + f", __tie long, n_words long, {SPANS}, items array<string>"
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        index = spark.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in part], window, k))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh_worker()
            found = index.value
            for batch in batches:
                for i, j, data, offs in chunks(batch.column("text")):
                    words, woff = hash_words(data, offs, ALNUM)
                    begin, end, item = found.matches(words, woff)
                    row = np.searchsorted(woff, begin, side="right") - 1
                    spans, own_items = [[] for _ in range(j - i)], [[] for _ in range(j - i)]
                    order = np.argsort(row, kind="stable")
                    for own in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(row) else []:
                        r = int(row[own[0]])
                        b, e = merged(begin[own], end[own])
                        spans[r] = [{"begin": x, "end": y} for x, y in zip((b - woff[r]).tolist(), (e - woff[r]).tolist(), strict=True)]
                        own_items[r] = sorted({found.names[x] for x in np.unique(item[own]).tolist()})
                    some = batch.slice(i, j - i)
                    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
                    yield pa.RecordBatch.from_arrays([*(some.column(n) for n in (*keep, "__tie")), pa.array(np.diff(woff).astype(np.int64)), pa.array(spans, kind), pa.array(own_items, pa.list_(pa.string()))], names)

        return rows.mapInArrow(scan, schema)

    first = block_pass(0, keep)
    if blocks > 1:
        # later passes keep only documents with hits; rows that repeat agree, so one of each is enough
        rest = None
        for number in range(1, blocks):
            part = block_pass(number, ["doc_id"]).where(F.size("items") > 0)
            part = staged(part, "hits")  # one block's index at a time
            rest = part if rest is None else rest.unionByName(part)
        more = rest.groupBy("__tie").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("more_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items"))
        both = first.join(more, "__tie", "left")
        joined = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.array_sort(F.array_union(a, b)))
        first = both.select(*keep, "n_words", joined("spans", "more_spans").alias("spans"), joined("items", "more_items").alias("items"))
    return first.select(*keep, "n_words", "spans", "items")


def hit_words(spans: str = "spans"):
    """The number of words that ascending spans cover, overlaps once."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["begin"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to"))
    return F.aggregate(spans, start, step, lambda a: a["n"]).cast("long")


def decontaminate(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    return find_hits(docs, items, **settings).select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit_words() > 0).alias("contaminated"),
    )
