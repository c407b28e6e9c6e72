"""Ranked lexical search by presence masks: the best documents of every item, exactly.

One pass over the documents counts, for the terms that items ask for, how often each document holds them. Documents are then searched
where they lie, a block at a time, for all items. In a block every item's documents get a mask, a bit for each of its terms that they
hold, put together by OR over the terms' postings; documents of one mask are a group. The most that a group can score is the sum of
the greatest contributions that its terms make in the block, so groups are evaluated by descending maximum score, in growing helpings,
until that of the next one is below the k-th score found. A block gives at most k rows an item, and blocks are merged.

Scores: w * ((1000000000 * tf) div (1000 * tf + 12 * m)), summed over an item's terms, repeats included, in 64-bit integers; w is
floor(1000 * ln((2N + 2) / (2df + 1))) in doubles and m is 75 + (25 * n * N) div L. N, L and df are counts of all documents.

Items come in batches of about ``batch_terms`` terms, which bounds what is broadcast; more items take more passes. Terms are compared
by 64-bit hashes.

Defined cases: a null or empty text has no term, is never returned and isn't counted in N; every row counts as a document, also where
rows repeat; rows without a doc_id count and come last among equal scores; items without a term, or whose terms no document holds, give
no rows; items that repeat (id and text) are one; empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ALNUM, chunks, fresh_worker, hash_words, small_batches, staged

#: Documents, and postings, of a block at most.
BLOCK_ROWS, BLOCK_POSTINGS = 32_768, 4_000_000
#: Terms whose bits one integer takes.
WORD = 63


def counted_terms(items: DataFrame) -> DataFrame:
    """key, terms (hashes, ascending) and counts of each of ``items`` (key, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in chunks(batch.column("text")):
                words, woff = hash_words(data, offs, ALNUM)
                found = [np.unique(words[a:b], return_counts=True) for a, b in zip(woff[:-1], woff[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), pa.array([t.view(np.int64) for t, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64()))], ["key", "terms", "counts"])

    return items.mapInArrow(emit, "key long, terms array<long>, counts array<long>")


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the sorted ``vocabulary``) and tfs of each of ``docs`` with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        known = shared.value
        for batch in batches:
            for i, j, data, offs in chunks(batch.column("text")):
                words, woff = hash_words(data, offs, ALNUM)
                n = np.diff(woff)
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                hit = known[at] == words
                both, tfs = np.unique(np.repeat(np.arange(j - i), n)[hit] * len(known) + at[hit], return_counts=True)
                offsets = np.searchsorted(both, np.arange(j - i + 1) * len(known)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (both % len(known), tfs)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.mapInArrow(emit, "doc_id long, n long, terms array<int>, tfs array<int>")


class Block:
    """The postings of some documents: sorted by term, with the contribution of each and the greatest of each term."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, documents: int, length: int, size: int):
        self.ids = ids
        m = 75 + 25 * n * documents // length
        doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        tf, self.docs = tfs[order].astype(np.int64), doc[order]
        self.gives = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.docs])
        self.starts = np.searchsorted(terms[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.gives, self.starts[held])
        self.evaluated = 0

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[term], self.starts[term + 1]
        return self.docs[a:b], self.gives[a:b]

    def groups(self, terms: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The masks of all documents by words of ``WORD`` terms, each document's group, and the first document of each."""
        masks, group = [], np.zeros(len(self.ids), np.int64)
        first = np.zeros(1, np.int64)
        for begin in range(0, len(terms), WORD):
            mask = np.zeros(len(self.ids), np.int64)
            for j, term in enumerate(terms[begin : begin + WORD]):
                mask[self.of(term)[0]] |= 1 << j
            _, here = np.unique(mask, return_inverse=True)
            _, first, group = np.unique(group * len(mask) + here, return_index=True, return_inverse=True)
            masks.append(mask)
        return masks, group, first

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents (places in the block) for an item of these terms, best first, and their scores."""
        use = (weights > 0) & (self.most[terms] > 0)
        terms, weights = terms[use], weights[use]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        masks, group, first = self.groups(terms)
        bound = np.zeros(len(first), np.int64)
        for j, (term, weight) in enumerate(zip(terms, weights, strict=True)):
            bound += (masks[j // WORD][first] >> (j % WORD) & 1) * (weight * self.most[term])
        order = np.argsort(-bound, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        place, bound = place[group], bound[order]
        many = np.cumsum(np.bincount(place, minlength=len(order)))
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, helping = 0, 4 * k
        while done < len(order) and bound[done] > 0 and (len(docs) < k or bound[done] >= scores[-1]):
            end = min(len(order), int(np.searchsorted(many, helping)) + 1)
            end = max(end, done + 1)
            new = np.flatnonzero((place >= done) & (place < end))
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.scores(new, terms, weights, masks)])
            keep = np.lexsort((self.ids[docs], -scores))[:k]
            docs, scores = docs[keep], scores[keep]
            done, helping = end, 2 * int(many[end - 1])
            self.evaluated += len(new)
        return docs[scores > 0], scores[scores > 0]

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
        """The scores of ``docs`` (ascending)."""
        out = np.zeros(len(docs), np.int64)
        for j, (term, weight) in enumerate(zip(terms, weights, strict=True)):
            has = np.flatnonzero(masks[j // WORD][docs] >> (j % WORD) & 1)
            held, gives = self.of(term)
            out[has] += weight * gives[np.searchsorted(held, docs[has])]
        return out


def searched(found: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], documents: int, length: int, size: int, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, doc_id and score of the k best of each block of ``found``, as :func:`postings` makes it, for each of ``items``:
    key, places of its terms, weights times repeats."""
    shared = found.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, terms, tfs = (rows.column(c).combine_chunks() for c in ("doc_id", "terms", "tfs"))
            offsets = terms.offsets.to_numpy() - terms.offsets[0].as_py()
            own = Block(ids.fill_null(np.iinfo(np.int64).max).to_numpy(), rows.column("n").to_numpy(), offsets, terms.flatten().to_numpy(), tfs.flatten().to_numpy(), documents, length, size)
            keys, docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for key, asked, weights in shared.value:
                at, score = own.best(asked, weights, k)
                keys.append(np.full(len(at), key))
                docs.append(at)
                scores.append(score)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], ["key", "doc_id", "score"])

        size_of = lambda: (sum(b.num_rows for b in held), sum(len(b.column("terms").flatten()) for b in held))
        for batch in batches:
            held.append(batch)
            rows, many = size_of()
            if rows >= block_rows or many >= BLOCK_POSTINGS:
                yield block()
        if any(b.num_rows for b in held):
            yield block()

    return found.select("doc_id", "n", "terms", "tfs").mapInArrow(scan, "key long, doc_id long, score long")


def weight(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, batch_terms: int = 500_000, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    items = items.select("item_id", F.xxhash64(F.col("item_id").cast("string"), "text").alias("key"), "text")
    terms = staged(counted_terms(items.select("key", "text")), "item-terms")
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes, near, facts = -(-total // batch_terms) or 1, None, None
    for number in range(passes):
        some = terms.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("key"), F.lit(passes)) == number)).toArrow()
        asked = list(zip(some.column("key").to_pylist(), (np.array(t, np.int64).view(np.uint64) for t in some.column("terms").to_pylist()), some.column("counts").to_pylist(), strict=True))
        vocabulary = np.unique(np.concatenate([t for _, t, _ in asked])) if asked else np.zeros(1, np.uint64)
        found = staged(postings(docs, vocabulary), "postings")
        if facts is None:
            facts = found.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        held = found.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        weights = np.zeros(len(vocabulary), np.int64)
        weights[held.column("term").to_numpy()] = [weight(facts["documents"], df) for df in held.column("count").to_pylist()]
        places = [(key, np.searchsorted(vocabulary, t)) for key, t, _ in asked]
        own = [(key, at, weights[at] * np.array(c, np.int64)) for (key, at), (_, _, c) in zip(places, asked, strict=True)]
        done = staged(searched(found, own, facts["documents"], max(1, facts["length"]), len(vocabulary), k, block_rows), "ranked")
        near = done if near is None else near.unionByName(done)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(items.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
