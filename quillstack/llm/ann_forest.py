"""Approximate nearest neighbours by a hash-prefix forest, nearness being the largest inner product.

Every vector gets one long hash string (``BITS`` signs of random projections) for each tree; a tree over a block of
rows is the sorted array of these strings. A query descends each tree by binary search to the rows that share the
longest prefixes with it, then all trees ascend together, one bit at a time, until enough rows share a prefix; those
rows are scored exactly. Vectors are first given one more component that makes their norms equal, so that the angle to
a query orders them as the inner product does.

Rows are indexed where they lie, a forest a block; a stated query set visits all blocks and the block results are
merged. Queries are broadcast in batches of about ``query_batch``, each after the one before is done; more queries take
more passes.

``share`` is the part of a block's rows that the ascent gathers at most, in steps that double from a sixteenth of it; a query
whose k nearest a step with new rows leaves as they were goes no further. Vectors without structure need about half of the rows for a
recall of 0.9, in any hash family; the ascent of clustered ones ends early.

Defined cases: vectors that are null, zero, of another length than most (which have no inner product with the others), or
that hold null or non-finite components take no part, as queries or candidates; neither do rows with a null id; ties go to
the smaller id; an id of several vectors counts by the best of them, as a query and as a candidate, so repeated rows count
once; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

BITS = 32
#: Steps of the ascent; each gathers about twice the rows of the one before.
STEPS = 5
_ONE = np.uint64(1)


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["size"] if sizes else 0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Forest:
    """The trees of one block of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, planes: np.ndarray, norm: float):
        self.ids, self.vectors, self.planes = ids, vectors, planes
        self.most = int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 1  # vectors of one id
        rest = np.sqrt(np.maximum(0.0, norm * norm - (vectors * vectors).sum(1)))
        hashes = self.hashed(np.column_stack([vectors, rest]))
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, 1)

    def hashed(self, points: np.ndarray) -> np.ndarray:
        """Hash strings as integers: trees by rows."""
        trees, bits, width = self.planes.shape
        signs = (points @ self.planes.reshape(-1, width).T > 0).reshape(len(points), trees, bits)
        return (signs.astype(np.uint64) << np.arange(bits, dtype=np.uint64)[::-1]).sum(2, dtype=np.uint64).T

    def candidates(self, queries: np.ndarray, leasts: list[int]) -> Iterator[Iterator[np.ndarray]]:
        """For each query the rows that share a prefix with it in some tree: for each of ``leasts``, in ascending order, what
        is new at the greatest common depth at which at least so many rows do. Trees ascend together, a bit at a time."""
        hashes = self.hashed(np.column_stack([queries, np.zeros(len(queries))]))
        trees, n, size, steps = len(self.sorted), len(queries), len(self.ids), len(leasts)
        lo, hi = np.zeros((steps, trees, n), np.int32), np.full((steps, trees, n), size, np.int32)
        wait = np.full((steps, n), True)
        for depth in range(BITS, 0, -1):
            at = np.flatnonzero(wait[-1])
            if not len(at):
                break
            cut = np.uint64(BITS - depth)
            own = hashes[:, at] >> cut << cut
            begin = np.stack([np.searchsorted(self.sorted[t], own[t], "left") for t in range(trees)])
            end = np.stack([np.searchsorted(self.sorted[t], own[t] + (_ONE << cut) - _ONE, "right") for t in range(trees)])
            # rows expected in the union of the trees' ranges, as if they were independent
            apart = size * (1 - np.prod(1 - (end - begin) / size, axis=0))
            for s, least in enumerate(leasts):
                now = wait[s, at] & (apart >= least)
                lo[s][:, at[now]], hi[s][:, at[now]] = begin[:, now], end[:, now]
                wait[s, at[now]] = False

        def grown(i: int) -> Iterator[np.ndarray]:
            seen = np.zeros(size, bool)
            for s in range(steps):
                before = seen.copy()
                for t in range(trees):
                    seen[self.order[t, lo[s, t, i] : hi[s, t, i]]] = True
                yield np.flatnonzero(seen & ~before)

        for i in range(n):
            yield grown(i)

    def nearest(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k of ``rows`` nearest to ``query``, one of each id, best first, and their scores."""
        near = self.vectors[rows] @ query
        if len(rows) > k * self.most:
            # rounding of the product above differs from that of the final scores by far less than the margin
            keep = np.partition(near, len(near) - k * self.most)[-k * self.most]
            rows = rows[near >= keep - 1e-9 * max(1.0, abs(keep))]
        score = (self.vectors[rows] * query).sum(1)
        best = np.lexsort((self.ids[rows], -score))
        if self.most > 1:
            best = best[np.sort(np.unique(self.ids[rows[best]], return_index=True)[1])]
        return rows[best[:k]], score[best[:k]]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, leasts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query id, row id and score of the k nearest found of each query. A query's ascent ends where new rows have changed
        none of its k nearest, else with the last of ``leasts``."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.gathered = 0
        for own, query, steps in zip(ids, queries, self.candidates(queries, leasts), strict=True):
            rows, score = np.zeros(0, np.int64), np.zeros(0)
            for new in steps:
                if not len(new):  # two steps that stop at one depth; nothing was looked at
                    continue
                self.gathered += len(new)
                before = rows
                rows, score = self.nearest(np.concatenate([rows, new[self.ids[new] != own]]), query, k)
                if len(rows) == k and np.array_equal(rows, before):
                    break
            out.append((np.full(len(rows), own), self.ids[rows], score))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, trees: int = 40, share: float = 0.66, block_rows: int = 16_384, query_batch: int = 32_768, seed: int = 5) -> DataFrame:
    """For each of ``rows`` (vec_id, embedding) that ``is_query`` picks, its k nearest found others: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    rows = usable(rows)
    queries = rows.where(is_query).distinct()
    facts = rows.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"), F.max(F.size("embedding")).alias("width"), F.count_if(is_query).alias("queries")).first()
    width, norm = int(facts["width"] or 1), float(facts["norm"] or 1.0)
    passes = -(-int(facts["queries"]) // query_batch) or 1
    planes = np.random.default_rng(seed).normal(size=(trees, BITS, width + 1))

    def batch_pass(number: int) -> DataFrame:
        some = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == number).toArrow()
        order = np.argsort(some.column("vec_id").to_numpy())
        own = spark.sparkContext.broadcast((some.column("vec_id").to_numpy()[order], matrix(some.column("embedding").combine_chunks(), width)[order]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, points = own.value
            held: list[pa.RecordBatch] = []

            def found() -> pa.RecordBatch:
                block = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                vec = block.column("vec_id").to_numpy()
                forest = Forest(vec, matrix(block.column("embedding").combine_chunks(), width), planes, norm)
                q, v, s = forest.search(ids, points, k, [max(4 * k, int(share * len(vec)) >> n) for n in range(STEPS - 1, -1, -1)])
                return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

            for batch in batches:
                for at in range(0, batch.num_rows, block_rows):
                    held.append(batch.slice(at, block_rows))
                    if sum(b.num_rows for b in held) >= block_rows:
                        yield found()
            if any(b.num_rows for b in held):
                yield found()

        # a query has at most k rows from each block
        done = staged(rows.select("vec_id", "embedding").mapInArrow(scan, "query_id long, vec_id long, score double"), "near")
        own.unpersist()
        return done

    near = batch_pass(0)
    for number in range(1, passes):
        near = near.unionByName(batch_pass(number))
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
