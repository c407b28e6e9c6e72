"""Hard negatives by cover trees over norm-augmented candidates.

Vectors get one more component that makes their norms equal, so that all lie on one sphere and the angle to an anchor, whose further
component is 0, orders them as the inner product does. The top of the tree is a level of at most ``CELLS`` pivots; every vector belongs
to the cell of the nearest one, and the cell's covering angle is the greatest of its vectors'. A cell is dealt to blocks of about
``block_rows`` rows, each of which is a cover tree: a node's children are chosen farthest-first, its own centre being the first, until
half of its covering radius is reached or it has ``FAN`` of them, and every node keeps the radius that covers all below it.

A covering angle bounds the inner products of all vectors below a node from both sides. An anchor's positives are found best-first:
in its own cell first, then in cells, and in nodes of their trees, that may hold a better one than its fifth. The positives set windows;
cells and nodes outside all windows of an anchor are skipped, the others are descended in the order of their upper bounds, and leaves
are verified by exact integer inner products until no window can gain. The result is exact.

Pivots are drawn from the rows (by hash), their number is bounded by ``CELLS``; only they, and one row of facts a cell, pass the driver.

Defined cases: rows with a null id, a null label, a null vector or a null component take no part, nor do vectors of another length than
most; rows that agree in all three count once; rows that share an id and differ in label or vector are different rows, but none is a
positive or negative of its own id; ties go to the smaller id; an anchor without a positive, or without a negative in a window, gives no
row; a table without rows gives no rows; other columns are not read. Components are integers; where inner products could exceed 55 bits
there is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Pivots of the top level at most; children of a node at most; rows from which a node is cut.
CELLS, FAN, LEAF = 1024, 16, 32
#: Leaves that an anchor looks at first; each next helping is twice as large.
HELPING = 4


def matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def on_sphere(vectors: np.ndarray, norm: float) -> np.ndarray:
    """The vectors with one more component, so that each has the norm ``norm``, the greatest of all."""
    x = vectors.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(1)))])


def bounds(queries: np.ndarray, centres: np.ndarray, angles: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Between which values the inner products of each query with the points of each cap lie, with room for rounding."""
    long = np.sqrt((queries * queries).sum(1))[:, None] * norm
    apart = np.arccos(np.clip(queries @ centres[:, :-1].T / np.where(long > 0, long, 1.0), -1.0, 1.0))
    room = 1e-6 * long + 1e-6
    return long * np.cos(np.minimum(np.pi, apart + angles)) - room, long * np.cos(np.maximum(0.0, apart - angles)) + room


def angle(chord: np.ndarray, norm: float) -> np.ndarray:
    return 2 * np.arcsin(np.minimum(1.0, chord / (2 * norm)))


class CoverTree:
    """The tree of a block: levels of nodes (centre, covering angle, parent), and the leaves' rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norm: float):
        self.ids, self.labels, self.vectors, self.norm = ids, labels, vectors, norm
        points = on_sphere(vectors, norm)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # centres, angles, parents in the level above
        self.leaves: list[tuple[int, int, np.ndarray]] = []  # level, node in it, rows
        now = [(0, np.arange(len(ids)), 0)] if len(ids) else []
        while now:
            below: list[tuple[int, np.ndarray, int]] = []
            radii = np.zeros(len(now))
            for node, (centre, rows, _) in enumerate(now):
                away = np.linalg.norm(points[rows] - points[centre], axis=1)
                radii[node] = radius = float(away.max())
                if len(rows) <= LEAF or radius == 0:
                    self.leaves.append((len(self.levels), node, rows))
                    continue
                owner, near = np.zeros(len(rows), np.int64), away
                picks = [centre]
                while len(picks) < FAN and (near.max() > radius / 2 or len(picks) < 2):
                    picks.append(int(rows[near.argmax()]))
                    own = np.linalg.norm(points[rows] - points[picks[-1]], axis=1)
                    owner[own < near] = len(picks) - 1
                    near = np.minimum(near, own)
                below += [(pick, rows[owner == j], node) for j, pick in enumerate(picks) if (owner == j).any()]
            self.levels.append((points[[c for c, _, _ in now]], angle(radii, norm), np.array([p for _, _, p in now])))
            now = below
        self.lows = np.array([labels[rows].min() for _, _, rows in self.leaves], np.int64)
        self.highs = np.array([labels[rows].max() for _, _, rows in self.leaves], np.int64)
        self.verified = 0

    def leaf_bounds(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and leaf, bounds of the inner products in it, each level's no wider than those above; a leaf below a
        node that is outside of the query's ``low`` to ``high`` gets an upper bound of minus infinity."""
        least, most = np.full((len(queries), len(self.leaves)), -np.inf), np.full((len(queries), len(self.leaves)), -np.inf)
        place = {(level, node): at for at, (level, node, _) in enumerate(self.leaves)}
        above = None
        for depth, (centres, angles, parents) in enumerate(self.levels):
            alive = np.ones(len(centres), bool) if above is None else (above[1] > -np.inf).any(0)[parents]
            lo, hi = np.full((len(queries), len(centres)), -np.inf), np.full((len(queries), len(centres)), -np.inf)
            lo[:, alive], hi[:, alive] = bounds(queries, centres[alive], angles[alive], self.norm)
            if above is not None:
                lo, hi = np.maximum(lo, above[0][:, parents]), np.minimum(hi, above[1][:, parents])
            hi[(hi < low[:, None]) | (lo > high[:, None])] = -np.inf
            own = [(node, place[depth, node]) for node in range(len(centres)) if (depth, node) in place]
            if own:
                nodes, at = (list(x) for x in zip(*own, strict=True))
                least[:, at], most[:, at] = lo[:, nodes], hi[:, nodes]
            above = (lo, hi)
        return least, most

    def rows_of(self, leaves: np.ndarray) -> np.ndarray:
        rows = np.concatenate([self.leaves[i][2] for i in leaves]) if len(leaves) else np.zeros(0, np.int64)
        self.verified += len(rows)
        return rows

    def positives(self, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, row and score of the k best rows of each query's label, other than its own, that reach its
        floor."""
        _, most = self.leaf_bounds(queries.astype(np.float64), floors, np.full(len(ids), np.inf))
        out = []
        for i in range(len(ids)):
            leaves = np.flatnonzero((most[i] > -np.inf) & (self.lows <= labels[i]) & (labels[i] <= self.highs))
            leaves = leaves[np.argsort(-most[i, leaves], kind="stable")]
            rows, scores, at, take, least = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype), 0, HELPING, floors[i]
            while at < len(leaves) and most[i, leaves[at]] >= least:
                new = leaves[at : at + take]
                at, take = at + take, 2 * take
                new = self.rows_of(new[most[i, new] >= least])
                new = new[(self.labels[new] == labels[i]) & (self.ids[new] != ids[i])]
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.vectors[new] @ queries[i]])
                best = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
                if len(rows) == k:
                    least = max(least, float(scores[-1]))
            out.append((np.full(len(rows), i), rows, scores))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def negatives(self, labels: np.ndarray, ids: np.ndarray, queries: np.ndarray, windows: list[list[tuple[int, int, int]]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, name of its window, row and score of the k best rows of another label within each window (name,
        least, most)."""
        low, high = np.array([min(a for _, a, _ in w) for w in windows], float), np.array([max(b for _, _, b in w) for w in windows], float)
        least, most = self.leaf_bounds(queries.astype(np.float64), low, high)
        out = []
        for i, spans in enumerate(windows):
            leaves = np.flatnonzero((most[i] > -np.inf) & ~((self.lows == labels[i]) & (self.highs == labels[i])))
            if len(leaves) and len(spans) > 1:
                touched = np.zeros(len(leaves), bool)
                for _, a, b in spans:
                    touched |= (most[i, leaves] >= a) & (least[i, leaves] <= b)
                leaves = leaves[touched]
            leaves = leaves[np.argsort(-np.minimum(most[i, leaves], high[i]), kind="stable")]
            rows, scores, at, take = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype), 0, HELPING
            wanted, picks = float(low[i]), [np.zeros(0, np.int64)] * len(spans)  # what a row must reach to be of use
            while at < len(leaves) and most[i, leaves[at]] >= wanted:
                new = leaves[at : at + take]
                at, take = at + take, 2 * take
                new = self.rows_of(new)
                new = new[(self.labels[new] != labels[i]) & (self.ids[new] != ids[i])]
                found = self.vectors[new] @ queries[i]
                inside = (found >= low[i]) & (found <= high[i])
                rows, scores = np.concatenate([rows, new[inside]]), np.concatenate([scores, found[inside]])
                order = np.lexsort((self.ids[rows], -scores))
                rows, scores = rows[order], scores[order]
                picks, wanted = [], np.inf
                for _, a, b in spans:
                    start, end = np.searchsorted(-scores, [-b, -a + 1])
                    picks.append(np.arange(start, min(start + k, end)))
                    wanted = min(wanted, float(scores[picks[-1][-1]]) if len(picks[-1]) == k else float(a))
                keep = np.unique(np.concatenate(picks))
                rows, scores, picks = rows[keep], scores[keep], [np.searchsorted(keep, p) for p in picks]
            for (name, _, _), p in zip(spans, picks, strict=True):
                out.append((np.full(len(p), i), np.full(len(p), name), rows[p], scores[p]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


class Cells:
    """The top level: pivots, the covering angle of each cell, and the blocks that its rows are dealt to."""

    def __init__(self, pivots: np.ndarray, norm: float, angles: np.ndarray, blocks: np.ndarray):
        self.pivots, self.norm, self.angles, self.blocks = pivots, norm, angles, blocks
        self.first = np.cumsum(blocks) - blocks


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and vector of the rows that take part, once each."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()) & (F.size("vector") > 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["size"] if sizes else 0)).distinct()


def celled(rows: DataFrame, block_rows: int) -> tuple[DataFrame, Cells, type]:
    """``rows`` with a row key, the cell and the block of each, the cells, and the type in which inner products are exact."""
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("square"), F.max(F.size("vector")).alias("width")).first()
    norm = max(1.0, float(np.sqrt(facts["square"] or 0.0)) * (1 + 1e-9))
    if norm * norm >= 2.0**55:
        raise ValueError("inner products could exceed 55 bits")
    kind = np.float64 if norm * norm < 2.0**52 else np.int64
    many = min(CELLS, max(1, -(-facts["n"] // block_rows)))
    width = facts["width"] or 1
    some = rows.select("vector", F.xxhash64("vec_id", "vector").alias("h")).orderBy("h").limit(many).collect()
    pivots = on_sphere(np.array([r["vector"] for r in some], np.int64).reshape(-1, width), norm)
    if not len(pivots):
        pivots = np.zeros((1, width + 1))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            points = on_sphere(matrix(batch.column("vector"), width), norm)
            cell = np.zeros(batch.num_rows, np.int64)
            for i in range(0, batch.num_rows, 1024):
                cell[i : i + 1024] = (points[i : i + 1024] @ own.T).argmax(1)
            chord = np.linalg.norm(points - own[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(chord)], [*batch.schema.names, "cell", "chord"])

    keyed = rows.withColumn("row_key", F.xxhash64("vec_id", "label", "vector"))
    placed = staged(keyed.mapInArrow(nearest, "vec_id long, label long, vector array<long>, row_key long, cell int, chord double"), "cells")
    chords, blocks = np.zeros(len(pivots)), np.ones(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.max("chord").alias("chord"), F.count(F.lit(1)).alias("n")).collect():
        chords[r["cell"]], blocks[r["cell"]] = r["chord"], -(-r["n"] // block_rows)
    cells = Cells(pivots, norm, angle(chords * (1 + 1e-9), norm), blocks)
    table = rows.sparkSession.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(cells.first, cells.blocks, strict=True))], "cell int, first long, many long")
    dealt = F.col("first") + F.pmod(F.xxhash64("row_key", F.lit(7)), F.col("many"))
    # at most CELLS rows
    return placed.join(F.broadcast(table), "cell").select("vec_id", "label", "vector", "row_key", "cell", dealt.alias("block")), cells, kind


_PROBE = "block long, row_key long, vec_id long, label long, vector array<long>, floor double, windows array<array<long>>"


def routed(anchors: DataFrame, cells: Cells, home: bool | None) -> DataFrame:
    """A row for each of ``anchors`` (row_key, vec_id, label, vector, cell, floor, windows) and block that may hold a row of at
    least its floor and within one of its windows: of its own cell only (home), of others only, or of all (None)."""
    shared = anchors.sparkSession.sparkContext.broadcast(cells)
    width = cells.pivots.shape[1] - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            queries = matrix(batch.column("vector"), width).astype(np.float64)
            least, most = bounds(queries, own.pivots, own.angles, own.norm)
            use = most >= batch.column("floor").to_numpy()[:, None]
            if home is not None:
                use &= (np.arange(len(own.pivots)) == batch.column("cell").to_numpy()[:, None]) == home
            for i, spans in enumerate(batch.column("windows").to_pylist()):
                if spans:
                    use[i] &= np.any([(most[i] >= a) & (least[i] <= b) for _, a, b in spans], axis=0)
            who, cell = np.nonzero(use)
            times = own.blocks[cell]
            who, start = np.repeat(who, times), np.repeat(own.first[cell], times)
            block = start + np.arange(len(start)) - np.repeat(np.cumsum(times) - times, times)
            for i in range(0, len(who), 8192):
                some = pa.Table.from_batches([batch]).select(["row_key", "vec_id", "label", "vector", "floor", "windows"]).take(pa.array(who[i : i + 8192])).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(block[i : i + 8192]), *(c.combine_chunks() for c in some.columns)], ["block", "row_key", "vec_id", "label", "vector", "floor", "windows"])

    return anchors.select("row_key", "vec_id", "label", "vector", "cell", "floor", "windows").mapInArrow(emit, _PROBE)


def probed(probes: DataFrame, rows: DataFrame, cells: Cells, kind: type, parts: int, k: int, windowed: bool) -> DataFrame:
    """anchor (a row key), place (of the window), vec_id and score of the best rows of each block for each of its probes."""
    norm, width = cells.norm, cells.pivots.shape[1] - 1

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("anchor", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()))})
        ids, labels = held.column("vec_id").to_numpy(), held.column("label").to_numpy()
        tree = CoverTree(ids, labels, matrix(held.column("vector"), width).astype(kind), norm)
        own, queries = asked.column("vec_id").to_numpy(), matrix(asked.column("vector"), width).astype(kind)
        if windowed:
            who, place, row, score = tree.negatives(asked.column("label").to_numpy(), own, queries, asked.column("windows").to_pylist(), k)
        else:
            who, row, score = tree.positives(own, asked.column("label").to_numpy(), queries, asked.column("floor").to_numpy(), k)
            place = np.zeros(len(who), np.int64)
        return pa.table({"anchor": asked.column("row_key").to_numpy()[who.astype(np.int64)], "place": pa.array(place.astype(np.int32)), "vec_id": ids[row.astype(np.int64)], "score": score.astype(np.int64)})

    # anchors of a block come in parts of bounded size, each with the block's rows
    probes = probes.withColumn("part", F.pmod(F.xxhash64("row_key"), F.lit(parts)))
    rows = rows.select("block", "vec_id", "label", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    return probes.groupBy("block", "part").cogroup(rows.groupBy("block", "part")).applyInArrow(search, "anchor long, place int, vec_id long, score long")


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_rows: int = 2048, anchor_rows: int = 8192) -> DataFrame:
    """For each of ``rows`` (vec_id, label, vector of integers) that ``is_anchor`` picks: its best ``positives`` other rows of its
    label, and for each of them the best ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of the
    positive's. anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    placed, cells, kind = celled(usable(rows), block_rows)
    anchors = placed.where(is_anchor).select("row_key", "vec_id", "label", "vector", "cell")
    parts = max(1, -(-anchors.count() // anchor_rows))
    none = F.lit(None).cast("array<array<long>>").alias("windows")

    home = routed(anchors.select("*", F.lit(float("-inf")).alias("floor"), none), cells, True)
    found = staged(probed(home, placed, cells, kind, parts, positives, False), "positives")
    if len(cells.pivots) > 1:
        fifth = first_of(found, ["anchor"], positives).where(F.col("rank") == positives).select(F.col("anchor").alias("row_key"), F.col("score").cast("double").alias("floor"))
        others = anchors.join(fifth, "row_key", "left").select(*anchors.columns, F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), none)
        found = found.unionByName(staged(probed(routed(others, cells, False), placed, cells, kind, parts, positives, False), "positives"))
    best = staged(first_of(found, ["anchor"], positives).select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # whole scores from low to high percent of the positive's; of a negative one there are none
    floor = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")
    ends = best.withColumn("lo", -floor(f"(-{low} * positive_score)")).withColumn("hi", floor(f"({high} * positive_score)"))
    wins = ends.where("lo <= hi").groupBy("anchor").agg(F.array_sort(F.collect_list(F.array(F.col("place").cast("long"), "lo", "hi"))).alias("windows"))
    wins = wins.withColumnRenamed("anchor", "row_key")
    asked = anchors.join(wins, "row_key").withColumn("floor", F.lit(float("-inf")))
    near = first_of(probed(routed(asked, cells, None), placed, cells, kind, parts, negatives, True), ["anchor", "place"], negatives)
    near = near.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row_key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return near.join(best, ["anchor", "place"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and the components times ``scale``, rounded down, of the rows whose label and components are all there."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
    return rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vector"))
