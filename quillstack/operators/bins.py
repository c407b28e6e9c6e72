"""Sequential bins in parallel: rows in order, a new bin where the next row would go over a limit.

Where bins begin depends on all rows before, so rows are cut into blocks of consecutive ones, and what a block does to the load of the
bin that is open when it begins is worked out for every load at once. In a block the next beginning after each row is found from prefix
sums, and where a chain of beginnings leaves the block by doubling these pointers (binary lifting). The first beginning in a block
falls as the load that comes in grows, so a block is a step function from the load coming in to the load going out and the bins
begun; steps of one result are one. Only the step functions of documents of several blocks are folded one after another, then every
block is numbered apart.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import staged

#: Rows of a block, as a power of two.
BLOCK_BITS = 16
_STEPS = "piece long, block long, first long, total long, lows array<long>, outs array<long>, counts array<long>, zero_out long, zero_count long"


def next_begins(prefix: np.ndarray, limit: int) -> np.ndarray:
    """For a bin that begins at each row: the row at which the next one begins (the number of rows where none does).
    ``prefix``: n + 1 sums of sizes. A bin that holds nothing but rows without a size takes the next one, however large."""
    full = np.searchsorted(prefix[1:], prefix[:-1] + limit, "right")
    used = np.searchsorted(prefix, prefix[:-1], "right")
    return np.minimum(np.maximum(full, used), len(prefix) - 1)


def chain_ends(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the last beginning of the chain that starts there, and how many beginnings it has, by doubling."""
    n = len(after)
    last, count = np.arange(n + 1), np.ones(n + 1, np.int64)
    last[n], count[n] = n, 0
    jump = np.append(after, n)
    while (jump[:n] < n).any():
        go = jump < n
        # a chain of ``count`` beginnings is followed by the one that starts where it ends
        count[go], last[go] = count[go] + count[jump[go]], last[jump[go]]
        jump = np.where(go, jump[jump], n)
    return last[:n], count[:n]


def step_function(sizes: np.ndarray, limit: int) -> tuple[int, list[int], list[int], list[int], int, int]:
    """What a block does: total size; from which loads (ascending) on the load going out and the bins begun are which, loads below
    the first only growing by the total; and the two for an empty bin."""
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    n, total = len(sizes), int(prefix[-1])
    last, count = chain_ends(next_begins(prefix, limit))
    out = total - prefix[last]
    # loads of 1 and more: the first beginning is e for loads above limit - prefix[e + 1] and up to limit - prefix[e]
    ends = int(np.searchsorted(prefix[1:], limit - 1, "right"))
    at = np.arange(min(ends, n - 1), -1, -1)
    lows = np.maximum(1, limit - prefix[at + 1] + 1)
    keep = np.concatenate([lows[1:] != lows[:-1], [True]]) if len(at) else np.zeros(0, bool)  # of equal loads the earliest beginning
    at, lows = at[keep], lows[keep]
    new = np.concatenate([[True], (out[at[1:]] != out[at[:-1]]) | (count[at[1:]] != count[at[:-1]])]) if len(at) else keep[:0]
    at, lows = at[new], lows[new]
    empty = max(int(np.searchsorted(prefix[1:], limit, "right")), int(np.searchsorted(prefix, 0, "right")))
    zero = (int(out[empty]), int(count[empty])) if empty < n else (total, 0)
    return (total, lows.tolist(), out[at].tolist(), count[at].tolist(), *zero)


def _segments(table: pa.Table) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs of one piece in a sorted table."""
    piece = table.column("__piece").to_numpy()
    cuts = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(piece)], strict=True)


def sequential_bins(rows: DataFrame, size: str, limit: int, doc: str = "doc_id", order: str = "ord", block_bits: int = BLOCK_BITS) -> DataFrame:
    """bin (from 0): the rows of each ``doc`` in ``order``, a new bin where the next row would take one that holds something over
    ``limit``. Sizes are whole numbers of 0 or more; a null is 0. Rows of one order come in any one order."""
    limit = int(limit)
    names = rows.columns
    weight = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0).cast("long")).alias("__size")
    # a hash names the document within a block, whatever its type
    ranged = rows.select("*", F.xxhash64(doc).alias("__piece"), weight).repartitionByRange(F.col("__piece"), F.col(order)).sortWithinPartitions("__piece", order)
    kept = staged(ranged.withColumn("__seq", F.monotonically_increasing_id()).withColumn("__block", F.shiftright("__seq", block_bits)), "bins")

    kinds = T.StructType.fromDDL(_STEPS)
    shape = [(f.name, pa.list_(pa.int64()) if isinstance(f.dataType, T.ArrayType) else pa.int64()) for f in kinds]

    def steps(block: pa.Table) -> pa.Table:
        block = block.sort_by("__seq")
        sizes, piece, seq = (block.column(c).to_numpy() for c in ("__size", "__piece", "__seq"))
        number = block.column("__block")[0].as_py()
        out = [(int(piece[a]), number, int(seq[a]), *step_function(sizes[a:b], limit)) for a, b in _segments(block)]
        return pa.table({name: pa.array([r[i] for r in out], t) for i, (name, t) in enumerate(shape)})

    spread = kept.groupBy("__piece").agg(F.min("__block").alias("low"), F.max("__block").alias("high")).where("low < high").select("__piece")
    wide = kept.join(spread, "__piece", "left_semi").select("__piece", "__seq", "__block", "__size")
    functions = staged(wide.groupBy("__block").applyInArrow(steps, _STEPS), "bin-steps")

    def fold(of: pa.Table) -> pa.Table:
        load, begun, out = 0, 0, []
        for r in of.sort_by("first").to_pylist():
            out.append((r["piece"], r["block"], load, begun))
            at = bisect_right(r["lows"], load) - 1
            if load == 0:
                load, begun = r["zero_out"], begun + r["zero_count"]
            elif at < 0:
                load += r["total"]
            else:
                load, begun = r["outs"][at], begun + r["counts"][at]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("piece", "block", "load", "begun"))})

    entries = functions.groupBy("piece").applyInArrow(fold, "piece long, block long, load long, begun long")
    kind = T.StructType([*rows.schema.fields, T.StructField("bin", T.IntegerType())])

    def number(block: pa.Table, known: pa.Table) -> pa.Table:
        entry = {r["piece"]: (r["load"], r["begun"]) for r in known.to_pylist()}
        block = block.sort_by("__seq")
        sizes, piece = block.column("__size").to_numpy(), block.column("__piece").to_numpy()
        bins = np.zeros(len(sizes), np.int64)
        for a, b in _segments(block) if len(sizes) else ():
            load, begun = entry.get(int(piece[a]), (0, 0))
            prefix = np.concatenate([[0], np.cumsum(sizes[a:b])])
            after = next_begins(prefix, limit)
            at = int(np.searchsorted(prefix[1:], limit - load, "right"))
            at = at if load else max(at, int(np.searchsorted(prefix, 0, "right")))
            begins = np.zeros(b - a, np.int64)
            while at < b - a:
                begins[at] = 1
                at = int(after[at])
            bins[a:b] = begun + np.cumsum(begins)
        return block.select(names).append_column("bin", pa.array(bins.astype(np.int32)))

    return kept.groupBy("__block").cogroup(entries.withColumnRenamed("block", "__block").groupBy("__block")).applyInArrow(number, kind)
