"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Every task packs its own pieces best-fit, largest first. Nearly full bins are done; underfull bins go on as single items
to rounds of best-fit in fewer, larger groups, until one group is left or a round saves next to nothing. No task takes
more than ``MOST`` items, however many rows there are.

Defined cases: a null text is empty; an empty text is the end id alone; documents over the capacity are cut, the last
piece may be shorter; repeated rows are packed each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .tokens import encoder, with_end

#: Items that one best-fit run takes at most.
MOST = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin. Ties: the earlier item first."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: dict[int, list[int]] = {}
    mask, fills = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := mask >> size:
            left = size + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, at = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = at, fills[at]
        fills[at] += size
        if left := left - size:
            room.setdefault(left, []).append(at)
            mask |= 1 << left
    return bins, offsets, np.asarray(fills, np.int64)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, slack: int = 8, split_spaces: bool = True) -> DataFrame:
    """Packs ``docs`` (doc_id, text); a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``slack``: a bin with so few tokens left is nearly full.
    """
    small_batches(docs.sparkSession)
    width = 4 * capacity

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, enc = TaskContext.get().partitionId() << 36, encoder(vocabulary, split_spaces)
        rows: list[tuple[int, int, int, int, int]] = []

        def packed() -> pa.RecordBatch:
            nonlocal first
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            sizes = np.asarray(cols[3], np.int64)
            bins, offsets, fills = best_fit(sizes, capacity)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] + [pa.array(bins + first), pa.array(offsets), pa.array(fills[bins] if len(bins) else bins)]
            first += len(fills)
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])

        for batch in batches:
            for i, j, ids, offs in enc.encode(batch.column("text")):
                ids, offs = with_end(ids, offs, end_id)
                raw, edges = memoryview(ids.tobytes()), (offs * 4).tolist()
                for doc, begin, end in zip(batch.column("doc_id").slice(i, j - i).to_pylist(), edges, edges[1:]):
                    for k, a in enumerate(range(begin, end, width)):
                        cut = raw[a : min(a + width, end)]
                        rows.append((doc, k, (a - begin) // 4, len(cut) // 4, zlib.crc32(cut)))
                if len(rows) >= MOST:
                    yield packed()
        yield packed()

    pieces = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(local, PIECES), "pieces")
    under = pieces.where((F.col("offset") == 0) & (F.col("fill") < capacity - slack)).select("bin", "fill")
    moved = merge_bins(under, capacity)
    return pieces.join(moved, "bin", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def merge_bins(items: DataFrame, capacity: int, most: int = MOST, fan_in: int = 8, saving: float = 0.002) -> DataFrame:
    """Best-fit rounds over underfull bins (bin, fill): where each goes, as bin, into, base (tokens before it there)."""

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("into")
        ids, sizes = table.column("into").to_numpy(), table.column("fill").to_numpy()
        bins, offsets, fills = best_fit(sizes, capacity)
        lead = np.zeros(len(fills), np.int64)
        lead[bins[offsets == 0]] = ids[offsets == 0]  # a merged bin takes the id of its first item
        return pa.table({"into": ids, "next": lead[bins], "more": offsets, "fill": fills[bins]})

    moved = staged(items.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("base"), "fill"), "moved")
    # items of the present round: a bin that heads its sequence
    head = (F.col("base") == 0) & (F.col("bin") == F.col("into"))
    n = moved.count()
    groups = max(1, -(-n // max(1, most // fan_in)))
    for step in range(12):
        if n < 2:
            break
        key = F.pmod(F.xxhash64("into", F.lit(step)), F.lit(groups))
        rounds = moved.where(head).select("into", "fill", key.alias("key")).groupBy("key").applyInArrow(fit, "into long, next long, more long, fill long")
        moved = staged(moved.select("bin", "into", "base").join(rounds, "into").select("bin", F.col("next").alias("into"), (F.col("base") + F.col("more")).alias("base"), "fill"), "moved")
        left = moved.where(head).count()
        if groups == 1 or (left > most and n - left < saving * n):
            break
        n, groups = left, max(-(-left // most), groups // fan_in)
    return moved.select("bin", "into", "base")
