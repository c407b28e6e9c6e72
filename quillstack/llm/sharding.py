"""Sharding by histogram sort: exact byte counts below probes, refined until the splitters meet the tolerance.

Rows are ordered by a 128-bit key written as 32 hexadecimal digits: a hash of the text, then a hash of the row, so that
equal texts lie together and a large group of them can still be cut. Round by round, bytes and rows are counted exactly
between probes (key prefixes); only cells that hold a splitter further off than the tolerance, or too many rows, get
finer probes. Then one exchange, by cell, numbers the rows. Law: shard sizes in bytes are near equal.

Only DataFrame functions are used. The driver sees counts of cells: ``16 ** digits`` for each splitter and round, and 16
for each 4 million rows at most.

Defined cases: a null text has no bytes (size 8, checksum 0); rows that agree in all of doc_id and text have one key and
stay in one shard; an empty table gives an empty table; other columns are dropped by :func:`document_sizes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

KEY_DIGITS = 32


def document_sizes(docs: DataFrame, overhead: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes and ``overhead``), text_crc32 and the sort key of each document."""
    text = F.coalesce("text", F.lit(""))
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.concat(hexed(F.xxhash64(text)), hexed(F.xxhash64(F.lit(1), "doc_id", text))).alias("key"),
    )


class Cells:
    """Counted cells of the key space: prefix to (bytes, rows), in key order; ``split`` holds refined prefixes: of one
    length, by so many digits."""

    def __init__(self):
        self.found: dict[str, tuple[int, int]] = {}
        self.split: list[tuple[int, int, list[str]]] = []

    def edges(self, shards: int) -> tuple[list[tuple[str, float]], int]:
        """For each splitter the first prefix above it and its distance to the target in bytes; the bytes in all."""
        total, below, out = sum(b for b, _ in self.found.values()), 0, []
        targets = [total * s / shards for s in range(1, shards)]
        for prefix in sorted(self.found):
            size = self.found[prefix][0]
            while len(out) < len(targets) and targets[len(out)] <= below + size:
                t = targets[len(out)]
                # the nearer edge of the cell that holds the target
                out.append((prefix, t - below) if t - below <= below + size - t else (prefix + "~", below + size - t))
            below += size
        return out, total


def leaf_of(key: Column, cells: Cells, digits: int) -> Column:
    """The prefix of ``key`` that is a leaf cell."""
    leaf = F.substring(key, 1, digits)
    for length, more, split in cells.split:
        leaf = F.when(F.substring(key, 1, length).isin(split), F.substring(key, 1, length + more)).otherwise(leaf)
    return leaf


def find_splitters(rows: DataFrame, shards: int, tolerance: float = 0.001, most_rows: int = 4_000_000, digits: int = 3) -> tuple[list[str], Cells]:
    """Splitters for ``rows`` (key, size): shard s + 1 begins at splitter s. ``tolerance`` is a share of a shard.

    Cells that hold a splitter are refined by ``digits``, at most ``shards`` of them in a round; cells of more than
    ``most_rows`` rows, which one task would number, by one digit: 16 cells for each.
    """
    cells = Cells()

    def count(part: DataFrame, length: int) -> None:
        counted = part.groupBy(F.substring("key", 1, length).alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        cells.found.update({r["cell"]: (int(r["bytes"]), int(r["rows"])) for r in counted.collect()})

    count(rows, digits)
    while True:
        edges, total = cells.edges(shards)
        more = {p: 1 for p, (_, n) in cells.found.items() if n > most_rows}
        more |= {p.rstrip("~"): digits for p, off in edges if off > tolerance * total / shards}
        kinds: dict[tuple[int, int], list[str]] = {}
        for p, n in more.items():
            if len(p) < KEY_DIGITS:
                kinds.setdefault((len(p), min(n, KEY_DIGITS - len(p))), []).append(p)
        if not kinds:
            return [p for p, _ in edges], cells
        for (length, n), split in sorted(kinds.items()):
            cells.split.append((length, n, sorted(split)))
            for p in split:
                del cells.found[p]
            count(rows.where(F.substring("key", 1, length).isin(split)), length + n)


def shard_rows(rows: DataFrame, shards: int = 24, tolerance: float = 0.001, digits: int = 3, most_rows: int = 4_000_000) -> DataFrame:
    """``rows`` (key, size and any others) with ``shard`` and ``slot``, gapless from 0 in a shard in key order."""
    splitters, cells = find_splitters(rows, shards, tolerance, most_rows, digits)
    shard = sum(((F.col("key") >= F.lit(s)).cast("int") for s in splitters), F.lit(0))
    placed = rows.withColumn("leaf", leaf_of(F.col("key"), cells, digits)).withColumn("shard", shard)
    # one row a leaf cell and shard
    leaves = placed.groupBy("shard", "leaf").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    bases = leaves.select("shard", "leaf", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "leaf").orderBy("key")
    numbered = placed.withColumn("nth", F.row_number().over(order))
    return numbered.join(bases, ["shard", "leaf"]).withColumn("slot", F.col("base") + F.col("nth") - 1).drop("leaf", "nth", "base")


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of each document."""
    rows = staged(document_sizes(docs), "sizes")
    return shard_rows(rows, shards, tolerance).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
