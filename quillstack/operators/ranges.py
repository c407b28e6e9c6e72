"""Interval tables: long form of matrix sheets, and lookups of a roll in a cell's ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import number_cell, range_cell, right_of_slash


def unpivot_matrix(sheet: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """label, cell, lo, hi and ord of each cell of a sheet that holds a range; ord is the row's place (column ``ord``)."""
    long = sheet.unpivot([label, "ord"], columns, "cell", "text")
    return long.withColumn("r", range_cell(F.col("text"))).where("r is not null").select(F.col(label).alias("bucket"), "cell", "r.lo", "r.hi", "ord")


def lookup(rolls: DataFrame, ranges: DataFrame, keys: list[str], roll: str = "roll") -> DataFrame:
    """``rolls`` with the bucket of ``ranges`` (keys, bucket, lo, hi, ord) that holds the roll; the first in order where
    several do, null where none does, or where a key is null. The cell is an equality key, the range a condition within
    it; each different roll of a cell is looked up once."""
    distinct = rolls.select(*keys, roll).distinct()
    held = distinct.join(ranges, keys).where(F.col(roll).between(F.col("lo"), F.col("hi")))
    found = held.groupBy(*keys, roll).agg(F.min_by("bucket", "ord").alias("bucket"))
    return rolls.join(found, [*keys, roll], "left").select(*rolls.columns, "bucket")


def blocks_of_sheet(sheet: DataFrame, label: str, order: str = "ord", marker: str = "FAILURE") -> DataFrame:
    """``sheet`` with ``failed``: whether a row stands below the marker row, which is left out like rows without a label."""
    is_marker = F.upper(F.trim(F.col(label))) == marker
    # the first marker of a sheet, not a window over all of it
    first = sheet.where(is_marker).agg(F.min(order).alias("__at"))
    both = sheet.where(F.col(label).isNotNull() & ~is_marker).crossJoin(F.broadcast(first))  # one row
    return both.withColumn("failed", F.coalesce(F.col(order) > F.col("__at"), F.lit(False))).drop("__at")


def dc_long(sheet: DataFrame, keys: list[str], plain: list[str], combined: list[str], ranks: list[str]) -> DataFrame:
    """keys, rank, dc and dc_other of a sheet with a column a rank of plain numbers and one of pairs such as ``15 / 18``, of
    which the right side counts."""
    cells = F.array(*[F.struct(F.lit(r).alias("rank"), number_cell(F.col(p)).alias("dc"), right_of_slash(F.col(c)).alias("dc_other")) for r, p, c in zip(ranks, plain, combined, strict=True)])
    return sheet.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")


def attempt(rolls: DataFrame, targets: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Whether total reaches the target (dc) of its cell, and the result of the table for success or failure."""
    aimed = rolls.join(targets, keys, "left").withColumn("success", F.col("total") >= F.col("dc"))
    margin = F.abs(F.col("total") - F.col("dc"))
    keyed = aimed.withColumn("outcome", F.when(F.col("success"), "success").when(~F.col("success"), "failure")).withColumn("roll", margin)
    return lookup(keyed, results, ["outcome"], "roll").drop("outcome").withColumnRenamed("roll", "margin")
