"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """For ``edges`` (a, b): node and label, the smallest node that it is linked with; only nodes that aren't their label.

    A round replaces each node's links by links to its smallest neighbour; all work is by joins and partial minima, so a
    node with very many links isn't gathered in one place.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(low, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")).union(low)
        now = staged(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = state
