"""Statistics of runs, trigger rates, splits, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, sample stddev (0 for one row), min, max and n of each key."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def delta(stats: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """The difference of the means of two keys."""
    means = lambda k, n: stats.where(F.col(key) == k).select(F.col("mean").alias(n))
    return means(first, "m0").join(means(second, "m1"), how="inner").select((F.col("m0") - F.col("m1")).alias("delta"))


def trigger_rates(rows: DataFrame, keys: list[str], hit: str, wanted: str, threshold: float = 0.5) -> DataFrame:
    """rate of ``hit`` and whether it passes: at least the threshold where wanted, below it where not."""
    rates = rows.groupBy(*keys, wanted).agg(F.avg(F.col(hit).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    return rates.withColumn("passed", F.when(F.col(wanted), F.col("rate") >= threshold).otherwise(F.col("rate") < threshold))


def stratified_split(rows: DataFrame, label: str, key: str, test_share: float = 0.4, seed: int = 42) -> DataFrame:
    """``is_test``: of each label the share asked for, at least one row, by a hash of the key.

    Rows are ranked within salted parts of a label and the parts' counts are added up, so a label that most rows have
    isn't ranked in one place.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    part = F.substring(h, 1, 3)
    hashed = rows.withColumns({"h": h, "part": part})
    counts = hashed.groupBy(label, "part").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(label).orderBy("part")
    bases = counts.select(label, "part", (F.sum("n").over(own) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy(label)).alias("total"))
    placed = hashed.withColumn("nth", F.row_number().over(Window.partitionBy(label, "part").orderBy("h", key))).join(bases, [label, "part"])
    return placed.withColumn("is_test", F.col("base") + F.col("nth") <= F.greatest(F.lit(1), F.floor(F.col("total") * test_share))).drop("h", "part", "nth", "base", "total")


def best_iteration(rows: DataFrame, iteration: str, score: str) -> DataFrame:
    """The iteration of the best score, the first of ties."""
    return rows.agg(F.max_by(iteration, F.struct(F.col(score), -F.col(iteration))).alias("best"), F.max(score).alias("score"))


def cost(chunks: DataFrame, prices: DataFrame, discount: float = 1.0) -> DataFrame:
    """tier and cost of chunks (tier, tokens_in, tokens_out) at ``prices`` (tier, price_in, price_out) a million tokens."""
    priced = chunks.where(F.col("tokens_in") > 0).join(prices, "tier")
    return priced.groupBy("tier").agg((F.sum(F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6 * discount).alias("cost"), F.count(F.lit(1)).alias("chunks"))
