"""Counts over the catalog: facets, options, statistics of topics, tags that occur together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import current, visible

DIMENSIONS = ("publisher", "game_system", "series")


def long_form(books: DataFrame, dimensions=DIMENSIONS, tags: bool = True) -> DataFrame:
    """dim and value: a row for each non-empty value of each dimension, and for each occurrence of a tag."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dimensions])
    if tags:
        pairs = F.concat(pairs, F.transform(F.coalesce("tags", F.array()), lambda t: F.struct(F.lit("tag").alias("dim"), t.alias("value"))))
    return books.select("id", F.explode(pairs).alias("x")).select("id", "x.dim", "x.value").where("value is not null and value <> ''")


def facets(books: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """dim, value, n of the rows given, in one pass."""
    return long_form(books, dimensions).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


def top_per_dimension(counts: DataFrame, most: dict[str, int], other: int) -> DataFrame:
    """The first values of each dimension: larger counts first, then by value."""
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "value"))
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in most.items() for x in kv])[F.col("dim")], F.lit(other)) if most else F.lit(other)
    return counts.withColumn("place", rank).where(F.col("place") <= limit)


def filter_options(books: DataFrame) -> DataFrame:
    return facets(books.where(current()))


def library_stats(books: DataFrame) -> DataFrame:
    """total, enriched, drafts, duplicates and pages of the current rows."""
    return books.where(current()).agg(
        F.count(F.lit(1)).alias("total"), F.count("date_enriched").alias("enriched"), F.count_if("is_draft").alias("drafts"), F.count_if("is_duplicate").alias("duplicates"), F.sum("page_count").alias("pages")
    )


def stats_by(books: DataFrame, columns: tuple[str, ...] = ("source", "product_type")) -> DataFrame:
    """dim, value and n of the current rows by each of the columns, rows without a value left out."""
    return facets(books.where(current()), columns).where(F.col("dim") != "tag")


def vocabulary_counts(books: DataFrame, words: DataFrame) -> DataFrame:
    """The ``words`` (tag) that visible books have, and how many have them."""
    live = books.where(visible()).select("id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return words.select("tag").distinct().join(live, "tag")


def tag_systems(books: DataFrame, most: int = 5, column: str = "game_system") -> DataFrame:
    """For each tag the systems with most visible rows that have it: tag, topic, n, place."""
    rows = books.where(visible() & F.col(column).isNotNull()).select(F.col(column).alias("topic"), F.explode(F.array_distinct("tags")).alias("tag"))
    counts = rows.groupBy("tag", "topic").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "topic"))).where(F.col("place") <= most)


def topic_stats(books: DataFrame, topic: str, name: str, most: int = 10, tags: int = 15) -> DataFrame:
    """The breakdown of a topic's visible rows; its own dimension is left out; dim ``total`` and ``enriched`` have counts."""
    test = F.array_contains("tags", name) if topic == "tag" else F.col(topic) == name
    rows = books.where(visible() & test)
    parts = facets(rows).where(F.col("dim") != topic)
    top = top_per_dimension(parts, {"tag": tags}, most).select("dim", "value", "n")
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.count("date_enriched").alias("enriched"))
    return top.unionByName(total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.lit("").alias("value"), F.col(c).alias("n")) for c in ("total", "enriched")])).alias("x")).select("x.*"))


def top_topics(books: DataFrame, column: str, most: int, written: DataFrame | None = None) -> DataFrame:
    """The largest topics; those of ``written`` (name) are taken out after the limit."""
    top = books.where(visible() & (F.coalesce(column, F.lit("")) != "")).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)
    return top if written is None else top.join(written, "name", "left_anti")


def at_least(books: DataFrame, column: str, least: int) -> DataFrame:
    return books.where(visible()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def tag_cooccurrence(books: DataFrame, most: int = 8) -> DataFrame:
    """For each tag the tags that share most rows with it: tag, other, n, place.

    Pairs are made within a row's own tags, so their number is that of the rows times the square of a row's tags.
    """
    own = books.where(visible()).select(F.array_distinct("tags").alias("tags"))
    pairs = own.select(F.explode("tags").alias("tag"), "tags").select("tag", F.explode("tags").alias("other")).where("tag <> other")
    counts = pairs.groupBy("tag", "other").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "other"))).where(F.col("place") <= most)


def top_tags_by(books: DataFrame, column: str, most: int = 5) -> DataFrame:
    rows = books.where(visible()).select(F.col(column).alias("topic"), F.explode("tags").alias("tag")).where("topic is not null")
    counts = rows.groupBy("topic", "tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "tag"))).where(F.col("place") <= most)


def series_info(books: DataFrame) -> DataFrame:
    """Of each series its rows, and the system and publisher of the row of smallest id."""
    return books.where(visible() & F.col("series").isNotNull()).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min_by("game_system", "id").alias("game_system"), F.min_by("publisher", "id").alias("publisher"))


def sample_of_topic(books: DataFrame, test: Column, most: int = 20) -> DataFrame:
    return books.where(visible() & test).orderBy(F.col("page_count").desc_nulls_last(), "id").limit(most)
