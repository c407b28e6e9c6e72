"""Tables that the queries read, and the catalog view over ``part`` with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a catalog of titles: flags, levels and dates follow from the key, tags from the columns."""
    key, size = F.col("p_partkey"), F.col("p_size")
    low = 1 + size % 10
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_name").alias("display_title"),
        F.col("p_brand").alias("publisher"),
        F.col("p_type").alias("game_system"),
        size.alias("page_count"),
        F.when(key % 3 != 0, F.col("p_name")).alias("collection"),
        F.when(key % 5 == 0, F.concat_ws(" / ", "p_brand", "p_type")).alias("series"),
        F.concat(F.split("p_name", " "), F.array("p_brand", "p_type", F.concat(F.lit("size_"), size))).alias("tags"),
        (key % 11 == 0).alias("is_old_version"),
        (key % 13 == 0).alias("is_draft"),
        (key % 17 == 0).alias("is_duplicate"),
        low.cast("long").alias("min_level"),
        (low + key % 5).cast("long").alias("max_level"),
        F.when(key % 7 != 0, F.lit("2024-01-01")).alias("date_enriched"),
    )


BOOKS = """WITH RECURSIVE books AS (SELECT p_partkey AS id, p_name AS display_title, p_brand AS publisher, p_type AS game_system, p_size AS page_count,
 CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS collection, CASE WHEN p_partkey % 5 = 0 THEN p_brand || ' / ' || p_type END AS series,
 list_concat(string_split(p_name, ' '), [p_brand, p_type, 'size_' || p_size]) AS tags, p_partkey % 11 = 0 AS is_old_version, p_partkey % 13 = 0 AS is_draft,
 p_partkey % 17 = 0 AS is_duplicate, CAST(1 + p_size % 10 AS BIGINT) AS min_level, CAST(1 + p_size % 10 + p_partkey % 5 AS BIGINT) AS max_level,
 CASE WHEN p_partkey % 7 <> 0 THEN '2024-01-01' END AS date_enriched FROM part),
visible AS (SELECT * FROM books WHERE NOT is_old_version AND NOT is_draft AND NOT is_duplicate)
"""


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("book_id"))


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the bookmarks of the book of its key."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").cast("long").alias("ord"), (1 + F.col("l_linenumber") % 3).cast("long").alias("level"), F.col("l_returnflag").alias("title"), F.when(F.col("l_linestatus") == "O", F.col("l_partkey")).alias("page_number"))


BOOKMARKS = "(SELECT l_orderkey AS book_id, CAST(l_linenumber AS BIGINT) AS ord, CAST(1 + l_linenumber % 3 AS BIGINT) AS level, l_returnflag AS title, CASE WHEN l_linestatus = 'O' THEN l_partkey END AS page_number FROM lineitem)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: path and name from the address, size from the text."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", "/"), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"), F.length("html").cast("long").alias("size"))


FILES = "(SELECT page_id AS id, path, string_split(path, '/')[-1] AS name, CAST(length(html) AS BIGINT) AS size FROM (SELECT *, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') AS path FROM pages))"


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as headings: level from the length, page from the place."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "title"))
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), "title", (1 + F.length("title") % 4).cast("long").alias("level"), F.floor(F.col("ord") / 2).alias("page"))


HEADINGS = "headings AS (SELECT doc_id, ord, title, CAST(1 + length(title) % 4 AS BIGINT) AS level, ord // 2 AS page FROM (SELECT doc_id, CAST(unnest(range(len(t))) AS BIGINT) AS ord, unnest(t) AS title FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))"
