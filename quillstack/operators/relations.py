"""Similarity of tag sets: pairs, top-k relations, related rows, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import setjoin
from .search import visible


def _tagged(books: DataFrame) -> DataFrame:
    return books.where(visible()).select("id", F.array_distinct(F.filter("tags", lambda t: t.isNotNull())).alias("tags")).where(F.size("tags") > 0)


def jaccard_relations(books: DataFrame, min_score: float = 0.1, top_k: int = 10, most_common: int | None = None) -> DataFrame:
    """a, b, score, shared, place, in both directions, the top k of each a.

    All tags count, however common, by an exact top-k set join. With ``most_common``, shared tags count only where at most so
    many rows have them (a catalog's cut, 500 in the usual one); set sizes count all tags.
    """
    own = _tagged(books)
    if most_common is None:
        return setjoin.top_k(own, own, top_k, min_score).select("a", "b", "score", "shared", "place")
    tagged = own.select("id", F.size("tags").alias("size"), F.explode("tags").alias("tag"))
    # common tags are at most one of ``most_common`` rows of tags, and never shuffled with their rows; tags that one row has make no pair
    common = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_common).select("tag")
    kept = tagged.join(F.broadcast(common), "tag", "left_anti")
    left, right = kept.select("tag", F.col("id").alias("a"), F.col("size").alias("na")), kept.select("tag", F.col("id").alias("b"), F.col("size").alias("nb"))
    pairs = left.join(right, "tag").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    scored = pairs.withColumn("score", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.col("score") >= min_score)
    both = scored.select("a", "b", "score", "shared").union(scored.select("b", "a", "score", "shared"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("place") <= top_k)


def related(relations: DataFrame, books: DataFrame, most: int = 6) -> DataFrame:
    """For each a its best visible relations."""
    seen = relations.join(books.where(visible()).select(F.col("id").alias("b"), "display_title"), "b")
    return seen.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("nth") <= most).select("a", "b", "display_title", "score", "nth")


def related_by_tags(books: DataFrame, of: DataFrame, most: int = 6, boost: int = 10) -> DataFrame:
    """For each row of ``of`` the visible others that share most tags; the same series adds ``boost``.

    Those of any series come from a top-k join of the tags, those of the own series from one of the tags within it, filled up with the
    first of the series that share no tag; so no list of a common tag or series is expanded into its pairs.
    """
    seen, own = _tagged(books), of.select("id", F.array_distinct(F.filter("tags", lambda t: t.isNotNull())).alias("tags")).where(F.size("tags") > 0)
    far = setjoin.top_k(own, seen, most, 1.0, "shared").select("a", "b", F.col("shared").alias("weight"))
    series = books.select("id", "series").where("series is not null")
    of_series = of.select("id", "series").where("series is not null")
    inside = lambda rows, named: rows.join(named, "id").select("id", F.transform("tags", lambda t: F.concat_ws("\u0001", "series", t)).alias("tags"))
    near = setjoin.top_k(inside(own, of_series), inside(seen, series), most, 1.0, "shared").select("a", "b", (F.col("shared") + boost).alias("weight"))
    heads = books.where(visible() & F.col("series").isNotNull()).select("series", F.col("id").alias("b"))
    heads = heads.withColumn("nth", F.row_number().over(Window.partitionBy("series").orderBy("b"))).where(F.col("nth") <= 2 * most + 1).select("series", "b")
    # weights of those already found are higher, and the greatest counts
    filled = of_series.select(F.col("id").alias("a"), "series").join(heads, "series").where("a <> b").select("a", "b", F.lit(boost).cast("long").alias("weight"))
    scores = far.unionByName(near).unionByName(filled).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    return scores.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))).where(F.col("nth") <= most)


def graph(relations: DataFrame, books: DataFrame, min_score: float = 0.25, most_nodes: int = 300, systems: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, degree) and edges (a, b, score): the best edges, their most linked nodes, the edges among those."""
    edges = relations.where((F.col("a") < F.col("b")) & (F.col("score") >= min_score))
    if systems:
        inside = books.where(F.col("game_system").isin(systems)).select("id")
        edges = edges.join(inside, edges["a"] == inside["id"], "left_semi").join(inside, edges["b"] == inside["id"], "left_semi")
    edges = edges.orderBy(F.desc("score"), "a", "b").limit(3 * most_nodes).select("a", "b", "score")
    nodes = degrees(edges).orderBy(F.desc("degree"), "id").limit(most_nodes)
    kept = edges.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    return nodes, kept.select("a", "b", "score")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
