"""Markdown pages of the catalog's topics, each with a head of fields and lines of links: systems, tags, series, and a home page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import wikilink
from . import facets
from .search import visible


def page(kind: str, name: Column, count: Column, title: Column, lines: list[tuple[str, Column]], fields: list[tuple[str, Column]] = ()) -> Column:
    """The text of a page; lines without links and fields without a value are left out."""
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    head = [F.lit(f"---\ntype: {kind}\nname: "), quoted(name), F.lit("\nbook_count: "), count.cast("string")]
    more = [F.coalesce(F.concat(F.lit(f"\n{n}: "), quoted(v)), F.lit("")) for n, v in fields]
    body = [F.when(F.size(links) > 0, F.concat(F.lit(f"**{label}:** "), F.array_join(links, " · "), F.lit("\n\n"))).otherwise(F.lit("")) for label, links in lines]
    return F.concat(*head, *more, F.lit("\n---\n\n# "), title, F.lit("\n\n"), *body)


def _links(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """by and links: the values of each in order, as links; ``rows`` hold a bounded number of each."""
    lists = rows.groupBy(F.col(by).alias("name")).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("v"))
    return lists.select("name", F.transform("v", lambda x: wikilink(x[value])).alias("links"))


def _counts(books: DataFrame, column: str) -> DataFrame:
    return books.where(visible() & (F.coalesce(column, F.lit("")) != "")).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def _none() -> Column:
    return F.array().cast("array<string>")


def system_pages(books: DataFrame, tags: int = 5, others: int = 5) -> DataFrame:
    """name and page of each system: its top tags and the largest other systems."""
    systems = _counts(books, "game_system")
    own = _links(facets.top_tags_by(books, "game_system", tags), "topic", "tag", "place").withColumnRenamed("links", "tags")
    first = systems.orderBy(F.desc("n"), "name").limit(others + 1).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.negate("n").alias("n"), "name"))), lambda x: x["name"]).alias("largest"))
    rows = systems.join(own, "name", "left").crossJoin(F.broadcast(first))  # one row
    also = F.transform(F.slice(F.filter("largest", lambda s: s != F.col("name")), 1, others), wikilink)
    return rows.select("name", page("game_system", F.col("name"), F.col("n"), F.col("name"), [("Top tags", F.coalesce("tags", _none())), ("See also", also)]).alias("page"))


def tag_pages(books: DataFrame) -> DataFrame:
    """name and page of each tag: the systems that have most of it, and the tags that it occurs with."""
    counts = books.where(visible()).select(F.explode(F.array_distinct("tags")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    systems = _links(facets.tag_systems(books), "tag", "topic", "place").withColumnRenamed("links", "systems")
    related = _links(facets.tag_cooccurrence(books), "tag", "other", "place").withColumnRenamed("links", "related")
    rows = counts.join(systems, "name", "left").join(related, "name", "left")
    lines = [("Game systems", F.coalesce("systems", _none())), ("Related tags", F.coalesce("related", _none()))]
    return rows.select("name", page("tag", F.col("name"), F.col("n"), F.replace("name", F.lit("_"), F.lit(" ")), lines).alias("page"))


def series_pages(books: DataFrame, tags: int = 5) -> DataFrame:
    """name and page of each series: system and publisher of its first book, and its top tags."""
    info = facets.series_info(books).withColumnRenamed("series", "name")
    own = _links(facets.top_tags_by(books, "series", tags), "topic", "tag", "place").withColumnRenamed("links", "tags")
    link = lambda c: F.when(F.col(c).isNotNull(), F.array(wikilink(F.col(c)))).otherwise(_none())
    lines = [("System", link("game_system")), ("Publisher", link("publisher")), ("Tags", F.coalesce("tags", _none()))]
    fields = [("game_system", F.col("game_system")), ("publisher", F.col("publisher"))]
    return info.join(own, "name", "left").select("name", page("series", F.col("name"), F.col("n"), F.col("name"), lines, fields).alias("page"))


def home_page(books: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """One page: how many books there are, and the largest systems, tags, series and publishers with their counts."""
    most = most or {"game_system": 20, "tag": 40, "series": 20, "publisher": 20}
    live = books.where(visible())
    top = facets.top_per_dimension(facets.facets(live, ("game_system", "series", "publisher")), most, 0)
    lists = top.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("v"))
    text = lists.select("dim", F.array_join(F.transform("v", lambda x: F.concat(wikilink(x["value"]), F.lit(" ("), x["n"].cast("string"), F.lit(")"))), " · ").alias("line"))
    parts = text.agg(F.map_from_entries(F.collect_list(F.struct("dim", "line"))).alias("m"))
    total = live.agg(F.count(F.lit(1)).alias("n"), F.count("date_enriched").alias("done"))
    part = lambda title, dim: F.concat(F.lit(f"\n\n## {title}\n\n"), F.coalesce(F.try_element_at("m", F.lit(dim)), F.lit("")))
    body = F.concat(F.lit("---\ntype: home\n---\n\n**"), F.col("n").cast("string"), F.lit(" books** · **"), F.col("done").cast("string"), F.lit(" enriched**"), *[part(t, c) for t, c in (("Game systems", "game_system"), ("Tags", "tag"), ("Series", "series"), ("Publishers", "publisher"))])
    return parts.crossJoin(total).select(F.lit("home").alias("name"), body.alias("page"))  # a row each
