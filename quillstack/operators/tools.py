"""The catalog's tool functions: seven requests as they are asked from outside, with their defaults and limits, as DataFrames.

Empty arguments don't filter. Limits are those of the surface: 100 rows of a page, 20 related rows, 200 rows of a tag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TIERS
from . import facets, relations, search

# fixed values: the limits of the surface
PAGE_LIMIT, RELATED_LIMIT, TAG_LIMIT = 100, 20, 200
TOPICS = ("game_system", "tag", "series", "publisher")
_TEXT = ("display_title", "description", "tags", "publisher", "series")


def _asked(books: DataFrame, query: str, title: str, equal: dict[str, str], tags: str, levels: tuple[int | None, int | None], include_old: bool) -> DataFrame:
    have = set(books.columns)
    spec = search.SearchSpec(
        q="", equal={c: v for c, v in equal.items() if v and c in have}, tags=[t.strip() for t in tags.split(",") if t.strip()], level_min=levels[0], level_max=levels[1], include_old=include_old,
    )
    rows = books.where(search.predicate(spec))
    if any(v and c not in have for c, v in equal.items()):
        rows = rows.limit(0)
    if query:
        text = F.concat_ws("\n", *[F.array_join(c, "\n") if c == "tags" else F.col(c).cast("string") for c in _TEXT if c in have])
        rows = rows.where(text.ilike(f"%{query}%"))
    if title:
        name = F.concat_ws("\n", *[c for c in ("display_title", "filename") if c in have])
        rows = rows.where(name.ilike(f"%{title}%"))
    return rows


def search_books(books: DataFrame, query: str = "", title_query: str = "", game_system: str = "", product_type: str = "", publisher: str = "", series: str = "", tags: str = "", tier: int = 0, char_level: int = 0, sort: str = "", sort_dir: str = "asc", include_old: bool = False, page: int = 1, per_page: int = 20) -> DataFrame:
    """A page of summaries in order, each row with total, page, per_page (100 at most) and total_pages. A tier outranks a level."""
    per_page, page = max(1, min(per_page, PAGE_LIMIT)), max(1, page)
    levels = TIERS[tier] if tier in TIERS else (char_level, char_level) if char_level else (None, None)
    found = _asked(books, query, title_query, {"game_system": game_system, "product_type": product_type, "publisher": publisher, "series": series}, tags, levels, include_old)
    order = search.order_of(search.SearchSpec(sort=sort or "title", descending=sort_dir == "desc"))
    rows = found.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    facts = total.select("total", F.lit(page).alias("page"), F.lit(per_page).alias("per_page"), F.ceil(F.col("total") / per_page).alias("total_pages"))
    return search.summaries(rows).crossJoin(F.broadcast(facts))  # one row of facts


def get_book(books: DataFrame, bookmarks: DataFrame, book_id: int) -> DataFrame:
    """The whole row of a book with its bookmarks nested; no row where there is none."""
    return search.detail(books.where(F.col("id") == book_id), bookmarks.where(F.col("book_id") == book_id))


def get_topic(books: DataFrame, topic_type: str, topic_name: str) -> tuple[DataFrame, DataFrame]:
    """The statistics of a topic and the summaries of its books by title."""
    if topic_type not in TOPICS:
        raise ValueError(f"topic_type must be one of {', '.join(TOPICS)}")
    test = F.array_contains("tags", topic_name) if topic_type == "tag" else F.col(topic_type) == topic_name
    rows = books.where(search.visible() & test)
    return facets.topic_stats(books, topic_type, topic_name), search.summaries(rows.orderBy("display_title", "id"))


def get_related_books(books: DataFrame, stored: DataFrame, book_id: int, limit: int = 8) -> DataFrame:
    """Summaries of the books most like one, 20 at most, by the ``stored`` relations (a, b, score); where it has none, by shared tags
    and series."""
    limit = max(0, min(limit, RELATED_LIMIT))
    own = stored.where(F.col("a") == book_id).join(books.where(search.visible()).select(F.col("id").alias("b")), "b", "left_semi")
    if own.isEmpty():
        near = relations.related_by_tags(books, books.where(F.col("id") == book_id), limit).select(F.col("b").alias("id"), F.col("weight").cast("double").alias("score"))
    else:
        near = own.orderBy(F.desc("score"), "b").limit(limit).select(F.col("b").alias("id"), "score")
    return search.summaries(books.join(near, "id", "left_semi")).join(near, "id").orderBy(F.desc("score"), "id")


def list_filters(books: DataFrame) -> DataFrame:
    """dim, value and n of what searches can filter by."""
    return facets.filter_options(books)


def get_stats(books: DataFrame) -> DataFrame:
    return facets.library_stats(books)


def find_books_by_tag(books: DataFrame, tag: str, limit: int = 30) -> DataFrame:
    """Summaries of the visible books that have a tag, by title, 200 at most."""
    rows = books.where(search.visible() & F.array_contains("tags", tag))
    return search.summaries(rows.orderBy(*search.order_of(search.SearchSpec())).limit(max(0, min(limit, TAG_LIMIT))))
