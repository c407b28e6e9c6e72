"""Catalog search: predicates, grouping of variants, paging, favourites, keyed state."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TIERS, group_key

#: Columns that a result can be ordered by; ``title`` stands for display_title, else the file name.
SORTABLE = {"title", "publisher", "game_system", "series", "page_count", "collection"}


@dataclass
class SearchSpec:
    """What a search asks for; empty values don't filter."""

    q: str = ""
    equal: dict[str, str] = field(default_factory=dict)
    tags: list[str] = field(default_factory=list)
    not_tags: list[str] = field(default_factory=list)
    level_min: int | None = None
    level_max: int | None = None
    tier: int | None = None
    include_old: bool = False
    include_drafts: bool = False
    include_duplicates: bool = False
    text_columns: tuple[str, ...] = ("display_title", "publisher", "collection", "game_system", "series")
    sort: str = "title"
    descending: bool = False
    page: int = 1
    per_page: int = 50


def current() -> Column:
    return ~F.col("is_old_version")


def visible(spec: SearchSpec | None = None) -> Column:
    spec = spec or SearchSpec()
    test = F.lit(True)
    for skip, flag in ((spec.include_old, "is_old_version"), (spec.include_drafts, "is_draft"), (spec.include_duplicates, "is_duplicate")):
        if not skip:
            test &= ~F.col(flag)
    return test


def level_overlap(lo: int | None, hi: int | None) -> Column:
    """Levels of a row meet those asked for; one bound alone is a single level; rows without levels don't pass."""
    lo, hi = (hi if lo is None else lo), (lo if hi is None else hi)
    return (F.col("min_level") <= hi) & (F.col("max_level") >= lo)


def predicate(spec: SearchSpec) -> Column:
    test = visible(spec)
    if spec.q:
        hit = F.lit(False)
        for c in spec.text_columns:
            hit |= F.coalesce(F.col(c).ilike(f"%{spec.q}%"), F.lit(False))
        test &= hit
    for c, value in spec.equal.items():
        if value:
            test &= F.col(c) == value
    for t in spec.tags:
        test &= F.array_contains("tags", t)
    for t in spec.not_tags:
        test &= F.col("tags").isNull() | ~F.array_contains("tags", t)
    lo, hi = TIERS[spec.tier] if spec.tier in TIERS else (spec.level_min, spec.level_max)
    if lo is not None or hi is not None:
        test &= level_overlap(lo, hi)
    return test


def order_of(spec: SearchSpec) -> list[Column]:
    name = spec.sort if spec.sort in SORTABLE else "title"
    c = F.col("display_title" if name == "title" else name)
    return [c.desc() if spec.descending else c.asc(), F.col("id").asc()]


def search(books: DataFrame, spec: SearchSpec) -> DataFrame:
    """A page of the matching rows, in order."""
    found = books.where(predicate(spec)).orderBy(*order_of(spec))
    return found.offset((spec.page - 1) * spec.per_page).limit(spec.per_page)


def search_grouped(books: DataFrame, spec: SearchSpec) -> DataFrame:
    """A page of groups of variants: the first row of each group in order, variant_count and variant_ids in order.

    Heads and counts are found for all groups, the ids of variants are gathered for those of the page alone.
    """
    keyed = books.where(predicate(spec)).withColumn("group_key", group_key(F.col("publisher"), F.col("collection"), F.col("id")))
    own = Window.partitionBy("group_key").orderBy(*order_of(spec))
    ranked = keyed.withColumn("place", F.row_number().over(own))
    page = ranked.where("place = 1").drop("place").orderBy(*order_of(spec)).offset((spec.page - 1) * spec.per_page).limit(spec.per_page)
    groups = ranked.join(page.select("group_key"), "group_key", "left_semi").groupBy("group_key").agg(F.count(F.lit(1)).alias("variant_count"), F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("variant_ids"))
    return page.join(groups, "group_key").orderBy(*order_of(spec))


def page_count(books: DataFrame, spec: SearchSpec) -> DataFrame:
    """total and pages of a search."""
    return books.where(predicate(spec)).agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / spec.per_page))


def with_favorites(books: DataFrame, favorites: DataFrame) -> DataFrame:
    """is_favorite by the ids of ``favorites`` (book_id)."""
    marks = favorites.select(F.col("book_id").alias("id")).distinct().withColumn("is_favorite", F.lit(True))
    return books.join(marks, "id", "left").withColumn("is_favorite", F.coalesce("is_favorite", F.lit(False)))


def only_favorites(books: DataFrame, favorites: DataFrame) -> DataFrame:
    return books.join(favorites.select(F.col("book_id").alias("id")), "id", "left_semi")


def by_ids(books: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """Books of a list of ids, or of a table of them (id)."""
    if isinstance(ids, DataFrame):
        return books.join(ids.select("id"), "id", "left_semi")
    return books.where(F.col("id").isin(ids))


def summaries(books: DataFrame, longest: int = 300) -> DataFrame:
    """The compact form of catalog rows: title (else the file name), tags decoded, description cut and empty as null, flags
    as booleans. Columns that the catalog hasn't are null."""
    have = set(books.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None)
    tags = books.schema["tags"].dataType.simpleString() if "tags" in have else "void"
    decoded = F.from_json("tags", "array<string>") if tags == "string" else col("tags").cast("array<string>")
    text = F.nullif(F.substring(F.coalesce(col("description").cast("string"), F.lit("")), 1, longest), F.lit(""))
    plain = [col(c).alias(c) for c in ("publisher", "game_system", "product_type", "series", "page_count")]
    flags = [F.coalesce(col(c).cast("boolean"), F.lit(False)).alias(c) for c in ("has_bookmarks", "is_favorite")]
    title = F.coalesce(F.nullif(col("display_title").cast("string"), F.lit("")), col("filename").cast("string"))
    return books.select("id", title.alias("title"), *plain, F.coalesce(decoded, F.array().cast("array<string>")).alias("tags"), text.alias("description"), *[col(c).alias(c) for c in ("min_level", "max_level")], *flags)


def tier_labels(books: DataFrame) -> DataFrame:
    """A row for each tier that the levels of a book overlap."""
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for t, (lo, hi) in TIERS.items()])
    return books.withColumn("t", F.explode(tiers)).where((F.col("min_level") <= F.col("t.hi")) & (F.col("max_level") >= F.col("t.lo"))).select("id", "t.tier")


def detail(books: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Books with their bookmarks (book_id, ord, level, title) nested in order."""
    nested = bookmarks.groupBy(F.col("book_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "level", "title"))).alias("bookmarks"))
    return books.join(nested, "id", "left")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The state after ``new`` replaces or joins ``old`` by key."""
    return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti"), allowMissingColumns=True)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone, keys, "left_anti")


def work_queue(books: DataFrame, publisher: str = "", force: bool = False, bookmarks: DataFrame | None = None, most: int | None = None, marks: int = 50) -> DataFrame:
    """Visible rows that haven't been enriched, or all with ``force``; the first ``most`` by publisher, collection and title,
    where that is given; with the first ``marks`` of their bookmarks (book_id, ord, level, title), where those are given."""
    test = visible()
    if not force:
        test &= F.col("date_enriched").isNull()
    if publisher:
        test &= F.col("publisher") == publisher
    found = books.where(test)
    if most is not None:
        found = found.orderBy("publisher", "collection", "display_title", "id").limit(most)
    if bookmarks is None:
        return found
    first = F.row_number().over(Window.partitionBy("book_id").orderBy("ord", "level", "title"))
    own = bookmarks.withColumn("nth", first).where(F.col("nth") <= marks).groupBy(F.col("book_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("nth", "level", "title"))).alias("bookmarks"))
    return found.join(own, "id", "left")


def insert_with_children(parents: DataFrame, children: DataFrame, errors: DataFrame, new: DataFrame, new_children: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after ``new`` rows and their children came in: what stood at their ``key`` is replaced, and the errors
    noted there are cleared."""
    same = new.select(key).distinct()
    renewed = lambda old, more: old.join(same, key, "left_anti").unionByName(more, allowMissingColumns=True)
    return renewed(parents, new), renewed(children, new_children), errors.join(same, key, "left_anti")


def flagged(rows: DataFrame, ids: DataFrame, flag: str, key: str = "id") -> DataFrame:
    """``rows`` with ``flag`` set for those of ``ids``; others keep theirs."""
    marks = ids.select(key).distinct().withColumn("__set", F.lit(True))
    return rows.join(marks, key, "left").withColumn(flag, F.coalesce("__set", F.col(flag))).drop("__set")


def facet_list(counts: DataFrame, text: str = "", by: str = "n", value: str = "value") -> DataFrame:
    """Values that hold ``text``, whatever the case, by falling count or by name."""
    found = counts.where(F.contains(F.lower(value), F.lit(text.lower()))) if text else counts
    return found.orderBy(F.desc("n"), value) if by == "n" else found.orderBy(F.lower(value), value)


def not_done(candidates: DataFrame, *done: DataFrame, key: str) -> DataFrame:
    """Candidates that are in none of the sets that are done."""
    for d in done:
        candidates = candidates.join(d.select(key), key, "left_anti")
    return candidates
