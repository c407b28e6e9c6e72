"""Cleaning: duplicates, fingerprints, tags, overrides, and the changes that a pass would make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_duplicates(rows: DataFrame, keys: list[str], key: str = "id") -> DataFrame:
    """Rows to be flagged: all of a group but that of the smallest id. Null and empty keys are alike."""
    same = {f"__{k}": F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys}
    keyed = rows.withColumns(same)
    # the first of each group is found by partial minima; a group that most rows are in is split in the join
    first = keyed.groupBy(*same).agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return keyed.join(first, list(same)).where(F.col(key) > F.col("__first")).select(*rows.columns)


def fingerprint(rows: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """id, fingerprint, method: SHA-256 of the ordered bookmarks, else of the first page's text, else of the name."""
    line = F.concat_ws("|", F.col("level").cast("string"), "title", F.coalesce(F.col("page_number").cast("string"), F.lit("None")))
    joined = bookmarks.groupBy(F.col("book_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("marks"))
    both = rows.join(joined, "id", "left")
    page = F.nullif("first_page_text", F.lit(""))
    method = F.when(F.col("marks").isNotNull(), "bookmarks").when(page.isNotNull(), "first_page_text").otherwise("filename")
    return both.select("id", F.sha2(F.coalesce("marks", page, "filename"), 256).alias("fingerprint"), method.alias("method"))


def coverage(prints: DataFrame) -> DataFrame:
    """rows and colliding rows (beyond the first of a fingerprint) of each method."""
    return prints.groupBy("method").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("fingerprint")).alias("collisions"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a null key is a key. Each task keeps its last rows before they are dealt out by key."""
    return _one_of(rows, keys, order, F.max_by)


def earliest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as :func:`latest` finds the last."""
    return _one_of(rows, keys, order, F.min_by)


def _one_of(rows: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(pick(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__one"))
    return one.select(*keys, "__one.*").select(*rows.columns)


def restore(prints: DataFrame, saved: DataFrame, enriched: DataFrame) -> DataFrame:
    """What saved values (fingerprint, seq, value) would be restored to rows that aren't in ``enriched`` (id)."""
    return prints.join(enriched, "id", "left_anti").join(latest(saved, ["fingerprint"], ["seq"]), "fingerprint").select("id", "fingerprint", "value")


def canonical_tags(tags: Column, canonical: list[str], aliases: dict[str, str]) -> Column:
    """Tags of the vocabulary, aliases replaced (also with spaces for underscores); others are dropped, repeats too."""
    known = F.array(*[F.lit(t) for t in canonical])
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None

    def one(tag: Column) -> Column:
        t = F.lower(F.trim(tag))
        found = F.when(F.array_contains(known, t), t)
        return found if names is None else F.coalesce(found, names[t], names[F.replace(t, F.lit("_"), F.lit(" "))])

    return F.array_distinct(F.filter(F.transform(tags, one), lambda t: t.isNotNull()))


def tag_frequency_filter(rows: DataFrame, least: int) -> DataFrame:
    """id and tags, those on fewer than ``least`` rows left out."""
    tagged = rows.select("id", F.posexplode("tags").alias("pos", "tag"))
    often = tagged.groupBy("tag").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= least).select("tag")
    kept = tagged.join(often, "tag").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("tags"))
    return rows.select("id").join(kept, "id", "left").select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def implied_tags(tags: Column, haystack: Column, rules: list[tuple[str, str]], closure: dict[str, str]) -> Column:
    """Tags and those that regular expressions over ``haystack`` imply, then one step of ``closure`` (tag to tag)."""
    added = F.filter(F.array(*[F.when(haystack.rlike(p), F.lit(t)) for p, t in rules]), lambda t: t.isNotNull())
    out = F.array_union(F.coalesce(tags, F.array().cast("array<string>")), added)
    if closure:
        step = F.create_map(*[F.lit(x) for kv in closure.items() for x in kv])
        out = F.array_union(out, F.filter(F.transform(out, lambda t: step[t]), lambda t: t.isNotNull()))
    return out


def guarded_override(rows: DataFrame, name: str, pattern: str, systems: list[str], to: str, drop: list[str], add: str) -> DataFrame:
    """The rows that change: id, game_system and tags after rows whose name matches, and whose system is listed, move to ``to``."""
    hit = rows.where(F.col(name).rlike(pattern) & F.col("game_system").isin(systems))
    return hit.select("id", F.lit(to).alias("game_system"), F.array_union(F.array_except("tags", F.array(*[F.lit(t) for t in drop])), F.array(F.lit(add))).alias("tags"))


def changes(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """id, old and new of the rows that a pass would change; writing them is another step."""
    pair = before.select("id", F.col(column).alias("old")).join(after.select("id", F.col(column).alias("new")), "id")
    return pair.where(~F.col("old").eqNullSafe(F.col("new")))


def change_histogram(changed: DataFrame) -> DataFrame:
    return changed.groupBy("new").agg(F.count(F.lit(1)).alias("n"))


def fuzzy_enum(value: Column, allowed: list[str]) -> Column:
    """The allowed value that equals, or else the first that holds or is held by, the one given; null if none does."""
    low = F.lower(F.trim(value))
    exact = F.coalesce(*[F.when(low == a.lower(), a) for a in allowed])
    part = F.coalesce(*[F.when((low != "") & (low.contains(a.lower()) | F.lit(a.lower()).contains(low)), a) for a in allowed])
    return F.coalesce(exact, part)


def validated(rows: DataFrame, kinds: list[str], fallback: str = "sourcebook", leveled: str = "adventure", doubtful: DataFrame | None = None) -> DataFrame:
    """Records (id, game_system, product_type, tags, description, min_level, max_level) made valid.

    Rows without one of the first five are left out. The type is one of ``kinds``: the one given, the first in order that
    the lower-cased type holds, or ``fallback``. Null tags become the type. Levels stay for the type ``leveled`` alone, each
    within 1 to 30; the upper one defaults to the lower. Rows of ``doubtful`` (id) get the tag low_confidence.
    """
    given = F.replace(F.lower("product_type"), F.lit(" "), F.lit("_"))
    kind = F.coalesce(*[F.when(F.col("product_type") == k, F.lit(k)) for k in kinds], *[F.when(given.contains(k), F.lit(k)) for k in kinds], F.lit(fallback))
    whole = rows.where("id is not null and game_system is not null and product_type is not null and description is not null").withColumn("product_type", kind)
    tags = F.coalesce("tags", F.array("product_type"))
    if doubtful is not None:
        whole = whole.join(doubtful.select("id").distinct().withColumn("__doubt", F.lit(True)), "id", "left")
        tags = F.when(F.col("__doubt"), F.array_union(tags, F.array(F.lit("low_confidence")))).otherwise(tags)
    lo, hi = F.col("min_level").try_cast("int"), F.coalesce("max_level", "min_level").try_cast("int")
    bound = lambda x: F.when((F.col("product_type") == leveled) & lo.isNotNull() & hi.isNotNull() & x.between(1, 30), x)
    return whole.withColumn("tags", tags).withColumns({"min_level": bound(lo), "max_level": bound(hi)}).select(*rows.columns)


def error_kinds(rows: DataFrame, message: str, markers: list[str]) -> DataFrame:
    """``known``: whether the message holds one of the markers; the two halves of a list of errors."""
    hit = F.lit(False)
    for m in markers:
        hit |= F.coalesce(F.col(message).contains(m), F.lit(False))
    return rows.withColumn("known", hit)


def numbers_added(state: DataFrame, new: DataFrame, key: str = "name", column: str = "numbers") -> DataFrame:
    """key and column of the rows of ``state`` (sorted lists of numbers) that ``new`` (key, number) changes or adds: the
    sorted union of both. Rows that stay as they are aren't written again."""
    more = new.groupBy(key).agg(F.collect_set("number").alias("__more"))
    both = more.join(state.select(key, F.col(column).alias("__old")), key, "left")
    union = F.array_sort(F.array_union(F.coalesce("__old", F.array().cast(state.schema[column].dataType)), "__more"))
    return both.select(key, "__old", union.alias(column)).where(F.col("__old").isNull() | (F.col("__old") != F.col(column))).drop("__old")
