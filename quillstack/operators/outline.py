"""Outlines: numbered rooms, printed tables of contents, levels, chunks of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import extract, strip
from . import trees

#: A keyed room is a letter and number, letters and a number apart, or a single letter; leaders of printed
#: tables of contents are dots, ellipses or dots apart.
ROOM_PATTERNS = (r"^([A-Z]\d+)(?:[.\-)\s]|$)", r"^([A-Z]+\s+\d+)(?:[.\-)\s]|$)", r"^([A-Z])(?:[.\-)\s]|$)")
LEADER = r"(?:\.{3,}|[…]{2,}|(?:\s\.){3,})"
TOC_PATTERNS = (rf"^\s*(.+?){LEADER}\s*(\d{{1,4}})\s*$", r"^\s*(.+?\S)\s{3,}(\d{1,4})\s*$", r"^\s*(\d+[.:;]\s+\S.*?\S)\s+(\d{1,4})\s*$")


def keyed_room(name: Column, longest: int = 40) -> Column:
    """The key of a room's name without spaces (``A1``, ``GT1``, ``B``), null for other names and long ones."""
    s = strip(name)
    key = F.coalesce(*[extract(s, p) for p in ROOM_PATTERNS])
    return F.when(F.length(s) < longest, F.regexp_replace(key, r"\s+", ""))


def toc_line(line: Column) -> Column:
    """A struct of title and page of a line of a printed table of contents: leaders, wide spaces, or a chapter number."""
    found = None
    for p in TOC_PATTERNS:
        title = F.regexp_replace(F.regexp_extract(line, p, 1), r"^[ .…–—-]+|[ .…–—-]+$", "")
        entry = F.when(title != "", F.struct(title.alias("title"), F.regexp_extract(line, p, 2).cast("int").alias("page")))
        found = F.when(line.rlike(p), entry) if found is None else found.when(line.rlike(p), entry)
    return found


def toc_pairs(lines: DataFrame, doc: str, order: str, line: str, pages: int, shortest: int = 3) -> DataFrame:
    """doc, title and page of title lines followed by a bare page number; a number is never a title, so pairs don't overlap."""
    s = strip(F.col(line))
    nxt = F.lead(s).over(Window.partitionBy(doc).orderBy(order))
    rows = lines.select(doc, order, s.alias("title"), nxt.alias("next"))
    ok = (F.length("title") >= shortest) & ~F.col("title").rlike(r"^\d+$") & F.col("next").rlike(r"^\d+$")
    return rows.where(ok).select(doc, order, "title", F.col("next").try_cast("int").alias("page")).where(F.col("page").between(1, pages))


def common_level(rows: DataFrame, doc: str, order: str, level: str) -> DataFrame:
    """The most frequent level of each document; of ties the one seen first."""
    counts = rows.groupBy(doc, level).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"))
    return counts.groupBy(doc).agg(F.max_by(level, F.struct(F.col("n"), -F.col("at"))).alias("common"), F.sum("n").alias("rooms"))


def level_rooms(rows: DataFrame, room: Column, doc: str, order: str, level: str, least: int = 5) -> DataFrame:
    """new_level: rooms within one of their document's common level move to it, where there are ``least`` such rooms."""
    marked = rows.withColumn("room", F.coalesce(room, F.lit(False)))
    modes = common_level(marked.where("room"), doc, order, level).where(F.col("rooms") >= least)
    both = marked.join(modes, doc, "left")
    near = F.col("room") & (F.abs(F.col(level) - F.col("common")) <= 1)
    tight = F.count_if(near).over(Window.partitionBy(doc))
    return both.withColumn("new_level", F.when(near & (tight >= least), F.col("common")).otherwise(F.col(level))).drop("room", "common", "rooms")


def interrupted(rows: DataFrame, doc: str, order: str, level: str, series: str, room_level: int) -> DataFrame:
    """doc and series of the room series with a shallower row between two of their members.

    The members of a series are followed by the count of shallower rows so far: it rises between two of them.
    """
    upto = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("shallow", F.sum(F.when(F.col(level) < room_level, 1).otherwise(0)).over(upto))
    members = counted.where((F.col(level) == room_level) & F.col(series).isNotNull())
    return members.groupBy(doc, series).agg(F.min("shallow").alias("lo"), F.max("shallow").alias("hi")).where("lo < hi").select(doc, series)


def longest_names(rows: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Of rows with one key the one of the longest name, the first of ties."""
    own = Window.partitionBy(*keys).orderBy(F.desc(F.length(name)), order)
    return rows.withColumn("nth", F.row_number().over(own)).where("nth = 1").drop("nth")


def toc_preview(rows: DataFrame, doc: str, order: str, level: str, name: str) -> DataFrame:
    """doc, chapter, name and headers: chapters are rows of level 1, headers those of level 2 after them, in order."""
    upto = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("chapter", F.sum(F.when(F.col(level) == 1, 1).otherwise(0)).over(upto)).where("chapter > 0")
    header = F.when(F.col(level) == 2, F.struct(order, F.col(name).alias("header")))
    return own.groupBy(doc, "chapter").agg(F.min_by(name, order).alias("name"), F.transform(F.array_sort(F.collect_list(header)), lambda h: h["header"]).alias("headers"))


def demote_chapters(rows: DataFrame, chosen: Column, doc: str, order: str, level: str) -> DataFrame:
    """Chapters (rows of level 1) for which ``chosen`` holds become headers of the chapter before; a document's first chapter
    stays. The rows below them follow, as chapters reach to the next one."""
    earlier = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    has = F.coalesce(F.max(F.col(level) == 1).over(earlier), F.lit(False))
    return rows.withColumn(level, F.when((F.col(level) == 1) & F.coalesce(chosen, F.lit(False)) & has, F.lit(2).cast(rows.schema[level].dataType)).otherwise(F.col(level)))


def build_toc(nodes: DataFrame) -> DataFrame:
    """From nodes of nested documents: each top section with its named child sections, less those of its own name."""
    tops = nodes.where("depth = 0 and type = 'section'").select("doc_id", F.col("ord").alias("at"), F.col("node_id").alias("top"), F.coalesce("name", F.lit("Untitled")).alias("chapter"))
    children = nodes.where("type in ('entries', 'section') and coalesce(name, '') <> ''").select("doc_id", "ord", F.col("parent_id").alias("top"), "name")
    both = tops.join(children, ["doc_id", "top"], "left")
    header = F.when(F.lower(F.trim("name")) != F.lower(F.trim("chapter")), F.struct("ord", "name"))
    return both.groupBy("doc_id", "at", "chapter").agg(F.transform(F.array_sort(F.collect_list(header)), lambda h: h["name"]).alias("headers"))


def split_oversized(nodes: DataFrame, limit: int) -> DataFrame:
    """From nodes (doc_id, ord, parent, size, own): the chunks of each document, as ord and is_stub.

    A node within ``limit``, or without children, is a chunk; a larger one gives its own text (if any) as a stub and
    leaves the rest to its children, however deep. A parent comes before its children.
    """
    parents = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("ord")).distinct().withColumn("inner", F.lit(True))
    known = nodes.join(parents, ["doc_id", "ord"], "left").withColumn("open", (F.col("size") > limit) & F.coalesce("inner", F.lit(False)))
    out = trees.reached(known, "doc_id", "ord", "parent", "open").where("reached")
    return out.where("not open or own > 0").select("doc_id", "ord", F.col("open").alias("is_stub"))


def children_lists(rows: DataFrame, doc: str, order: str, parent: str, name: str) -> DataFrame:
    """The tree's edges as ordered lists: doc, parent and the names of its children."""
    return rows.groupBy(doc, parent).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(name).alias("name")))), lambda x: x["name"]).alias("children"))


def repaired_tags(text: Column, known: list[str]) -> Column:
    """Tags ``{@kind a|b}`` of kinds that aren't known are replaced by their last part."""
    kinds = "|".join(known)
    return F.regexp_replace(text, rf"\{{@(?!(?:{kinds})\b)\w+\s+(?:[^{{}}|]*\|)*\s*([^{{}}|]*?)\s*\}}", "$1")


def same_shape(left: DataFrame, right: DataFrame, doc: str, order: str, kind: str) -> DataFrame:
    """Whether two ordered lists of a document have equal lengths and kinds."""
    shape = lambda d, n: d.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, kind))), lambda x: x[kind]).alias(n))
    return shape(left, "l").join(shape(right, "r"), doc, "full_outer").select(doc, F.coalesce(F.col("l") == F.col("r"), F.lit(False)).alias("same"))


def replace_places(base: DataFrame, patch: DataFrame, doc: str, pos: str, columns: list[str]) -> DataFrame:
    """``base`` with the rows of ``patch`` in their places; places past its end are added."""
    both = base.alias("b").join(patch.alias("p"), [doc, pos], "full_outer")
    return both.select(doc, pos, *[F.coalesce(f"p.{c}", f"b.{c}").alias(c) for c in columns])
