"""Nested documents and headings: parents, section ends, folding, joins by place, flattening and validation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import discard, small_batches, staged
from . import trees
from .bins import sequential_bins


def _by(doc: str, order: str):
    return Window.partitionBy(doc).orderBy(order)


def parents(headings: DataFrame, doc: str = "doc_id", order: str = "ord", level: str = "level", levels: Iterable[int] | None = None) -> DataFrame:
    """parent: the nearest earlier heading that is shallower, whatever the levels are; by windows where all ``levels`` are stated."""
    return trees.nearest_shallower(headings, doc, order, level, levels=levels)


def section_ends(headings: DataFrame, last: Column, doc: str = "doc_id", order: str = "ord", level: str = "level", page: str = "page", levels: Iterable[int] | None = None) -> DataFrame:
    """end_page: the page before the next heading that is as shallow or shallower, not before the own page; else ``last``. By windows
    where all ``levels`` are stated."""
    seen = trees.next_as_shallow(headings, doc, order, level, page, "next_page", levels)
    return seen.withColumn("end_page", F.greatest(F.col(page), F.coalesce(F.col("next_page") - 1, last))).drop("next_page")


def fold_sections(rows: DataFrame, is_section: Column, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """section_no: the count of sections so far; rows before the first belong to 0."""
    upto = _by(doc, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section_no", F.sum(F.when(is_section, 1).otherwise(0)).over(upto))


def after_first(rows: DataFrame, test: Column, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """``past``: whether a row for which ``test`` holds came before."""
    before = _by(doc, order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("past", F.coalesce(F.max(test).over(before), F.lit(False)))


def dedupe_toc(rows: DataFrame, doc: str = "doc_id", order: str = "ord", title: str = "title", page: str = "page", crowd: int = 3) -> DataFrame:
    """Without exact repeats, and of pages with ``crowd`` entries or more the first entry alone."""
    once = rows.withColumn("nth", F.row_number().over(Window.partitionBy(doc, title, page).orderBy(order))).where("nth = 1").drop("nth")
    on_page = Window.partitionBy(doc, page)
    return once.withColumns({"many": F.count(F.lit(1)).over(on_page), "nth": F.row_number().over(on_page.orderBy(order))}).where((F.col("many") < crowd) | (F.col("nth") == 1)).drop("many", "nth")


def without_references(rows: DataFrame, doc: str = "doc_id", order: str = "ord", title: str = "title") -> DataFrame:
    """Without entries such as ``Name (12)`` that refer to an entry before: one of that name, with or without a number
    (``3. Name``) before it or in parentheses after it."""
    name = F.lower(F.trim(F.regexp_replace(F.regexp_replace(title, r"\s*\(\d+\)\s*$", ""), r"^\s*\d+[.:;)]\s*", "")))
    own = Window.partitionBy(doc, "__name").orderBy(order)
    named = rows.withColumn("__name", name).withColumn("__nth", F.row_number().over(own))
    return named.where((F.col("__nth") == 1) | ~F.col(title).rlike(r"\(\d+\)\s*$")).drop("__name", "__nth")


def found_titles(entries: DataFrame, heads: DataFrame, radii: tuple[int, ...] = (5, 15, 30, 60), shortest: int = 6) -> DataFrame:
    """``entries`` (doc_id, ord, title, page) with ``actual``: the page near the claimed one whose head (doc_id, page, head)
    holds the title; the smallest radius in which one does decides, then the earlier page; null where none does.

    A title meets at most the pages within the largest radius: pages are joined by band, not with all of a document.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    width = 2 * max(radii) + 1
    asked = entries.select("doc_id", "ord", "page", clean(F.col("title")).alias("t")).where(F.length("t") >= shortest)
    band = F.explode(F.sequence(F.floor((F.col("page") - max(radii)) / width), F.floor((F.col("page") + max(radii)) / width)))
    pages = heads.select("doc_id", F.col("page").alias("at"), clean(F.col("head")).alias("h")).withColumn("band", F.floor(F.col("at") / width))
    off = F.abs(F.col("at") - F.col("page"))
    ring = F.coalesce(*[F.when(off <= r, r) for r in radii])
    hits = asked.withColumn("band", band).join(pages, ["doc_id", "band"]).where((off <= max(radii)) & F.col("h").contains(F.col("t")))
    best = hits.groupBy("doc_id", "ord").agg(F.min(F.struct(ring.alias("ring"), "at")).alias("b")).select("doc_id", "ord", F.col("b.at").alias("actual"))
    return entries.join(best, ["doc_id", "ord"], "left")


def nearest_offset(rows: DataFrame, offset: Column, doc: str = "doc_id", order: str = "ord", place: str = "page") -> DataFrame:
    """used_offset: the own offset, or that of the entry nearest by place that has one (ties: the one before)."""
    known = F.when(offset.isNotNull(), F.struct(F.col(place).alias("p"), offset.alias("o")))
    w = Window.partitionBy(doc).orderBy(place, order)
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = F.when(after.isNull() | (F.col(place) - before["p"] <= after["p"] - F.col(place)), before["o"]).otherwise(F.coalesce(after["o"], before["o"]))
    return rows.withColumn("used_offset", F.coalesce(offset, near))


def positional_zip(left: DataFrame, right: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """Two ordered lists side by side by place; a side is null where its list is shorter."""
    place = lambda d, n: d.select(doc, (F.row_number().over(_by(doc, order)) - 1).alias("pos"), F.struct(*[c for c in d.columns if c != doc]).alias(n))
    return place(left, "left").join(place(right, "right"), [doc, "pos"], "full_outer")


def splice(base: DataFrame, patch: DataFrame, at: int, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """``patch`` put in at a place of each document's list; what stood there and after moves on."""
    many = patch.groupBy(doc).agg(F.count(F.lit(1)).alias("shift"))
    moved = base.join(many, doc, "left").withColumn(pos, F.when(F.col(pos) >= at, F.col(pos) + F.coalesce("shift", F.lit(0))).otherwise(F.col(pos))).drop("shift")
    put = patch.withColumn(pos, F.row_number().over(_by(doc, pos)) - 1 + at)
    return moved.unionByName(put, allowMissingColumns=True)


def chunk_bins(rows: DataFrame, size: str, limit: int, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """bin: rows in order, a new bin where the next one would go over ``limit``; a long document is cut over many tasks."""
    return sequential_bins(rows, size, limit, doc, order)


#: Lefts of a block, which are told one after another; blocks of a document are told side by side.
LEFTS = 1024


def greedy_pairs(scores: DataFrame, doc: str = "doc_id", left: str = "left_ord", right: str = "right_ord", score: str = "score", least: float = 0.3) -> DataFrame:
    """One-to-one: each left entry, in order, takes the unused right entry that scores best (ties: the earlier). ``left`` is a number.

    Every block of ``LEFTS`` lefts is told for itself, its sorted rows streamed. Where blocks of a document take the same right, the earliest
    left holds it, lefts later than that lose it, and the blocks of that document alone are told again. As all rights prefer earlier
    lefts, what is held once nothing is lost is what lefts get one after another. So rounds grow with the blocks of a document only.
    """
    now = staged(scores.where(F.col(score) >= least).withColumn("__block", F.floor(F.col(left) / LEFTS)), "greedy")
    found = []
    while True:
        order = [doc, "__block", left, F.negate(score), right]
        taken = staged(now.repartition(doc, "__block").sortWithinPartitions(*order).mapInArrow(_takes(doc, left, right), now.schema), "greedy-taken")
        held = taken.groupBy(F.col(doc).alias("d"), F.col(right).alias("r")).agg(F.min(left).alias("holder"), F.count(F.lit(1)).alias("n"))
        again = staged(held.where("n > 1").select("d").distinct(), "greedy-again")
        own = F.col(doc).eqNullSafe(F.col("d"))
        found.append(staged(taken.join(again, own, "left_anti").drop("__block"), "greedy-found"))
        if again.isEmpty():
            break
        some = now.join(again, own, "left_semi").join(held, own & (F.col(right) == F.col("r")), "left")
        rest = staged(some.where(F.col("holder").isNull() | (F.col(left) <= F.col("holder"))).select(*now.columns), "greedy")
        for table in (now, taken, again):
            discard(table)
        now = rest
    for table in (now, taken, again):
        discard(table)
    return reduce(DataFrame.unionByName, found)


def _takes(doc: str, left: str, right: str) -> Callable:
    """Of rows by document, block, left and falling score the first of each left whose right isn't used in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, used, done = None, set(), None
        for batch in batches:
            kept = []
            for i, (d, b, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in (doc, "__block", left, right)), strict=True)):
                if block != (d, b):
                    block, used, done = (d, b), set(), None
                if x != done and y not in used:
                    used.add(y)
                    done = x
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return run


#: Nodes of a frame that leaves Python: documents in a batch have many times its rows.
FRAME = 2000

NODES = "doc_id long, node_id string, parent_id string, ord int, depth int, path string, type string, name string, text string"


def node_frames(documents: Iterable[list[tuple]], frame: Callable) -> Iterator:
    """Frames of at most ``FRAME`` rows of the nodes of documents, however many nodes a batch of documents has."""
    rows: list[tuple] = []
    for nodes in documents:
        rows += nodes
        whole = len(rows) - len(rows) % FRAME
        for i in range(0, whole, FRAME):
            yield frame(rows[i : i + FRAME])
        rows = rows[whole:]
    yield frame(rows)


def flatten_documents(docs: DataFrame, doc: str = "doc_id", body: str = "body") -> DataFrame:
    """The nodes of nested entries (strings, or objects with type, name, id and entries), a row each, in reading order.

    Text that isn't JSON gives no rows. The depth of nesting is known only to the data, so a document is walked in Python.
    """

    def walk(value, parent, depth, path, out, number):
        if isinstance(value, str):
            out.append((number, None, parent, len(out), depth, path, "text", None, value))
            return
        if isinstance(value, dict):
            own = str(value.get("id") or f"n{len(out)}")
            out.append((number, own, parent, len(out), depth, path, str(value.get("type", "section")), value.get("name"), None))
            for i, e in enumerate(value.get("entries") or []):
                walk(e, own, depth + 1, f"{path}.entries[{i}]", out, number)

    def nodes(number, text) -> list[tuple]:
        out: list[tuple] = []
        try:
            data = json.loads(text) if isinstance(text, str) else None
        except ValueError:
            return out
        for i, section in enumerate((data or {}).get("data", []) if isinstance(data, dict) else []):
            walk(section, None, 0, f"data[{i}]", out, number)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODES.split(", ")]
        yield from node_frames((nodes(number, text) for pdf in batches for number, text in zip(pdf[doc], pdf[body], strict=True)), lambda rows: pd.DataFrame(rows, columns=names))

    small_batches(docs.sparkSession)
    return docs.select(doc, body).mapInPandas(run, NODES)


def validate_nodes(nodes: DataFrame) -> DataFrame:
    """doc_id, path, severity, message: sections without a name, ids that repeat, empty texts."""
    repeated = F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("ord")) > 1
    own = nodes.withColumn("repeated", F.col("node_id").isNotNull() & repeated)
    rules = [
        ((F.col("type") == "section") & (F.coalesce("name", F.lit("")) == ""), "error", "a section has no name"),
        (F.col("repeated"), "error", "an id repeats"),
        ((F.col("type") == "text") & (F.trim("text") == ""), "warning", "a text is empty"),
    ]
    found = F.filter(F.array(*[F.when(t, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for t, s, m in rules]), lambda x: x.isNotNull())
    return own.select("doc_id", "path", F.explode(found).alias("x")).select("doc_id", "path", "x.*")


def inline_tags(rows: DataFrame, text: str, known: list[str]) -> DataFrame:
    """Tags such as ``{@spell x}`` that aren't of the known kinds: key columns and tag."""
    tags = rows.select(*[c for c in rows.columns if c != text], F.explode(F.regexp_extract_all(text, F.lit(r"\{@(\w+)"), 1)).alias("tag"))
    return tags.where(~F.col("tag").isin(known))
