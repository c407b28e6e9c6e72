"""Stat blocks and tables within texts, owners of nodes, and edits of node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import extract
from . import trees
from .quality import earliest

#: How the lines of a stat block begin.
STAT_LABELS = ("Armor Class", "Hit Points", "Speed", "Saving Throws", "Skills", "Damage Resistances", "Damage Immunities", "Condition Immunities", "Senses", "Languages", "Challenge")


def stat_line(text: Column) -> Column:
    """A struct of ac, hp and cr of a line such as ``AC 15; HP 22 (4d8+4); CR 1/2``; null where it has neither AC nor HP."""
    ac, hp = (extract(text, rf"(?i)\b{p}\s*:?\s*(\d+)").try_cast("int") for p in (r"(?:AC|armor class)", r"(?:HP|hit points|hp)"))
    cr = extract(text, r"(?i)\b(?:CR|challenge)\s*:?\s*(\d+(?:/\d+)?)")
    return F.when(ac.isNotNull() | hp.isNotNull(), F.struct(ac.alias("ac"), hp.alias("hp"), cr.alias("cr")))


def stat_spans(text: Column) -> Column:
    """The spans in italics (``*AC 15; HP 22*``) that hold an AC or hit points, each as :func:`stat_line` reads it, with its
    body."""
    spans = F.regexp_extract_all(text, F.lit(r"(?<!\*)\*([^*\n]+)\*(?!\*)"), 1)
    read = F.transform(spans, lambda s: F.struct(s.alias("body"), stat_line(s).alias("stats")))
    return F.filter(read, lambda x: x["stats"].isNotNull())


def unrepeated_stats(rows: DataFrame, name: str, body: str, order: str) -> DataFrame:
    """Of rows that agree in the name, whatever its case, and the first 60 characters of the body the first."""
    keyed = rows.withColumns({"__name": F.lower(name), "__body": F.substring(body, 1, 60)})
    return earliest(keyed, ["__name", "__body"], [order]).drop("__name", "__body").select(*rows.columns)


def stat_rows(rows: DataFrame, text: str, order: str = "ord") -> DataFrame:
    """The lines of stat blocks as rows of kind, key and value: ``stat`` for lines that begin with one of the known labels,
    ``trait`` for those that begin with a title and a full stop; other lines are left out. ``order`` counts the lines."""
    lines = rows.select(*[c for c in rows.columns if c != text], F.posexplode(F.split(text, "\n")).alias(order, "line")).withColumn("line", F.trim("line"))
    label = rf"^({'|'.join(STAT_LABELS)})\s*:?\s+(.+)$"
    trait = r"^([A-Z][\w'’ ()/–-]{2,60})\.\s+(\S.*)$"
    kind = F.when(F.col("line").rlike(label), "stat").when(F.col("line").rlike(trait), "trait")
    part = lambda g: F.when(kind == "stat", F.regexp_extract("line", label, g)).otherwise(F.regexp_extract("line", trait, g))
    return lines.withColumns({"kind": kind, "key": part(1), "value": part(2)}).where("kind is not null").drop("line")


def delimiter(text: Column) -> Column:
    """The first of tab, bar, semicolon and comma that the first line holds; else two spaces or more."""
    first = F.split(text, "\n")[0]
    return F.coalesce(*[F.when(first.contains(d), F.lit(d)) for d in ("\t", "|", ";", ",")], F.lit("  "))


def sniffed_table(text: Column) -> Column:
    """Rows of cells of a text table, cut at its delimiter and padded to the width of the first row."""
    d = delimiter(text)
    pattern = F.when(d == "  ", F.lit(r"\s{2,}")).otherwise(F.concat(F.lit(r"\s*\Q"), d, F.lit(r"\E\s*")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    # a bar may also stand at both ends of a line
    rows = F.transform(lines, lambda x: F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), pattern))
    width = F.size(F.try_element_at(rows, F.lit(1)))
    return F.transform(rows, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), 1, width))


def named_ancestor(rows: DataFrame, name: Column, doc: str = "doc_id", order: str = "ord", depth: str = "depth") -> DataFrame:
    """owner: the place of the nearest ancestor that has a name. Rows are in reading order; of each depth the last row
    before is an ancestor if no shallower one came after it."""
    return trees.nearest_named(rows.withColumn("__named", name.isNotNull()), doc, order, depth, "__named").drop("__named")


def leaf_owners(nodes: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """From nodes of nested documents: nodes below the top that own a text for which ``test`` holds, with how many; and
    the orphans, such texts that stand directly in a top section."""
    texts = nodes.where((F.col("type") == "text") & test).withColumn("owner_path", F.regexp_replace("path", r"\.entries\[\d+\]$", ""))
    top = F.col("depth") == 1
    return texts.where(~top).groupBy("doc_id", "owner_path").agg(F.count(F.lit(1)).alias("blocks")), texts.where(top).select("doc_id", "path")


# edits of (doc_id, ord, parent, level); each gives the new table


def delete_subtrees(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the nodes of ``gone`` (doc_id, ord) and all below them, however deep; a parent comes before its children."""
    marked = nodes.join(gone.select("doc_id", "ord").distinct().withColumn("__gone", F.lit(True)), ["doc_id", "ord"], "left")
    return trees.inherited(marked, "doc_id", "ord", "parent", "__gone", "__lost").where("not __lost").select(*nodes.columns)


def move_under(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """``nodes`` after ``moves`` (doc_id, ord, to): the parent of each moved node is ``to`` and its level that of ``to`` and 1;
    what is below it keeps its distance. A move below the own subtree, or to a node that isn't there, is left out."""
    asked = nodes.join(moves.groupBy("doc_id", "ord").agg(F.min("to").alias("to")), ["doc_id", "ord"], "left")
    places = nodes.select("doc_id", F.col("ord").alias("to"), F.col("level").alias("to_level"))
    aimed = asked.join(places, ["doc_id", "to"], "left")

    up = aimed.withColumn("aim", F.when(F.col("to_level").isNotNull(), F.col("to")))
    # whether the target lies in the node's own subtree: rows are in reading order, so a subtree is a run of rows
    ends = trees.next_as_shallow(up, "doc_id", "ord", "level", "ord", "__end")
    inside = (F.col("aim") >= F.col("ord")) & (F.col("__end").isNull() | (F.col("aim") < F.col("__end")))
    chosen = ends.withColumn("aim", F.when(~inside, F.col("aim"))).withColumn("__shift", F.when(F.col("aim").isNotNull(), F.col("to_level") + 1 - F.col("level")))

    def shifts():
        own: dict = {}

        def step(at, parent, shift):
            own[at] = shift if shift is not None else own.get(parent, 0)
            return own[at]

        return step

    moved = trees.walk(chosen, "doc_id", "ord", ["parent", "__shift"], "__by", T.LongType(), shifts)
    return moved.select("doc_id", "ord", F.coalesce("aim", "parent").alias("parent"), (F.col("level") + F.col("__by")).alias("level"))


def dissolve(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """The nodes of ``gone`` (doc_id, ord) are taken out and their children go to their parents, a level up."""
    lost = nodes.join(gone, ["doc_id", "ord"], "left_semi").select("doc_id", F.col("ord").alias("parent"), F.col("parent").alias("above"), F.lit(True).alias("moved"))
    kept = nodes.join(gone, ["doc_id", "ord"], "left_anti").join(lost, ["doc_id", "parent"], "left")
    moved = F.coalesce("moved", F.lit(False))
    return kept.select("doc_id", "ord", F.when(moved, F.col("above")).otherwise(F.col("parent")).alias("parent"), (F.col("level") - moved.cast("int")).alias("level"))


def shift_levels(nodes: DataFrame, chosen: DataFrame, by: int, deepest: int | None = None) -> DataFrame:
    """Promotes (``by`` below 0) or demotes the nodes of ``chosen`` (doc_id, ord), not above level 1 and, where ``deepest``
    is given, not below that; a node that lies deeper already stays there."""
    marked = nodes.join(chosen.withColumn("chosen", F.lit(True)), ["doc_id", "ord"], "left")
    level = F.greatest(F.lit(1), F.col("level") + by)
    if deepest is not None:
        level = F.least(level, F.greatest(F.lit(deepest), F.col("level")))
    return marked.withColumn("level", F.when(F.col("chosen"), level).otherwise(F.col("level"))).drop("chosen")
