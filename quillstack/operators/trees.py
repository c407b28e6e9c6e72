"""Trees of any depth: rows in reading order are walked once, and links are followed by doubling.

:func:`walk` deals documents to partitions, sorts each document and passes it through batch by batch, so the state of one
document is all that a task holds. What needs no such order is done by joins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..staging import staged

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def walk(rows: DataFrame, doc: str, order: str, inputs: list[str], name: str, kind: T.DataType, make: Callable[[], Callable], descending: bool = False) -> DataFrame:
    """``rows`` with a column more. For each document ``make()`` gives a function, which is called with the order and the
    ``inputs`` of its rows, one after another in order, and returns the new column's values."""
    key = F.col(order).desc() if descending else F.col(order)
    arrow = _ARROW[kind.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            out = []
            for d, *values in zip(*(batch.column(c).to_pylist() for c in (doc, order, *inputs)), strict=True):
                if step is None or d != now:
                    now, step = d, make()
                out.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], [*batch.schema.names, name])

    schema = T.StructType([*rows.schema.fields, T.StructField(name, kind)])
    return rows.repartition(doc).sortWithinPartitions(doc, key).mapInArrow(run, schema)


def _by_level(rows: DataFrame, doc: str, key: Column, level: str, levels: Iterable[int], value: str, name: str, passes: Callable[[int], Column]) -> DataFrame:
    """``name``: the ``value`` of the last row before, in the order of ``key``, that ``passes`` the own level; a running value for each of the
    ``levels``, all in one window. A level that isn't among them is an error."""
    before = Window.partitionBy(doc).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    found = F.when(F.col(level).isNull(), F.lit(None).cast(rows.schema[value].dataType))
    for own in levels:
        # in a struct, as a row that passes counts without a value too
        held = F.last(F.when(passes(own), F.struct(value)), ignorenulls=True).over(before)
        found = found.when(F.col(level) == own, held[value])
    return rows.withColumn(name, found.otherwise(F.raise_error(F.concat(F.lit("a level that isn't among the stated ones: "), F.col(level).cast("string")))))


def nearest_shallower(rows: DataFrame, doc: str, order: str, level: str, name: str = "parent", levels: Iterable[int] | None = None) -> DataFrame:
    """``name``: the order of the nearest earlier row of a smaller level. Rows without a level have none and are none. Where all
    ``levels`` are stated (few, as those of headings), built-in windows find it, else a walk."""
    if levels is not None:
        return _by_level(rows, doc, F.col(order), level, levels, order, name, lambda own: F.col(level) < own)

    def make():
        above: list[tuple] = []

        def step(at, lev):
            if lev is None:
                return None
            while above and above[-1][0] >= lev:
                above.pop()
            found = above[-1][1] if above else None
            above.append((lev, at))
            return found

        return step

    return walk(rows, doc, order, [level], name, rows.schema[order].dataType, make)


def next_as_shallow(rows: DataFrame, doc: str, order: str, level: str, value: str, name: str, levels: Iterable[int] | None = None) -> DataFrame:
    """``name``: the ``value`` of the nearest later row of the same or a smaller level; ``levels`` as in :func:`nearest_shallower`."""
    if levels is not None:
        return _by_level(rows, doc, F.col(order).desc(), level, levels, value, name, lambda own: F.col(level) <= own)

    def make():
        below: list[tuple] = []

        def step(_, lev, val):
            if lev is None:
                return None
            while below and below[-1][0] > lev:
                below.pop()
            found = below[-1][1] if below else None
            below.append((lev, val))
            return found

        return step

    return walk(rows, doc, order, [level, value], name, rows.schema[value].dataType, make, descending=True)


def nearest_named(rows: DataFrame, doc: str, order: str, depth: str, named: str, name: str = "owner") -> DataFrame:
    """``name``: the order of the nearest ancestor (earlier, less deep, not closed since) for which ``named`` holds."""

    def make():
        above: list[tuple] = []  # depth, and the nearest named row from there up

        def step(at, dep, own):
            if dep is None:
                return None
            while above and above[-1][0] >= dep:
                above.pop()
            found = above[-1][1] if above else None
            above.append((dep, at if own else found))
            return found

        return step

    return walk(rows, doc, order, [depth, named], name, rows.schema[order].dataType, make)


def reached(rows: DataFrame, doc: str, order: str, parent: str, open_: str, name: str = "reached") -> DataFrame:
    """``name``: whether all rows above a row are open. A parent comes before its children."""

    def make():
        let: dict = {}

        def step(at, up, own):
            ok = up is None or let.get(up, False)
            let[at] = ok and bool(own)
            return ok

        return step

    return walk(rows, doc, order, [parent, open_], name, T.BooleanType(), make)


def inherited(rows: DataFrame, doc: str, order: str, parent: str, flag: str, name: str = "inherited") -> DataFrame:
    """``name``: whether ``flag`` holds for a row or any above it. A parent comes before its children."""

    def make():
        held: dict = {}

        def step(at, up, own):
            held[at] = bool(own) or held.get(up, False)
            return held[at]

        return step

    return walk(rows, doc, order, [parent, flag], name, T.BooleanType(), make)


def with_content(rows: DataFrame, doc: str, order: str, parent: str, filled: str, name: str = "kept") -> DataFrame:
    """``name``: whether ``filled`` holds for a row or any below it. A parent comes before its children."""

    def make():
        needed: set = set()

        def step(at, up, own):
            keep = bool(own) or at in needed
            if keep and up is not None:
                needed.add(up)
            return keep

        return step

    return walk(rows, doc, order, [parent, filled], name, T.BooleanType(), make, descending=True)


def assemble(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """The nodes (doc_id, root, ord, parent, title) to put together from ``results`` (doc_id, root, target, entries; null
    entries are failures), with the entries of each: roots that failed altogether are left out, and so are the nodes below
    which nothing is."""
    some = results.where("entries is not null").groupBy("doc_id", "root", F.col("target").alias("ord")).agg(F.flatten(F.collect_list("entries")).alias("entries"))
    alive = some.select("doc_id", "root").distinct()
    both = nodes.join(alive, ["doc_id", "root"], "left_semi").join(some, ["doc_id", "root", "ord"], "left")
    marked = with_content(both.withColumn("filled", F.col("entries").isNotNull()), "doc_id", "ord", "parent", "filled")
    # a root stays where one of its chunks came, though that had nothing
    return marked.where(F.col("kept") | (F.col("ord") == F.col("root"))).drop("filled", "kept")


def rebuild(rows: DataFrame, doc: str, order: str, level: str, name: str, text: str, most: int = 1_000_000) -> DataFrame:
    """doc and body: each document's headings (level, name, text) nested as JSON, sections with entries within entries.

    A heading goes into the nearest earlier one of a smaller level. A document is built in one task; one of more than
    ``most`` headings is refused.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"a document has over {most} headings")
        top: list = []
        above: list[tuple[int, list]] = [(-(2**31), top)]
        for lev, own, body in pdf.sort_values(order, kind="stable")[[level, name, text]].itertuples(index=False):
            while above[-1][0] >= lev:
                above.pop()
            node = {"type": "section" if len(above) == 1 else "entries", "name": own, "entries": [body] if body else []}
            above[-1][1].append(node)
            above.append((lev, node["entries"]))
        return pd.DataFrame({doc: [pdf[doc].iloc[0]], "body": [json.dumps({"data": top}, ensure_ascii=False, separators=(",", ":"))]})

    schema = T.StructType([rows.schema[doc], T.StructField("body", T.StringType())])
    return rows.select(*dict.fromkeys([doc, order, level, name, text])).groupBy(doc).applyInPandas(build, schema)


def rebased_levels(rows: DataFrame, anchor: Column, depth: str, doc: str = "doc_id", order: str = "ord", deepest: int = 4) -> DataFrame:
    """section: the order of the last row with an ``anchor`` level so far; new_level: that level for anchors, for rows after
    one the depth counted from it, ``deepest`` at most; the own depth and 1 before the first."""
    upto = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(anchor.isNotNull(), F.struct(F.col(order).alias("o"), anchor.alias("a"))), ignorenulls=True).over(upto)
    level = F.coalesce(anchor, F.least(F.col(depth) + F.coalesce(last["a"] + 1, F.lit(1)), F.lit(deepest)))
    return rows.withColumns({"section": last["o"], "new_level": level})


def reading_ids(nodes: DataFrame, kinds: tuple[str, ...] = ("section", "entries", "inset"), doc: str = "doc_id", order: str = "ord", kind: str = "type") -> DataFrame:
    """new_id: nodes of these kinds numbered from 000 in reading order; others have none."""
    own = F.col(kind).isin(*kinds)
    n = F.sum(own.cast("int")).over(Window.partitionBy(doc).orderBy(order)) - 1
    return nodes.withColumn("new_id", F.when(own, F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))))


def named_headings(nodes: DataFrame, kinds: tuple[str, ...] = ("section", "entries"), deepest: int = 4) -> DataFrame:
    """Nodes of these kinds that have a name, with heading_id (from 0, in order) and proposed_level; the depth counts
    containers without a name too."""
    found = nodes.where(F.col("type").isin(*kinds) & (F.trim(F.coalesce("name", F.lit(""))) != ""))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return found.withColumns({"heading_id": number, "proposed_level": F.least(F.col("depth") + 1, F.lit(deepest))})


# links that don't come in an order


def _follow(state: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Applies ``step`` (own rows, all rows) until no pointer ``up`` is left; each round doubles the reach, so a chain of n
    links takes log2(n) rounds. What still points after log2 of all rows is in or below a circle and is left out."""
    state = staged(state, "links")
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.where("up is not null").isEmpty():
            break
        state = staged(step(state, state), "links")
    return state.where("up is null").drop("up")


def root_paths(nodes: DataFrame, key: str = "id", name: str = "name", parent: str = "parent", sep: str = "/") -> DataFrame:
    """id, path and depth of each of ``nodes``: names from the root down; a parent that isn't there is the root. Nodes in or
    below a circle have no path and no row."""
    ids = nodes.select(F.col(key).alias("up"), F.lit(True).alias("there"))
    own = nodes.select(F.col(key).alias("id"), F.col(name).alias("path"), F.col(parent).alias("up")).join(ids, "up", "left")
    state = own.select("id", "path", F.lit(1).alias("depth"), F.when(F.col("there"), F.col("up")).alias("up"))
    # circles are found by ids alone, before any path grows along one
    ends = _follow(state.select("id", "up"), lambda rows, known: rows.join(known.select(F.col("id").alias("up"), F.col("up").alias("next")), "up", "left").select("id", F.col("next").alias("up")))
    state = state.join(ends, "id", "left_semi")

    def step(rows: DataFrame, known: DataFrame) -> DataFrame:
        above = known.select(F.col("id").alias("up"), F.col("path").alias("more"), F.col("depth").alias("deep"), F.col("up").alias("next"))
        both = rows.join(above, "up", "left")
        return both.select("id", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("more", F.lit(sep), "path")).alias("path"), (F.col("depth") + F.coalesce("deep", F.lit(0))).alias("depth"), F.col("next").alias("up"))

    return _follow(state, step)


def nearest_value(links: DataFrame, key: str, parent: str, value: str) -> DataFrame:
    """key, value and depth: the own value of a row, or that of the nearest row above that has one, ``depth`` links away.
    Rows above which no value is have no row."""
    have = F.col(value).isNotNull()
    ids = links.select(F.col(key).alias("up"), F.lit(True).alias("there"))
    own = links.select(F.col(key).alias("id"), F.col(value).alias("v"), F.when(~have, F.col(parent)).alias("up")).join(ids, "up", "left")
    state = own.select("id", "v", F.when(F.col("v").isNotNull(), 0).otherwise(1).alias("depth"), F.when(F.col("there"), F.col("up")).alias("up"))

    def step(rows: DataFrame, known: DataFrame) -> DataFrame:
        above = known.select(F.col("id").alias("up"), F.col("v").alias("w"), F.col("depth").alias("deep"), F.col("up").alias("next"))
        return rows.join(above, "up", "left").select("id", F.coalesce("v", "w").alias("v"), (F.col("depth") + F.coalesce("deep", F.lit(0))).alias("depth"), F.when(F.coalesce("v", "w").isNull(), F.col("next")).alias("up"))

    return _follow(state, step).where("v is not null").select(F.col("id").alias(key), F.col("v").alias(value), "depth")
