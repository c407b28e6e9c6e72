"""Typed documents: nested entries of known kinds as node rows, and the rules that they have to keep."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import balanced
from ..staging import small_batches
from .documents import node_frames

#: The kinds of entries, and the fields that hold child entries.
CONTAINERS = ("section", "entries", "inset", "insetReadaloud", "quote", "variantInner")
KINDS = (*CONTAINERS, "list", "table", "tableGroup", "item", "itemSub", "cell", "cellHeader", "row", "image", "gallery", "statblock", "statblockInline", "spellcasting", "flowchart", "flowBlock", "hr", "inline", "inlineBlock", "internal", "external", "square", "none", "hexColsOdd", "hexColsEven", "hexRowsOdd", "hexRowsEven")
CHILDREN = ("entries", "items", "images", "tables", "blocks", "headerEntries", "footerEntries")
#: What stands for entries that aren't objects: strings, cells of tables, and others.
TEXT, CELL, NULL, SCALAR, OTHER = "#text", "#cell", "#null", "#scalar", "#other"

NODES = "doc_id long, ord int, depth int, path string, parent int, type string, name string, node_id string, text string, raw string"


def typed_nodes(docs: DataFrame, doc: str = "doc_id", body: str = "body") -> DataFrame:
    """The nodes of documents, a row each, in reading order; nothing is lost: ``raw`` has an object's own fields as JSON, and
    objects of other kinds are nodes too. A document is an object with ``data``, or with ``adventureData`` or ``bookData``
    (the ``data`` of its first element); other texts give no rows. ``parent`` is the order of the node above.

    The nesting is known only to the data, so a document is walked in Python, in one task.
    """

    def top_of(data) -> list:
        if not isinstance(data, dict):
            return []
        for key in ("adventureData", "bookData"):
            if isinstance(data.get(key), list) and data[key] and isinstance(data[key][0], dict):
                data = data[key][0]
                break
        return data.get("data") if isinstance(data.get("data"), list) else []

    def nodes(number, top: list) -> list[tuple]:
        out: list[tuple] = []
        todo = [(e, f"data[{i}]", 0, None) for i, e in enumerate(top)][::-1]
        while todo:
            value, path, depth, parent = todo.pop()
            at = len(out)
            row = [number, at, depth, path, parent, None, None, None, None, None]
            if isinstance(value, str):
                row[5], row[8] = (CELL if isinstance(parent, int) and path.endswith("]]") else TEXT), value
            elif value is None:
                row[5] = NULL
            elif isinstance(value, bool | int | float):
                row[5], row[8] = SCALAR, json.dumps(value)
            elif not isinstance(value, dict):
                row[5], row[9] = OTHER, json.dumps(value, ensure_ascii=False)
            else:
                kind, name, own = value.get("type"), value.get("name"), value.get("id")
                row[5] = None if kind is None else str(kind)
                row[6] = name if isinstance(name, str) else None
                row[7] = own if isinstance(own, str) else None
                nested = [k for k in CHILDREN if isinstance(value.get(k), list)]
                row[9] = json.dumps({k: v for k, v in value.items() if k not in nested}, ensure_ascii=False)
                below = [(e, f"{path}.{k}[{i}]", depth + 1, at) for k in nested for i, e in enumerate(value[k])]
                if kind == "table" and isinstance(value.get("rows"), list):
                    below += [(c, f"{path}.rows[{i}][{j}]]", depth + 1, at) for i, r in enumerate(value["rows"]) if isinstance(r, list) for j, c in enumerate(r) if isinstance(c, str)]
                todo += below[::-1]
            row[3] = row[3].replace("]]", "]")
            out.append(tuple(row))
        return out

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])
        out["parent"] = out["parent"].astype("Int64").astype(object).where(out["parent"].notna(), None)
        return out

    def of_text(number, text) -> list[tuple]:
        try:
            return nodes(number, top_of(json.loads(text) if isinstance(text, str) else None))
        except ValueError:
            return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from node_frames((of_text(number, text) for pdf in batches for number, text in zip(pdf[doc], pdf[body], strict=True)), frame)

    small_batches(docs.sparkSession)
    return docs.select(doc, body).mapInPandas(run, NODES)


def checked(nodes: DataFrame, tags: list[str], strict: bool = False) -> DataFrame:
    """doc_id, path, severity and message of what is wrong with ``nodes``; ``tags`` are the inline tags known, and with
    ``strict`` a top entry that isn't a section is an error, else a warning."""
    raw = lambda field: F.get_json_object("raw", f"$.{field}")
    listed = lambda field: raw(field).isNull() | raw(field).startswith("[")
    kind, isobject = F.col("type"), F.col("raw").isNotNull() & (F.coalesce("type", F.lit("")) != OTHER)
    again = Window.partitionBy("doc_id", "node_id").orderBy("ord")
    before = F.when(F.col("node_id").isNotNull() & ~F.col("path").contains("mapParent"), F.lag("path").over(again))
    text = F.coalesce("text", F.concat_ws(" ", "name", *[F.when(isobject, raw(f)) for f in ("caption", "by", "from")]))
    unknown = F.array_except(F.regexp_extract_all(text, F.lit(r"\{@(\w+)[^}]*\}"), 1), F.array(*[F.lit(t) for t in tags]).cast("array<string>"))
    top = F.col("depth") == 0
    rules: list[tuple[Column, str, Column | str]] = [
        (top & (kind == TEXT), "error" if strict else "warning", "a top entry is a bare string"),
        (top & isobject & ~kind.eqNullSafe("section"), "error" if strict else "warning", "a top entry isn't a section"),
        (kind == NULL, "error", "an entry is null"),
        (kind == OTHER, "warning", "an entry is neither text nor object"),
        (isobject & kind.isNull(), "warning", "an entry has no type"),
        (isobject & ~kind.isin(*KINDS), "warning", F.concat(F.lit("unknown type "), kind)),
        (isobject & raw("id").isNotNull() & F.col("node_id").isNull(), "error", "an id isn't a string"),
        (F.col("before").isNotNull(), "warning", F.concat(F.lit("the id stands at "), F.col("before"), F.lit(" too"))),
        (isobject & kind.isin("section", "entries") & (F.coalesce("name", F.lit("")) == ""), "warning", F.concat(kind, F.lit(" has no name"))),
        (isobject & kind.isin(*CONTAINERS) & raw("entries").isNotNull(), "error", "entries isn't a list"),
        (isobject & (kind == "list") & raw("items").isNotNull(), "error", "items isn't a list"),
        (isobject & (kind == "table") & ~listed("colLabels"), "error", "colLabels isn't a list"),
        (isobject & (kind == "table") & ~listed("rows"), "error", "rows isn't a list"),
        (isobject & (kind == "table") & listed("rows") & listed("colLabels") & (F.coalesce(F.json_array_length(raw("rows")), F.lit(0)) > 0) & (F.coalesce(F.json_array_length(raw("colLabels")), F.lit(0)) == 0), "warning", "a table has rows and no labels"),
        (isobject & (kind == "image") & raw("href").isNull(), "error", "an image has no address"),
        (isobject & (kind == "image") & raw("href").startswith("{") & raw("href.path").isNull() & raw("href.url").isNull(), "warning", "an image's address has neither path nor url"),
        (F.size(unknown) > 0, "error", F.concat(F.lit("unknown tags "), F.array_join(F.array_sort(F.array_distinct(unknown)), ", "))),
        (~balanced(text), "warning", "braces don't close"),
    ]
    found = F.filter(F.array(*[F.when(t, F.struct(F.lit(s).alias("severity"), (m if isinstance(m, Column) else F.lit(m)).alias("message"))) for t, s, m in rules]), lambda x: x.isNotNull())
    return nodes.withColumn("before", before).select("doc_id", "path", F.explode(found).alias("x")).select("doc_id", "path", "x.*")


def stat_summary(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, ac, hp and cr of nodes with tables of statistics directly below them: rows of key and value, or a row
    below labels; where several have a value the last counts."""
    tables = nodes.where("type = 'table' and parent is not null").select("doc_id", F.col("parent").alias("ord"), F.col("ord").alias("at"), F.from_json(F.get_json_object("raw", "$.colLabels"), "array<string>").alias("labels"), F.from_json(F.get_json_object("raw", "$.rows"), "array<array<string>>").alias("rows"))
    pairs = F.transform("rows", lambda r: F.struct(F.trim(F.try_element_at(r, F.lit(1))).alias("key"), F.trim(F.try_element_at(r, F.lit(2))).alias("value")))
    labelled = F.transform(F.arrays_zip("labels", F.coalesce(F.try_element_at("rows", F.lit(1)), F.array().cast("array<string>")).alias("first")), lambda x: F.struct(x["labels"].alias("key"), F.trim(x["first"]).alias("value")))
    # of one table the labels come after the rows
    facts = tables.select("doc_id", "ord", "at", F.posexplode(F.concat(F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>")), F.coalesce(labelled, F.array().cast("array<struct<key:string,value:string>>")))).alias("pos", "x")).where("x.value is not null")
    last = lambda key: F.max_by(F.when(F.col("x.key") == key, F.col("x.value")), F.when(F.col("x.key") == key, F.struct("at", "pos")))
    out = facts.groupBy("doc_id", "ord").agg(last("Armor Class").alias("ac"), last("Hit Points").alias("hp"), F.trim(F.substring_index(last("Challenge"), "(", 1)).alias("cr"))
    return out.where("ac is not null or hp is not null or cr is not null")
