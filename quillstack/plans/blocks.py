"""Queries over blocks and edits of outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, documents
from .tables import HEADINGS, headings, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 2 THEN p_size END AS ac, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2 END AS hp, CASE p_partkey % 3 WHEN 0 THEN '1/' || p_size END AS cr FROM part WHERE p_partkey % 3 <> 2")
def stat_lines(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    line = F.when(k % 3 == 0, F.concat("p_name", F.lit(": AC "), s, F.lit("; HP: "), (F.col("p_size") * 2).cast("string"), F.lit(" (4d8); CR 1/"), s)).when(k % 3 == 1, F.concat(F.lit("Armor Class "), s)).otherwise(F.concat("p_name", F.lit(" crew 7")))
    return table(spark, d, "part").select(k.alias("id"), blocks.stat_line(line).alias("x")).where("x is not null").select("id", "x.*")


@query("SELECT p_partkey AS id, 'a' || '/' || p_name || '/' || p_type || ';' || 'b' || '/' || p_size || '/' AS cells FROM part")
def sniffed_tables(spark, d):
    k = F.col("p_partkey")
    sep = F.when(k % 4 == 0, "\t").when(k % 4 == 1, " | ").when(k % 4 == 2, ";").otherwise("   ")
    text = F.concat(F.lit("a"), sep, F.when(k % 4 == 3, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_name")), sep, "p_type", F.lit("\n\nb"), sep, F.col("p_size").cast("string"), F.lit("\n"))
    cells = F.array_join(F.transform(blocks.sniffed_table(text), lambda r: F.array_join(r, "/")), ";")
    return table(spark, d, "part").select(k.alias("id"), F.when(k % 4 == 3, F.replace(cells, F.lit("_"), F.lit(" "))).otherwise(cells).alias("cells"))


@query(f"WITH {HEADINGS} SELECT h.doc_id, h.ord, (SELECT max(b.ord) FROM headings b WHERE b.doc_id = h.doc_id AND b.ord < h.ord AND b.level < h.level AND length(b.title) % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM headings c WHERE c.doc_id = h.doc_id AND c.ord > b.ord AND c.ord < h.ord AND c.level <= b.level)) AS owner FROM headings h")
def named_ancestors(spark, d):
    name = F.when(F.length("title") % 3 != 0, F.col("title"))
    return blocks.named_ancestor(headings(spark, d), name, depth="level").select("doc_id", "ord", "owner")


PARENTS = f"{HEADINGS}, p AS (SELECT h.doc_id, h.ord, h.level, (SELECT max(b.ord) FROM headings b WHERE b.doc_id = h.doc_id AND b.ord < h.ord AND b.level < h.level) AS parent FROM headings h)"


def _tree(spark, d):
    return documents.parents(headings(spark, d)).select("doc_id", "ord", "parent", "level")


@query(f"WITH {PARENTS} SELECT p.doc_id, p.ord, CASE WHEN q.ord IS NOT NULL THEN q.parent ELSE p.parent END AS parent, p.level - CASE WHEN q.ord IS NOT NULL THEN 1 ELSE 0 END AS level FROM p LEFT JOIN p q ON q.doc_id = p.doc_id AND q.ord = p.parent AND q.level = 2 WHERE p.level <> 2")
def dissolved_nodes(spark, d):
    t = _tree(spark, d)
    return blocks.dissolve(t, t.where("level = 2").select("doc_id", "ord"))


@query(f"WITH RECURSIVE {PARENTS}, g AS (SELECT doc_id, ord FROM p WHERE level = 2 AND ord % 2 = 0 UNION SELECT p.doc_id, p.ord FROM g JOIN p ON p.doc_id = g.doc_id AND p.parent = g.ord) SELECT p.doc_id, p.ord, p.parent, p.level FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.ord = p.ord)")
def deleted_subtrees(spark, d):
    t = _tree(spark, d)
    return blocks.delete_subtrees(t, t.where("level = 2 and ord % 2 = 0").select("doc_id", "ord"))


@query(f"WITH {HEADINGS} SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN greatest(1, level - 1) ELSE level END AS level FROM headings")
def promoted_nodes(spark, d):
    t = headings(spark, d).select("doc_id", "ord", "level")
    return blocks.shift_levels(t, t.where("ord % 3 = 0").select("doc_id", "ord"), -1)


@query("SELECT p_partkey AS id, p_size AS ac, p_size * 2 AS hp FROM part WHERE p_partkey % 4 <> 3")
def stat_spans(spark, d):
    s = F.col("p_size").cast("string")
    text = F.concat(F.col("p_name"), F.lit(" **bold AC 99** and *plain text* then "), F.when(F.col("p_partkey") % 4 != 3, F.concat(F.lit("*AC "), s, F.lit("; HP "), (F.col("p_size") * 2).cast("string"), F.lit("*"))).otherwise("none"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(blocks.stat_spans(text)).alias("x")).select("id", "x.stats.ac", "x.stats.hp")


@query("SELECT p_name AS name, min(p_partkey) AS id, p_brand AS body FROM part GROUP BY p_name, p_brand")
def unrepeated_stats(spark, d):
    rows = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.concat(F.rpad("p_brand", 60, "."), F.col("p_partkey").cast("string")).alias("body"), F.col("p_partkey").alias("id"))
    return blocks.unrepeated_stats(rows, "name", "body", "id").select(F.lower("name").alias("name"), "id", F.rtrim(F.substring("body", 1, 60), F.lit(".")).alias("body"))


@query("SELECT p_partkey AS id, 0 AS ord, 'stat' AS kind, 'Armor Class' AS key, p_size || ' (hide)' AS value FROM part UNION ALL SELECT p_partkey, 2, 'trait', 'Keen Sight', 'It sees the ' || p_name || '.' FROM part UNION ALL SELECT p_partkey, 3, 'stat', 'Challenge', '1/2' FROM part WHERE p_partkey % 2 = 0")
def stat_rows(spark, d):
    text = F.concat(F.lit("Armor Class: "), F.col("p_size").cast("string"), F.lit(" (hide)\nsmall thing\n Keen Sight. It sees the "), "p_name", F.lit("."), F.when(F.col("p_partkey") % 2 == 0, F.lit("\nChallenge 1/2")).otherwise(""))
    return blocks.stat_rows(table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), "text")
