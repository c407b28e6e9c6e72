"""Queries over trees of headings: levels, ids, moves, assembling, typed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, documents, trees, typed
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


TREE = f"{HEADINGS}, p AS (SELECT h.*, (SELECT max(b.ord) FROM headings b WHERE b.doc_id = h.doc_id AND b.ord < h.ord AND b.level < h.level) AS parent FROM headings h)"


@query(f"WITH {HEADINGS}, a AS (SELECT *, CASE WHEN level = 1 THEN 1 + length(title) % 2 END AS anchor FROM headings), l AS (SELECT *, last_value(CASE WHEN anchor IS NOT NULL THEN ord END IGNORE NULLS) OVER w AS section, last_value(anchor IGNORE NULLS) OVER w AS la FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT doc_id, ord, section, CAST(coalesce(anchor, least(level + coalesce(la + 1, 1), 4)) AS BIGINT) AS new_level FROM l")
def rebased_levels(spark, d):
    anchor = F.when(F.col("level") == 1, 1 + F.length("title") % 2)
    return trees.rebased_levels(headings(spark, d), anchor, "level").select("doc_id", "ord", "section", F.col("new_level").cast("long").alias("new_level"))


@query(f"WITH {HEADINGS}, n AS (SELECT doc_id, ord, level, sum(CASE WHEN level <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS n FROM headings) SELECT doc_id, ord, CASE WHEN level <= 3 THEN printf('%03d', CAST(n AS BIGINT)) END AS new_id FROM n")
def reading_ids(spark, d):
    kind = F.when(F.col("level") == 1, "section").when(F.col("level") == 2, "entries").when(F.col("level") == 3, "inset").otherwise("text")
    return trees.reading_ids(headings(spark, d).withColumn("type", kind)).select("doc_id", "ord", "new_id")


SHORT = "CASE length(title) % 3 WHEN 0 THEN title || ' (' || ord || ')' WHEN 1 THEN ord || '. ' || title ELSE title END"


@query(f"WITH {HEADINGS}, t AS (SELECT doc_id, ord, {SHORT} AS title FROM headings), n AS (SELECT *, lower(trim(regexp_replace(regexp_replace(title, '\\s*\\(\\d+\\)\\s*$', ''), '^\\s*\\d+[.:;)]\\s*', ''))) AS name FROM t) SELECT doc_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY ord) AS nth FROM n) WHERE nth = 1 OR NOT regexp_matches(title, '\\(\\d+\\)\\s*$')")
def toc_references(spark, d):
    n, at, short = F.length("title"), F.col("ord").cast("string"), F.col("title")
    title = F.when(n % 3 == 0, F.concat(short, F.lit(" ("), at, F.lit(")"))).when(n % 3 == 1, F.concat(at, F.lit(". "), short)).otherwise(short)
    return documents.without_references(headings(spark, d).select("doc_id", "ord", title.alias("title"))).select("doc_id", "ord")


CLEAN = "trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(
    f"WITH {HEADINGS}, heads AS (SELECT doc_id, page * 4 + 3 AS spot, {CLEAN.format(c='string_agg(title, chr(32) ORDER BY ord)')} AS h FROM headings GROUP BY doc_id, page), e AS (SELECT doc_id, ord, page, {CLEAN.format(c='title')} AS t FROM headings), "
    "hit AS (SELECT e.doc_id, ord, spot, CASE WHEN abs(spot - page) <= 5 THEN 5 WHEN abs(spot - page) <= 15 THEN 15 WHEN abs(spot - page) <= 30 THEN 30 ELSE 60 END AS ring FROM e JOIN heads USING (doc_id) WHERE length(t) >= 6 AND abs(spot - page) <= 60 AND contains(h, t)) "
    "SELECT e.doc_id, e.ord, b.spot AS actual FROM e LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY ring, spot) AS nth FROM hit) WHERE nth = 1) b ON b.doc_id = e.doc_id AND b.ord = e.ord"
)
def found_titles(spark, d):
    h = headings(spark, d)
    heads = h.groupBy("doc_id", (F.col("page") * 4 + 3).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]), " ").alias("head"))
    entries = h.select("doc_id", "ord", "title", "page")
    return documents.found_titles(entries, heads).select("doc_id", "ord", "actual")


def _named(spark, d):
    name = F.when(F.length("title") % 4 != 0, F.concat("title", F.lit("#"), F.col("ord").cast("string")))
    return headings(spark, d).select("doc_id", "ord", "level", name.alias("name"), "title")


DEPTHS = f"{TREE}, r AS (SELECT *, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.*, depth + 1 FROM r JOIN p ON p.doc_id = r.doc_id AND p.parent = r.ord)"


@query(f"WITH RECURSIVE {DEPTHS} SELECT doc_id, CASE WHEN length(title) % 4 <> 0 THEN title || '#' || ord END AS name, CASE WHEN depth = 0 THEN 'section' ELSE 'entries' END AS type, CAST(depth AS INTEGER) AS depth, length(title) AS size FROM r")
def rebuilt_documents(spark, d):
    bodies = trees.rebuild(_named(spark, d), "doc_id", "ord", "level", "name", "title")
    nodes = typed.typed_nodes(bodies)
    own = nodes.where(F.col("type") == typed.TEXT).select("doc_id", F.col("parent").alias("ord"), F.length("text").alias("size"))
    found = nodes.where(F.col("type").isin("section", "entries")).join(own, ["doc_id", "ord"], "left")
    return found.select("doc_id", "name", "type", "depth", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


@query(f"WITH RECURSIVE {DEPTHS} SELECT doc_id, title || '#' || ord AS name, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS heading_id, least(depth + 1, 4) AS proposed_level FROM r WHERE length(title) % 4 <> 0")
def named_headings(spark, d):
    bodies = trees.rebuild(_named(spark, d), "doc_id", "ord", "level", "name", "title")
    out = trees.named_headings(typed.typed_nodes(bodies))
    return out.select("doc_id", "name", F.col("heading_id").cast("long").alias("heading_id"), F.col("proposed_level").cast("long").alias("proposed_level"))


ROOTS = f"{TREE}, r AS (SELECT *, ord AS root FROM p WHERE parent IS NULL UNION ALL SELECT p.*, root FROM r JOIN p ON p.doc_id = r.doc_id AND p.parent = r.ord)"


@query(
    f"""WITH RECURSIVE {ROOTS}, ok AS (SELECT doc_id, root, ord, parent FROM r WHERE length(title) % 5 = 1), alive AS (SELECT DISTINCT doc_id, root FROM ok), up AS (SELECT doc_id, ord, parent FROM ok UNION SELECT p.doc_id, p.ord, p.parent FROM up JOIN p ON p.doc_id = up.doc_id AND p.ord = up.parent)
SELECT r.doc_id, r.ord, r.root, length(r.title) % 5 = 1 AS filled FROM r JOIN alive USING (doc_id, root) WHERE (doc_id, r.ord) IN (SELECT (doc_id, ord) FROM up) OR r.ord = root"""
)
def assembled_sections(spark, d):
    tree = documents.parents(headings(spark, d))
    root = tree.where("parent is null").select("doc_id", F.col("ord").alias("at"))
    # a root's tree reaches to the next root
    from pyspark.sql.window import Window

    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    nodes = tree.join(root.withColumnRenamed("at", "ord").withColumn("top", F.lit(True)), ["doc_id", "ord"], "left").withColumn("root", F.max(F.when(F.col("top"), F.col("ord"))).over(upto)).select("doc_id", "root", "ord", "parent", "title")
    results = nodes.where(F.length("title") % 5 < 3).select("doc_id", "root", F.col("ord").alias("target"), F.when(F.length("title") % 5 == 1, F.array("title")).alias("entries"))
    out = trees.assemble(nodes, results)
    return out.select("doc_id", "ord", "root", F.col("entries").isNotNull().alias("filled"))


@query(
    f"""WITH RECURSIVE {TREE}, a AS (SELECT doc_id, min(ord) AS aim FROM p WHERE level = 1 GROUP BY doc_id), m AS (SELECT p.doc_id, p.ord, p.parent, p.level, CASE WHEN p.level = 3 AND length(title) % 2 = 0 THEN aim END AS aim FROM p LEFT JOIN a USING (doc_id)),
r AS (SELECT *, CASE WHEN aim IS NOT NULL THEN 2 - level ELSE 0 END AS shift FROM m WHERE parent IS NULL UNION ALL SELECT m.*, CASE WHEN m.aim IS NOT NULL THEN 2 - m.level ELSE r.shift END FROM r JOIN m ON m.doc_id = r.doc_id AND m.parent = r.ord)
SELECT doc_id, ord, coalesce(aim, parent) AS parent, level + shift AS level FROM r"""
)
def moved_nodes(spark, d):
    tree = documents.parents(headings(spark, d))
    aims = tree.where("level = 1").groupBy("doc_id").agg(F.min("ord").alias("to"))
    moves = tree.where((F.col("level") == 3) & (F.length("title") % 2 == 0)).select("doc_id", "ord").join(aims, "doc_id")
    return blocks.move_under(tree.select("doc_id", "ord", "parent", "level"), moves)


def _typed(spark, d):
    """Each document's headings as entries of several kinds, some of them faulty."""
    t, n = F.col("title"), F.length("title")
    name = F.regexp_replace(t, r"[{}\"\\]", "")
    section = F.struct(F.lit("section").alias("type"), F.when(n % 7 != 0, name).alias("name"), F.concat(F.lit("i"), (n % 50).cast("string")).alias("id"), F.array(F.concat(name, F.when(n % 2 == 0, F.lit(" {@spell x} {@odd y}")).otherwise(F.lit(" {")))).alias("entries"))
    grid = F.struct(F.when(n % 3 != 0, F.lit("table")).otherwise("grid").alias("type"), F.when(n % 2 == 0, F.array(F.lit("Armor Class"), F.lit("Speed"))).alias("colLabels"), F.array(F.array(n.cast("string"), name)).alias("rows"))
    listed = F.struct(F.lit("list").alias("type"), F.array(name, name).alias("items"))
    image = F.struct(F.lit("image").alias("type"), F.when(n % 2 == 0, F.struct(F.when(n % 4 == 0, F.lit("p")).alias("path"))).alias("href"))
    body = F.when(F.col("level") == 1, F.to_json(section)).when(F.col("level") == 2, F.to_json(grid)).when(F.col("level") == 3, F.to_json(listed)).otherwise(F.to_json(image))
    rows = headings(spark, d).select("doc_id", "ord", body.alias("x")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "x"))), lambda e: e["x"]), ",").alias("x"))
    return rows.select("doc_id", F.concat(F.lit('{"data":['), "x", F.lit("]}")).alias("body"))


@query(
    f"""WITH {HEADINGS}, h AS (SELECT doc_id, ord, level, length(title) AS n, 'data[' || (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) || ']' AS path FROM headings), name AS (SELECT doc_id, ord, regexp_replace(title, '[{{}}"\\\\]', '', 'g') AS name FROM headings),
i AS (SELECT *, lag(path) OVER (PARTITION BY doc_id, n % 50 ORDER BY ord) AS prev FROM h WHERE level = 1)
SELECT doc_id, path, 'warning' AS severity, 'section has no name' AS message FROM h JOIN name USING (doc_id, ord) WHERE level = 1 AND (n % 7 = 0 OR name = '') UNION ALL SELECT doc_id, path, 'warning', 'the id stands at ' || prev || ' too' FROM i WHERE prev IS NOT NULL
UNION ALL SELECT doc_id, path || '.entries[0]', 'error', 'unknown tags odd' FROM h WHERE level = 1 AND n % 2 = 0 UNION ALL SELECT doc_id, path || '.entries[0]', 'warning', 'braces don''t close' FROM h WHERE level = 1 AND n % 2 = 1
UNION ALL SELECT doc_id, path, 'warning', 'a top entry isn''t a section' FROM h WHERE level <> 1 UNION ALL SELECT doc_id, path, 'warning', 'unknown type grid' FROM h WHERE level = 2 AND n % 3 = 0 UNION ALL SELECT doc_id, path, 'warning', 'a table has rows and no labels' FROM h WHERE level = 2 AND n % 3 <> 0 AND n % 2 <> 0
UNION ALL SELECT doc_id, path, 'error', 'an image has no address' FROM h WHERE level = 4 AND n % 2 <> 0 UNION ALL SELECT doc_id, path, 'warning', 'an image''s address has neither path nor url' FROM h WHERE level = 4 AND n % 4 = 2"""
)
def checked_documents(spark, d):
    return typed.checked(typed.typed_nodes(_typed(spark, d)), ["spell"])


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size + 1 AS VARCHAR) END AS ac, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS hp, CASE WHEN p_partkey % 2 = 0 THEN '1/4' END AS cr FROM part")
def stat_summaries(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    pairs = F.concat(F.lit('[["Armor Class","'), s.cast("string"), F.lit('"],["Hit Points"," '), "p_name", F.lit(' "],["Challenge","1/4 (50 XP)"],["Speed"]]'))
    rows = F.when(k % 2 == 0, F.concat(F.lit('"rows":'), pairs)).otherwise(F.concat(F.lit('"colLabels":["Speed","Armor Class"],"rows":[["30","'), (s + 1).cast("string"), F.lit('"]]')))
    body = F.concat(F.lit('{"data":[{"type":"section","name":"x","entries":[{"type":"table",'), rows, F.lit("}]}]}"))
    docs = table(spark, d, "part").select(k.alias("doc_id"), body.alias("body"))
    return typed.stat_summary(typed.typed_nodes(docs)).select("doc_id", "ac", "hp", "cr")


@query(f"WITH {HEADINGS}, p AS (SELECT h.doc_id, h.ord, h.level, h.title FROM headings h) SELECT doc_id, 'data[' || (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) || ']' AS path FROM p QUALIFY length(title) % 3 = 0")
def orphan_blocks(spark, d):
    from .texts import _nested

    nodes = documents.flatten_documents(_nested(spark, d))
    _, orphans = blocks.leaf_owners(nodes, F.length("text") % 3 == 0)
    return orphans.select("doc_id", F.regexp_replace("path", r"\.entries\[\d+\]$", "").alias("path"))
