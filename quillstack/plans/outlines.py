"""Queries over outlines derived from the documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import documents, outline, quality
from .tables import HEADINGS, headings, table
from .texts import _nested

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'A' || p_size WHEN 1 THEN 'GT' || p_size WHEN 2 THEN 'B' END AS room FROM part")
def keyed_rooms(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit(" A"), s, F.lit(". "), "p_name")).when(k % 4 == 1, F.concat(F.lit("GT "), s, F.lit(") hall"))).when(k % 4 == 2, F.concat(F.lit("B "), "p_name")).otherwise(F.concat(F.lit("A1 "), F.repeat("p_name", 9)))
    return table(spark, d, "part").select(k.alias("id"), outline.keyed_room(name).alias("room"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 2 THEN p_size || '. ' || p_name WHEN 3 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 4 <> 3 THEN p_size END AS page FROM part")
def toc_lines(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    line = F.when(k % 4 == 0, F.concat("p_name", F.lit(" ...... "), s)).when(k % 4 == 1, F.concat(F.lit("  "), "p_name", F.lit("     "), s)).when(k % 4 == 2, F.concat(s, F.lit(". "), "p_name", F.lit(" "), s)).otherwise(F.concat(F.lit("It has "), s, F.lit(" pages")))
    return table(spark, d, "part").select(k.alias("id"), outline.toc_line(line).alias("t")).select("id", "t.title", "t.page")


@query("SELECT l_orderkey AS doc, 2 * n AS ord, l_shipmode AS title, page FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_returnflag || l_linestatus || l_linenumber AS l_shipmode, CAST(l_quantity AS INTEGER) AS page FROM lineitem) WHERE page BETWEEN 1 AND 40")
def toc_line_pairs(spark, d):
    from pyspark.sql.window import Window

    rows = table(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    two = F.explode(F.array(F.struct((2 * F.col("n")).alias("ord"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("line")), F.struct((2 * F.col("n") + 1).alias("ord"), F.col("l_quantity").cast("int").cast("string").alias("line"))))
    lines = rows.select(F.col("l_orderkey").alias("doc"), two.alias("x")).select("doc", F.col("x.ord").cast("long").alias("ord"), "x.line")
    return outline.toc_pairs(lines, "doc", "ord", "line", 40)


ROOMS = f"WITH {HEADINGS}, h AS (SELECT *, length(title) % 3 <> 0 AS room FROM headings)"


@query(f"{ROOMS}, c AS (SELECT doc_id, level, count(*) AS n, min(ord) AS seen FROM h WHERE room GROUP BY ALL), m AS (SELECT doc_id, level AS common FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS k FROM c) WHERE k = 1), t AS (SELECT h.doc_id, count(*) AS tight FROM h JOIN m USING (doc_id) WHERE room AND abs(level - common) <= 1 GROUP BY h.doc_id) SELECT h.doc_id, h.ord, CASE WHEN room AND abs(level - common) <= 1 AND tight >= 5 THEN common ELSE level END AS new_level FROM h LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)")
def room_levels(spark, d):
    h = headings(spark, d)
    return outline.level_rooms(h, F.length("title") % 3 != 0, "doc_id", "ord", "level").select("doc_id", "ord", "new_level")


@query(f"WITH {HEADINGS}, h AS (SELECT *, CASE WHEN level = 3 THEN length(title) % 2 END AS series FROM headings) SELECT DISTINCT a.doc_id, a.series FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.series = b.series AND a.ord < b.ord WHERE EXISTS (SELECT 1 FROM h c WHERE c.doc_id = a.doc_id AND c.ord > a.ord AND c.ord < b.ord AND c.level < 3)")
def interrupted_series(spark, d):
    h = headings(spark, d).withColumn("series", F.when(F.col("level") == 3, (F.length("title") % 2).cast("long")))
    return outline.interrupted(h, "doc_id", "ord", "level", "series", 3)


@query(f"WITH {HEADINGS} SELECT doc_id, level, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY length(title) DESC, ord) AS n FROM headings) WHERE n = 1")
def longest_names(spark, d):
    return outline.longest_names(headings(spark, d), ["doc_id", "level"], "title", "ord").select("doc_id", "level", "ord")


@query(f"WITH {HEADINGS}, s AS (SELECT *, CAST(sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS chapter FROM headings) SELECT doc_id, chapter, arg_min(title, ord) AS name, coalesce(string_agg(title, '|' ORDER BY ord) FILTER (level = 2), '') AS headers FROM s WHERE chapter > 0 GROUP BY doc_id, chapter")
def toc_preview(spark, d):
    out = outline.toc_preview(headings(spark, d), "doc_id", "ord", "level", "title")
    return out.select("doc_id", "chapter", "name", F.array_join("headers", "|").alias("headers"))


@query(f"WITH {HEADINGS}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i FROM headings) SELECT doc_id, CAST(2 * i AS INTEGER) AS at, CASE WHEN level <> 4 THEN title ELSE 'Untitled' END AS chapter, '' AS headers FROM h")
def toc_build(spark, d):
    nodes = documents.flatten_documents(_nested(spark, d))
    # children of one id in several places would mix: nodes are told apart by their place
    nodes = nodes.withColumn("node_id", F.when(F.col("depth") == 0, F.col("path")).otherwise(F.col("node_id"))).withColumn("parent_id", F.regexp_extract("path", r"^(data\[\d+\])\.", 1))
    return outline.build_toc(nodes).withColumn("headers", F.array_join("headers", "|"))


SIZES = f"""WITH RECURSIVE {HEADINGS}, p AS (SELECT h.doc_id, h.ord, h.level, length(h.title) AS own, (SELECT max(b.ord) FROM headings b WHERE b.doc_id = h.doc_id AND b.ord < h.ord AND b.level < h.level) AS parent, coalesce((SELECT min(b.ord) FROM headings b WHERE b.doc_id = h.doc_id AND b.ord > h.ord AND b.level <= h.level), 1000000) AS nx FROM headings h),
n AS (SELECT p.*, (SELECT sum(q.own) FROM p q WHERE q.doc_id = p.doc_id AND q.ord >= p.ord AND q.ord < p.nx) AS size, EXISTS (SELECT 1 FROM p c WHERE c.doc_id = p.doc_id AND c.parent = p.ord) AS inn FROM p),
r AS (SELECT * FROM n WHERE parent IS NULL UNION ALL SELECT n.* FROM r JOIN n ON n.doc_id = r.doc_id AND n.parent = r.ord WHERE r.size > 600 AND r.inn)
SELECT doc_id, ord, (size > 600 AND inn) AS is_stub FROM r WHERE NOT (size > 600 AND inn) OR own > 0"""


@query(SIZES)
def oversize_split(spark, d):
    from pyspark.sql.window import Window

    h = documents.parents(headings(spark, d))
    ends = documents.section_ends(h.withColumn("page", F.col("ord")), F.lit(10**6))
    own = F.length("title").cast("long")
    upto = F.sum(own).over(Window.partitionBy("doc_id").orderBy("ord"))
    summed = ends.withColumns({"own": own, "upto": upto})
    # the running sum at the last row of the section, less that before the section
    at_end = F.last("upto").over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(0, Window.unboundedFollowing))
    total = summed.withColumn("total", at_end)
    marks = total.select("doc_id", F.col("ord").alias("end_page"), F.col("upto").alias("end_sum"))
    sized = total.join(marks, ["doc_id", "end_page"], "left").withColumn("size", F.coalesce("end_sum", "total") - F.col("upto") + F.col("own"))
    return outline.split_oversized(sized.select("doc_id", "ord", "parent", "size", "own"), 600)


@query(f"WITH {HEADINGS}, p AS (SELECT h.doc_id, h.ord, length(h.title) AS size, (SELECT max(b.ord) FROM headings b WHERE b.doc_id = h.doc_id AND b.ord < h.ord AND b.level < h.level) AS parent FROM headings h) SELECT doc_id, parent, string_agg(CAST(size AS VARCHAR), ',' ORDER BY ord) AS children FROM p GROUP BY doc_id, parent")
def tree_children(spark, d):
    h = documents.parents(headings(spark, d)).withColumn("size", F.length("title").cast("string"))
    return outline.children_lists(h, "doc_id", "ord", "parent", "size").withColumn("children", F.array_join("children", ","))


@query("SELECT p_partkey AS id, 'cast {@spell ' || p_name || '} on ' || p_name || ' with ' || p_type AS text FROM part")
def repaired_tags(spark, d):
    text = F.concat(F.lit("cast {@spell "), "p_name", F.lit("} on {@odd "), "p_name", F.lit("} with {@item2 x|y|"), "p_type", F.lit("}"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), outline.repaired_tags(text, ["spell", "item"]).alias("text"))


@query("SELECT p_partkey AS id, 'odd' AS tag FROM part WHERE p_partkey % 2 = 0")
def unknown_tags(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("{@odd "), "p_name", F.lit("} {@spell x}"))).otherwise(F.col("p_name"))
    return documents.inline_tags(table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), "text", ["spell"])


@query("WITH a AS (SELECT l_orderkey AS doc, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS s FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1), b AS (SELECT l_orderkey AS doc, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS s FROM lineitem WHERE l_partkey % 2 = 1 GROUP BY 1) SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.s = b.s, false) AS same FROM a FULL OUTER JOIN b ON a.doc = b.doc")
def same_shape(spark, d):
    rows = table(spark, d, "lineitem").withColumn("doc", F.col("l_orderkey"))
    return outline.same_shape(rows.where("l_partkey % 2 = 0"), rows.where("l_partkey % 2 = 1"), "doc", "l_linenumber", "l_returnflag")


@query(f"WITH {HEADINGS} SELECT coalesce(b.doc_id, p.doc_id) AS doc_id, coalesce(b.ord, p.ord) AS ord, coalesce(p.size, b.size) AS size FROM (SELECT doc_id, ord, length(title) AS size FROM headings WHERE level <> 1) b FULL OUTER JOIN (SELECT doc_id, ord, -ord AS size FROM headings WHERE level IN (1, 3)) p ON b.doc_id = p.doc_id AND b.ord = p.ord")
def replaced_places(spark, d):
    h = headings(spark, d)
    base = h.where("level <> 1").select("doc_id", "ord", F.length("title").cast("long").alias("size"))
    return outline.replace_places(base, h.where("level in (1, 3)").select("doc_id", "ord", (-F.col("ord")).alias("size")), "doc_id", "ord", ["size"])


@query("SELECT p_brand AS stem, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS numbers FROM part GROUP BY p_brand")
def grouped_numbers(spark, d):
    from ..sources import grouped_listing

    files = table(spark, d, "part").select(F.concat(F.lit("dir/"), "p_brand", F.lit("-"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".md")).alias("path"))
    return grouped_listing(files, r"^(.+)-(\d+)\.md$").select("stem", F.array_join(F.array_sort(F.transform("numbers", lambda n: n.cast("string"))), ",").alias("numbers"))


@query("SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'Promotion' WHEN p_type = 'SMALL' THEN 'Small goods' WHEN p_type = 'ECONOMY' THEN 'Economy' END AS kind FROM part")
def fuzzy_kind(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), quality.fuzzy_enum(F.col("p_type"), ["Small goods", "Promotion", "Economy"]).alias("kind"))


@query("SELECT page_id AS id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def page_slugs(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), fn.slug(F.col("url")).alias("slug"), fn.extract(F.col("url"), r"^[a-z]+://([^/]+)").alias("host"))


@query(
    f"""WITH RECURSIVE {HEADINGS}, w AS (SELECT doc_id, ord, level, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x NOT IN ('', 'the', 'of'))) AS a FROM headings),
p AS (SELECT l.doc_id, l.ord AS left_ord, r.ord AS right_ord, CASE WHEN least(len(l.a), len(r.a)) > 0 THEN len(list_intersect(l.a, r.a)) / greatest(len(l.a), len(r.a)) ELSE 0.0 END AS score FROM w l JOIN w r ON r.doc_id = l.doc_id AND r.ord BETWEEN l.ord - 3 AND l.ord + 3 WHERE l.level = 1 AND r.level > 1),
s AS (SELECT * FROM p WHERE score >= 0.05), lefts AS (SELECT doc_id, left_ord, row_number() OVER (PARTITION BY doc_id ORDER BY left_ord) AS n FROM (SELECT DISTINCT doc_id, left_ord FROM s)),
g AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS left_ord, CAST(NULL AS BIGINT) AS right_ord FROM s
UNION ALL SELECT g.doc_id, l.n, list_append(g.used, arg_min(s.right_ord, (-s.score, s.right_ord))), l.left_ord, arg_min(s.right_ord, (-s.score, s.right_ord)) FROM g JOIN lefts l ON l.doc_id = g.doc_id AND l.n = g.n + 1 LEFT JOIN s ON s.doc_id = l.doc_id AND s.left_ord = l.left_ord AND NOT list_contains(g.used, s.right_ord) GROUP BY g.doc_id, l.n, l.left_ord, g.used)
SELECT doc_id, left_ord, right_ord, s.score FROM g JOIN s USING (doc_id, left_ord, right_ord)"""
)
def heading_matches(spark, d):
    # the words of a heading are told once, not for each pair
    h = headings(spark, d).select("doc_id", "ord", fn.word_set(F.col("title"), ["the", "of"]).alias("words"), "level")
    left = h.where("level = 1").select("doc_id", F.col("ord").alias("left_ord"), F.col("words").alias("l"), F.posexplode(F.sequence(F.col("ord") - 3, F.col("ord") + 3)).alias("x", "right_ord"))
    both = left.join(h.where("level > 1").select("doc_id", F.col("ord").alias("right_ord"), F.col("words").alias("r")), ["doc_id", "right_ord"])
    scored = both.select("doc_id", "left_ord", "right_ord", fn.word_overlap(F.col("l"), F.col("r")).alias("score"))
    return documents.greedy_pairs(scored, least=0.05)


@query(f"WITH {HEADINGS}, f AS (SELECT *, min(CASE WHEN level = 1 THEN ord END) OVER (PARTITION BY doc_id) AS first FROM headings) SELECT doc_id, ord, CASE WHEN level = 1 AND length(title) % 3 = 0 AND ord > first THEN 2 ELSE level END AS level FROM f")
def demoted_chapters(spark, d):
    return outline.demote_chapters(headings(spark, d), F.length("title") % 3 == 0, "doc_id", "ord", "level").select("doc_id", "ord", "level")
