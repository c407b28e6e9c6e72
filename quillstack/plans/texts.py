"""Queries over texts: full-text search, headings, nested documents, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import documents, fulltext
from ..sources import chunked, salvaged
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


INDEX = "WITH words AS (SELECT doc_id AS doc, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM documents), idx AS (SELECT term, doc, count(*) AS tf FROM words GROUP BY ALL)"


def _index(spark, d):
    return fulltext.postings(table(spark, d, "documents"), "doc_id", ["text"])


@query(INDEX + " SELECT doc FROM idx WHERE term IN ('the', 'and', 'with') GROUP BY doc HAVING count(*) = 3")
def fts_match(spark, d):
    return fulltext.matching(_index(spark, d), ["the", "and", "with"])


@query(INDEX + ", dl AS (SELECT doc, sum(tf) AS dl FROM idx GROUP BY doc) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM idx GROUP BY term")
def fts_index(spark, d):
    return _index(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(
    INDEX
    + """, dl AS (SELECT doc, sum(tf) AS dl FROM idx GROUP BY doc), f AS (SELECT count(*) AS docs, avg(dl) AS mean FROM dl), hit AS (SELECT * FROM idx WHERE term IN ('under', 'license')), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
both_ AS (SELECT doc FROM hit GROUP BY doc HAVING count(*) = 2)
SELECT doc, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score FROM hit JOIN both_ USING (doc) JOIN df USING (term) JOIN dl USING (doc) CROSS JOIN f GROUP BY doc"""
)
def fts_bm25(spark, d):
    return fulltext.bm25(_index(spark, d), ["under", "license"], most=None).select("doc", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%MIT license%' OR source ILIKE '%MIT license%'")
def fts_fallback(spark, d):
    return fulltext.like_fallback(table(spark, d, "documents"), "MIT license", ["text", "source"]).select("doc_id")


@query("SELECT conv_id, turn, array_to_string(list_slice(string_split(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), 1, 12), ' ') AS keywords FROM conversations WHERE role = 'user'")
def query_keywords(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", fn.keywords(F.col("text")).alias("keywords"))


@query(f"WITH {HEADINGS} SELECT h.doc_id, h.ord, (SELECT max(b.ord) FROM headings b WHERE b.doc_id = h.doc_id AND b.ord < h.ord AND b.level < h.level) AS parent FROM headings h")
def parent_of(spark, d):
    return documents.parents(headings(spark, d), levels=range(1, 5)).select("doc_id", "ord", "parent")


@query(
    f"""WITH {HEADINGS}, n AS (SELECT h.doc_id, h.ord, h.page, (SELECT min(b.ord) FROM headings b WHERE b.doc_id = h.doc_id AND b.ord > h.ord AND b.level <= h.level) AS nx FROM headings h)
SELECT n.doc_id, n.ord, n.page, greatest(n.page, coalesce(b.page - 1, 9999)) AS end_page FROM n LEFT JOIN headings b ON b.doc_id = n.doc_id AND b.ord = n.nx"""
)
def toc_ranges(spark, d):
    return documents.section_ends(headings(spark, d), F.lit(9999), levels=range(1, 5)).select("doc_id", "ord", "page", "end_page")


@query(f"WITH {HEADINGS} SELECT doc_id, ord, CAST(sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS section_no FROM headings")
def section_fold(spark, d):
    return documents.fold_sections(headings(spark, d), F.col("level") == 1).select("doc_id", "ord", "section_no")


@query(f"WITH {HEADINGS} SELECT doc_id, ord, coalesce(bool_or(level = 3) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past FROM headings")
def after_keyed(spark, d):
    return documents.after_first(headings(spark, d), F.col("level") == 3).select("doc_id", "ord", "past")


@query(f"WITH {HEADINGS}, h4 AS (SELECT doc_id, ord, title, page // 2 AS page FROM headings), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, title, page ORDER BY ord) AS r FROM h4) WHERE r = 1) SELECT doc_id, ord FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS many, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS nth FROM once) WHERE many < 3 OR nth = 1")
def toc_dedupe(spark, d):
    return documents.dedupe_toc(headings(spark, d).withColumn("page", F.floor(F.col("page") / 2))).select("doc_id", "ord")


@query(
    f"""WITH {HEADINGS}, k AS (SELECT doc_id, ord, CASE WHEN level = 2 THEN length(title) END AS o FROM headings)
SELECT a.doc_id, a.ord, CAST(coalesce(a.o, (SELECT arg_min(b.o, abs(b.ord - a.ord) * 2 + CASE WHEN b.ord > a.ord THEN 1 ELSE 0 END) FROM k b WHERE b.doc_id = a.doc_id AND b.o IS NOT NULL)) AS BIGINT) AS used_offset FROM k a"""
)
def nearest_offset(spark, d):
    rows = headings(spark, d)
    offset = F.when(F.col("level") == 2, F.length("title").cast("long"))
    return documents.nearest_offset(rows, offset, place="ord").select("doc_id", "ord", "used_offset")


@query(f"WITH {HEADINGS}, l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos, ord FROM headings WHERE level <= 2), r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos, ord FROM headings WHERE level > 2) SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.pos, r.pos) AS pos, l.ord AS left_ord, r.ord AS right_ord FROM l FULL OUTER JOIN r ON l.doc_id = r.doc_id AND l.pos = r.pos")
def positional_zip(spark, d):
    h = headings(spark, d).select("doc_id", "ord", "level")
    return documents.positional_zip(h.where("level <= 2"), h.where("level > 2")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("left.ord").alias("left_ord"), F.col("right.ord").alias("right_ord"))


@query(f"WITH {HEADINGS}, n AS (SELECT doc_id, count(*) AS shift FROM headings WHERE level = 4 GROUP BY doc_id) SELECT doc_id, ord, CASE WHEN ord >= 2 THEN ord + coalesce(shift, 0) ELSE ord END AS pos FROM headings LEFT JOIN n USING (doc_id) WHERE level <> 4 UNION ALL SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 + 2 FROM headings WHERE level = 4")
def list_splice(spark, d):
    h = headings(spark, d).select("doc_id", "ord", "level", F.col("ord").alias("pos"))
    return documents.splice(h.where("level <> 4"), h.where("level = 4"), 2).select("doc_id", "ord", F.col("pos").cast("long").alias("pos"))


@query(
    f"""WITH RECURSIVE {HEADINGS}, h AS (SELECT doc_id, ord, length(title) AS size FROM headings), r AS (SELECT doc_id, ord, size, size AS used, 0 AS bin FROM h WHERE ord = 0
UNION ALL SELECT h.doc_id, h.ord, h.size, CASE WHEN r.used > 0 AND r.used + h.size > 2000 THEN h.size ELSE r.used + h.size END, r.bin + CASE WHEN r.used > 0 AND r.used + h.size > 2000 THEN 1 ELSE 0 END FROM r JOIN h ON h.doc_id = r.doc_id AND h.ord = r.ord + 1) SELECT doc_id, ord, size, bin FROM r"""
)
def chunk_split(spark, d):
    h = headings(spark, d).withColumn("size", F.length("title"))
    return documents.chunk_bins(h.select("doc_id", "ord", "size"), "size", 2000)


def _last(mark: str, n: int) -> str:
    """SQL of the last place (from 0) of a mark of n characters within those after the first of a rest of over 1000."""
    return f"(CASE WHEN contains(substr(rest, 2, 1000), {mark}) THEN 1002 - {n} - instr(reverse(substr(rest, 2, 1000)), {mark}) ELSE 0 END)"


_CUT = f"coalesce(nullif({_last('chr(10) || chr(10)', 2)}, 0), nullif({_last('chr(10)', 1)}, 0), nullif({_last('chr(32)', 1)}, 0), 1000)"


@query(
    f"""WITH RECURSIVE p AS (SELECT doc_id, 0 AS piece, text AS rest FROM documents WHERE length(text) > 0 UNION ALL SELECT * FROM (SELECT doc_id, piece + 1, regexp_replace(substr(rest, {_CUT} + 1), '^\\s+', '') AS rest FROM p WHERE length(rest) > 1000) WHERE rest <> '')
SELECT doc_id, piece, CASE WHEN length(rest) > 1000 THEN {_CUT} ELSE length(rest) END AS size FROM p"""
)
def text_pieces(spark, d):
    return chunked(table(spark, d, "documents"), "doc_id", "text", 1000).select("doc_id", "piece", F.length("part").alias("size"))


def _nested(spark, d):
    """The headings of each document as a nested JSON document, a section a heading, with its title as text."""
    entry = F.struct(F.lit("section").alias("type"), F.when(F.col("level") != 4, F.col("title")).alias("name"), F.concat(F.lit("s"), F.col("level").cast("string")).alias("id"), F.array("title").alias("entries"), "ord")
    body = F.transform(F.array_sort(F.collect_list(entry), lambda a, b: (a["ord"] - b["ord"]).cast("int")), lambda e: F.struct(*[e[n].alias(n) for n in ("type", "name", "id", "entries")]))
    return headings(spark, d).groupBy("doc_id").agg(F.to_json(F.struct(body.alias("data"))).alias("body"))


@query(f"WITH {HEADINGS}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i FROM headings) SELECT doc_id, CAST(2 * i AS INTEGER) AS ord, 'data[' || i || ']' AS path, 'section' AS type, length(title) AS size, 's' || level AS node_id FROM h UNION ALL SELECT doc_id, CAST(2 * i + 1 AS INTEGER), 'data[' || i || '].entries[0]', 'text', length(title), NULL FROM h")
def doc_nodes(spark, d):
    nodes = documents.flatten_documents(_nested(spark, d))
    flat = nodes.select("doc_id", "ord", "path", "type", "node_id", F.length("text").alias("own"), F.floor(F.col("ord") / 2).alias("pair"))
    sizes = flat.groupBy("doc_id", "pair").agg(F.max("own").cast("long").alias("size"))
    return flat.join(sizes, ["doc_id", "pair"]).select("doc_id", "ord", "path", "type", "size", "node_id")


@query(
    f"""WITH {HEADINGS}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i, row_number() OVER (PARTITION BY doc_id, level ORDER BY ord) AS nth FROM headings)
SELECT doc_id, 'data[' || i || ']' AS path, 'error' AS severity, 'a section has no name' AS message FROM h WHERE level = 4 OR title = '' UNION ALL SELECT doc_id, 'data[' || i || ']', 'error', 'an id repeats' FROM h WHERE nth > 1
UNION ALL SELECT doc_id, 'data[' || i || '].entries[0]', 'warning', 'a text is empty' FROM h WHERE trim(title) = ''"""
)
def doc_validate(spark, d):
    return documents.validate_nodes(documents.flatten_documents(_nested(spark, d)))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\*\\*\\*')) AS BIGINT) AS stars, regexp_replace(text, '[^a-z]+', '', 'g') = '' AS bare FROM documents")
def text_marks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\*\*\*"), 0)).cast("long").alias("stars"), (F.regexp_replace("text", "[^a-z]+", "") == "").alias("bare"))


@query(f"WITH {HEADINGS}, w AS (SELECT doc_id, ord, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x NOT IN ('', 'the', 'of'))) AS a FROM headings), p AS (SELECT w.doc_id, w.ord, w.a, n.a AS b FROM w JOIN w n ON n.doc_id = w.doc_id AND n.ord = w.ord + 1) SELECT doc_id, ord, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / greatest(len(a), len(b)) ELSE 0.0 END, 6) AS overlap FROM p")
def heading_overlap(spark, d):
    h = headings(spark, d).select("doc_id", "ord", fn.word_set(F.col("title"), ["the", "of"]).alias("words"))
    nxt = h.select("doc_id", (F.col("ord") - 1).alias("ord"), F.col("words").alias("other"))
    return h.join(nxt, ["doc_id", "ord"]).select("doc_id", "ord", F.round(fn.word_overlap(F.col("words"), F.col("other")), 6).alias("overlap"))


@query("SELECT event_id, '[{\"k\": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}]' AS json FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'error'")
def salvaged_records(spark, d):
    broken = F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n["), "props", F.lit("]\n```"))).when(F.col("event_type") == "error", F.lit("none")).otherwise(F.concat(F.lit("["), "props", F.lit(', {"k": 1, "l": [')))
    return table(spark, d, "events").select("event_id", salvaged(broken).alias("json"))
