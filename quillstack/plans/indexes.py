"""Queries over stored indexes and exact joins: impact-ordered search, set joins, rules by their literals, stored searches, edit logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..functions import markdown
from ..operators import edits, impact, pages, relations, rules, sketches, stored, tools
from ..staging import fresh_path
from .tables import BOOKS, HEADINGS, catalog, headings, table
from .texts import INDEX

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_PART = "max(CASE WHEN term = '{}' THEN ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean)) END)"


def _ranking(*terms: str) -> str:
    """SQL of the 30 best documents that have all terms."""
    names = ", ".join(f"'{t}'" for t in terms)
    return (
        INDEX
        + f""", dl AS (SELECT doc, sum(tf) AS dl FROM idx GROUP BY doc), f AS (SELECT count(*) AS docs, avg(dl) AS mean FROM dl), hit AS (SELECT * FROM idx WHERE term IN ({names})), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
s AS (SELECT doc, {" + ".join(_PART.format(t) for t in sorted(terms))} AS score FROM hit JOIN df USING (term) JOIN dl USING (doc) CROSS JOIN f GROUP BY doc HAVING count(*) = {len(terms)})
SELECT doc, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc LIMIT 30"""
    )


def _indexed(spark, d):
    path = fresh_path(spark, "impact-index")
    impact.write(table(spark, d, "documents"), "doc_id", ["text"], path)
    return path


@query(_ranking("under", "license"))
def fts_impact(spark, d):
    return impact.search(spark, _indexed(spark, d), ["under", "license"]).select("doc", F.round("score", 6).alias("score"))


@query(_ranking("the"))
def fts_impact_frequent(spark, d):
    return impact.search(spark, _indexed(spark, d), ["the"]).select("doc", F.round("score", 6).alias("score"))


def _relations(books: str, share: str) -> str:
    return f"""own AS (SELECT id, list_distinct(tags) AS tags, len(list_distinct(tags)) AS size FROM {books}), tagged AS (SELECT id, size, unnest(tags) AS tag FROM own),
kept AS (SELECT * FROM tagged WHERE tag IN (SELECT tag FROM tagged GROUP BY tag HAVING {share})),
pairs AS (SELECT l.id AS a, r.id AS b, l.size AS na, r.size AS nb, count(*) AS shared FROM kept l JOIN kept r ON l.tag = r.tag AND l.id < r.id GROUP BY ALL),
scored AS (SELECT a, b, shared / (na + nb - shared) AS score, shared FROM pairs WHERE shared / (na + nb - shared) >= 0.1),
relations AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM (SELECT a, b, score, shared FROM scored UNION ALL SELECT b, a, score, shared FROM scored)) WHERE place <= 10)
SELECT a, b, round(score, 6) AS score, shared, CAST(place AS INTEGER) AS place FROM relations"""


def _shown(found):
    return found.select("a", "b", F.round("score", 6).alias("score"), "shared", "place")


@query(BOOKS + ", " + _relations("visible", "count(*) BETWEEN 2 AND 500"))
def jaccard_topk_capped(spark, d):
    return _shown(relations.jaccard_relations(catalog(spark, d), most_common=500))


@query(BOOKS + ", marked AS (SELECT id, CASE WHEN id % 2 = 0 THEN list_append(tags, 'even') ELSE tags END AS tags FROM visible), " + _relations("marked", "true"))
def jaccard_hot_tag(spark, d):
    tags = F.when(F.col("id") % 2 == 0, F.array_append("tags", F.lit("even"))).otherwise(F.col("tags"))
    return _shown(relations.jaccard_relations(catalog(spark, d).withColumn("tags", tags)))


@query(
    """WITH r AS (SELECT p_partkey AS rule, CASE p_partkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'click|view' ELSE 'purchase' END AS tools, CASE WHEN p_partkey % 5 = 0 THEN 'block' ELSE 'warn' END AS action, p_name AS message, CAST(p_size % 10 AS VARCHAR) AS digit FROM part),
m AS (SELECT event_id, rule, action, message FROM (SELECT *, CAST(value AS VARCHAR) AS v FROM events) JOIN r ON (tools = '*' OR list_contains(string_split(tools, '|'), event_type))
WHERE CASE rule % 6 WHEN 0 THEN props = '{"k": ' || rule % 100 || '}' WHEN 1 THEN contains(props, '"k": ' || rule % 100 || '}') AND starts_with(v, digit) WHEN 2 THEN ends_with(props, ': ' || rule % 100 || '}') AND NOT contains(v, digit)
WHEN 3 THEN props LIKE '%k": ' || rule % 100 || '_' WHEN 4 THEN starts_with(props, '{"k": ' || rule % 100) AND event_type = 'view' ELSE v LIKE digit || '7_0%' END)
SELECT event_id, CASE WHEN bool_or(action = 'block') THEN 'block' ELSE 'warn' END AS verdict, CASE WHEN bool_or(action = 'block') THEN string_agg(message, chr(10) ORDER BY rule, message) FILTER (action = 'block') ELSE string_agg(message, chr(10) ORDER BY rule, message) FILTER (action = 'warn') END AS messages FROM m GROUP BY event_id"""
)
def rule_index_verdict(spark, d):
    part = table(spark, d, "part")
    k, digit = F.col("p_partkey"), (F.col("p_size") % 10).cast("string")
    tools = F.when(k % 3 == 0, "*").when(k % 3 == 1, "click|view").otherwise("purchase")
    known = part.select(k.alias("rule"), tools.alias("tools"), F.when(k % 5 == 0, "block").otherwise("warn").alias("action"), F.col("p_name").alias("message"))
    text = lambda before, after: F.concat(F.lit(before), (k % 100).cast("string"), F.lit(after))
    one = lambda field, operator, pattern: F.struct(F.lit(field).alias("field"), F.lit(operator).alias("operator"), pattern.alias("pattern"))
    asks = (
        F.when(k % 6 == 0, F.array(one("props", "equals", text('{"k": ', "}"))))
        .when(k % 6 == 1, F.array(one("props", "contains", text('"k": ', "}")), one("value", "starts_with", digit)))
        .when(k % 6 == 2, F.array(one("props", "ends_with", text(": ", "}")), one("value", "not_contains", digit)))
        .when(k % 6 == 3, F.array(one("props", "regex_match", text('^.*k": ', ".$"))))
        .when(k % 6 == 4, F.array(one("props", "starts_with", text('{"k": ', "")), one("event_type", "equals", F.lit("view"))))
        .otherwise(F.array(one("value", "regex_match", F.concat(F.lit("^["), digit, F.lit("]7.0")))))
    )
    conditions = part.select(k.alias("rule"), F.explode(asks).alias("c")).select("rule", "c.*")
    return rules.judged(table(spark, d, "events"), known, conditions, ["value", "props", "event_type"], tool="event_type")


# stored searches


@query(
    BOOKS
    + """, q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 4 IN (0, 1) THEN p_brand END AS pub, CASE WHEN p_partkey % 4 IN (0, 2) THEN p_type END AS sys, CASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, ' ')[1] END AS outside,
CASE WHEN p_partkey % 4 IN (1, 2) THEN 'size_' || p_size END AS tag, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 12 END AS lvl, CASE WHEN p_partkey % 4 = 3 THEN p_brand ELSE string_split(p_name, ' ')[2] END AS word FROM part)
SELECT query_id, id FROM q JOIN visible ON (pub IS NULL OR publisher = pub) AND (sys IS NULL OR game_system = sys) AND (outside IS NULL OR NOT list_contains(tags, outside)) AND (tag IS NULL OR list_contains(tags, tag)) AND (lvl IS NULL OR (min_level <= lvl AND max_level >= lvl))
AND (display_title ILIKE '%' || word || '%' OR publisher ILIKE '%' || word || '%' OR collection ILIKE '%' || word || '%' OR game_system ILIKE '%' || word || '%' OR series ILIKE '%' || word || '%')"""
)
def stored_searches(spark, d):
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    token = lambda test, *text: F.when(test, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))
    line = F.concat_ws(
        " ", token(k % 4 < 2, "pub:odd pub:", F.col("p_brand")), token((k % 4).isin(0, 2), "SYS:", F.col("p_type")), token(k % 3 == 0, "!tag:", words[0]), token((k % 4).isin(1, 2), "tag:size_", F.col("p_size").cast("string")),
        token(k % 5 == 0, "level:", (k % 12).cast("string")), F.when(k % 4 == 3, F.col("p_brand")).otherwise(words[1]),
    )
    queries = stored.from_commands(table(spark, d, "part").select(k.alias("query_id"), line.alias("text")))
    return stored.matched(queries, catalog(spark, d))


@query(
    """WITH c AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE WHEN n % 5 <> 0 AND n % 3 = 0 THEN 'S' || n % 7 END AS game_system, CASE WHEN n % 5 <> 0 THEN 'magic_items' END AS product_type,
CASE WHEN n % 5 <> 0 AND n % 2 = 0 THEN 'a,b' ELSE '' END AS tags, CASE WHEN n % 5 <> 0 AND n % 40 BETWEEN 1 AND 30 THEN n % 40 END AS level_min FROM c"""
)
def validated_intents(spark, d):
    n = F.length("text")
    system = F.when(n % 3 == 0, F.concat(F.lit('"S'), (n % 7).cast("string"), F.lit('"'))).otherwise(F.lit("null"))
    body = F.concat(F.lit('{"game_system": '), system, F.lit(', "product_type": "Magic Items", "tags": '), F.when(n % 2 == 0, '["a", 1, "b"]').otherwise("null"), F.lit(', "level_min": '), F.when(n % 3 == 1, F.concat(F.lit('"'), (n % 40).cast("string"), F.lit('"'))).otherwise((n % 40).cast("string")), F.lit("}"))
    answer = F.when(n % 5 == 0, F.concat(F.lit("sorry "), body)).when(n % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", stored.intent(answer, F.col("text")).alias("i"))
    return rows.select("conv_id", "turn", "i.game_system", "i.product_type", F.array_join("i.tags", ",").alias("tags"), "i.level_min")


# edit logs


_ACTION = "CASE event_type WHEN 'click' THEN 'undo' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'redo' ELSE 'jump' END ELSE 'push' END"
_EDITS = f"""WITH RECURSIVE e AS (SELECT user_id AS doc_id, event_id AS seq, {_ACTION} AS action, event_id % 6 AS place, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, true AS ok, CAST(-1 AS BIGINT) AS position, CAST([] AS BIGINT[]) AS entries, CAST(NULL AS BIGINT) AS entry FROM e
UNION ALL SELECT e.doc_id, e.n, e.seq, e.action, CASE e.action WHEN 'push' THEN true WHEN 'undo' THEN s.position >= 0 WHEN 'redo' THEN s.position + 1 < len(s.entries) ELSE e.place < len(s.entries) END,
CASE e.action WHEN 'push' THEN least(s.position + 1, 9) WHEN 'undo' THEN greatest(s.position - 1, -1) WHEN 'redo' THEN least(s.position + 1, len(s.entries) - 1) ELSE CASE WHEN e.place < len(s.entries) THEN e.place ELSE s.position END END,
CASE WHEN e.action = 'push' THEN CASE WHEN s.position + 1 >= 10 THEN list_append(s.entries[2 : s.position + 1], e.seq) ELSE list_append(s.entries[1 : s.position + 1], e.seq) END ELSE s.entries END,
CASE e.action WHEN 'push' THEN e.seq WHEN 'undo' THEN s.entries[CASE WHEN s.position >= 0 THEN s.position + 1 END] WHEN 'redo' THEN s.entries[s.position + 2] ELSE s.entries[e.place + 1] END
FROM s JOIN e ON e.doc_id = s.doc_id AND e.n = s.n + 1) """


def _edits(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.expr(_ACTION).alias("action"), (F.col("event_id") % 6).alias("place"))


@query(_EDITS + "SELECT doc_id, seq, action, ok, CAST(position AS INTEGER) AS position, CAST(len(entries) AS INTEGER) AS total, CASE WHEN ok THEN entry END AS entry FROM s WHERE n > 0")
def edit_states(spark, d):
    return edits.replayed(_edits(spark, d), most=10)


@query(_EDITS + ", x AS (SELECT doc_id, n, seq, unnest(entries) AS entry FROM s WHERE n > 0), r AS (SELECT doc_id, entry, min(seq) AS since, max(n) AS last FROM x GROUP BY doc_id, entry) SELECT r.doc_id, r.entry, r.since, e.seq AS until FROM r LEFT JOIN e ON e.doc_id = r.doc_id AND e.n = r.last + 1")
def edit_intervals(spark, d):
    return edits.intervals(_edits(spark, d), most=10).select("doc_id", "entry", "since", "until")


# mergeable distinct counts


@query("SELECT CAST(month AS VARCHAR) AS month, count(DISTINCT user_id) AS n, true AS near FROM (SELECT user_id, strftime(ts, '%Y-%m') AS month FROM events) GROUP BY month")
def distinct_by_month(spark, d):
    rows = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    kept = sketches.by_period(rows, "day", "user_id")
    merged = sketches.merged(kept, F.substring("day", 1, 7).alias("month"))
    exact = rows.groupBy(F.substring("day", 1, 7).alias("month")).agg(F.countDistinct("user_id").alias("n"))
    return exact.join(merged, "month").select("month", "n", (F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(1), 0.05 * F.col("n"))).alias("near"))


# the surface of tool functions


@query(
    BOOKS
    + """, hit AS (SELECT * FROM visible WHERE publisher = 'Brand#3' AND list_contains(tags, 'red') AND min_level <= 10 AND max_level >= 5), p AS (SELECT *, row_number() OVER (ORDER BY page_count DESC, id) AS nth, count(*) OVER () AS total FROM hit)
SELECT id, display_title AS title, page_count, total, CAST(ceil(total / 100) AS BIGINT) AS total_pages FROM p WHERE nth <= 100"""
)
def tool_search(spark, d):
    found = tools.search_books(catalog(spark, d), publisher="Brand#3", tags="red, ", tier=2, sort="page_count", sort_dir="desc", per_page=1000)
    return found.select("id", "title", "page_count", "total", "total_pages")


@query(BOOKS + "SELECT id, display_title AS title FROM visible WHERE list_contains(tags, 'blue') ORDER BY display_title, id LIMIT 200")
def tool_tag(spark, d):
    return tools.find_books_by_tag(catalog(spark, d), "blue", 5000).select("id", "title")


@query(BOOKS + "SELECT id, display_title AS title, page_count FROM visible WHERE game_system = 'PROMO'")
def tool_topic(spark, d):
    return tools.get_topic(catalog(spark, d), "game_system", "PROMO")[1].select("id", "title", "page_count")


# pages of topics


_LINK = "'[[' || replace({}, ' / ', ' - ') || ']]'"
_HEAD = "'---' || chr(10) || 'type: {kind}' || chr(10) || 'name: \"' || name || '\"' || chr(10) || 'book_count: ' || n{more} || chr(10) || '---' || chr(10) || chr(10) || '# ' || {title} || chr(10) || chr(10)"


def _line(label: str, links: str) -> str:
    return f" || coalesce('**{label}:** ' || {links} || chr(10) || chr(10), '')"


def _digest(rows):
    return rows.select("name", F.md5(F.col("page").cast("binary")).alias("page"))


@query(
    BOOKS
    + f""", s AS (SELECT game_system AS name, count(*) AS n FROM visible GROUP BY game_system), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS r FROM s), c AS (SELECT game_system AS name, tag, row_number() OVER (PARTITION BY game_system ORDER BY count(*) DESC, tag) AS place FROM (SELECT game_system, unnest(tags) AS tag FROM visible) GROUP BY game_system, tag),
t AS (SELECT name, string_agg({_LINK.format('tag')}, ' · ' ORDER BY place) AS tags FROM c WHERE place <= 5 GROUP BY name), a AS (SELECT x.name, string_agg({_LINK.format('y.name')}, ' · ' ORDER BY y.r) AS also FROM s x JOIN o y ON y.name <> x.name WHERE y.r <= 5 OR (y.r = 6 AND x.name IN (SELECT name FROM o WHERE r <= 5)) GROUP BY x.name)
SELECT name, md5({_HEAD.format(kind='game_system', more='', title='name')}{_line('Top tags', 'tags')}{_line('See also', 'also')}) AS page FROM s LEFT JOIN t USING (name) LEFT JOIN a USING (name)"""
)
def system_pages(spark, d):
    return _digest(pages.system_pages(catalog(spark, d)))


@query(
    BOOKS
    + f""", g AS (SELECT list_distinct(tags) AS tags, game_system FROM visible), u AS (SELECT unnest(tags) AS name, game_system, tags FROM g), s AS (SELECT name, count(*) AS n FROM u GROUP BY name),
c AS (SELECT name, game_system, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, game_system) AS place FROM u GROUP BY name, game_system), t AS (SELECT name, string_agg({_LINK.format('game_system')}, ' · ' ORDER BY place) AS systems FROM c WHERE place <= 5 GROUP BY name),
p AS (SELECT name, other, count(*) AS k FROM (SELECT name, unnest(tags) AS other FROM u) WHERE other <> name GROUP BY name, other), q AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k DESC, other) AS place FROM p), r AS (SELECT name, string_agg({_LINK.format('other')}, ' · ' ORDER BY place) AS related FROM q WHERE place <= 8 GROUP BY name)
SELECT name, md5({_HEAD.format(kind='tag', more='', title="replace(name, '_', ' ')")}{_line('Game systems', 'systems')}{_line('Related tags', 'related')}) AS page FROM s LEFT JOIN t USING (name) LEFT JOIN r USING (name)"""
)
def tag_pages(spark, d):
    return _digest(pages.tag_pages(catalog(spark, d)))


@query(
    BOOKS
    + f""", s AS (SELECT series AS name, count(*) AS n, arg_min(game_system, id) AS sys, arg_min(publisher, id) AS pub FROM visible WHERE series IS NOT NULL GROUP BY series), c AS (SELECT name, tag, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, tag) AS place FROM (SELECT series AS name, unnest(tags) AS tag FROM visible WHERE series IS NOT NULL) GROUP BY name, tag),
t AS (SELECT name, string_agg({_LINK.format('tag')}, ' · ' ORDER BY place) AS tags FROM c WHERE place <= 5 GROUP BY name)
SELECT name, md5({_HEAD.format(kind='series', more=" || chr(10) || 'game_system: \"' || sys || '\"' || chr(10) || 'publisher: \"' || pub || '\"'", title='name')}{_line('System', _LINK.format('sys'))}{_line('Publisher', _LINK.format('pub'))}{_line('Tags', 'tags')}) AS page FROM s LEFT JOIN t USING (name)"""
)
def series_pages(spark, d):
    return _digest(pages.series_pages(catalog(spark, d)))


def _largest(rows: str, most: int) -> str:
    return f"coalesce((SELECT string_agg({_LINK.format('v')} || ' (' || n || ')', ' · ' ORDER BY n DESC, v) FROM (SELECT v, count(*) AS n FROM (SELECT {rows} AS v FROM visible) WHERE v IS NOT NULL GROUP BY v ORDER BY n DESC, v LIMIT {most})), '')"


@query(
    BOOKS
    + "SELECT 'home' AS name, md5('---' || chr(10) || 'type: home' || chr(10) || '---' || chr(10) || chr(10) || '**' || count(*) || ' books** · **' || count(date_enriched) || ' enriched**'"
    + "".join(f" || chr(10) || chr(10) || '## {title}' || chr(10) || chr(10) || {_largest(rows, most)}" for title, rows, most in (("Game systems", "game_system", 20), ("Tags", "unnest(tags)", 40), ("Series", "series", 20), ("Publishers", "publisher", 20)))
    + ") AS page FROM visible"
)
def home_page(spark, d):
    return _digest(pages.home_page(catalog(spark, d)))


# a second catalog


@query(BOOKS + "SELECT publisher, count(*) AS n, count(s_suppkey) AS favorites FROM books LEFT JOIN supplier ON s_suppkey = id GROUP BY publisher")
def attached_catalog(spark, d):
    sources.attach(spark, d, "personal", ["supplier"])
    return spark.sql("SELECT publisher, count(*) AS n, count(s_suppkey) AS favorites FROM {books} b LEFT JOIN personal.supplier f ON f.s_suppkey = b.id GROUP BY publisher", books=catalog(spark, d))


# formatted texts


@query(
    f"""WITH {HEADINGS}, h AS (SELECT *, length(title) AS n, regexp_replace(title, '([\\\\*_`\\[\\]])', '\\\\\\1', 'g') AS safe FROM headings), r AS (SELECT *, CASE WHEN title = '' THEN '' ELSE CASE WHEN n % 6 = 0 THEN '[' ELSE '' END || CASE WHEN n % 5 = 0 AND level > 1 THEN '~~' ELSE '' END || CASE WHEN n % 3 = 0 AND level > 1 THEN '**' ELSE '' END || CASE WHEN n % 7 = 0 THEN '`' || title || '`' ELSE safe END
|| CASE WHEN n % 3 = 0 AND level > 1 THEN '**' ELSE '' END || CASE WHEN n % 5 = 0 AND level > 1 THEN '~~' ELSE '' END || CASE WHEN n % 6 = 0 THEN '](u' || n || ')' ELSE '' END END AS line FROM h),
e AS (SELECT doc_id, ord, CASE level WHEN 1 THEN CASE WHEN trim(line) = '' THEN '' ELSE '## ' || line END WHEN 2 THEN CASE WHEN trim(line) = '' THEN '' ELSE line END WHEN 3 THEN '  1. ' || line ELSE '| ' || replace(title, '|', '\\|') || ' | ' || n || ' |' || chr(10) || '| --- | --- |' END AS line FROM r)
SELECT doc_id, md5(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY ord), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') || chr(10)) AS page FROM e GROUP BY doc_id"""
)
def markdown_documents(spark, d):
    n = F.length("title")
    run = F.struct(F.col("title").alias("text"), (n % 3 == 0).alias("bold"), F.lit(False).alias("italic"), (n % 5 == 0).alias("strike"), F.when(n % 7 == 0, "Consolas").alias("font"), F.when(n % 6 == 0, F.concat(F.lit("u"), n.cast("string"))).alias("link"), F.lit(None).cast("boolean").alias("image"))
    kind = F.when(F.col("level") <= 2, "paragraph").when(F.col("level") == 3, "item").otherwise("table")
    depth = F.when(F.col("level") == 1, 2).when(F.col("level") == 2, 0).otherwise(1)
    one = F.struct("ord", kind.alias("kind"), depth.alias("level"), F.lit(True).alias("ordered"), F.array(run).alias("runs"), F.array(F.array(F.col("title"), n.cast("string"))).alias("rows"))
    rows = headings(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(one), lambda a, b: (a["ord"] - b["ord"]).cast("int")).alias("elements"))
    return rows.select("doc_id", F.md5(markdown.document(F.col("elements")).cast("binary")).alias("page"))
