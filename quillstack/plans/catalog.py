"""Queries over the catalog: search, facets, relations, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import facets, quality, relations, search
from ..operators.search import SearchSpec
from .tables import BOOKMARKS, BOOKS, bookmarks, catalog, favorites, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


FOLD = "CASE WHEN coalesce(collection, '') = '' THEN 'id:' || id ELSE lower(trim(coalesce(publisher, ''))) || '||' || lower(trim(replace(replace(replace(collection, '–', '-'), '—', '-'), '  ', ' '))) END"


@query(BOOKS + "SELECT id, display_title, publisher FROM visible WHERE display_title ILIKE '%ring%' OR publisher ILIKE '%ring%' OR collection ILIKE '%ring%' OR game_system ILIKE '%ring%' OR series ILIKE '%ring%' ORDER BY display_title, id LIMIT 20 OFFSET 20")
def search_flat(spark, d):
    return search.search(catalog(spark, d), SearchSpec(q="ring", page=2, per_page=20)).select("id", "display_title", "publisher")


@query(
    BOOKS
    + f""", keyed AS (SELECT *, {FOLD} AS group_key FROM visible WHERE min_level <= 9 AND max_level >= 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY page_count DESC NULLS LAST, id) AS place FROM keyed),
groups AS (SELECT group_key, count(*) AS variant_count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) AS variant_ids FROM ranked GROUP BY group_key)
SELECT id, display_title, group_key, variant_count, variant_ids FROM ranked JOIN groups USING (group_key) WHERE place = 1 ORDER BY page_count DESC NULLS LAST, id LIMIT 50"""
)
def search_grouped(spark, d):
    spec = SearchSpec(level_min=2, level_max=9, sort="page_count", descending=True)
    return search.search_grouped(catalog(spark, d), spec).select("id", "display_title", "group_key", "variant_count", F.array_join(F.transform("variant_ids", lambda x: x.cast("string")), ",").alias("variant_ids"))


@query(BOOKS + "SELECT id, min_level, max_level FROM books WHERE NOT is_old_version AND NOT is_draft AND min_level <= 6 AND max_level >= 6")
def search_level_overlap(spark, d):
    spec = SearchSpec(level_max=6, include_duplicates=True)
    return catalog(spark, d).where(search.predicate(spec)).select("id", "min_level", "max_level")


@query(BOOKS + "SELECT id, min_level, max_level FROM visible WHERE min_level <= 16 AND max_level >= 11")
def search_by_tier(spark, d):
    return catalog(spark, d).where(search.predicate(SearchSpec(tier=3, level_min=1))).select("id", "min_level", "max_level")


@query(BOOKS + "SELECT id, display_title FROM visible WHERE list_contains(tags, 'red') AND list_contains(tags, 'STANDARD') AND NOT list_contains(tags, 'gear') AND NOT list_contains(tags, 'Brand#3')")
def search_tags_all_none(spark, d):
    spec = SearchSpec(tags=["red", "STANDARD"], not_tags=["gear", "Brand#3"])
    return catalog(spark, d).where(search.predicate(spec)).select("id", "display_title")


@query(BOOKS + "SELECT id, game_system, s_suppkey IS NOT NULL AS is_favorite FROM visible LEFT JOIN supplier ON s_suppkey = id WHERE game_system = 'PROMO'")
def search_favorites(spark, d):
    return search.with_favorites(catalog(spark, d).where(search.predicate(SearchSpec(equal={"game_system": "PROMO"}))), favorites(spark, d)).select("id", "game_system", "is_favorite")


@query(BOOKS + "SELECT id, display_title FROM visible WHERE id IN (SELECT s_suppkey FROM supplier)")
def search_only_favorites(spark, d):
    return search.only_favorites(catalog(spark, d).where(search.visible()), favorites(spark, d)).select("id", "display_title")


@query(BOOKS + "SELECT id, display_title, page_count FROM books WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def books_by_ids(spark, d):
    asked = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("id"))
    return search.by_ids(catalog(spark, d), asked).select("id", "display_title", "page_count")


@query(BOOKS + "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM visible WHERE publisher = 'Brand#7'")
def search_pages(spark, d):
    return search.page_count(catalog(spark, d), SearchSpec(equal={"publisher": "Brand#7"}))


@query(BOOKS + "SELECT id, tier FROM books JOIN (VALUES (1, 1, 4), (2, 5, 10), (3, 11, 16), (4, 17, 20)) t(tier, lo, hi) ON min_level <= hi AND max_level >= lo")
def tier_labels(spark, d):
    return search.tier_labels(catalog(spark, d))


@query(BOOKS + f"SELECT id, display_title, coalesce(string_agg(title || level, ',' ORDER BY ord, level, title), '') AS marks, count(ord) AS n FROM books LEFT JOIN {BOOKMARKS} ON book_id = id GROUP BY id, display_title")
def book_detail(spark, d):
    out = search.detail(catalog(spark, d), bookmarks(spark, d))
    marks = F.coalesce("bookmarks", F.array())
    return out.select("id", "display_title", F.array_join(F.transform(marks, lambda b: F.concat(b["title"], b["level"].cast("string"))), ",").alias("marks"), F.size(marks).cast("long").alias("n"))


@query(BOOKS + "SELECT id, publisher FROM visible WHERE date_enriched IS NULL")
def enrichment_queue(spark, d):
    return search.work_queue(catalog(spark, d)).select("id", "publisher")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def skip_set(spark, d):
    done = favorites(spark, d).select(F.col("book_id").alias("p_partkey"))
    failed = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return search.not_done(table(spark, d, "part").select("p_partkey"), done, failed, key="p_partkey")


@query("SELECT coalesce(s_suppkey + 0, p_partkey) AS id, coalesce(s_acctbal, p_retailprice) AS price FROM part FULL JOIN supplier ON s_suppkey = p_partkey")
def state_upsert(spark, d):
    old = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("price"))
    return search.upsert(old, new, ["id"])


LONG = "(SELECT 'publisher' AS dim, publisher AS value, {c} FROM {t} UNION ALL SELECT 'game_system', game_system, {c} FROM {t} UNION ALL SELECT 'series', series, {c} FROM {t} WHERE series IS NOT NULL UNION ALL SELECT 'tag', unnest(tags), {c} FROM {t})"


@query(BOOKS + ", found AS (SELECT * FROM visible WHERE display_title ILIKE '%bolt%') SELECT dim, value, count(*) AS n FROM " + LONG.format(c="id", t="found") + " GROUP BY dim, value UNION ALL SELECT 'total', '', count(*) FROM found")
def facets_all(spark, d):
    found = catalog(spark, d).where(search.predicate(SearchSpec(q="bolt", text_columns=("display_title",))))
    total = found.agg(F.lit("total").alias("dim"), F.lit("").alias("value"), F.count(F.lit(1)).alias("n"))
    return facets.facets(found).unionByName(total)


@query(BOOKS + ", cur AS (SELECT * FROM books WHERE NOT is_old_version) SELECT dim, value, count(*) AS n FROM " + LONG.format(c="id", t="cur") + " GROUP BY dim, value")
def filters_all(spark, d):
    return facets.filter_options(catalog(spark, d))


@query(BOOKS + "SELECT count(*) AS total, count(date_enriched) AS enriched, count(*) FILTER (is_draft) AS drafts, count(*) FILTER (is_duplicate) AS duplicates, CAST(sum(page_count) AS BIGINT) AS pages FROM books WHERE NOT is_old_version")
def library_stats(spark, d):
    return facets.library_stats(catalog(spark, d))


@query(
    BOOKS
    + ", found AS (SELECT * FROM visible WHERE game_system = 'ECONOMY'), counts AS (SELECT dim, value, count(*) AS n FROM "
    + LONG.format(c="id", t="found")
    + " WHERE dim <> 'game_system' GROUP BY dim, value) SELECT dim, value, n FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) AS place FROM counts) WHERE place <= CASE dim WHEN 'tag' THEN 15 ELSE 10 END UNION ALL SELECT 'total', '', count(*) FROM found UNION ALL SELECT 'enriched', '', count(date_enriched) FROM found"
)
def topic_stats(spark, d):
    return facets.topic_stats(catalog(spark, d), "game_system", "ECONOMY")


@query(BOOKS + "SELECT name, n FROM (SELECT publisher AS name, count(*) AS n FROM visible GROUP BY publisher ORDER BY n DESC, name LIMIT 10) WHERE name NOT IN (SELECT p_brand FROM part WHERE p_partkey < 5)")
def topic_top_n(spark, d):
    written = table(spark, d, "part").where("p_partkey < 5").select(F.col("p_brand").alias("name"))
    return facets.top_topics(catalog(spark, d), "publisher", 10, written)


@query(BOOKS + "SELECT publisher AS value, count(*) AS n FROM visible GROUP BY publisher HAVING count(*) >= 5")
def having_min_books(spark, d):
    return facets.at_least(catalog(spark, d), "publisher", 5)


@query(
    BOOKS
    + ", own AS (SELECT list_distinct(tags) AS tags FROM visible), pairs AS (SELECT tag, unnest(tags) AS other FROM (SELECT unnest(tags) AS tag, tags FROM own)), counts AS (SELECT tag, other, count(*) AS n FROM pairs WHERE tag <> other GROUP BY tag, other) SELECT tag, other, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, other) AS place FROM counts) WHERE place <= 8"
)
def tag_cooccurrence(spark, d):
    return facets.tag_cooccurrence(catalog(spark, d))


@query(BOOKS + ", counts AS (SELECT topic, tag, count(*) AS n FROM (SELECT game_system AS topic, unnest(tags) AS tag FROM visible) GROUP BY topic, tag) SELECT topic, tag, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, tag) AS place FROM counts) WHERE place <= 5")
def system_top_tags(spark, d):
    return facets.top_tags_by(catalog(spark, d), "game_system")


@query(BOOKS + "SELECT series, count(*) AS n, arg_min(game_system, id) AS game_system, arg_min(publisher, id) AS publisher FROM visible WHERE series IS NOT NULL GROUP BY series")
def series_info(spark, d):
    return facets.series_info(catalog(spark, d))


@query(BOOKS + "SELECT id, page_count FROM visible WHERE publisher = 'Brand#2' ORDER BY page_count DESC NULLS LAST, id LIMIT 20")
def topic_sample(spark, d):
    return facets.sample_of_topic(catalog(spark, d), F.col("publisher") == "Brand#2").select("id", "page_count")


def _relations(kept: str) -> str:
    return f""", own AS (SELECT id, list_distinct(tags) AS tags, len(list_distinct(tags)) AS size FROM visible), tagged AS (SELECT id, size, unnest(tags) AS tag FROM own),
{kept},
pairs AS (SELECT l.id AS a, r.id AS b, l.size AS na, r.size AS nb, count(*) AS shared FROM kept l JOIN kept r ON l.tag = r.tag AND l.id < r.id GROUP BY ALL),
scored AS (SELECT a, b, shared / (na + nb - shared) AS score, shared FROM pairs WHERE shared / (na + nb - shared) >= 0.1),
relations AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM (SELECT a, b, score, shared FROM scored UNION ALL SELECT b, a, score, shared FROM scored)) WHERE place <= 10)
"""


RELATIONS = _relations("kept AS (SELECT * FROM tagged)")
# with the catalog's cut: tags of more than 500 titles don't count
CUT_RELATIONS = _relations("rare AS (SELECT tag FROM tagged GROUP BY tag HAVING count(*) BETWEEN 2 AND 500), kept AS (SELECT * FROM tagged WHERE tag IN (SELECT tag FROM rare))")


@query(BOOKS + RELATIONS + "SELECT a, b, round(score, 6) AS score, shared, CAST(place AS INTEGER) AS place FROM relations")
def jaccard_topk(spark, d):
    return relations.jaccard_relations(catalog(spark, d)).select("a", "b", F.round("score", 6).alias("score"), "shared", "place")


@query(BOOKS + RELATIONS + ", seen AS (SELECT a, b, display_title, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS nth FROM relations JOIN visible ON id = b) SELECT a, b, display_title, CAST(nth AS INTEGER) AS nth FROM seen WHERE nth <= 6")
def related_precomputed(spark, d):
    books = catalog(spark, d)
    return relations.related(relations.jaccard_relations(books), books).select("a", "b", "display_title", "nth")


@query(
    BOOKS
    + CUT_RELATIONS
    + """, chosen AS (SELECT * FROM books WHERE id NOT IN (SELECT a FROM relations WHERE score >= 0.5)), w AS (SELECT l.id AS a, r.id AS b, 1 AS w FROM (SELECT id, unnest(list_distinct(tags)) AS tag FROM chosen) l JOIN (SELECT id, unnest(list_distinct(tags)) AS tag FROM visible) r USING (tag) WHERE l.id <> r.id
UNION ALL SELECT c.id, v.id, 10 FROM chosen c JOIN visible v ON c.series = v.series WHERE c.id <> v.id), s AS (SELECT a, b, CAST(sum(w) AS BIGINT) AS weight FROM w GROUP BY a, b)
SELECT a, b, weight, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS nth FROM s) WHERE nth <= 6"""
)
def related_fallback(spark, d):
    books = catalog(spark, d)
    alone = books.join(relations.jaccard_relations(books, most_common=500).where("score >= 0.5").select(F.col("a").alias("id")), "id", "left_anti")
    return relations.related_by_tags(books, alone)


GRAPH = """, best AS (SELECT a, b, score FROM relations WHERE a < b AND score >= 0.25 ORDER BY score DESC, a, b LIMIT 900), nodes AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM best UNION ALL SELECT b FROM best) GROUP BY id ORDER BY degree DESC, id LIMIT 300) """


@query(BOOKS + RELATIONS + GRAPH + "SELECT a, b, round(score, 6) AS score FROM best WHERE a IN (SELECT id FROM nodes) AND b IN (SELECT id FROM nodes)")
def similarity_graph(spark, d):
    books = catalog(spark, d)
    _, edges = relations.graph(relations.jaccard_relations(books), books)
    return edges.select("a", "b", F.round("score", 6).alias("score"))


@query(BOOKS + RELATIONS + ", best AS (SELECT a, b, score FROM relations WHERE a < b AND score >= 0.25 AND a IN (SELECT id FROM books WHERE game_system IN ('PROMO', 'SMALL')) AND b IN (SELECT id FROM books WHERE game_system IN ('PROMO', 'SMALL')) ORDER BY score DESC, a, b LIMIT 900), nodes AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM best UNION ALL SELECT b FROM best) GROUP BY id ORDER BY degree DESC, id LIMIT 300) SELECT a, b, round(score, 6) AS score FROM best WHERE a IN (SELECT id FROM nodes) AND b IN (SELECT id FROM nodes)")
def similarity_graph_of_systems(spark, d):
    books = catalog(spark, d)
    _, edges = relations.graph(relations.jaccard_relations(books), books, systems=["PROMO", "SMALL"])
    return edges.select("a", "b", F.round("score", 6).alias("score"))


@query(BOOKS + RELATIONS + GRAPH + "SELECT id, degree FROM nodes")
def similarity_graph_nodes(spark, d):
    books = catalog(spark, d)
    return relations.graph(relations.jaccard_relations(books), books)[0]


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY coalesce(text, ''), n_chars, coalesce(lang, '') ORDER BY doc_id) AS nth FROM documents) WHERE nth > 1")
def content_duplicates(spark, d):
    # a digest stands for the text in the shuffle
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "n_chars", "lang")
    return quality.content_duplicates(docs, ["digest", "n_chars", "lang"], "doc_id").select("doc_id")


PRINTS = BOOKS + f""", marks AS (SELECT book_id, string_agg(concat_ws('|', level, title, coalesce(CAST(page_number AS VARCHAR), 'None')), chr(10) ORDER BY ord, concat_ws('|', level, title, coalesce(CAST(page_number AS VARCHAR), 'None'))) AS m FROM {BOOKMARKS} GROUP BY book_id),
src AS (SELECT id, CASE WHEN id % 2 = 0 THEN text ELSE '' END AS first_page_text, display_title AS filename FROM books LEFT JOIN documents ON doc_id = id),
prints AS (SELECT id, sha256(coalesce(m, nullif(first_page_text, ''), filename)) AS fingerprint, CASE WHEN m IS NOT NULL THEN 'bookmarks' WHEN nullif(first_page_text, '') IS NOT NULL THEN 'first_page_text' ELSE 'filename' END AS method FROM src LEFT JOIN marks ON book_id = id)
"""


def _prints(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    src = catalog(spark, d).join(docs, "id", "left").select("id", F.when(F.col("id") % 2 == 0, F.col("text")).otherwise("").alias("first_page_text"), F.col("display_title").alias("filename"))
    return quality.fingerprint(src, bookmarks(spark, d))


@query(PRINTS + "SELECT * FROM prints")
def fingerprint(spark, d):
    return _prints(spark, d)


@query(PRINTS + "SELECT method, count(*) AS n, count(*) - count(DISTINCT fingerprint) AS collisions FROM prints GROUP BY method")
def fingerprint_coverage(spark, d):
    return quality.coverage(_prints(spark, d))


@query(PRINTS + ", saved AS (SELECT fingerprint, arg_max(id, id) AS value FROM prints GROUP BY fingerprint) SELECT id, fingerprint, value FROM prints JOIN saved USING (fingerprint) WHERE id NOT IN (SELECT id FROM books WHERE date_enriched IS NOT NULL)")
def restore_by_fingerprint(spark, d):
    prints = _prints(spark, d)
    saved = prints.select("fingerprint", F.col("id").alias("seq"), F.col("id").alias("value"))
    return quality.restore(prints, saved, catalog(spark, d).where("date_enriched is not null").select("id"))


@query("SELECT p_partkey AS id, nullif(trim(regexp_replace(trim(regexp_replace(replace(raw, '–', '-'), '\\s+', ' ', 'g')), '[\\s:,\\-]+$', '')), '') AS series FROM (SELECT p_partkey, '  ' || p_brand || '  –  ' || p_type || CASE p_partkey % 3 WHEN 0 THEN ' : ' WHEN 1 THEN ',-' ELSE '' END AS raw FROM part)")
def normalize_series(spark, d):
    tail = F.when(F.col("p_partkey") % 3 == 0, " : ").when(F.col("p_partkey") % 3 == 1, ",-").otherwise("")
    raw = F.concat(F.lit("  "), "p_brand", F.lit("  –  "), "p_type", tail)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), fn.normal_series(raw).alias("series"))


@query("SELECT p_partkey AS id, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT p_partkey, list_filter([CASE w1 WHEN 'crimson' THEN 'red' ELSE w1 END, w2], lambda x: x IN ('red', 'blue', 'small', 'ring', 'bolt')) AS list_distinct_ordered FROM (SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = 'red' THEN 'crimson' ELSE split_part(p_name, ' ', 1) END AS w1, split_part(p_name, ' ', 2) AS w2 FROM part))")
def normalize_tags(spark, d):
    raw = F.transform(F.split("p_name", " "), lambda t: F.when(t == "red", "Crimson ").otherwise(t))
    tags = quality.canonical_tags(raw, ["red", "blue", "small", "ring", "bolt"], {"crimson": "red"})
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(tags, ",").alias("tags"))


@query(BOOKS + ", t AS (SELECT id, pos, tag FROM (SELECT id, unnest(range(len(tags))) AS pos, unnest(tags) AS tag FROM books)), often AS (SELECT tag FROM t GROUP BY tag HAVING count(DISTINCT id) >= 40) SELECT books.id, coalesce(string_agg(tag, ',' ORDER BY pos), '') AS tags FROM books LEFT JOIN (SELECT * FROM t WHERE tag IN (SELECT tag FROM often)) k ON k.id = books.id GROUP BY books.id")
def frequent_tags(spark, d):
    return quality.tag_frequency_filter(catalog(spark, d), 40).select("id", F.array_join("tags", ",").alias("tags"))


@query(
    BOOKS
    + """, r AS (SELECT id, tags, regexp_matches(hay, '(?i)\\bring\\b') AS a, regexp_matches(hay, '(?i)brand#1([^0-9]|$)') AS b FROM (SELECT id, tags, concat_ws(' ', display_title, collection, series, publisher) AS hay FROM books))
SELECT id, array_to_string(list_concat(tags, CASE WHEN a THEN ['jewelry'] ELSE [] END, CASE WHEN b THEN ['first_brand'] ELSE [] END, CASE WHEN a THEN ['worn'] ELSE [] END), ',') AS tags FROM r"""
)
def implied_tags(spark, d):
    hay = F.concat_ws(" ", "display_title", "collection", "series", "publisher")
    rules = [(r"(?i)\bring\b", "jewelry"), (r"(?i)brand#1(?![0-9])", "first_brand")]
    return catalog(spark, d).select("id", F.array_join(quality.implied_tags(F.col("tags"), hay, rules, {"jewelry": "worn"}), ",").alias("tags"))


@query(BOOKS + "SELECT id, 'PROMO' AS game_system, array_to_string(list_concat(list_filter(tags, lambda t: t NOT IN ('ECONOMY', 'SMALL')), ['moved']), ',') AS tags FROM books WHERE regexp_matches(display_title, '(?i)gear$') AND game_system IN ('ECONOMY', 'SMALL')")
def guarded_override(spark, d):
    out = quality.guarded_override(catalog(spark, d), "display_title", "(?i)gear$", ["ECONOMY", "SMALL"], "PROMO", ["ECONOMY", "SMALL"], "moved")
    return out.withColumn("tags", F.array_join("tags", ","))


@query("SELECT new, count(*) AS n FROM (SELECT p_type AS old, CASE WHEN p_size > 25 THEN 'LARGE' ELSE p_type END AS new FROM part) WHERE old <> new GROUP BY new")
def change_histogram(spark, d):
    before = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("system"), "p_size")
    after = before.select("id", F.when(F.col("p_size") > 25, "LARGE").otherwise(F.col("system")).alias("system"))
    return quality.change_histogram(quality.changes(before, after, "system"))


NAMES = "(SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN (p_partkey + 10000) || '-' || replace(p_name, ' ', '_') || '_(v1.' || p_size || ').pdf' WHEN 1 THEN replace(p_name, ' ', '_') || '_V2.' || p_size || '.pdf' WHEN 2 THEN p_name || ' draft (1).pdf' WHEN 3 THEN p_name || '.old-00' || (p_size % 10) || '.pdf' WHEN 4 THEN p_name || '.old.pdf' ELSE p_name || '.pdf' END AS name FROM part)"


def _names(spark, d):
    k, n, s = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    low = F.replace(n, F.lit(" "), F.lit("_"))
    name = (
        F.when(k % 6 == 0, F.concat((k + 10000).cast("string"), F.lit("-"), low, F.lit("_(v1."), s, F.lit(").pdf")))
        .when(k % 6 == 1, F.concat(low, F.lit("_V2."), s, F.lit(".pdf")))
        .when(k % 6 == 2, F.concat(n, F.lit(" draft (1).pdf")))
        .when(k % 6 == 3, F.concat(n, F.lit(".old-00"), (F.col("p_size") % 10).cast("string"), F.lit(".pdf")))
        .when(k % 6 == 4, F.concat(n, F.lit(".old.pdf")))
        .otherwise(F.concat(n, F.lit(".pdf")))
    )
    return table(spark, d, "part").select(k.alias("id"), name.alias("name"))


@query(
    f"""SELECT id, nullif(regexp_extract(name, '^(\\d{{4,}})-', 1), '') AS product_id, coalesce(nullif(regexp_extract(name, '(?i)\\((v[\\d._]+)[^)]*\\)', 1), ''), nullif(regexp_extract(name, '(?i)[_\\s](v\\d+[._]\\d+(\\.\\d+)?)', 1), '')) AS product_version,
regexp_matches(name, '(?i)\\.old(-\\d+)?\\.pdf$') AS is_old_version, CASE WHEN regexp_matches(name, '(?i)\\.old(-\\d+)?\\.pdf$') THEN coalesce(TRY_CAST(nullif(regexp_extract(name, '(?i)\\.old-(\\d+)\\.pdf$', 1), '') AS INTEGER), 0) END AS version_generation,
regexp_matches(name, '(?i)(^|[_\\s.-])(draft|preview|beta)([_\\s.-]|$)') AS is_draft, regexp_matches(name, '(?i)\\s*\\(\\d+\\)\\.pdf$') AS is_duplicate FROM {NAMES}"""
)
def filename_parse(spark, d):
    name = F.col("name")
    return _names(spark, d).select("id", *fn.product_code(name), *fn.version_flags(name), *fn.draft_flags(name))


@query(
    """SELECT p_partkey AS id, CAST(CASE p_partkey % 5 WHEN 0 THEN 1 + p_size % 10 WHEN 1 THEN CASE WHEN p_size BETWEEN 1 AND 30 THEN p_size END WHEN 2 THEN 5 WHEN 3 THEN 3 END AS INTEGER) AS min_level,
CAST(CASE p_partkey % 5 WHEN 0 THEN 4 + p_size % 10 WHEN 1 THEN CASE WHEN p_size BETWEEN 1 AND 30 THEN p_size END WHEN 2 THEN 10 WHEN 3 THEN 5 END AS INTEGER) AS max_level FROM part"""
)
def level_from_text(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("For heroes of Levels "), (1 + s % 10).cast("string"), F.lit(" - "), (4 + s % 10).cast("string")))
        .when(k % 5 == 1, F.concat(F.lit("A quest of level "), s.cast("string"), F.lit(" sorts")))
        .when(k % 5 == 2, F.lit("Made for tier 2 characters"))
        .when(k % 5 == 3, F.lit("A third-to-fifth level adventure"))
        .otherwise(F.lit("A book of rings"))
    )
    return table(spark, d, "part").select(k.alias("id"), fn.level_range(text).alias("r")).select("id", "r.min_level", "r.max_level")
