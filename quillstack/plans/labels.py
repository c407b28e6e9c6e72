"""Queries over labels, records, summaries and filtered search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import facets, fulltext, inventory, quality, ranges, search
from ..operators.search import SearchSpec
from .tables import BOOKMARKS, BOOKS, FILES, bookmarks, catalog, favorites, files, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


CELLS = "(SELECT p_partkey AS id, p_name AS label, p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN p_size || ' / ' || (p_size + 3) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'n/a' ELSE ' ' || p_size || '/x' END AS pair, CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE ' ' || p_size END AS plain FROM part)"


def _cells(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    pair = F.when(k % 4 == 0, F.concat(s, F.lit(" / "), (F.col("p_size") + 3).cast("string"))).when(k % 4 == 1, s).when(k % 4 == 2, F.lit("n/a")).otherwise(F.concat(F.lit(" "), s, F.lit("/x")))
    return table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("label"), k.alias("ord"), pair.alias("pair"), F.when(k % 3 == 0, "-").otherwise(F.concat(F.lit(" "), s)).alias("plain"))


@query(f"SELECT id, 'A' AS rank, TRY_CAST(trim(plain) AS INTEGER) AS dc, TRY_CAST(trim(CASE WHEN contains(pair, '/') THEN substr(pair, strpos(pair, '/') + 1) ELSE pair END) AS INTEGER) AS dc_other FROM {CELLS}")
def dc_cells(spark, d):
    return ranges.dc_long(_cells(spark, d), ["id"], ["plain"], ["pair"], ["A"])


@query(f"WITH c AS {CELLS}, m AS (SELECT min(ord) AS first FROM c WHERE upper(trim(label)) = 'LARGE GEAR') SELECT id, coalesce(ord > first, false) AS failed FROM c CROSS JOIN m WHERE upper(trim(label)) <> 'LARGE GEAR'")
def sheet_blocks(spark, d):
    return ranges.blocks_of_sheet(_cells(spark, d), "label", marker="LARGE GEAR").select("id", "failed")


@query("WITH e AS (SELECT event_id, ' ' || upper(substr(event_type, 1, 4)) || CASE event_id % 3 WHEN 0 THEN '-' WHEN 1 THEN '_' ELSE ' ' END || substr(event_type, 5) AS label FROM events), k AS (SELECT event_id, replace(replace(replace(lower(trim(label)), ' ', ''), '_', ''), '-', '') AS key FROM e) SELECT event_id, CASE key WHEN 'click' THEN 'press' WHEN 'purchase' THEN 'sale' WHEN 'signup' THEN 'entry' END AS name, CASE key WHEN 'click' THEN 'A press' WHEN 'error' THEN 'An error' ELSE key END AS shown FROM k")
def canonical_labels(spark, d):
    e, t = F.col("event_id"), F.col("event_type")
    label = F.concat(F.lit(" "), F.upper(F.substring(t, 1, 4)), F.when(e % 3 == 0, "-").when(e % 3 == 1, "_").otherwise(" "), F.substring(t, 5, 20))
    name = fn.canonical_label(label, {"click": "press", "purchase": "sale", "signup": "entry"})
    return table(spark, d, "events").select("event_id", name.alias("name"), fn.display_name(fn.compressed(label), {"click": "A press", "error": "An error"}).alias("shown"))


@query("WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'DDAL0' || (p_size % 10) || '-' || p_name WHEN 1 THEN 'ddex_' || (p_size % 10) || '_' || p_name WHEN 2 THEN 'x DDAL-1' || (p_size % 10) || ' ' || p_name WHEN 3 THEN 'DDEX0' || (p_size % 5) || p_name ELSE p_name END AS name FROM part), s AS (SELECT id, TRY_CAST(nullif(regexp_extract(name, '(?i)ddal[\\s_-]*(\\d{2})', 1), '') AS INTEGER) AS late, TRY_CAST(nullif(regexp_extract(name, '(?i)ddex[\\s_-]*0?(\\d)', 1), '') AS INTEGER) AS early FROM n) SELECT id, coalesce(CASE WHEN late BETWEEN 4 AND 11 THEN late END, CASE WHEN early BETWEEN 1 AND 3 THEN early END) AS season FROM s")
def seasons(spark, d):
    k, s, n = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    one = (s % 10).cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("DDAL0"), one, F.lit("-"), n)).when(k % 5 == 1, F.concat(F.lit("ddex_"), one, F.lit("_"), n)).when(k % 5 == 2, F.concat(F.lit("x DDAL-1"), one, F.lit(" "), n)).when(k % 5 == 3, F.concat(F.lit("DDEX0"), (s % 5).cast("string"), n)).otherwise(n)
    return table(spark, d, "part").select(k.alias("id"), fn.season(name).alias("season"))


@query(
    """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 19 <> 0 THEN p_brand END AS game_system, CASE p_partkey % 4 WHEN 0 THEN 'adventure' WHEN 1 THEN 'Big Adventure ' || p_type ELSE p_type END AS product_type, CASE WHEN p_partkey % 6 <> 0 THEN [p_name] END AS tags, p_name AS description, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS VARCHAR) ELSE 'low' END AS lo, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size + 5 AS VARCHAR) END AS hi FROM part),
k AS (SELECT *, CASE WHEN product_type IN ('promo', 'adventure', 'small') THEN product_type WHEN contains(lower(product_type), 'promo') THEN 'promo' WHEN contains(lower(product_type), 'adventure') THEN 'adventure' WHEN contains(lower(product_type), 'small') THEN 'small' ELSE 'sourcebook' END AS kind, TRY_CAST(lo AS INTEGER) AS l, TRY_CAST(coalesce(hi, lo) AS INTEGER) AS h FROM r WHERE game_system IS NOT NULL)
SELECT id, kind AS product_type, array_to_string(list_concat(coalesce(tags, [kind]), CASE WHEN id IN (SELECT s_suppkey FROM supplier) THEN ['low_confidence'] ELSE [] END), ',') AS tags, CASE WHEN kind = 'adventure' AND l IS NOT NULL AND h IS NOT NULL AND l BETWEEN 1 AND 30 THEN l END AS min_level, CASE WHEN kind = 'adventure' AND l IS NOT NULL AND h IS NOT NULL AND h BETWEEN 1 AND 30 THEN h END AS max_level FROM k"""
)
def validated_records(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 4 == 0, F.lit("adventure")).when(k % 4 == 1, F.concat(F.lit("Big Adventure "), "p_type")).otherwise(F.col("p_type"))
    rows = table(spark, d, "part").select(
        k.alias("id"), F.when(k % 19 != 0, F.col("p_brand")).alias("game_system"), kind.alias("product_type"), F.when(k % 6 != 0, F.array("p_name")).alias("tags"), F.col("p_name").alias("description"), F.when(k % 5 != 0, s.cast("string")).otherwise("low").alias("min_level"), F.when(k % 3 == 0, (s + 5).cast("string")).alias("max_level")
    )
    doubtful = favorites(spark, d).select(F.col("book_id").alias("id"))
    return quality.validated(rows, ["promo", "adventure", "small"], doubtful=doubtful).select("id", "product_type", F.array_join("tags", ",").alias("tags"), "min_level", "max_level")


@query(BOOKS + "SELECT b.id, display_title AS title, publisher, series, array_to_string(tags, ',') AS tags, nullif(left(text, 300), '') AS description, s_suppkey IS NOT NULL AS is_favorite FROM visible b LEFT JOIN documents ON doc_id = b.id LEFT JOIN supplier ON s_suppkey = b.id")
def book_summaries(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description"))
    books = search.with_favorites(catalog(spark, d).where(search.visible()).join(docs, "id", "left"), favorites(spark, d))
    return search.summaries(books).select("id", "title", "publisher", "series", F.array_join("tags", ",").alias("tags"), "description", "is_favorite")


@query(
    BOOKS
    + """, words AS (SELECT id AS doc, unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', display_title, publisher, game_system, series)), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM books), idx AS (SELECT term, doc, count(*) AS tf FROM words GROUP BY ALL), dl AS (SELECT doc, sum(tf) AS dl FROM idx GROUP BY doc), f AS (SELECT count(*) AS docs, avg(dl) AS mean FROM dl),
hit AS (SELECT * FROM idx WHERE term IN ('ring', 'promo')), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term), both_ AS (SELECT doc FROM hit GROUP BY doc HAVING count(*) = 2),
s AS (SELECT doc, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score FROM hit JOIN both_ USING (doc) JOIN df USING (term) JOIN dl USING (doc) CROSS JOIN f GROUP BY doc)
SELECT id, display_title, score FROM visible JOIN s ON doc = id WHERE min_level <= 9 AND max_level >= 3"""
)
def fts_filtered(spark, d):
    books = catalog(spark, d)
    index = fulltext.postings(books, "id", ["display_title", "publisher", "game_system", "series"])
    out = fulltext.search_text(books, index, ["ring", "promo"], search.predicate(SearchSpec(level_min=3, level_max=9)), most=1_000_000)
    return out.select("id", "display_title", F.round("score", 6).alias("score"))


@query(BOOKS + "SELECT dim, value, n FROM (SELECT 'publisher' AS dim, publisher AS value, count(*) AS n FROM books WHERE NOT is_old_version GROUP BY publisher UNION ALL SELECT 'game_system', game_system, count(*) FROM books WHERE NOT is_old_version GROUP BY game_system)")
def library_breakdown(spark, d):
    return facets.stats_by(catalog(spark, d), ("publisher", "game_system"))


@query(BOOKS + ", counts AS (SELECT tag, game_system AS topic, count(*) AS n FROM (SELECT game_system, unnest(list_distinct(tags)) AS tag FROM visible) GROUP BY ALL) SELECT tag, topic, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, topic) AS place FROM counts) WHERE place <= 5")
def tag_systems(spark, d):
    return facets.tag_systems(catalog(spark, d))


@query(BOOKS + "SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(tags)) AS tag FROM visible) WHERE tag IN (SELECT p_brand FROM part) GROUP BY tag")
def vocabulary_counts(spark, d):
    return facets.vocabulary_counts(catalog(spark, d), table(spark, d, "part").select(F.col("p_brand").alias("tag")))


@query(BOOKS + "SELECT publisher AS value, count(*) AS n FROM visible WHERE contains(lower(publisher), 'd#1') GROUP BY publisher")
def facet_names(spark, d):
    counts = facets.facets(catalog(spark, d).where(search.visible()), ("publisher",)).where("dim = 'publisher'").select("value", "n")
    return search.facet_list(counts, "D#1", by="value")


@query(BOOKS + f", b AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord, level, title) AS nth FROM {BOOKMARKS}), m AS (SELECT book_id, string_agg(title || level, ',' ORDER BY nth) AS marks FROM b WHERE nth <= 2 GROUP BY book_id) SELECT id, marks FROM (SELECT id FROM visible WHERE date_enriched IS NULL AND publisher <> '' ORDER BY publisher, collection NULLS FIRST, display_title, id LIMIT 1000000) LEFT JOIN m ON book_id = id")
def queue_with_marks(spark, d):
    found = search.work_queue(catalog(spark, d), bookmarks=bookmarks(spark, d), most=1_000_000, marks=2)
    return found.select("id", F.array_join(F.transform("bookmarks", lambda b: F.concat(b["title"], b["level"].cast("string"))), ",").alias("marks"))


@query(f"WITH f AS {FILES} SELECT id, string_split(path, '/')[2] AS publisher, nullif(array_to_string(string_split(path, '/')[3 : len(string_split(path, '/')) - 1], '/'), '') AS collection FROM f")
def folder_publishers(spark, d):
    below = F.regexp_replace("path", "^/", "")
    return files(spark, d).select("id", *fn.folder_parts(below))


@query(f"WITH f AS {FILES} SELECT string_split(path, '/')[2] = 'www.thrst.example.com' OR starts_with(path, '/m.') AS skipped, count(*) AS files FROM (SELECT id, path FROM f) GROUP BY 1")
def skipped_tops(spark, d):
    rows = files(spark, d).withColumn("path", F.when(F.startswith(F.col("path"), F.lit("/m.")), F.concat(F.lit("/Mobile"), "path")).otherwise(F.col("path")))
    return inventory.without_tops(rows, ["mobile", "WWW.thrst.example.com"]).groupBy("skipped").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH f AS {FILES} SELECT count(*) AS files FROM f o WHERE EXISTS (SELECT 1 FROM f t WHERE t.id <> o.id AND t.path = o.path AND t.name = o.name AND t.size = o.size) OR o.size > 3000")
def present_files(spark, d):
    f = files(spark, d)
    several = f.groupBy("path", "name", "size").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most"))
    return inventory.already_there(f, several.where("n > 1 or most > 3000")).agg(F.count(F.lit(1)).alias("files"))


@query("SELECT doc_id, md5(regexp_replace(text, '(\\w)-\\n(\\w)', '\\1\\2', 'g')) AS digest FROM (SELECT doc_id, replace(text, ' ', '-' || chr(10)) AS text FROM documents)")
def joined_lines(spark, d):
    broken = F.replace("text", F.lit(" "), F.lit("-\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(fn.joined_lines(broken).cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, md5(regexp_replace(text, '([\\\\`*_{}\\[\\]<>#|])', '\\\\\\1', 'g')) AS digest FROM conversations")
def escaped_texts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(fn.escaped_markdown(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT page_id, '[[' || left(trim(regexp_replace(url, '[<>:\"/\\\\|?*]', '-', 'g')), 200) || ']]' AS link, CASE WHEN regexp_matches(url, '/d/[A-Za-z0-9_-]{10,}') THEN regexp_extract(url, '/d/([A-Za-z0-9_-]{10,})', 1) ELSE nullif(regexp_extract(url || '&id=page' || md5(url), '[?&]id=([A-Za-z0-9_-]{10,})', 1), '') END AS doc FROM pages")
def page_links(spark, d):
    address = F.concat("url", F.lit("&id=page"), F.md5(F.col("url").cast("binary")))
    return table(spark, d, "pages").select("page_id", fn.wikilink(F.col("url")).alias("link"), fn.document_id(address).alias("doc"))


@query("SELECT contains(text, 'that') OR contains(text, 'chen') AS known, count(*) AS n FROM conversations GROUP BY 1")
def error_halves(spark, d):
    return quality.error_kinds(table(spark, d, "conversations"), "text", ["that", "chen"]).groupBy("known").agg(F.count(F.lit(1)).alias("n"))


@query("WITH o AS (SELECT p_brand AS name, list_sort(list_distinct(list(p_size))) AS numbers FROM part WHERE p_type <> 'PROMO' GROUP BY p_brand), n AS (SELECT p_brand AS name, list_distinct(list(p_size)) AS more FROM part WHERE p_type = 'PROMO' GROUP BY p_brand), u AS (SELECT n.name, o.numbers AS old, list_sort(list_distinct(list_concat(coalesce(o.numbers, []), more))) AS numbers FROM n LEFT JOIN o USING (name)) SELECT name, array_to_string(numbers, ',') AS numbers FROM u WHERE old IS NULL OR old <> numbers")
def numbers_added(spark, d):
    parts = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("number"), "p_type")
    state = parts.where("p_type <> 'PROMO'").groupBy("name").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    out = quality.numbers_added(state, parts.where("p_type = 'PROMO'"))
    return out.select("name", F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",").alias("numbers"))


@query(BOOKS + "SELECT id, is_duplicate OR id IN (SELECT s_suppkey FROM supplier) AS is_duplicate FROM books")
def flagged_books(spark, d):
    return search.flagged(catalog(spark, d), favorites(spark, d).select(F.col("book_id").alias("id")), "is_duplicate").select("id", "is_duplicate")


@query(
    """WITH n AS (SELECT DISTINCT l_orderkey AS path FROM lineitem WHERE l_quantity >= 45), p AS (SELECT o_orderkey AS path, 'old' AS state FROM orders WHERE o_orderkey NOT IN (SELECT path FROM n) UNION ALL SELECT path, 'new' FROM n), c AS (SELECT l_orderkey AS path FROM lineitem WHERE l_orderkey NOT IN (SELECT path FROM n) UNION ALL SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45), e AS (SELECT o_orderkey AS path FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT path FROM n))
SELECT 'parents ' || state AS part, count(*) AS n FROM p GROUP BY state UNION ALL SELECT 'children', count(*) FROM c UNION ALL SELECT 'errors', count(*) FROM e"""
)
def inserted_with_children(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    old = orders.select(F.col("o_orderkey").alias("path"), F.lit("old").alias("state"))
    heavy = lines.where("l_quantity >= 45").select(F.col("l_orderkey").alias("path"))
    parents, children, errors = search.insert_with_children(old, lines.select(F.col("l_orderkey").alias("path")), orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path")), heavy.distinct().withColumn("state", F.lit("new")), heavy)
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return parents.groupBy(F.concat(F.lit("parents "), "state").alias("part")).agg(F.count(F.lit(1)).alias("n")).unionByName(count(children, "children")).unionByName(count(errors, "errors"))


@query("SELECT doc_id IN (SELECT doc_id FROM labels) AS labelled, count(*) AS n FROM documents GROUP BY 1")
def membership_split(spark, d):
    docs, known = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    inside, outside = docs.join(known, "doc_id", "left_semi"), search.not_done(docs, known, key="doc_id")
    return inside.withColumn("labelled", F.lit(True)).unionByName(outside.withColumn("labelled", F.lit(False))).groupBy("labelled").agg(F.count(F.lit(1)).alias("n"))


@query(BOOKS + "SELECT publisher, md5('# ' || publisher || chr(10) || chr(10) || '## Systems' || chr(10) || string_agg(DISTINCT '- ' || game_system, chr(10) ORDER BY '- ' || game_system) || coalesce(chr(10) || chr(10) || '## Series' || chr(10) || string_agg(DISTINCT '- [[' || replace(series, '/', '-') || ']]', chr(10) ORDER BY '- [[' || replace(series, '/', '-') || ']]'), '')) AS page FROM visible GROUP BY publisher")
def publisher_pages(spark, d):
    own = catalog(spark, d).where(search.visible()).groupBy("publisher").agg(F.array_sort(F.collect_set("game_system")).alias("systems"), F.array_sort(F.collect_set(fn.wikilink(F.col("series")))).alias("series"))
    page = fn.sectioned_page(F.col("publisher"), [("Systems", F.col("systems")), ("Series", F.col("series"))])
    return own.select("publisher", F.md5(page.cast("binary")).alias("page"))
