"""Queries over event logs, inventories, change feeds, interval tables, rules and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import inventory, quality, ranges, rules, sessions, stats, sync
from .tables import FILES, files, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(
    """WITH g AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, round(coalesce(sum(gap) FILTER (gap > 0 AND gap < 3600000000), 0) / 1e6, 3) AS active_s, round((max(t) - min(t)) / 1e6, 3) AS wall_s, count(*) AS events FROM g GROUP BY user_id"""
)
def active_time(spark, d):
    out = sessions.active_time(table(spark, d, "events"), ["user_id"], "ts", ["event_id"], 3600)
    return out.select("user_id", F.round("active_s", 3).alias("active_s"), F.round("wall_s", 3).alias("wall_s"), "events")


@query("SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt_turn FROM conversations")
def prompt_attribution(spark, d):
    out = sessions.fill_forward(table(spark, d, "conversations"), ["conv_id"], ["turn"], "prompt_turn", F.col("turn"), F.col("role") == "user")
    return out.select("conv_id", "turn", "prompt_turn")


@query(
    """WITH m AS (SELECT *, max(CASE WHEN event_type IN ('click', 'signup') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS at FROM events)
SELECT m.event_id, CASE WHEN e.event_type = 'click' THEN e.value END AS skill FROM m LEFT JOIN events e ON e.event_id = m.at"""
)
def skill_attribution(spark, d):
    value = F.when(F.col("event_type") == "click", F.col("value"))
    return sessions.fill_forward(table(spark, d, "events"), ["user_id"], ["event_id"], "skill", value, F.col("event_type").isin("click", "signup")).select("event_id", "skill")


@query("SELECT a.conv_id, a.turn, b.turn AS near, a.turn = b.turn AS here FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 2 AND a.n + 2")
def context_pm2(spark, d):
    return sessions.neighbours(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query(
    """WITH s AS (SELECT CAST(ts AS DATE) AS day, user_id, min(epoch(ts) % 86400) AS b, max(epoch(ts) % 86400) AS e FROM events GROUP BY ALL),
c AS (SELECT day, CAST(floor(b / 600) AS BIGINT) AS lo, CAST(ceil(e / 600) AS BIGINT) AS hi FROM s), h AS (SELECT day, unnest(range(lo, hi)) AS bucket FROM c WHERE hi > lo),
n AS (SELECT day, bucket, count(*) AS n FROM h GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, bucket) AS k FROM n)
SELECT CAST(day AS VARCHAR) AS day, n AS peak, bucket FROM r WHERE k = 1"""
)
def peak_concurrency(spark, d):
    sec = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) % 86400
    spans = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.min(sec).alias("begin_s"), F.max(sec).alias("end_s"))
    return sessions.peak_concurrency(spans, ["day"]).select(F.col("day").cast("string").alias("day"), "peak", "bucket")


USAGE = "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN user_id % 3 <> 0 THEN 'p' || user_id % 5 END AS project, CASE WHEN event_type <> 'view' THEN event_type END AS agent, CASE WHEN event_id % 4 = 0 THEN 's' || event_id % 7 END AS skill FROM events"


def _usage(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        k.alias("k"), F.when(u % 3 != 0, F.concat(F.lit("p"), (u % 5).cast("string"))).alias("project"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("agent"), F.when(e % 4 == 0, F.concat(F.lit("s"), (e % 7).cast("string"))).alias("skill")
    )


@query(f"WITH u AS ({USAGE}) SELECT 'all' AS dim, '' AS value, CAST(sum(k) AS BIGINT) AS k, count(*) AS calls FROM u UNION ALL SELECT 'project', project, CAST(sum(k) AS BIGINT), count(*) FROM u WHERE project IS NOT NULL GROUP BY project UNION ALL SELECT 'agent', agent, CAST(sum(k) AS BIGINT), count(*) FROM u WHERE agent IS NOT NULL GROUP BY agent UNION ALL SELECT 'skill', skill, CAST(sum(k) AS BIGINT), count(*) FROM u WHERE skill IS NOT NULL GROUP BY skill")
def usage_grouping_sets(spark, d):
    return sessions.usage(_usage(spark, d), ["project", "agent", "skill"], ["k"])


@query(f"WITH u AS ({USAGE}), s AS (SELECT agent, CAST(sum(k) AS BIGINT) AS whole, CAST(sum(CASE WHEN k > 50 THEN k ELSE 0 END) AS BIGINT) AS part, count(*) AS calls FROM u WHERE agent IS NOT NULL GROUP BY agent) SELECT agent, round(part * 100.0 / whole, 1) AS pct, round(whole / calls, 6) AS per_call FROM s")
def usage_ratios(spark, d):
    s = _usage(spark, d).where("agent is not null").groupBy("agent").agg(F.sum("k").alias("whole"), F.sum(F.when(F.col("k") > 50, F.col("k")).otherwise(0)).alias("part"), F.count(F.lit(1)).alias("calls"))
    return sessions.ratios(s, "part", "whole", "calls").select("agent", "pct", F.round("per_call", 6).alias("per_call"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, d):
    return quality.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def dedup_max(spark, d):
    return sessions.max_per_key(table(spark, d, "events"), ["user_id", "event_type"], "value", "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def first_per_key(spark, d):
    return sessions.first_per_key(table(spark, d, "lineitem"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS users, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY 1")
def by_day(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"))


@query("SELECT conv_id, turn, length(text) AS size FROM conversations WHERE role = 'user' ORDER BY size DESC, conv_id, turn LIMIT 15")
def top_prompts(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return rows.orderBy(F.desc("size"), "conv_id", "turn").limit(15)


@query("SELECT event_id, value FROM events WHERE value > 40 ORDER BY value DESC, event_id LIMIT 100")
def cache_breaks(spark, d):
    return sessions.top(table(spark, d, "events").select("event_id", "value"), "value", "event_id", 100, 40.0)


@query("WITH a AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id, turn, CASE WHEN length(p) > 60 THEN substring(p, 1, 59) || '…' ELSE p END AS preview FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS p FROM a WHERE role = 'user')")
def prompt_preview(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", fn.preview(F.col("text"), 60).alias("preview"))


@query("WITH RECURSIVE a AS (SELECT conv_id * 1000 + turn AS agent, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, CASE WHEN role = 'user' THEN conv_id * 1000 + turn END AS prompt FROM conversations), up AS (SELECT agent, parent AS next, prompt, 0 AS depth FROM a UNION ALL SELECT up.agent, a.parent, a.prompt, depth + 1 FROM up JOIN a ON up.next = a.agent WHERE up.prompt IS NULL) SELECT agent, prompt, depth FROM up WHERE prompt IS NOT NULL")
def linked_prompts(spark, d):
    key = F.col("conv_id") * 1000 + F.col("turn")
    rows = table(spark, d, "conversations").select(key.alias("agent"), F.when(F.col("turn") > 0, key - 1).alias("parent"), F.when(F.col("role") == "user", key).alias("prompt"))
    return sessions.linked_prompts(rows)


# inventories


@query(f"WITH f AS {FILES}, b AS (SELECT array_to_string(list_slice(p, 1, least(2, greatest(len(p) - 1, 0))), '/') AS k, array_to_string(p[1 : len(p) - 1], '/') AS folder, size, len(p) AS level FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM f)) SELECT '/' || k AS bucket, count(*) AS files, count(DISTINCT folder) AS folders, CAST(sum(size) AS BIGINT) AS bytes, max(level) AS deepest FROM b GROUP BY k UNION ALL SELECT 'TOTAL', count(*), count(DISTINCT folder), CAST(sum(size) AS BIGINT), max(level) FROM b")
def path_rollup(spark, d):
    return inventory.roll_up(files(spark, d), 2).withColumn("deepest", F.col("deepest").cast("long"))


@query(f"WITH f AS {FILES}, o AS (SELECT * FROM f WHERE starts_with(path, '/m.')), t AS (SELECT * FROM f WHERE NOT starts_with(path, '/m.')) SELECT string_split(path, '/')[2] AS host, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM o WHERE NOT EXISTS (SELECT 1 FROM t WHERE lower(t.name) = lower(o.name) AND t.size = o.size) GROUP BY 1")
def unmatched_rollup(spark, d):
    f = files(spark, d)
    # the mobile pages as one inventory, all others as another
    mobile = F.startswith(F.col("path"), F.lit("/m."))
    left = inventory.unmatched(f.where(mobile), f.where(~mobile))
    return left.groupBy(F.split("path", "/")[1].alias("host")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(f"WITH f AS {FILES} SELECT count(*) AS files FROM f o WHERE starts_with(path, '/m.') AND EXISTS (SELECT 1 FROM f t WHERE NOT starts_with(t.path, '/m.') AND lower(t.name) = lower(o.name) AND t.size = o.size)")
def matched_files(spark, d):
    f = files(spark, d)
    mobile = F.startswith(F.col("path"), F.lit("/m."))
    return inventory.matched(f.where(mobile), f.where(~mobile)).agg(F.count(F.lit(1)).alias("files"))


@query("WITH n AS (SELECT p_partkey AS id, lower(p_name) AS base FROM part), g AS (SELECT base || '.pdf' AS near_key, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY lpad(CAST(id AS VARCHAR), 9, '0')) AS members FROM n GROUP BY base HAVING count(*) >= 2) SELECT * FROM g")
def near_name_groups(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Copy of "), "p_name", F.lit(".pdf"))).when(k % 4 == 1, F.concat("p_name", F.lit(" (2).PDF"))).when(k % 4 == 2, F.concat("p_name", F.lit(" - copy.pdf"))).otherwise(F.concat("p_name", F.lit(".pdf")))
    rows = table(spark, d, "part").select(name.alias("name"), F.lpad(k.cast("string"), 9, "0").alias("path"))
    out = inventory.near_name_groups(rows)
    return out.select("near_key", "n", F.array_join(F.transform("members", lambda m: m.cast("long").cast("string")), ",").alias("members"))


@query("SELECT 'n' || n_nationkey AS id, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name FROM region UNION ALL SELECT 's' || s_suppkey, r_name || '/' || n_name || '/' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def folder_paths(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    regions = table(spark, d, "region").select(key("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    nations = table(spark, d, "nation").select(key("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), key("r", "n_regionkey").alias("parent"))
    suppliers = table(spark, d, "supplier").select(key("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), key("n", "s_nationkey").alias("parent"))
    return inventory.folder_paths(regions.union(nations).union(suppliers)).select("id", "path")


@query(f"WITH f AS {FILES} SELECT id, path FROM f WHERE (string_split(path, '/')[3] = 'en' AND len(string_split(path, '/')) > 3) AND NOT contains(lower(path), 'spam') AND NOT contains(lower(path), 'farm')")
def files_under(spark, d):
    rows = inventory.without(files(spark, d), "path", ["SPAM", "farm"])
    # the path below the host
    below = F.regexp_replace("path", "^/[^/]+", "")
    return rows.where(inventory.under(below, "/en")).select("id", "path")


@query(f"WITH f AS {FILES}, p AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM f) SELECT DISTINCT folder FROM (SELECT '/' || array_to_string(p[1:i], '/') AS folder FROM (SELECT p, unnest(range(1, len(p))) AS i FROM p)) WHERE folder NOT IN (SELECT '/' || string_split(path, '/')[2] FROM f WHERE starts_with(path, '/m.'))")
def missing_folders(spark, d):
    f = files(spark, d)
    return inventory.missing_folders(f, f.where(F.startswith(F.col("path"), F.lit("/m."))).select(F.concat(F.lit("/"), F.split("path", "/")[1]).alias("folder")))


@query("SELECT id, CASE WHEN size >= 1099511627776 THEN printf('%.1f', size / 1099511627776.0) || ' TB' WHEN size >= 1073741824 THEN printf('%.1f', size / 1073741824.0) || ' GB' WHEN size >= 1048576 THEN printf('%.1f', size / 1048576.0) || ' MB' WHEN size >= 1024 THEN printf('%.1f', size / 1024.0) || ' KB' ELSE size || ' B' END AS human FROM (SELECT page_id AS id, length(html) AS size FROM pages)")
def human_sizes(spark, d):
    return files(spark, d).select("id", fn.human_bytes(F.col("size")).alias("human"))


# change feeds


@query("SELECT user_id AS id, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'signup') WHERE n = 1 AND event_type <> 'error'")
def cdc_compact(spark, d):
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "root").otherwise("upsert")
    changes = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kind.alias("op"), "value")
    return sync.compact(changes).select("id", "seq", "value")


def _log(spark, d):
    action = F.when(F.col("event_type") == "purchase", "uploaded").when(F.col("event_type") == "view", "skipped_existing").otherwise("failed")
    return table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), action.alias("action"))


LAST = "WITH l AS (SELECT user_id AS id, CASE event_type WHEN 'purchase' THEN 'uploaded' WHEN 'view' THEN 'skipped_existing' ELSE 'failed' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1) "


@query(LAST + "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM l WHERE action <> 'failed')")
def pending_items(spark, d):
    return sync.pending(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), _log(spark, d))


@query(LAST + "SELECT count(*) FILTER (action = 'uploaded') AS uploaded, count(*) FILTER (action = 'skipped_existing') AS skipped_existing, count(*) FILTER (action = 'failed') AS failed, count(*) AS total FROM l")
def worker_totals(spark, d):
    return sync.worker_totals(_log(spark, d))


# interval tables


@query("WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag AS cell, CAST(l_quantity AS BIGINT) AS roll FROM lineitem) SELECT l_orderkey, l_linenumber, CASE cell WHEN 'A' THEN CASE WHEN roll <= 10 THEN 'miss' WHEN roll <= 30 THEN 'graze' ELSE 'hit' END WHEN 'N' THEN CASE WHEN roll <= 25 THEN 'miss' WHEN roll <= 40 THEN 'hit' END END AS bucket FROM c")
def bucket_lookup(spark, d):
    cells = {"A": [("miss", 1, 10), ("graze", 11, 30), ("hit", 31, 100)], "N": [("miss", 1, 25), ("hit", 26, 40)]}
    rows = F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(b).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(i).alias("ord")) for c, x in cells.items() for i, (b, lo, hi) in enumerate(x)])
    table_ = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    rolls = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("cell"), F.col("l_quantity").cast("long").alias("roll"))
    return ranges.lookup(rolls, table_, ["cell"]).select("l_orderkey", "l_linenumber", "bucket")


@query("SELECT roll, bucket, count(*) AS n FROM (SELECT 1 + l_orderkey % 20 AS roll, CASE WHEN 1 + l_orderkey % 20 <= 8 THEN 'legs' WHEN 1 + l_orderkey % 20 <= 16 THEN 'body' WHEN 1 + l_orderkey % 20 >= 18 THEN 'head' END AS bucket FROM lineitem) GROUP BY ALL")
def bucket_hole(spark, d):
    rows = F.array(*[F.struct(F.lit("t").alias("cell"), F.lit(b).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(i).alias("ord")) for i, (b, lo, hi) in enumerate([("legs", 1, 8), ("body", 9, 16), ("head", 18, 20)])])
    table_ = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    rolls = table(spark, d, "lineitem").select(F.lit("t").alias("cell"), (1 + F.col("l_orderkey") % 20).alias("roll"))
    return ranges.lookup(rolls, table_, ["cell"]).groupBy("roll", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, total >= dc AS success, abs(total - dc) AS margin, CASE WHEN total >= dc THEN CASE WHEN total - dc <= 9 THEN 'agree' ELSE 'help' END ELSE CASE WHEN dc - total <= 4 THEN 'doubt' ELSE 'refuse' END END AS bucket FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS total, CASE l_returnflag WHEN 'A' THEN 15 WHEN 'N' THEN 20 ELSE 30 END AS dc FROM lineitem)")
def social_attempt(spark, d):
    make = lambda names, rows: spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])).alias("r")).select("r.*")
    targets = make(["stance", "dc"], [("A", 15), ("N", 20), ("R", 30)])
    results = make(["outcome", "bucket", "lo", "hi", "ord"], [("success", "agree", 0, 9, 0), ("success", "help", 10, 100, 1), ("failure", "doubt", 1, 4, 0), ("failure", "refuse", 5, 100, 1)])
    rolls = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("stance"), F.col("l_quantity").cast("long").alias("total"))
    return ranges.attempt(rolls, targets, results, ["stance"]).select("l_orderkey", "l_linenumber", "success", F.col("margin").cast("long").alias("margin"), "bucket")


@query("SELECT p_name AS bucket, cell, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, CAST(ord AS BIGINT) AS ord FROM (SELECT p_name, 'small' AS cell, p_size AS lo, p_size + 10 AS hi, p_partkey AS ord FROM part UNION ALL SELECT p_name, 'large', p_size, p_size, p_partkey FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_name, 'large', 100, 100, p_partkey FROM part WHERE p_partkey % 3 = 1)")
def unpivot_matrix(spark, d):
    s = F.col("p_size")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    large = F.when(F.col("p_partkey") % 3 == 0, two(s)).when(F.col("p_partkey") % 3 == 1, "00").otherwise("–")
    sheet = table(spark, d, "part").select(F.col("p_name").alias("label"), F.col("p_partkey").alias("ord"), F.concat(two(s), F.lit("–"), two(s + 10)).alias("small"), large.alias("large"))
    return ranges.unpivot_matrix(sheet, "label", ["small", "large"])


# rules and statistics


@query(
    """WITH m AS (SELECT event_id, 'r1' AS rule, 'block' AS action, 'too much' AS message FROM events WHERE event_type = 'purchase' AND regexp_matches(CAST(value AS VARCHAR), '^[5-9][0-9]\\.')
UNION ALL SELECT event_id, 'r2', 'warn', 'nines' FROM events WHERE event_type IN ('purchase', 'view') AND contains(props, '9') AND NOT contains(props, '99') UNION ALL SELECT event_id, 'r3', 'warn', 'error seen' FROM events WHERE event_type = 'error')
SELECT event_id, CASE WHEN bool_or(action = 'block') THEN 'block' ELSE 'warn' END AS verdict, CASE WHEN bool_or(action = 'block') THEN string_agg(message, chr(10) ORDER BY rule) FILTER (action = 'block') ELSE string_agg(message, chr(10) ORDER BY rule) FILTER (action = 'warn') END AS messages FROM m GROUP BY event_id"""
)
def rule_verdict(spark, d):
    make = lambda names, rows: spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])).alias("r")).select("r.*")
    known = make(["rule", "tools", "action", "message"], [("r1", "purchase", "block", "too much"), ("r2", "purchase|view", "warn", "nines"), ("r3", "*", "warn", "error seen"), ("r4", "*", "block", "no conditions")])
    conditions = make(["rule", "field", "operator", "pattern"], [("r1", "value", "regex_match", r"^[5-9][0-9]\."), ("r2", "props", "contains", "9"), ("r2", "props", "not_contains", "99"), ("r3", "event_type", "equals", "error")])
    return rules.judged(table(spark, d, "events"), known, conditions, ["value", "props", "event_type"], tool="event_type")


@query("SELECT event_id, CASE WHEN contains(props, '12') THEN 'a' WHEN contains(props, '1') THEN 'b' END AS rule FROM events")
def first_rule(spark, d):
    return rules.first_match(table(spark, d, "events"), [("a", "12"), ("b", "1")], "props").select("event_id", "rule")


@query("SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS stddev, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM orders GROUP BY ALL")
def run_stats(spark, d):
    out = stats.run_stats(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return out.withColumns({"mean": F.round("mean", 4), "stddev": F.round("stddev", 4)})


@query("SELECT round((SELECT avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F') - (SELECT avg(o_totalprice) FROM orders WHERE o_orderstatus = 'O'), 4) AS delta")
def run_delta(spark, d):
    return stats.delta(stats.run_stats(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice"), "o_orderstatus", "F", "O").select(F.round("delta", 4).alias("delta"))


@query("SELECT l_returnflag, l_linestatus = 'O' AS wanted, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n, CASE WHEN l_linestatus = 'O' THEN avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END) >= 0.5 ELSE avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END) < 0.5 END AS passed FROM lineitem GROUP BY l_returnflag, l_linestatus")
def trigger_rate(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_linestatus") == "O").alias("wanted"), (F.col("l_quantity") > 25).cast("int").alias("hit"))
    return stats.trigger_rates(rows, ["l_returnflag"], "hit", "wanted").withColumn("rate", F.round("rate", 6))


@query("SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY quality) * 0.4)) AS is_test FROM labels")
def stratified_split(spark, d):
    return stats.stratified_split(table(spark, d, "labels"), "quality", "doc_id").select("doc_id", "quality", "is_test")


@query("SELECT user_id AS best, n AS score FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 1)")
def best_iteration(spark, d):
    return stats.best_iteration(table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "n")


@query("SELECT tier, round(sum(tokens_in * CASE tier WHEN 'user' THEN 3.0 ELSE 15.0 END + tokens_out * CASE tier WHEN 'user' THEN 6.0 ELSE 75.0 END) / 1e6 * 0.5, 6) AS cost, count(*) AS chunks FROM (SELECT role AS tier, length(text) AS tokens_in, turn AS tokens_out FROM conversations) WHERE tokens_in > 0 AND tier IN ('user', 'assistant') GROUP BY tier")
def cost_estimate(spark, d):
    rows = [("user", 3.0, 6.0), ("assistant", 15.0, 75.0)]
    prices = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(a).alias("price_in"), F.lit(b).alias("price_out")) for t, a, b in rows])).alias("r")).select("r.*")
    chunks = table(spark, d, "conversations").select(F.col("role").alias("tier"), F.length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"))
    return stats.cost(chunks, prices, 0.5).select("tier", F.round("cost", 6).alias("cost"), "chunks")
