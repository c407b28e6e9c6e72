"""Queries over the conversations as transcripts of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: A conversation is a session; flags and marks follow from the turn and the text's length, ids repeat for long texts.
LINES = """lines AS (SELECT CASE WHEN length(text) % 7 <> 0 THEN 'u' || (length(text) % 97) || '-' || conv_id // 3 END AS uuid, conv_id AS session, turn AS line, CAST(conv_id % 2 AS BIGINT) AS kind_rank, CAST(conv_id AS BIGINT) AS born, TIMESTAMP '2024-01-01' + to_seconds(CAST(conv_id * 700 + turn * 60 AS BIGINT)) AS ts, role AS type,
CASE length(text) % 5 WHEN 0 THEN '<task-notification>' || text WHEN 1 THEN '<command-name>/' || split_part(text, ' ', 1) || '</command-name>' WHEN 2 THEN '[Request interrupted' || text ELSE text END AS text, turn % 11 = 4 AS is_meta, length(text) % 13 = 0 AS is_summary, conv_id % 5 = 4 AS is_sidechain, turn % 6 = 2 AS is_result FROM conversations)"""


def _lines(spark, d):
    n, c, t, text = F.length("text"), F.col("conv_id"), F.col("turn"), F.col("text")
    shown = F.when(n % 5 == 0, F.concat(F.lit("<task-notification>"), text)).when(n % 5 == 1, F.concat(F.lit("<command-name>/"), F.split(text, " ")[0], F.lit("</command-name>"))).when(n % 5 == 2, F.concat(F.lit("[Request interrupted"), text)).otherwise(text)
    return table(spark, d, "conversations").select(
        F.when(n % 7 != 0, F.concat(F.lit("u"), (n % 97).cast("string"), F.lit("-"), F.floor(c / 3).cast("string"))).alias("uuid"),
        c.alias("session"), t.alias("line"), (c % 2).alias("kind_rank"), c.alias("born"), F.timestamp_micros(F.lit(1704067200000000) + (c * 700 + t * 60) * 1_000_000).alias("ts"),
        F.col("role").alias("type"), shown.alias("text"), (t % 11 == 4).alias("is_meta"), (n % 13 == 0).alias("is_summary"), (c % 5 == 4).alias("is_sidechain"), (t % 6 == 2).alias("is_result"),
    )


@query(f"WITH {LINES} SELECT session, line FROM lines WHERE ts >= TIMESTAMP '2024-01-03 12:00:00' - INTERVAL 2 DAY")
def since_days(spark, d):
    return sessions.since(_lines(spark, d), "2d", F.lit("2024-01-03 12:00:00").cast("timestamp")).select("session", "line")


@query(f"WITH {LINES} SELECT session, line FROM lines WHERE type = 'user' AND NOT is_meta AND NOT is_summary AND NOT is_result AND NOT is_sidechain AND NOT starts_with(text, '<task-notification') AND NOT starts_with(text, '[Request interrupted')")
def human_messages(spark, d):
    return _lines(spark, d).where(sessions.is_human()).select("session", "line")


@query(f"WITH {LINES} SELECT session, line, uuid FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY kind_rank, born, line) AS nth FROM lines) WHERE nth = 1 OR uuid IS NULL")
def once_by_uuid(spark, d):
    return sessions.once_by_uuid(_lines(spark, d)).select("session", "line", "uuid")


@query(f"WITH {LINES}, c AS (SELECT is_sidechain, nullif(trim(regexp_extract(text, '<command-(?:name|message)>/?([^<]+)</command-', 1)), '') AS skill FROM lines), n AS (SELECT is_sidechain, skill, count(*) AS n FROM c WHERE skill IS NOT NULL GROUP BY ALL) SELECT is_sidechain, skill, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY is_sidechain ORDER BY n DESC, skill) AS place FROM n) WHERE place <= 5")
def skill_calls(spark, d):
    rows = _lines(spark, d).withColumn("skill", sessions.command_of(F.col("text")))
    return sessions.top_invocations(rows, ["is_sidechain"], "skill")


@query(
    f"""WITH {LINES}, s AS (SELECT session, min(ts) AS a, max(ts) AS b, CAST(sum(length(text)) AS BIGINT) AS tokens FROM lines GROUP BY session),
m AS (SELECT CAST(a AS DATE) AS day, session, tokens, greatest(0, CAST(round((epoch_us(a) - epoch_us(date_trunc('day', a))) / 60e6) AS BIGINT)) AS x, greatest(1, CAST(round((epoch_us(b) - epoch_us(date_trunc('day', a))) / 60e6) AS BIGINT)) AS y FROM s WHERE tokens > 0)
SELECT CAST(day AS VARCHAR) AS day, CAST(sum(tokens) AS BIGINT) AS tokens, string_agg(session || ':' || x || '-' || y, ',' ORDER BY x, session) AS sessions FROM m GROUP BY day"""
)
def days_of_sessions(spark, d):
    spans = _lines(spark, d).groupBy("session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(F.length("text")).alias("tokens"))
    shown = F.transform("sessions", lambda s: F.concat(s["session"].cast("string"), F.lit(":"), s["start_min"].cast("string"), F.lit("-"), s["end_min"].cast("string")))
    return sessions.sessions_by_day(spans).select(F.col("day").cast("string").alias("day"), "tokens", F.array_join(shown, ",").alias("sessions"))


@query(
    """WITH f AS (SELECT conv_id * 1000 + turn AS id, CASE length(text) % 3 WHEN 0 THEN 'dir/agent-a' || role || '-' || substr(md5(text), 1, 8) || '.jsonl' WHEN 1 THEN 'dir/agent-a' || substr(md5(text), 1, 16) || '.jsonl' ELSE 'dir/' || conv_id || '_' || turn || '.jsonl' END AS path FROM conversations), s AS (SELECT 'dir/' || conv_id || '_' || turn || '.meta.json' AS path, 'side ' || role AS agent_type FROM conversations WHERE turn % 2 = 0)
SELECT id, coalesce(s.agent_type, nullif(regexp_extract(regexp_replace(string_split(f.path, '/')[-1], '\\.jsonl$', ''), '^agent-a([a-zA-Z_][\\w-]*?)-[0-9a-f]{6,}$', 1), ''), 'fork') AS agent_type FROM f LEFT JOIN s ON s.path = regexp_replace(f.path, '\\.jsonl$', '.meta.json')"""
)
def agent_kinds(spark, d):
    n, c, t = F.length("text"), F.col("conv_id").cast("string"), F.col("turn").cast("string")
    digest = F.md5(F.col("text").cast("binary"))
    path = F.when(n % 3 == 0, F.concat(F.lit("dir/agent-a"), "role", F.lit("-"), F.substring(digest, 1, 8), F.lit(".jsonl"))).when(n % 3 == 1, F.concat(F.lit("dir/agent-a"), F.substring(digest, 1, 16), F.lit(".jsonl"))).otherwise(F.concat(F.lit("dir/"), c, F.lit("_"), t, F.lit(".jsonl")))
    rows = table(spark, d, "conversations")
    side = rows.where("turn % 2 = 0").select(F.concat(F.lit("dir/"), c, F.lit("_"), t, F.lit(".meta.json")).alias("path"), F.concat(F.lit("side "), "role").alias("agent_type"))
    return sessions.agent_types(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), path.alias("path")), side).select("id", "agent_type")


@query("WITH c AS (SELECT event_id AS call, event_type AS kind, user_id AS prompt FROM events WHERE event_type <> 'error'), r AS (SELECT event_id AS call, CAST(json_extract(props, '$.k') AS BIGINT) AS agent FROM events) SELECT agent, arg_max(kind, call) AS kind, arg_max(prompt, call) AS prompt FROM r JOIN c USING (call) GROUP BY agent")
def spawned_agents(spark, d):
    events = table(spark, d, "events")
    calls = events.where("event_type <> 'error'").select(F.col("event_id").alias("call"), F.col("event_type").alias("kind"), F.col("user_id").alias("prompt"))
    results = events.select(F.col("event_id").alias("call"), F.get_json_object("props", "$.k").cast("long").alias("agent"))
    return sessions.spawned_agents(calls, results)


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events) WHERE nth = 1")
def emitted_once(spark, d):
    return sessions.emitted_once(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")
