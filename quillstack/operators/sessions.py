"""Event logs: active time, attribution by forward fill, neighbours, concurrency, usage sums."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import trees
from .quality import earliest, latest

#: How messages begin that the machine puts in a user's place.
MACHINE_HEADS = ("<task-notification", "<scheduled-wakeup", "<background-task", "[Request interrupted")


def active_time(events: DataFrame, keys: list[str], ts: str, order: list[str], idle_s: int = 300) -> DataFrame:
    """active_s and wall_s of each key: gaps over 0 and under ``idle_s`` seconds count as active."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = at - F.lag(at).over(Window.partitionBy(*keys).orderBy(ts, *order))
    counted = events.withColumn("gap", gap)
    return counted.groupBy(*keys).agg(
        (F.coalesce(F.sum(F.when((F.col("gap") > 0) & (F.col("gap") < idle_s * 1_000_000), F.col("gap"))), F.lit(0)) / 1e6).alias("active_s"), ((F.max(at) - F.min(at)) / 1e6).alias("wall_s"), F.count(F.lit(1)).alias("events")
    )


def fill_forward(rows: DataFrame, keys: list[str], order: list[str], name: str, value: Column, sets: Column) -> DataFrame:
    """``name``: the value at the last row, this one included, for which ``sets`` holds; that value may be null."""
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(sets, F.struct(value.alias("v")))
    return rows.withColumn(name, F.last(mark, ignorenulls=True).over(own)["v"])


def neighbours(rows: DataFrame, keys: list[str], order: str, reach: int = 2) -> DataFrame:
    """The rows up to ``reach`` before and after each one: a row for each, with ``here`` at the row itself."""
    own = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    return rows.withColumn("around", F.collect_list(order).over(own)).withColumn("near", F.explode("around")).drop("around").withColumn("here", F.col("near") == F.col(order))


def peak_concurrency(spans: DataFrame, keys: list[str], bucket_s: int = 600) -> DataFrame:
    """peak and the earliest bucket that has it, of spans (begin_s, end_s in seconds of the day), counted by bucket."""
    cut = spans.withColumns({"lo": F.floor(F.col("begin_s") / bucket_s), "hi": F.ceil(F.col("end_s") / bucket_s)}).where("hi > lo")
    hits = cut.select(*keys, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("bucket")).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    return hits.groupBy(*keys).agg(F.max("n").alias("peak"), F.max_by("bucket", F.struct(F.col("n"), -F.col("bucket"))).alias("bucket"))


def usage(rows: DataFrame, dimensions: list[str], sums: list[str]) -> DataFrame:
    """Sums in all and by each dimension alone, in one pass: dim, value and the sums; rows without a value of a dimension
    count in all only."""
    some = rows.groupingSets([[], *[[d] for d in dimensions]], *dimensions)
    gid = F.grouping_id()
    out = some.agg(*[F.sum(s).alias(s) for s in sums], F.count(F.lit(1)).alias("calls"), gid.alias("gid"))
    n = len(dimensions)
    full = (1 << n) - 1
    named = [F.when(F.col("gid") == full - (1 << (n - 1 - i)), F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"))) for i, d in enumerate(dimensions)]
    key = F.coalesce(*named, F.struct(F.lit("all").alias("dim"), F.lit("").alias("value")))
    return out.select(key.alias("__key"), *sums, "calls").select("__key.*", *sums, "calls").where("value is not null")


def max_per_key(rows: DataFrame, keys: list[str], measure: str, seq: str) -> DataFrame:
    """The row of the largest measure of each key; of ties the later."""
    return latest(rows, keys, [measure, seq])


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return earliest(rows, keys, order)


def ratios(rows: DataFrame, part: str, whole: str, calls: str) -> DataFrame:
    """pct (of whole) and per_call, safe where there is nothing."""
    pct = F.coalesce(F.round(F.col(part) * 100 / F.nullif(F.col(whole), F.lit(0)), 1), F.lit(0.0))
    return rows.withColumns({"pct": pct, "per_call": F.coalesce(F.col(whole) / F.nullif(F.col(calls), F.lit(0)), F.lit(0.0))})


def top(rows: DataFrame, measure: str, key: str, most: int, over: float | None = None) -> DataFrame:
    if over is not None:
        rows = rows.where(F.col(measure) > over)
    return rows.orderBy(F.desc(measure), key).limit(most)


def linked_prompts(agents: DataFrame) -> DataFrame:
    """For ``agents`` (agent, parent, prompt): the prompt of each, or of its nearest ancestor that has one, and how many
    links that one is away."""
    return trees.nearest_value(agents, "agent", "parent", "prompt")


# transcripts: (uuid, session, line, kind_rank, ts, type, text, is_meta, is_summary, is_sidechain, is_result)


def since(rows: DataFrame, value: str, now: Column, ts: str = "ts") -> DataFrame:
    """Rows from a time on: days or hours before ``now`` (``7d``, ``24h``) or a date; a value that is neither keeps all,
    rows without a time stay."""
    found = re.fullmatch(r"(\d+)([dh])", value.strip())
    if found:
        first = now - F.expr(f"INTERVAL {int(found[1])} {'DAY' if found[2] == 'd' else 'HOUR'}")
    else:
        first = F.lit(value).try_cast("timestamp")
    return rows.where(F.coalesce(F.col(ts) >= first, F.lit(True)))


def is_human(text: str = "text") -> Column:
    """Whether a user's message was written by a person in the main transcript: no meta row, summary, tool result, message of
    the machine, interruption or side chain."""
    t = F.coalesce(F.col(text), F.lit(""))
    machine = F.lit(False)
    for head in MACHINE_HEADS:
        machine |= t.startswith(head)
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("is_meta", "is_summary", "is_result", "is_sidechain")]
    return (F.col("type") == "user") & ~(flags[0] | flags[1] | flags[2] | flags[3]) & ~machine


def once_by_uuid(rows: DataFrame) -> DataFrame:
    """Of rows of one uuid the first by kind_rank (main transcripts before others), file age and line; all without a uuid."""
    named = rows.where("uuid is not null")
    return earliest(named, ["uuid"], ["kind_rank", "born", "line"]).unionByName(rows.where("uuid is null"))


def command_of(text: Column) -> Column:
    """The slash command that a message names, null where it names none."""
    return F.nullif(F.trim(F.regexp_extract(text, r"<command-(?:name|message)>/?([^<]+)</command-", 1)), F.lit(""))


def top_invocations(rows: DataFrame, keys: list[str], name: str, most: int = 5) -> DataFrame:
    """keys, name, n and place of the ``most`` names called most often of each key; ties by name."""
    counts = rows.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), name))).where(F.col("place") <= most)


def agent_types(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``files`` (path) with agent_type: that of the sidecar (path, agent_type) beside a file, else the label in its name,
    else ``fork``."""
    beside = files.withColumn("__side", F.regexp_replace("path", r"\.jsonl$", ".meta.json"))
    found = beside.join(sidecars.select(F.col("path").alias("__side"), F.col("agent_type").alias("__type")), "__side", "left")
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jsonl$", "")
    label = F.nullif(F.regexp_extract(base, r"^agent-a([a-zA-Z_][\w-]*?)-[0-9a-f]{6,}$", 1), F.lit(""))
    return found.withColumn("agent_type", F.coalesce("__type", label, F.lit("fork"))).select(*files.columns, "agent_type")


def spawned_agents(calls: DataFrame, results: DataFrame) -> DataFrame:
    """agent, kind and prompt of agents: ``calls`` (call, kind, prompt) are tool uses, ``results`` (call, agent) their
    results; of several calls of an agent the last counts."""
    both = results.join(calls, "call")
    return both.groupBy("agent").agg(F.max_by("kind", "call").alias("kind"), F.max_by("prompt", "call").alias("prompt"))


def sessions_by_day(spans: DataFrame) -> DataFrame:
    """day, tokens and sessions (start_min, end_min, session, tokens; by start) of ``spans`` (session, first_ts, last_ts,
    tokens), each on the day of its first message; sessions without tokens are left out."""
    day = F.date_trunc("day", "first_ts")
    minute = lambda c: F.round((F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(day.cast("timestamp"))) / 60e6)
    one = F.struct(F.greatest(F.lit(0), minute("first_ts")).cast("long").alias("start_min"), F.col("session"), F.greatest(F.lit(1), minute("last_ts")).cast("long").alias("end_min"), F.col("tokens"))
    some = spans.where("first_ts is not null and tokens > 0")
    return some.groupBy(F.to_date("first_ts").alias("day")).agg(F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(one)).alias("sessions"))


def emitted_once(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: what is emitted once for a session, file and rule."""
    return earliest(rows, keys, order)
