"""Rules as rows: conditions on fields, all of a rule's must hold; an index of rules by their literals; verdicts of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged


def condition_holds(value, operator, pattern):
    """One condition; a null field, or an operator that isn't known, doesn't hold."""
    test = (
        F.when(operator == "regex_match", F.regexp(value, pattern))
        .when(operator == "contains", value.contains(pattern))
        .when(operator == "equals", value == pattern)
        .when(operator == "not_contains", ~value.contains(pattern))
        .when(operator == "starts_with", value.startswith(pattern))
        .when(operator == "ends_with", value.endswith(pattern))
        .otherwise(F.lit(False))
    )
    return F.coalesce(test, F.lit(False))


#: Characters of a literal's piece by which rules are looked up.
GRAM = 3
#: Rows of kinds, and of rules, that are broadcast; more are joined by a shuffle.
FEW_KINDS, FEW_RULES = 100_000, 2_000_000
#: Bytes of different messages of a partition, and events of a verdict that are dealt together.
TEXTS, SHARE = 500_000, 50_000


def _gram_keys(field: Column, text: Column) -> Column:
    """Keys of the pieces of a text in a field, without repeats."""
    chars = F.split(text, "")
    pieces = F.transform(F.slice(chars, 1, F.greatest(F.size(chars) - (GRAM - 1), F.lit(0))), lambda c, i: F.xxhash64(F.lit("~"), field, F.concat(c, *[F.get(chars, i + n) for n in range(1, GRAM)])))
    return F.when(F.length(text) >= GRAM, F.array_distinct(pieces)).otherwise(F.array().cast("array<bigint>"))


def _equal_key(field: Column, value: Column) -> Column:
    return F.xxhash64(F.lit("="), field, value)


def required_literal(pattern: Column) -> Column:
    """The longest text that every match of a regular expression holds, of expressions made of plain characters, dots (with * or +)
    and anchors alone; null for others."""
    plain = r"^\^?(?:[^\\^$.|?*+()\[\]{}]|\.[*+]?)*\$?$"
    runs = F.split(F.regexp_replace(pattern, r"[\^$]", ""), r"\.[*+]?")
    return F.when(pattern.rlike(plain), F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)))


def condition_keys(field: Column, operator: Column, pattern: Column) -> Column:
    """The keys that an event must have, all of them, for a condition to hold; none where a condition asks for no text."""
    literal = F.when(operator.isin("contains", "starts_with", "ends_with"), pattern).when(operator == "regex_match", required_literal(pattern))
    equal = F.when((operator == "equals") & pattern.isNotNull(), F.array(_equal_key(field, pattern)))
    return F.coalesce(equal, F.when(literal.isNotNull(), _gram_keys(field, literal)), F.array().cast("array<bigint>"))


def anchors(conditions: DataFrame) -> DataFrame:
    """rule and key of the rules that have one: of the keys that its conditions ask for, the one that fewest rules ask for."""
    keys = conditions.select("rule", F.explode(condition_keys(F.col("field"), F.col("operator"), F.col("pattern"))).alias("key")).distinct()
    asked = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return keys.join(asked.hint("merge"), "key").groupBy("rule").agg(F.min_by("key", F.struct("n", "key")).alias("key"))


def _beside(table: DataFrame, few: int) -> DataFrame:
    """``table``, staged, for a join with many rows: broadcast if it has ``few`` rows at most. The size of a file tells little of the memory
    that a driver needs to broadcast it."""
    return F.broadcast(table) if table.count() <= few else table.hint("merge")


def _kinds(rules: DataFrame, conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules that ask for the same (tools and conditions) are one kind: rule, action, message and kind of the rules that have
    conditions; kind, tools and conditions of the kinds. A hash of what is asked for stands for the kind."""
    each = conditions.groupBy("rule").agg(F.array_sort(F.collect_set(F.struct("field", "operator", "pattern"))).alias("conditions"))
    known = staged(rules.join(each.hint("merge"), "rule").withColumn("kind", F.xxhash64(F.to_json(F.struct("tools", "conditions")))), "rules")
    kinds = staged(known.groupBy("kind").agg(F.first("tools").alias("tools"), F.first("conditions").alias("conditions")), "rule-kinds")
    return known.select("rule", "action", "message", "kind"), kinds


def _met(events: DataFrame, kinds: DataFrame, fields: list[str], key: str, tool: str, batch: int) -> tuple[DataFrame, DataFrame]:
    """event and row of ``events``, and row and kind of those that a kind of rules matches. Events of equal tools and fields are one row,
    for which a hash of them stands."""
    named = [F.col(tool).alias("tool"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]]
    # numbers between the values tell nulls apart
    row = F.xxhash64(*[x for i, c in enumerate(["tool", *[f"f{i}" for i in range(len(fields))]]) for x in (F.lit(i), F.col(c))])
    own = events.select(F.col(key).alias("event"), *named).select("event", row.alias("row"))
    values = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.col(f"f{i}"))])
    rows = staged(events.select(*named).distinct().select(row.alias("row"), "tool", values.alias("values")), "rule-rows")

    fits = (F.col("tools") == "*") | F.array_contains(F.split("tools", r"\|"), F.col("tool"))
    holds = F.forall("conditions", lambda c: condition_holds(F.try_element_at(F.col("values"), c["field"]), c["operator"], c["pattern"]))
    keys = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.concat(F.array(_equal_key(F.lit(f), F.col("values")[f])), _gram_keys(F.lit(f), F.col("values")[f])), F.array().cast("array<bigint>")) for f in fields])))
    asked = kinds.select(F.col("kind").alias("rule"), F.explode("conditions").alias("c")).select("rule", "c.*")
    held = staged(anchors(asked).withColumnRenamed("rule", "kind").join(kinds.select("kind", "tools").hint("merge"), "kind"), "rule-anchors")
    # a kind has one key, and a row has a key once
    some = rows.select("row", "tool", F.explode(keys).alias("key")).join(_beside(held, FEW_KINDS), "key").where(fits).select("row", "kind")
    found = rows.join(some.hint("merge"), "row").join(_beside(kinds, FEW_KINDS), "kind").where(holds).select("row", "kind")

    rest = staged(kinds.join(held, "kind", "left_anti"), "rule-rest")
    batches = -(-rest.count() // batch)
    for number in range(batches):
        # about ``batch`` kinds
        part = F.broadcast(rest.where(F.pmod(F.xxhash64("kind"), F.lit(batches)) == number))
        found = found.unionByName(rows.join(part, fits).where(holds).select("row", "kind"))
    return own, found


def matches(events: DataFrame, rules: DataFrame, conditions: DataFrame, fields: list[str], key: str = "event_id", tool: str = "tool", batch: int = 10_000) -> DataFrame:
    """key and rule of the events that a rule matches: its tool pattern (``*`` or names between ``|``) and all its conditions.

    ``rules``: rule, tools, action, message. ``conditions``: rule, field, operator, pattern. A rule without conditions matches
    nothing.

    Rules that ask for the same are one kind, and kinds are an inverted index: each is kept under one key that a matching event must have,
    a value it equals or a piece of a text it holds, and an event meets the kinds of its own keys only. Kinds that ask for no text
    meet all events; they are broadcast in batches of ``batch``, so any number is taken. Events of one key are told apart by
    their row.
    """
    known, kinds = _kinds(rules, conditions)
    own, met = _met(events, kinds, fields, key, tool, batch)
    return own.join(met.hint("merge"), "row").join(known.hint("merge"), "kind").select(F.col("event").alias(key), "rule", "action", "message")


def judged(events: DataFrame, rules: DataFrame, conditions: DataFrame, fields: list[str], key: str = "event_id", tool: str = "tool", batch: int = 10_000) -> DataFrame:
    """The :func:`verdicts` of the :func:`matches`, without a row for every match: events that meet the same kinds of rules share their
    verdict, so messages are put together once for each set of kinds."""
    known, kinds = _kinds(rules, conditions)
    own, met = _met(events, kinds, fields, key, tool, batch)
    sets = met.groupBy("row").agg(F.array_sort(F.collect_list("kind")).alias("kinds")).withColumn("set", F.xxhash64("kinds"))
    sets = staged(sets, "rule-sets")
    # an event of several rows has the matches of all of them
    marks = own.join(sets.select("row", "set").hint("merge"), "row").groupBy("event").agg(F.array_sort(F.collect_list("set")).alias("sets"))
    marks = staged(marks.withColumn("mark", F.xxhash64("sets")), "rule-marks")
    of_sets = sets.groupBy("set").agg(F.first("kinds").alias("kinds")).select("set", F.explode("kinds").alias("kind"))
    each = marks.groupBy("mark").agg(F.first("sets").alias("sets"), F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("copies"))
    each = staged(each.select("mark", "copies", F.explode("sets").alias("set")).join(of_sets.hint("merge"), "set").select("mark", "copies", "kind"), "rule-asked")
    return _dealt(marks, each, known).select(F.col("event").alias(key), "verdict", "messages")


def _dealt(marks: DataFrame, each: DataFrame, known: DataFrame) -> DataFrame:
    """event, verdict and messages of ``marks`` (event, mark), by the kinds of ``each`` mark (mark, copies, kind) and their rules. Every event
    has all its messages, so they are many times the input. Events of a mark lie together, in partitions of so few marks
    that a writer with dictionaries keeps each text once; those of a mark with many events are dealt to copies of it."""
    act = lambda a, x: F.when(F.col("action") == a, x)
    bytes_ = known.groupBy("kind").agg(*[F.sum(act(a, F.octet_length("message") + 1)).alias(a) for a in ("block", "warn")])
    told = each.join(bytes_.hint("merge"), "kind").groupBy("mark").agg(F.max("copies").alias("copies"), F.sum("block").alias("b"), F.sum("warn").alias("w"))
    total = told.agg(F.sum(F.col("copies") * (F.coalesce("b", "w", F.lit(0)) + 32))).first()[0] or 0

    lists = known.groupBy("kind", "action").agg(F.collect_list(F.struct("rule", "message")).alias("list"))
    lists = F.broadcast(lists) if known.count() <= FEW_RULES else lists.hint("merge")
    texts = lambda a: F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list(act(a, F.col("list"))))), lambda x: x["message"]), "\n")
    ends = [texts("block").alias("blocked"), texts("warn").alias("warned"), F.bool_or(F.col("action") == "block").alias("stop")]
    if total <= TEXTS:
        return marks.join(F.broadcast(_told(each.join(lists, "kind").groupBy("mark").agg(*ends), "mark")), "mark")
    parts = max(-(-total // TEXTS), int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = F.broadcast(each.where("copies > 1").select("mark", "copies").distinct())
    dealt = marks.select("event", "mark").join(many, "mark", "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64("event"), "copies"), F.lit(0)).cast("int"))
    copies = each.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).repartition(parts, "mark", "copy")
    told = _told(copies.join(lists, "kind").groupBy("mark", "copy").agg(*ends), "mark", "copy")
    return dealt.repartition(parts, "mark", "copy").join(told.hint("merge"), ["mark", "copy"])


def _told(found: DataFrame, *key: str) -> DataFrame:
    return found.select(*key, F.when(F.col("stop"), "block").otherwise("warn").alias("verdict"), F.when(F.col("stop"), F.col("blocked")).otherwise(F.col("warned")).alias("messages"))


def verdicts(found: DataFrame, key: str = "event_id") -> DataFrame:
    """verdict and messages of each event: any block outranks warnings."""
    texts = lambda a: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("action") == a, F.struct("rule", "message")))), lambda x: x["message"]), "\n")
    out = found.groupBy(key).agg(texts("block").alias("blocked"), texts("warn").alias("warned"), F.bool_or(F.col("action") == "block").alias("stop"))
    return _told(out, key)


def first_match(rows: DataFrame, rules: list[tuple[str, str]], column: str) -> DataFrame:
    """The first rule, in order, whose substring the column holds; null where none does."""
    return rows.withColumn("rule", F.coalesce(*[F.when(F.col(column).contains(p), F.lit(r)) for r, p in rules]))
