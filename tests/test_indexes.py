"""Stored indexes and exact joins against plain ones."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.operators import bins, documents, fulltext, impact, relations, rules, setjoin

# impact-ordered search


def number_of_files(df):
    """Files that a scan has read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numFiles").get().value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(1, 60)))) for i in range(900)] + [(900, None), (901, ""), (902, "lonely w0")]
    docs = spark.createDataFrame(rows, "id long, text string")
    path = str(tmp_path_factory.mktemp("impact") / "index")
    impact.write(docs, "id", ["text"], path, block=16, folders=8, strand=200)
    return docs, path


@pytest.mark.parametrize("terms", [["w0"], ["w0", "w1"], ["w3", "w10", "w0"], ["w50", "w51"], ["lonely"], ["w0", "nowhere"], []])
def test_best_of_an_impact_index_are_those_of_all(spark, library, terms):
    docs, path = library
    ranking = [(r["doc"], round(r["score"], 9)) for r in fulltext.bm25(fulltext.postings(docs, "id", ["text"]), terms).collect()] if terms else []
    assert [(r["doc"], round(r["score"], 9)) for r in impact.search(spark, path, terms, first_blocks=1).collect()] == ranking


def test_best_within_other_filters(spark, library):
    docs, path = library
    some = docs.where("id % 3 = 0").select(F.col("id").alias("doc"))
    want = fulltext.bm25(fulltext.postings(docs, "id", ["text"]), ["w0", "w2"], 5, within=some).collect()
    assert [r["doc"] for r in impact.search(spark, path, ["w0", "w2"], 5, within=some, first_blocks=1).collect()] == [r["doc"] for r in want]


def test_a_search_reads_its_terms_folders_only(spark, library):
    _, path = library
    whole = number_of_files(spark.read.parquet(f"{path}/blocks"))
    own = number_of_files(impact.blocks_of(spark, path, ["w7"]))
    assert 0 < own < whole / 3
    blocks = impact.blocks_of(spark, path, ["w0"]).collect()
    assert len(blocks) > 20 and all(len(r["docs"]) <= 16 for r in blocks)
    # blocks are in impact order, each bounded by its first posting
    assert all(r["tfs"][0] / (r["tfs"][0] + 0.3 + 0.9 * r["dls"][0] / 30) >= r["tfs"][-1] / (r["tfs"][-1] + 0.3 + 0.9 * r["dls"][-1] / 30) - 0.02 for r in blocks)


# top-k set joins


def best_sets(probes, held, k, least, measure):
    out = set()
    for a, x in probes.items():
        scored = []
        for b, y in held.items():
            o = len(x & y)
            score = o if measure == "shared" else o / len(x | y) if o else 0
            if a != b and o and score >= least:
                scored.append((-score, b, o))
        out |= {(a, b, o, place) for place, (_, b, o) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("measure,least", [("jaccard", 0.1), ("jaccard", 0.45), ("shared", 1.0)])
@pytest.mark.parametrize("k", [1, 4])
def test_top_k_sets(spark, monkeypatch, measure, least, k):
    monkeypatch.setattr(setjoin, "CELL", 20)  # so that cells are cut
    rng = np.random.default_rng(k)
    sets = {i: {f"t{t}" for t in rng.zipf(1.4, rng.integers(1, 9)) if t < 80} | ({"hot"} if i % 2 else set()) for i in range(240)}
    sets = {i: s for i, s in sets.items() if s} | {500: {"alone"}}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tags array<string>")
    got = setjoin.top_k(rows, rows, k, least, measure).collect()
    assert {(r["a"], r["b"], r["shared"], r["place"]) for r in got} == best_sets(sets, sets, k, least, measure)



@pytest.mark.parametrize("levels", [(), (0.9, 0.5)])
def test_top_k_sets_with_one_element_in_all(spark, monkeypatch, levels):
    monkeypatch.setattr(setjoin, "CELL", 20)
    sets = {i: {"hot", f"own{i}"} | ({"warm"} if i % 2 else set()) | ({"pair"} if i in (31, 77) else set()) for i in range(150)} | {900: {"hot"}, 901: set()}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tags array<string>")
    got = setjoin.top_k(rows, rows, 3, 0.1, levels=levels).collect()
    assert {(r["a"], r["b"], r["shared"], r["place"]) for r in got} == best_sets(sets, sets, 3, 0.1, "jaccard")
    probes = rows.where("id % 50 = 0")
    got = setjoin.top_k(probes, rows, 3, 1.0, "shared", levels=levels).collect()
    assert {(r["a"], r["b"], r["shared"], r["place"]) for r in got} == best_sets({a: s for a, s in sets.items() if a % 50 == 0}, sets, 3, 1.0, "shared")


def test_copies_of_a_set_are_joined_once(spark):
    sets = [["x", "y"], ["y", "x", "z"], ["hot"], ["hot", "x"]]
    rows = spark.createDataFrame([(i, sets[i % 4]) for i in range(400)] + [(900, [])], "id long, tags array<string>")
    classes, members = setjoin._classes(rows)
    assert (classes.count(), members.count()) == (4, 400)
    own = {i: set(sets[i % 4]) for i in range(400)}
    for measure, least in (("jaccard", 0.1), ("shared", 1.0)):
        got = setjoin.top_k(rows, rows, 5, least, measure).collect()
        assert {(r["a"], r["b"], r["shared"], r["place"]) for r in got} == best_sets(own, own, 5, least, measure)


@pytest.mark.parametrize("small", [0, 3, 8])
@pytest.mark.parametrize("measure,least,k", [("jaccard", 0.1, 4), ("shared", 1.0, 1), ("shared", 1.0, 5)])
def test_sets_meet_by_subsets_or_by_lists(spark, monkeypatch, small, measure, least, k):
    monkeypatch.setattr(setjoin, "SMALL", small)
    rng = np.random.default_rng(3)
    sets = {i: {f"t{t}" for t in rng.integers(0, 14, rng.integers(1, 8))} for i in range(200)}
    probes = {i: s | ({"unknown"} if i % 2 else set()) for i, s in sets.items() if i % 3 == 0} | {700: {"unknown"}}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tags array<string>")
    asked = spark.createDataFrame([(i, sorted(s)) for i, s in probes.items()], "id long, tags array<string>")
    got = setjoin.top_k(asked, rows, k, least, measure).collect()
    assert {(r["a"], r["b"], r["shared"], r["place"]) for r in got} == best_sets(probes, sets, k, least, measure)


@pytest.mark.parametrize("measure,least", [("jaccard", 0.1), ("shared", 1.0)])
def test_sets_of_few_elements_meet_few_others(spark, monkeypatch, measure, least):
    # 1,600 classes, each with 78 others that differ in one element
    rows = spark.range(1600).select("id", F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.concat(F.lit("x"), F.col("id") % 40), F.concat(F.lit("y"), F.floor(F.col("id") / 40))).alias("tags"))
    seen, first_of = [], setjoin.first_of
    monkeypatch.setattr(setjoin, "first_of", lambda pairs, k: seen.append(pairs.count()) or first_of(pairs, k))
    found = setjoin.top_k(rows, rows, 2, least, measure)
    assert found.count() == 3200 and found.where("shared = 4").count() == 3200
    assert max(seen) <= 1600 * 5 * 3


BOOK = "id long, series string, tags array<string>, is_old_version boolean, is_draft boolean, is_duplicate boolean"


def test_related_by_tags_with_a_hot_tag_and_a_hot_series(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "s" if i % 2 else (f"q{i % 5}" if i % 3 else None), sorted({f"t{t}" for t in rng.integers(0, 25, 3)} | {"hot"}) if i % 7 else None) for i in range(120)]
    books = spark.createDataFrame([(*r, i % 11 == 5, False, False) for i, r in enumerate(rows)], BOOK)
    tags, series = {i: set(t or ()) for i, _, t in rows}, {i: s for i, s, _ in rows}
    want = set()
    for a in tags:
        scored = [(-(len(tags[a] & tags[b]) + (10 if series[a] and series[a] == series[b] else 0)), b) for b in tags if b != a and b % 11 != 5]
        want |= {(a, b, -w, n) for n, (w, b) in enumerate(sorted(x for x in scored if x[0])[:6], 1)}
    got = relations.related_by_tags(books, books.select("id", "series", "tags")).collect()
    assert {(r["a"], r["b"], r["weight"], r["nth"]) for r in got} == want


# rules by their literals


def test_rules_by_their_literals(spark):
    rng = random.Random(2)
    alphabet = "abcd. "
    text = lambda n: "".join(rng.choices(alphabet, k=n))
    events = [(i, rng.choice(["Bash", "Edit", None]), text(rng.randint(0, 14)), rng.choice([None, text(5)])) for i in range(150)] + [(3, "Bash", "abcd", "x")]
    operators = ["regex_match", "contains", "equals", "not_contains", "starts_with", "ends_with", "odd"]
    known, conditions = [], []
    for r in range(120):
        known.append((r, rng.choice(["*", "Bash", "Bash|Edit", "Write"]), "warn", f"m{r}"))
        for _ in range(rng.randint(0, 3)):
            op = rng.choice(operators)
            pattern = rng.choice(["^a", "b+", "[ab]c", "ab.*cd", "a.c", "abc$", "(a|b)", "abc|bcd", "ab?c", r"a\.b"]) if op == "regex_match" else rng.choice([None, rng.choice(events)[2] or "a", text(3), text(2), text(1)])
            conditions.append((r, rng.choice(["command", "file", "missing"]), op, pattern))
    import re

    def holds(e, field, op, pattern):
        value = {"command": e[2], "file": e[3]}.get(field)
        if value is None or pattern is None:
            return False
        return {"regex_match": lambda: re.search(pattern, value) is not None, "contains": lambda: pattern in value, "equals": lambda: pattern == value, "not_contains": lambda: pattern not in value, "starts_with": lambda: value.startswith(pattern), "ends_with": lambda: value.endswith(pattern)}.get(op, lambda: False)()

    want = defaultdict(int)
    for e in events:
        for r, tools, _, _ in known:
            own = [c[1:] for c in conditions if c[0] == r]
            if own and (tools == "*" or e[1] in tools.split("|")) and all(holds(e, *c) for c in own):
                want[e[0], r] += 1
    rows = spark.createDataFrame(events, "event_id long, tool string, command string, file string")
    table = spark.createDataFrame(known, "rule long, tools string, action string, message string")
    asked = spark.createDataFrame(conditions, "rule long, field string, operator string, pattern string")
    got = defaultdict(int)
    for r in rules.matches(rows, table, asked, ["command", "file"], batch=7).collect():
        got[r["event_id"], r["rule"]] += 1
    assert got == want and len(want) > 30


def test_required_literals(spark):
    cases = {"^abc": "abc", "ab.*cdef": "cdef", "a.b+": None, "abc|d": None, "ab?c": None, "a{2}b": None, "x.+yz$": "yz", "(abc)": None, "": "", r"a\d": None, "abc*": None, "ab.cde": "cde"}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", rules.required_literal(F.col("p")).alias("x")).collect()
    assert {r["p"]: r["x"] for r in rows} == cases


def test_very_many_rules(spark):
    known = spark.range(100_000).select(F.col("id").alias("rule"), F.lit("*").alias("tools"), F.lit("warn").alias("action"), F.lit("m").alias("message"))
    asked = known.select("rule", F.lit("command").alias("field"), F.lit("contains").alias("operator"), F.concat(F.lit("key"), F.col("rule"), F.lit(";")).alias("pattern"))
    events = spark.range(50).select(F.col("id").alias("event_id"), F.lit("Bash").alias("tool"), F.concat(F.lit("run key"), F.col("id") * 1999, F.lit("; end")).alias("command"))
    got = rules.matches(events, known, asked, ["command"]).collect()
    assert sorted((r["event_id"], r["rule"]) for r in got) == [(i, i * 1999) for i in range(50)]


def test_verdicts_of_kinds_are_those_of_all_matches(spark):
    rng = random.Random(5)
    events = [(rng.randint(0, 60), rng.choice(["Bash", "Edit", None]), rng.choice(["abc", "abcd", "", None]), rng.choice([None, "x", "abc"])) for _ in range(120)]
    known = [(r, rng.choice(["*", "Bash", "Bash|Edit"]), rng.choice(["warn", "block", "note", None]), f"m{r % 7}") for r in range(200)] + [(3, "*", "warn", "again")]
    conditions = [(r, rng.choice(["command", "file"]), *rng.choice([("contains", "abc"), ("not_contains", "d"), ("equals", "x"), ("regex_match", "[ab]c"), ("equals", None)])) for r in range(200) for _ in range(rng.randint(0, 2))]
    rows = spark.createDataFrame(events, "event_id long, tool string, command string, file string")
    table = spark.createDataFrame(known, "rule long, tools string, action string, message string")
    asked = spark.createDataFrame(conditions, "rule long, field string, operator string, pattern string")
    want = rules.verdicts(rules.matches(rows, table, asked, ["command", "file"])).collect()
    got = rules.judged(rows, table, asked, ["command", "file"], batch=3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 30


def test_rules_that_ask_for_the_same_are_told_once(spark):
    # 60 million matches, of one kind of rules
    known = spark.range(20_000).select(F.col("id").alias("rule"), F.lit("*").alias("tools"), F.lit("warn").alias("action"), F.lit("m").alias("message"))
    asked = known.select("rule", F.lit("command").alias("field"), F.lit("not_contains").alias("operator"), F.lit("x").alias("pattern"))
    events = spark.range(3000).select(F.col("id").alias("event_id"), F.lit("Bash").alias("tool"), F.lit("run").alias("command"))
    own, met = rules._met(events, rules._kinds(known, asked)[1], ["command"], "event_id", "tool", 10_000)
    assert (own.count(), met.count()) == (3000, 1)
    assert rules.judged(events, known, asked, ["command"]).where(F.length("messages") == 2 * 20_000 - 1).count() == 3000


def test_rows_of_events_are_not_broadcast(spark):
    # small in a file, large in the memory of a driver
    known = spark.createDataFrame([(1, "*", "warn", "m")], "rule long, tools string, action string, message string")
    asked = spark.createDataFrame([(1, "command", "contains", "key")], "rule long, field string, operator string, pattern string")
    events = spark.range(2000).select(F.col("id").alias("event_id"), F.lit("Bash").alias("tool"), F.concat(F.lit("a key "), F.col("id")).alias("command"))
    _, met = rules._met(events, rules._kinds(known, asked)[1], ["command"], "event_id", "tool", 10_000)
    assert "SortMergeJoin [row" in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 2000
    assert rules.judged(events, known, asked, ["command"]).count() == 2000


def test_events_of_equal_messages_lie_together(spark, monkeypatch):
    monkeypatch.setattr(rules, "TEXTS", 400, raising=False)
    monkeypatch.setattr(rules, "SHARE", 100, raising=False)
    known = spark.range(100).select(F.col("id").alias("rule"), F.lit("*").alias("tools"), F.lit("warn").alias("action"), F.concat(F.lit("message "), F.col("id")).alias("message"))
    asked = known.select("rule", F.lit("command").alias("field"), F.lit("contains").alias("operator"), F.concat(F.lit("key"), F.col("rule") % 20, F.lit(";")).alias("pattern"))
    which = F.when(F.col("id") % 2 == 0, F.lit(3)).otherwise(F.col("id") % 20)
    events = spark.range(2000).select(F.col("id").alias("event_id"), F.lit("Bash").alias("tool"), F.concat(F.lit("key"), which, F.lit("; key"), F.col("id") % 3, F.lit(";")).alias("command"))
    got = rules.judged(events, known, asked, ["command"]).withColumn("part", F.spark_partition_id()).collect()
    want = rules.verdicts(rules.matches(events, known, asked, ["command"])).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(map(tuple, want)) and len(want) == 2000
    parts = defaultdict(set)
    for r in got:
        parts[r["messages"]].add(r["part"])
    # texts of few events are in one place; half of the events have one of three texts and are dealt to copies of it
    counts = Counter(r["messages"] for r in got)
    assert all(len(parts[m]) == 1 for m, n in counts.items() if n <= 100) and max(len(parts[m]) for m, n in counts.items() if n > 300) > 1
    assert max(Counter(r["part"] for r in got).values()) < 1000


# greedy pairs and sequential bins


def test_greedy_pairs_are_those_of_a_loop(spark):
    rng = random.Random(6)
    rows = [(d, i, j, rng.randint(1, 6) / 6) for d in range(12) for i in range(10) for j in range(9) if rng.random() < 0.5] + [(None, 1, 1, 0.9), (None, 2, 1, 1.0)]
    want = set()
    for d in [*range(12), None]:
        used = set()
        for i in sorted({r[1] for r in rows if r[0] == d}):
            free = sorted((-s, j) for e, k, j, s in rows if e == d and k == i and j not in used and s >= 0.3)
            if free:
                used.add(free[0][1])
                want.add((d, i, free[0][1]))
    table = spark.createDataFrame(rows, "doc_id long, left_ord int, right_ord int, score double").repartition(5)
    got = documents.greedy_pairs(table).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["left_ord"], r["right_ord"]) for r in got} == want


@pytest.mark.parametrize("lefts", [1, 3, 1024])
def test_greedy_pairs_over_blocks_are_those_of_a_loop(spark, monkeypatch, lefts):
    monkeypatch.setattr(documents, "LEFTS", lefts)
    rng = random.Random(7)
    rows = [(d, i, j, rng.randint(1, 6) / 6) for d in ("a", "b", None) for i in range(9) for j in range(i - 2, i + 3) if rng.random() < 0.8]
    want = set()
    for d in ("a", "b", None):
        used = set()
        for i in range(9):
            free = sorted((-s, j) for e, k, j, s in rows if e == d and k == i and j not in used and s >= 0.3)
            if free:
                used.add(free[0][1])
                want.add((d, i, free[0][1], -free[0][0]))
    got = documents.greedy_pairs(spark.createDataFrame(rows, "doc_id string, left_ord long, right_ord long, score double").repartition(3)).collect()
    assert len(got) == len(want) and {tuple(r[c] for c in ("doc_id", "left_ord", "right_ord", "score")) for r in got} == want


def test_a_chain_of_lefts_takes_no_round_each(spark, monkeypatch):
    # every left wants the right that the one before falls back to
    rows = [(1, 0, 0, 1.0)] + [x for i in range(1, 40) for x in ((1, i, i - 1, 1.0), (1, i, i, 0.5))]
    written, staged = [], documents.staged
    monkeypatch.setattr(documents, "staged", lambda df, name: written.append(name) or staged(df, name))
    got = documents.greedy_pairs(spark.createDataFrame(rows, "doc_id long, left_ord long, right_ord long, score double")).collect()
    assert sorted((r["left_ord"], r["right_ord"]) for r in got) == [(i, i) for i in range(40)]
    assert len(written) <= 5


def bins_of(sizes, limit):
    out, used, now = [], 0, 0
    for n in sizes:
        if used and used + n > limit:
            now, used = now + 1, 0
        used += n
        out.append(now)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_step_functions(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.integers(1, 30))
    sizes = rng.integers(0, [3, 12, 40][seed % 3], rng.integers(1, 40))
    total, lows, outs, counts, zero_out, zero_count = bins.step_function(sizes, limit)
    for load in range(0, 60):
        used, begun = load, 0
        for n in sizes.tolist():
            if used and used + n > limit:
                begun, used = begun + 1, 0
            used += n
        at = int(np.searchsorted(lows, load, "right")) - 1
        got = (zero_out, zero_count) if load == 0 else (load + total, 0) if at < 0 else (outs[at], counts[at])
        assert got == (used, begun), load


def test_bins_over_many_blocks_are_those_of_a_loop(spark):
    rng = np.random.default_rng(5)
    docs = {0: rng.integers(0, 50, 6000), 1: rng.integers(0, 3, 700), 2: np.array([5, 500, 0, 0, 5]), 3: np.zeros(90, int), 4: rng.integers(0, 400, 2500)}
    rows = [(d, i, int(n), "x") for d, sizes in docs.items() for i, n in enumerate(sizes)] + [(None, 0, None, "n"), (None, 1, 100, "n"), (None, 2, 1, "n")]
    table = spark.createDataFrame(rows, "doc_id long, ord long, size int, note string").repartition(6)
    got = defaultdict(dict)
    for r in documents.chunk_bins(table, "size", 100).collect():
        got[r["doc_id"]][r["ord"]] = r["bin"]
    small = defaultdict(dict)
    for r in bins.sequential_bins(table, "size", 100, block_bits=5).collect():
        small[r["doc_id"]][r["ord"]] = r["bin"]
    want = {d: dict(enumerate(bins_of(s.tolist(), 100))) for d, s in docs.items()} | {None: {0: 0, 1: 0, 2: 1}}
    assert got == want and small == want


def test_one_long_document_is_cut_over_many_tasks(spark):
    n = 300_000
    table = spark.range(n).select(F.lit("only").alias("doc_id"), F.col("id").alias("ord"), (F.pmod(F.xxhash64("id"), F.lit(97))).alias("size"))
    found = bins.sequential_bins(table, "size", 1000, block_bits=12)
    got = [r["bin"] for r in found.orderBy("ord").select("bin").collect()]
    sizes = [r["size"] for r in table.orderBy("ord").collect()]
    assert got == bins_of(sizes, 1000)
    # no task holds more than a block
    parts = found.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < n


def test_an_index_counts_where_postings_lie(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b" if i % 2 else "a a") for i in range(20)] + [(1, "c")], "doc_id long, text string")
    impact.write(docs, "doc_id", ["text"], str(tmp_path), block=3, folders=2, strand=4)
    assert {(r["doc"], r["dl"]) for r in spark.read.parquet(f"{tmp_path}/postings").collect()} == {(i, 3 if i == 1 else 2) for i in range(20)}
    assert {(r["term"], r["df"]) for r in spark.read.parquet(f"{tmp_path}/blocks").collect()} == {("a", 20), ("b", 10), ("c", 1)}
