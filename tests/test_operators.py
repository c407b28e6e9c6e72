"""Operators on small hand-made tables, edge cases first."""

import pytest
from pyspark.sql import functions as F

from quillstack.functions import text as fn
from quillstack.operators import documents, inventory, quality, ranges, relations, search, sessions, stats, sync


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("cell,lo,hi", [("01-30", 1, 30), ("96-00", 96, 100), ("00", 100, 100), ("45", 45, 45), ("7–9", 7, 9), (" 3 - 5 ", 3, 5)])
def test_range_cell(spark, cell, lo, hi):
    got = one(spark, cell, fn.range_cell)
    assert (got["lo"], got["hi"]) == (lo, hi)


@pytest.mark.parametrize("cell", ["-", "–", "n/a", "", None])
def test_range_cell_without_range(spark, cell):
    assert one(spark, cell, fn.range_cell) is None


@pytest.mark.parametrize(
    "text,lo,hi",
    [
        ("a third-to-fifth level adventure", 3, 5),
        ("a first-level quest", 1, 1),
        ("for 5th-10th level heroes", 5, 10),
        ("Levels 3-5", 3, 5),
        ("of level 7", 7, 7),
        ("tier 2 characters", 5, 10),
        ("levels 40-50", None, None),
        ("a ring", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_level_range(spark, text, lo, hi):
    got = one(spark, text, fn.level_range)
    assert (got["min_level"], got["max_level"]) == (lo, hi)


@pytest.mark.parametrize("name,key", [("Copy of Map (1).PDF", "map.pdf"), ("map - copy.pdf", "map.pdf"), ("map", "map"), (".hidden", ".hidden"), ("A  B.txt", "a b.txt")])
def test_near_name(spark, name, key):
    assert one(spark, name, fn.near_name) == key


@pytest.mark.parametrize("text,out", [("A — B :", "A - B"), ("  x  y , ", "x y"), (" : ", None), (None, None), ("old", "new")])
def test_normal_series(spark, text, out):
    assert one(spark, text, lambda c: fn.normal_series(c, {"old": "new"})) == out


def test_decoded_path_keeps_plus_and_bad_escapes(spark):
    assert one(spark, "a%20b+c", fn.decoded_path) == "a b+c"
    assert one(spark, "100%", fn.decoded_path) == "100%"


@pytest.mark.parametrize("text,ok", [("{a{b}}", True), ("}{", False), ("{", False), ("", True)])
def test_balanced(spark, text, ok):
    assert one(spark, text, fn.balanced) is ok


BOOK = "id long, display_title string, publisher string, game_system string, series string, collection string, page_count int, tags array<string>, is_old_version boolean, is_draft boolean, is_duplicate boolean, min_level long, max_level long, date_enriched string"


def books(spark, tags):
    return spark.createDataFrame([(i, f"t{i}", "p", "g", None, None, 1, t, False, False, False, None, None, None) for i, t in tags.items()], BOOK)


def relation(spark, tags, **more):
    return {(r["a"], r["b"]): (round(r["score"], 6), r["shared"]) for r in relations.jaccard_relations(books(spark, tags), **more).collect()}


def test_jaccard(spark):
    assert relation(spark, {1: ["a", "b"], 2: ["a", "b"]}) == {(1, 2): (1.0, 2), (2, 1): (1.0, 2)}
    assert relation(spark, {1: list("abc"), 2: list("bcd")})[1, 2] == (0.5, 2)
    assert relation(spark, {1: ["a"], 2: ["b"], 3: [], 4: None}) == {}
    # a tag that is too common doesn't count as shared, but counts in sizes
    assert relation(spark, {i: ["x", "r"] if i < 2 else ["x"] for i in range(6)}, most_common=5)[0, 1] == (round(1 / 3, 6), 1)
    found = relation(spark, {i: ["x"] for i in range(11)}, top_k=3)
    assert sum(a == 1 for a, _ in found) == 3


def test_grouping_without_collection_is_a_group_each(spark):
    rows = [(1, "b", "P", "g", None, "Set  One", 1, [], False, False, False, None, None, None), (2, "a", "p ", "g", None, "set one", 1, [], False, False, False, None, None, None), (3, "c", "p", "g", None, None, 1, [], False, False, False, None, None, None), (4, "d", "p", "g", None, "", 1, None, False, False, False, None, None, None)]
    got = search.search_grouped(spark.createDataFrame(rows, BOOK), search.SearchSpec()).collect()
    assert [(r["id"], r["variant_count"], r["variant_ids"]) for r in got] == [(2, 2, [2, 1]), (3, 1, [3]), (4, 1, [4])]


def test_level_bounds_alone_are_a_point(spark):
    rows = spark.createDataFrame([(1, 1, 4), (2, 5, 10), (3, None, None)], "id long, min_level long, max_level long")
    assert [r["id"] for r in rows.where(search.level_overlap(None, 4)).collect()] == [1]
    assert [r["id"] for r in rows.where(search.level_overlap(4, 5)).collect()] == [1, 2]


def test_not_tags_passes_null(spark):
    b = books(spark, {1: ["a"], 2: None, 3: ["b"]})
    assert {r["id"] for r in b.where(search.predicate(search.SearchSpec(not_tags=["a"]))).collect()} == {2, 3}


def test_upsert_insert_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    state = lambda df: sorted((r["id"], r["v"]) for r in df.collect())
    assert state(search.upsert(old, new, ["id"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert state(search.insert_absent(old, new, ["id"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert state(search.delete(old, new, ["id"])) == [(1, "a")]


def test_content_duplicates_are_idempotent(spark):
    rows = spark.createDataFrame([(3, "f", None), (1, "f", None), (2, "f", "x"), (4, "g", None)], "id long, filename string, title string")
    flagged = quality.content_duplicates(rows, ["filename", "title"])
    assert [r["id"] for r in flagged.collect()] == [3]
    left = rows.join(flagged, "id", "left_anti")
    assert quality.content_duplicates(left, ["filename", "title"]).count() == 0


def test_implied_tags_twice_is_once(spark):
    b = books(spark, {1: ["a"], 2: None})
    tags = lambda df: df.select("id", "display_title", quality.implied_tags(F.col("tags"), F.col("display_title"), [("t1", "one")], {"one": "two"}).alias("tags"))
    once = tags(b)
    assert {r["id"]: r["tags"] for r in once.collect()} == {1: ["a", "one", "two"], 2: []}
    assert once.collect() == tags(once).collect()


def test_fuzzy_enum(spark):
    f = lambda v: one(spark, v, lambda c: quality.fuzzy_enum(c, ["Adventure", "Rules"]))
    assert (f("adventure"), f("core rules book"), f("adv"), f("map"), f(""), f(None)) == ("Adventure", "Rules", "Adventure", None, None, None)


def test_prefix_by_segment(spark):
    rows = spark.createDataFrame([("/Foo/a",), ("/Foobar/a",), ("/Foo",)], "path string")
    assert {r["path"] for r in rows.where(inventory.under(F.col("path"), "/Foo")).collect()} == {"/Foo/a", "/Foo"}


def test_folder_paths_with_missing_parent(spark):
    nodes = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "C", "gone")], "id string, name string, parent string")
    assert {r["id"]: r["path"] for r in inventory.folder_paths(nodes).collect()} == {"a": "A", "b": "A/B", "c": "C"}


def test_failed_then_uploaded_is_done(spark):
    log = spark.createDataFrame([(1, 1, "failed"), (1, 2, "uploaded"), (2, 1, "failed")], "id long, seq long, action string")
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert sorted(r["id"] for r in sync.pending(items, log).collect()) == [2, 3]


def test_gap_of_exactly_the_limit_is_idle(spark):
    rows = spark.createDataFrame([("u", 0), ("u", 300), ("u", 599), ("u", 599)], "u string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sessions.active_time(rows, ["u"], "ts", ["s"]).first()
    assert (got["active_s"], got["wall_s"]) == (299.0, 599.0)


def test_fill_forward_with_reset(spark):
    rows = spark.createDataFrame([(1, "set", "a"), (2, "x", None), (3, "set", None), (4, "x", None)], "o long, kind string, v string").withColumn("k", F.lit(1))
    got = sessions.fill_forward(rows, ["k"], ["o"], "now", F.col("v"), F.col("kind") == "set").orderBy("o").collect()
    assert [r["now"] for r in got] == ["a", "a", None, None]


def test_peak_concurrency_skips_empty_spans(spark):
    rows = spark.createDataFrame([("d", 0.0, 0.0), ("d", 10.0, 1300.0), ("d", 700.0, 800.0)], "day string, begin_s double, end_s double")
    got = sessions.peak_concurrency(rows, ["day"]).collect()
    assert [(r["peak"], r["bucket"]) for r in got] == [(2, 1)]


def test_lookup_first_match_and_hole(spark):
    cells = spark.createDataFrame([("c", "x", 1, 5, 0), ("c", "y", 5, 9, 1)], "cell string, bucket string, lo int, hi int, ord int")
    rolls = spark.createDataFrame([("c", 5), ("c", 5), ("c", 10), ("z", 1)], "cell string, roll int")
    got = sorted((r["cell"], r["roll"], r["bucket"] or "") for r in ranges.lookup(rolls, cells, ["cell"]).collect())
    assert got == [("c", 5, "x"), ("c", 5, "x"), ("c", 10, ""), ("z", 1, "")]


def test_stddev_of_one(spark):
    got = stats.run_stats(spark.createDataFrame([("a", 1.0)], "k string, v double"), ["k"], "v").first()
    assert got["stddev"] == 0.0


def test_split_has_a_test_row_of_each_label(spark):
    rows = spark.createDataFrame([(i, "x" if i else "y") for i in range(50)], "id long, label string")
    got = stats.stratified_split(rows, "label", "id", 0.2).groupBy("label").agg(F.count_if("is_test").alias("n")).collect()
    assert {r["label"]: r["n"] for r in got} == {"x": 9, "y": 1}


def test_flatten_and_validate(spark):
    body = '{"data":[{"type":"section","name":"A","id":"1","entries":["x",{"type":"entries","id":"1","entries":[""]}]},{"type":"section"}]}'
    nodes = documents.flatten_documents(spark.createDataFrame([(1, body), (2, "not json"), (3, None), (4, "[]")], "doc_id long, body string"))
    assert nodes.count() == 5
    found = {(r["path"], r["message"]) for r in documents.validate_nodes(nodes).collect()}
    assert found == {("data[0].entries[1]", "an id repeats"), ("data[0].entries[1].entries[0]", "a text is empty"), ("data[1]", "a section has no name")}


def test_chunk_bins(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 5, 11, 2, 9])], "doc_id long, ord int, size int")
    got = documents.chunk_bins(rows, "size", 10).orderBy("ord").collect()
    assert [r["bin"] for r in got] == [0, 0, 1, 2, 3]


def test_greedy_pairs(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.9), (1, 1, 1, 0.4), (1, 2, 1, 0.9), (1, 3, 3, 0.1)], "doc_id long, left_ord int, right_ord int, score double")
    got = sorted((r["left_ord"], r["right_ord"]) for r in documents.greedy_pairs(rows).collect())
    assert got == [(0, 0), (1, 1)]


def test_inline_tags(spark):
    rows = spark.createDataFrame([(1, "{@spell x} {@odd y}")], "id long, text string")
    assert [r["tag"] for r in documents.inline_tags(rows, "text", ["spell"]).collect()] == ["odd"]


def test_common_tags_are_put_aside_before_tags_are_shuffled(spark):
    books = spark.createDataFrame([(i, ["hot", f"t{i // 2}"], False, False, False) for i in range(40)], "id long, tags array<string>, is_old_version boolean, is_draft boolean, is_duplicate boolean")
    found = relations.jaccard_relations(books, most_common=10)
    assert "BroadcastHashJoin" in (plan := found._jdf.queryExecution().toString()) and "LeftAnti, BuildRight" in plan
    assert sorted((r["a"], r["b"], r["shared"]) for r in found.collect()) == sorted((i, i ^ 1, 1) for i in range(40))


def test_human_sizes_round_halves_to_even(spark):
    rows = spark.createDataFrame([(1023,), (1280,), (1792,), (1536,), (5 << 20,), (3 << 30,)], "size long")
    assert [r["x"] for r in rows.select(fn.human_bytes(F.col("size")).alias("x")).collect()] == ["1023 B", "1.2 KB", "1.8 KB", "1.5 KB", "5.0 MB", "3.0 GB"]
