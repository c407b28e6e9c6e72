"""Trees of any depth against plain Python, and the operators that no standard table can feed."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillstack.functions import text as fn
from quillstack.operators import blocks, documents, fulltext, inventory, outline, quality, ranges, search, sessions, trees, typed

CHAIN = 20


def chain(spark, more=()):
    """A chain of nodes, each below the one before, over the documents 1 and 2."""
    rows = [(doc, i, i - 1 if i else None, i + 1, 100 - i, 1) for doc in (1, 2) for i in range(CHAIN)]
    return spark.createDataFrame([*rows, *more], "doc_id long, ord long, parent long, level long, size long, own long").repartition(3)


def test_chain_of_twenty_levels(spark):
    rows = chain(spark)
    assert {(r["ord"], r["parent"]) for r in documents.parents(rows.drop("parent")).collect()} == {(i, i - 1 if i else None) for i in range(CHAIN)}
    got = outline.split_oversized(rows, 10).collect()
    assert sorted((r["ord"], r["is_stub"]) for r in got if r["doc_id"] == 1) == [(i, i < CHAIN - 1) for i in range(CHAIN)]
    cut = outline.split_oversized(rows, 95)
    assert sorted((r["ord"], r["is_stub"]) for r in cut.where("doc_id = 2").collect()) == [*((i, True) for i in range(5)), (5, False)]
    left = blocks.delete_subtrees(rows, spark.createDataFrame([(1, 12)], "doc_id long, ord long"))
    assert sorted((r["doc_id"], r["ord"]) for r in left.collect()) == [*((1, i) for i in range(12)), *((2, i) for i in range(CHAIN))]
    named = blocks.named_ancestor(rows, F.when(F.col("ord") == 0, "root"), depth="level")
    assert {r["owner"] for r in named.where("ord > 0").collect()} == {0} and {r["owner"] for r in named.where("ord = 0").collect()} == {None}
    # the plan doesn't grow with the depth
    assert blocks.delete_subtrees(rows, rows.limit(1))._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 3


def test_levels_of_any_size_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(doc, i, rng.choice([-2, 1, 2, 3, 7, 9, 40, None]), rng.randrange(100)) for doc in (1, None, 3) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, ord long, level long, page long").repartition(4)
    up, down = {}, {}
    for doc, i, level, page in rows:
        own = [r for r in rows if r[0] == doc and r[2] is not None]
        up[doc, i] = None if level is None else max((o for _, o, lv, _ in own if o < i and lv < level), default=None)
        nxt = None if level is None else min(((o, p) for _, o, lv, p in own if o > i and lv <= level), default=None)
        down[doc, i] = max(page, nxt[1] - 1 if nxt else 999)
    assert {(r["doc_id"], r["ord"]): r["parent"] for r in documents.parents(table).collect()} == up
    assert {(r["doc_id"], r["ord"]): r["end_page"] for r in documents.section_ends(table, F.lit(999)).collect()} == down
    # the same by windows where the levels are stated; one that isn't is no silent null
    levels = [-2, 1, 2, 3, 7, 9, 40]
    by_window = documents.parents(table, levels=levels)
    assert {(r["doc_id"], r["ord"]): r["parent"] for r in by_window.collect()} == up
    assert "MapInArrow" not in by_window._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["ord"]): r["end_page"] for r in documents.section_ends(table, F.lit(999), levels=levels).collect()} == down
    assert documents.parents(table.limit(0), levels=levels).count() == 0
    with pytest.raises(Exception, match="isn't among the stated ones"):
        documents.parents(table, levels=levels[:-1]).collect()


def test_next_row_without_a_value_counts(spark):
    table = spark.createDataFrame([(1, 0, 1, 5), (1, 1, 1, None), (1, 2, 1, 9)], "doc_id long, ord long, level long, page long")
    for levels in (None, [1]):
        got = trees.next_as_shallow(table, "doc_id", "ord", "level", "page", "next_page", levels)
        assert {r["ord"]: r["next_page"] for r in got.collect()} == {0: None, 1: 9, 2: None}


def test_links_of_any_length_and_circles(spark):
    rows = [(i, f"n{i}", i - 1 if i else None) for i in range(70)] + [(100, "a", 101), (101, "b", 100), (102, "c", 100), (103, "d", 103), (104, "e", 999)]
    nodes = spark.createDataFrame(rows, "id long, name string, parent long").repartition(3)
    got = {r["id"]: (r["path"], r["depth"]) for r in inventory.folder_paths(nodes).collect()}
    assert got == {i: ("/".join(f"n{k}" for k in range(i + 1)), i + 1) for i in range(70)} | {104: ("e", 1)}
    agents = spark.createDataFrame([(i, i - 1 if i else None, 7 if i == 5 else None) for i in range(60)] + [(200, 201, None), (201, 200, None)], "agent long, parent long, prompt long")
    assert {(r["agent"], r["prompt"], r["depth"]) for r in sessions.linked_prompts(agents).collect()} == {(i, 7, i - 5) for i in range(5, 60)}
    assert inventory.folder_paths(nodes.limit(0)).count() == 0


def test_moves(spark):
    rows = spark.createDataFrame([(1, 0, None, 1), (1, 1, 0, 2), (1, 2, 1, 3), (1, 3, 2, 4), (1, 4, None, 1), (1, 5, 4, 2)], "doc_id long, ord long, parent long, level long")
    move = lambda *m: {r["ord"]: (r["parent"], r["level"]) for r in blocks.move_under(rows, spark.createDataFrame([(1, *x) for x in m], "doc_id long, ord long, to long")).collect()}
    assert move((2, 4)) == {0: (None, 1), 1: (0, 2), 2: (4, 2), 3: (2, 3), 4: (None, 1), 5: (4, 2)}
    same = {0: (None, 1), 1: (0, 2), 2: (1, 3), 3: (2, 4), 4: (None, 1), 5: (4, 2)}
    assert move((1, 3)) == same and move((1, 77)) == same and move((0, 0)) == same
    kept = blocks.shift_levels(rows.withColumn("level", F.lit(9).cast("long")), rows.select("doc_id", "ord"), -1, deepest=6)
    assert {r["level"] for r in kept.collect()} == {8}
    deeper = blocks.shift_levels(rows, rows.select("doc_id", "ord"), 4, deepest=6)
    assert {r["ord"]: r["level"] for r in deeper.collect()} == {0: 5, 1: 6, 2: 6, 3: 6, 4: 5, 5: 6}


def test_assembling_leaves_out_failed_roots_and_empty_branches(spark):
    nodes = spark.createDataFrame([(1, 0, 0, None, "a"), (1, 0, 1, 0, "b"), (1, 0, 2, 1, "c"), (1, 0, 3, 0, "d"), (1, 4, 4, None, "e"), (1, 4, 5, 4, "f")], "doc_id long, root long, ord long, parent long, title string")
    results = spark.createDataFrame([(1, 0, 2, ["x"]), (1, 0, 2, ["y"]), (1, 0, 3, None), (1, 4, 4, None), (1, 4, 5, None)], "doc_id long, root long, target long, entries array<string>")
    got = {r["ord"]: r["entries"] for r in trees.assemble(nodes, results).collect()}
    assert set(got) == {0, 1, 2} and sorted(got[2]) == ["x", "y"] and got[0] is None


def test_typed_nodes_lose_nothing(spark):
    data = [{"type": "section", "name": "S", "id": "1", "entries": ["t", None, 3, True, ["odd"], {"type": "list", "items": ["i", {"type": "item", "name": "n", "entries": ["deep"]}]}, {"type": "odd", "x": {"y": 1}}, {"no": "type"}]}, "bare"]
    bodies = [json.dumps({"data": data}), json.dumps({"adventure": [{}], "adventureData": [{"data": data}]}), "not json", None, "[1]", json.dumps({"bookData": []})]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")
    nodes = typed.typed_nodes(docs)
    got = {(r["doc_id"], r["path"]): r for r in nodes.collect()}
    assert {k[0] for k in got} == {0, 1}
    paths = [p for d, p in got if d == 0]
    assert set(paths) == {"data[0]", "data[1]", *(f"data[0].entries[{i}]" for i in range(8)), "data[0].entries[5].items[0]", "data[0].entries[5].items[1]", "data[0].entries[5].items[1].entries[0]"}
    assert got[0, "data[0].entries[6]"]["type"] == "odd" and json.loads(got[0, "data[0].entries[6]"]["raw"]) == {"type": "odd", "x": {"y": 1}}
    assert got[0, "data[0].entries[5].items[1].entries[0]"]["depth"] == 3
    wrong = {(r["path"], r["severity"]) for r in typed.checked(nodes, [], strict=True).where("doc_id = 1").collect()}
    assert {("data[1]", "error"), ("data[0].entries[1]", "error"), ("data[0].entries[4]", "warning"), ("data[0].entries[6]", "warning"), ("data[0].entries[7]", "warning")} <= wrong


def test_rules_of_typed_documents(spark):
    entries = [
        {"type": "section", "name": "a", "id": "x", "entries": ["{@spell y} {@bad z} }"]}, {"type": "section", "name": "b", "id": "x", "entries": "no"}, {"type": "section", "id": 5, "name": "c"},
        {"type": "table", "colLabels": "x", "rows": []}, {"type": "table", "rows": [["1 {@bad q}", "2"]]}, {"type": "list", "items": {}}, {"type": "image"}, {"type": "image", "href": {"a": 1}}, {"type": "section", "name": "d", "id": "x"},
    ]
    nodes = typed.typed_nodes(spark.createDataFrame([(1, json.dumps({"data": entries}))], "doc_id long, body string"))
    got = {(r["path"], r["message"]) for r in typed.checked(nodes, ["spell"]).collect()}
    for want in [("data[0].entries[0]", "unknown tags bad"), ("data[0].entries[0]", "braces don't close"), ("data[1]", "the id stands at data[0] too"), ("data[8]", "the id stands at data[1] too"), ("data[1]", "entries isn't a list"), ("data[2]", "an id isn't a string"), ("data[3]", "colLabels isn't a list"), ("data[4]", "a table has rows and no labels"), ("data[4].rows[0][0]", "unknown tags bad"), ("data[5]", "items isn't a list"), ("data[6]", "an image has no address"), ("data[7]", "an image's address has neither path nor url")]:
        assert want in got, want


def test_rebuilt_documents_go_round(spark):
    rows = spark.createDataFrame([(1, 0, 2, "a", "x"), (1, 1, 5, "b", None), (1, 2, 3, "c", "y"), (1, 3, 2, "d", ""), (2, 0, 1, "e", "z")], "doc_id long, ord long, level long, name string, text string")
    got = {r["doc_id"]: json.loads(r["body"]) for r in trees.rebuild(rows, "doc_id", "ord", "level", "name", "text").collect()}
    assert got[1]["data"][0] == {"type": "section", "name": "a", "entries": ["x", {"type": "entries", "name": "b", "entries": []}, {"type": "entries", "name": "c", "entries": ["y"]}]}
    assert [x["name"] for x in got[1]["data"]] == ["a", "d"] and len(got) == 2
    with pytest.raises(Exception, match="over 2 headings"):
        trees.rebuild(rows, "doc_id", "ord", "level", "name", "text", most=2).collect()


def test_titles_are_found_in_the_smallest_radius(spark):
    entries = spark.createDataFrame([(1, 0, "The Old Mill", 10), (1, 1, "Far Away Keep", 10), (1, 2, "Nowhere Town", 10), (1, 3, "ab", 10), (1, 4, "Twice Seen", 50)], "doc_id long, ord long, title string, page long")
    heads = spark.createDataFrame([(1, 3, "the OLD mill!"), (1, 24, "the old  mill"), (1, 70, "Far away keep"), (1, 71, "nowhere town"), (1, 10, "ab"), (1, 52, "twice seen"), (1, 46, "twice  seen"), (2, 10, "nowhere town")], "doc_id long, page long, head string")
    assert {r["ord"]: r["actual"] for r in documents.found_titles(entries, heads).collect()} == {0: 3, 1: 70, 2: None, 3: None, 4: 46}


def test_lookup_with_null_keys(spark):
    rolls = spark.createDataFrame([(None, "x", 5), ("x", None, 5), ("x", "y", 5), ("x", "y", 50)], "a string, b string, roll long")
    cells = spark.createDataFrame([("x", "y", "hit", 1, 10, 0), ("x", "y", "late", 5, 9, 1)], "a string, b string, bucket string, lo long, hi long, ord long")
    assert sorted(str((r["a"], r["b"], r["roll"], r["bucket"])) for r in ranges.lookup(rolls, cells, ["a", "b"]).collect()) == sorted(map(str, [(None, "x", 5, None), ("x", None, 5, None), ("x", "y", 5, "hit"), ("x", "y", 50, None)]))


def test_latest_takes_null_keys_and_ties(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 5, "c"), (None, 6, "d"), (2, 3, None)], "k long, seq long, v string")
    assert {(r["k"], r["v"]) for r in quality.latest(rows, ["k"], ["seq"]).collect()} == {(1, "b"), (None, "d"), (2, None)}
    assert {(r["k"], r["v"]) for r in quality.earliest(rows, ["k"], ["seq"]).collect()} == {(1, "a"), (None, "c"), (2, None)}


def test_search_text_and_kept_index(spark, tmp_path):
    books = spark.createDataFrame([(1, "red ring of fire", 3), (2, "ring ring", 5), (3, "red bolt", 3), (4, "red ring", 9)], "id long, title string, level long")
    index = fulltext.postings(books, "id", ["title"])
    fulltext.write_index(index, str(tmp_path / "index"))
    kept = spark.read.parquet(str(tmp_path / "index"))
    got = fulltext.search_text(books, kept, ["ring", "red"], F.col("level") < 9).collect()
    assert [r["id"] for r in got] == [1]
    scores = {r["doc"]: r["score"] for r in fulltext.bm25(index, ["ring", "red"]).collect()}
    assert got[0]["score"] == pytest.approx(scores[1]) and set(scores) == {1, 4}


def test_labels_and_names(spark):
    row = spark.range(1).select(
        fn.right_of_slash(F.lit("15 / 18 ")).alias("a"), fn.right_of_slash(F.lit("7")).alias("b"), fn.right_of_slash(F.lit("-")).alias("c"), fn.right_of_slash(F.lit(12)).alias("d"),
        fn.canonical_label(F.lit(" Very-Small_Thing "), {"verysmallthing": "tiny"}).alias("e"), fn.display_name(F.lit(None).cast("string"), {"a": "b"}).alias("f"),
        fn.season(F.lit("DDAL05-02 x")).alias("g"), fn.season(F.lit("DDEX03-1")).alias("h"), fn.season(F.lit("DDAL99 DDEX2")).alias("i"),
        fn.document_id(F.lit("https://x.org/document/d/abcdefghij_K/edit")).alias("j"), fn.escaped_markdown(F.lit("a*b_[c]")).alias("k"), fn.without_fence(F.lit("```json\n{}\n```")).alias("l"),
        fn.wikilink(F.lit("a/b: c")).alias("m"), fn.joined_lines(F.lit("won-\nder and - \nx")).alias("n"),
        fn.level_range(F.lit("from sixth to eighth level and second level")).alias("o"), fn.level_range(F.lit("levels 3 - 5")).alias("p"), fn.level_range(F.lit("1st-4th level")).alias("q"), fn.level_range(F.lit("level 40")).alias("r"), fn.level_range(F.lit("tier 4")).alias("s"), fn.level_range(F.lit(None).cast("string")).alias("t"),
    ).first()
    assert tuple(row[:4]) == (18, 7, None, 12) and tuple(row[4:9]) == ("tiny", "", 5, 3, 2)
    assert tuple(row[9:14]) == ("abcdefghij_K", r"a\*b\_\[c\]", "{}", "[[a-b- c]]", "wonder and - \nx")
    assert [tuple(x) for x in row[14:]] == [(2, 2), (3, 5), (1, 4), (None, None), (17, 20), (None, None)]


def test_summaries_and_queue_and_state(spark):
    books = spark.createDataFrame([(1, None, "f.pdf", '["a","b"]', "x" * 400, 1, False), (2, "T", "g.pdf", "broken", "", 0, True)], "id long, display_title string, filename string, tags string, description string, has_bookmarks int, is_favorite boolean")
    got = {r["id"]: r for r in search.summaries(books).collect()}
    assert (got[1]["title"], got[1]["tags"], len(got[1]["description"]), got[1]["has_bookmarks"]) == ("f.pdf", ["a", "b"], 300, True)
    assert (got[2]["title"], got[2]["tags"] or [], got[2]["description"], got[2]["publisher"], got[2]["is_favorite"]) == ("T", [], None, None, True)
    state = spark.createDataFrame([("a", [1, 3]), ("b", [2])], "name string, numbers array<long>")
    new = spark.createDataFrame([("a", 2), ("b", 2), ("c", 9), ("c", 4)], "name string, number long")
    assert {(r["name"], tuple(r["numbers"])) for r in quality.numbers_added(state, new).collect()} == {("a", (1, 2, 3)), ("c", (4, 9))}


def test_since_and_people(spark):
    rows = spark.createDataFrame([(1, "2024-01-02 00:00:00"), (2, "2024-01-01 01:00:00"), (3, None)], "id long, t string").withColumn("ts", F.col("t").cast("timestamp"))
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    ids = lambda v: {r["id"] for r in sessions.since(rows, v, now).collect()}
    assert ids("1d") == {1, 3} and ids("48h") == {1, 2, 3} and ids("2024-01-01 12:00:00") == {1, 3} and ids("soon") == {1, 2, 3}


def test_nodes_leave_python_in_small_frames(spark):
    from quillstack.operators import documents

    rows = [(i, json.dumps({"data": [{"type": "section", "name": "n", "entries": ["x"] * 999}]})) for i in range(12)] + [(99, "no")]
    docs = spark.createDataFrame(rows, "doc_id long, body string").coalesce(1)
    for make in (documents.flatten_documents, typed.typed_nodes):
        assert make(docs).count() == 12_000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    frames = list(documents.node_frames(([tuple(range(9))] * n for n in (5000, 1, 0, 4001)), lambda rows: len(rows)))
    assert sum(frames) == 9002 and max(frames) <= documents.FRAME
