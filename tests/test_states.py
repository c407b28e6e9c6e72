"""Keyed streams, paged sources, published tables, edit logs and stored searches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillstack import sources, streaming
from quillstack.operators import edits, stored
from quillstack.sources import paged, published
from quillstack.streaming import keyed

# streams with state


def put(folder, name, rows, names):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))


CHANGE = ("id", "v", "seq", "op")


def run_keyed(spark, feed, checkpoint, out, **more):
    changes = streaming.read_changes(spark, str(feed), "id string, v long, seq long, op string", 1)
    found = keyed.keyed_changes(changes, **more)
    query = found.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").json(str(out)))
    query.option("checkpointLocation", str(checkpoint)).trigger(once=True).start().awaitTermination()
    return {r["id"]: r["v"] for r in keyed.keyed_table(spark, str(checkpoint)).collect()}


def test_keyed_state_with_deletes_is_the_same_after_restarts(spark, tmp_path):
    feed, out = tmp_path / "feed", tmp_path / "out"
    batches = [
        [("a", 1, 1, "upsert"), ("b", 2, 2, "upsert"), ("r", 0, 3, "root")],
        [("a", 5, 4, "upsert"), ("b", None, 6, "delete"), ("c", 3, 7, "upsert")],
        [("b", 9, 5, "upsert"), ("a", 4, 2, "upsert"), ("c", 8, 9, "upsert"), ("c", 7, 8, "upsert")],
    ]
    for n, rows in enumerate(batches):
        put(feed, n, rows, CHANGE)
        state = run_keyed(spark, feed, tmp_path / "stepwise", out)
    assert state == {"a": 5, "c": 8}  # the late change of a deleted key doesn't bring it back
    assert run_keyed(spark, feed, tmp_path / "stepwise", out) == state
    assert run_keyed(spark, feed, tmp_path / "at-once", tmp_path / "other") == state
    rows = [(r["id"], r["seq"], r["op"]) for r in spark.read.json(str(out)).collect()]
    assert sorted(rows) == [("a", 1, "upsert"), ("a", 4, "upsert"), ("b", 2, "upsert"), ("b", 6, "delete"), ("c", 7, "upsert"), ("c", 9, "upsert")]


def test_deleted_keys_are_forgotten_by_a_timer(spark, tmp_path):
    feed, point = tmp_path / "feed", tmp_path / "checkpoint"
    for n, rows in enumerate([[("b", 2, 2, "upsert")], [("b", None, 6, "delete")], [("x", 0, 1, "upsert")], [("b", 9, 5, "upsert")]]):
        put(feed, n, rows, CHANGE)
        state = run_keyed(spark, feed, point, tmp_path / "out", remember_ms=1)
    assert state == {"x": 0, "b": 9}


def test_rows_are_emitted_once_over_restarts(spark, tmp_path):
    keyed.use_rocksdb(spark)
    feed, out, got = tmp_path / "feed", tmp_path / "out", []
    for n, rows in enumerate([[("s", "f", 1), ("s", "f", 2), ("s", "g", 3)], [("s", "f", 4), ("t", "f", 5)], [("t", "f", 6), ("s", "g", 7)]]):
        put(feed, n, rows, ("session", "file", "seq"))
        stream = spark.readStream.schema("session string, file string, seq long").json(str(feed))
        once = keyed.emit_once(stream, ["session", "file"], "seq")
        once.writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        got = sorted((r["session"], r["file"], r["seq"]) for r in spark.read.json(str(out)).collect())
    assert got == [("s", "f", 1), ("s", "g", 3), ("t", "f", 5)]


def test_emitted_rows_come_again_after_their_time(spark, tmp_path):
    feed, out = tmp_path / "feed", tmp_path / "out"
    for n in range(2):
        put(feed, n, [("s", n)], ("session", "seq"))
        stream = spark.readStream.schema("session string, seq long").json(str(feed))
        keyed.emit_once(stream, ["session"], "seq", keep_ms=1).writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(once=True).start().awaitTermination()
    assert sorted(r["seq"] for r in spark.read.json(str(out)).collect()) == [0, 1]


# paged listings


def page(folder, generation, number, records, end):
    (folder / generation).mkdir(parents=True, exist_ok=True)
    (folder / generation / f"page-{number:04d}.json").write_text(json.dumps({"value": records, end: "x"}))


def test_pages_of_the_newest_complete_walk(spark, tmp_path):
    page(tmp_path, "g1", 1, [{"id": "old"}], "delta")
    page(tmp_path, "g2", 1, [{"id": "a"}, {"id": "é"}], "next")
    page(tmp_path, "g2", 2, [], "next")
    page(tmp_path, "g2", 3, [{"id": "c"}], "delta")
    page(tmp_path, "g2", 4, [{"id": "unfinished"}], "next")
    page(tmp_path, "g3", 1, [{"id": "unfinished"}], "next")
    rows = paged.read_pages(spark, str(tmp_path), 1)
    assert rows.rdd.getNumPartitions() == 3
    assert [(r["generation"], r["page"], r["place"], json.loads(r["record"])["id"]) for r in rows.orderBy("page", "place").collect()] == [("g2", 1, 0, "a"), ("g2", 1, 1, "é"), ("g2", 3, 0, "c")]
    assert paged.read_pages(spark, str(tmp_path / "none")).count() == 0


def test_a_page_stream_resumes_at_its_cursor_and_restarts_when_it_is_gone(spark, tmp_path):
    folder, state, schema = tmp_path / "pages", str(tmp_path / "state"), "id string, v long"

    def run():
        streaming.sync_pages(spark, str(folder), state, str(tmp_path / "checkpoint"), schema).awaitTermination()
        return {r["id"]: r["v"] for r in streaming.read_state(spark, state, schema).collect()}

    page(folder, "g1", 1, [{"id": "a", "v": 1}, {"id": "root", "root": {}}], "next")
    page(folder, "g1", 2, [{"id": "b", "v": 2}, {"id": "a", "v": 3}], "delta")
    assert run() == {"a": 3, "b": 2}
    page(folder, "g1", 3, [{"id": "c", "v": 4}], "next")
    assert run() == {"a": 3, "b": 2}  # half a walk isn't seen
    page(folder, "g1", 4, [{"id": "b", "deleted": {}}], "delta")
    assert run() == {"a": 3, "c": 4}
    assert run() == {"a": 3, "c": 4}
    # the cursor is stale: another walk from its beginning, without what was there before
    page(folder, "g2", 1, [{"id": "z", "v": 9}, {"id": "a", "v": 7}], "delta")
    assert run() == {"z": 9, "a": 7}
    page(folder, "g2", 2, [{"id": "a", "v": 8}], "delta")
    assert run() == {"z": 9, "a": 8}
    # pages after the cursor are gone
    page(folder, "g2", 5, [{"id": "q", "v": 1}], "delta")
    for n in (1, 2):
        (folder / "g2" / f"page-{n:04d}.json").unlink()
    assert run() == {"q": 1}


# published tables


def test_a_table_is_replaced_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, path)
    sources.write_replace(spark.range(3), path)
    reader = published.read_published(spark, path)
    with pytest.raises(Exception, match="half way"):
        sources.write_replace(spark.range(10).withColumn("id", F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("half way")).cast("long"))), path)
    assert published.read_published(spark, path).count() == 3
    # a replacement may read what it replaces, and who reads the old version goes on
    sources.write_replace(published.read_published(spark, path).where("id > 0"), path)
    assert (reader.count(), published.read_published(spark, path).count()) == (3, 2)
    sources.write_replace(spark.range(7), path)
    assert published.read_published(spark, path).count() == 7 and len(list((tmp_path / "table" / "data").iterdir())) <= 3
    assert len(published.commits(spark, path)) == 2


# edit logs


def replay(rows, most):
    """State after each event, by the book: a list and a position."""
    entries, position, out, history = [], -1, [], []
    for seq, action, place in rows:
        ok, entry = True, None
        if action == "push":
            entries = entries[: position + 1] + [seq]
            entries = entries[-most:]
            position, entry = len(entries) - 1, seq
        elif action == "undo" and position >= 0:
            entry, position = entries[position], position - 1
        elif action == "redo" and position + 1 < len(entries):
            position += 1
            entry = entries[position]
        elif action == "jump" and place is not None and 0 <= place < len(entries):
            position, entry = place, entries[place]
        else:
            ok = False
        out.append((seq, action, ok, position, len(entries), entry))
        history.append((position, list(entries)))
    return out, history


@pytest.mark.parametrize("most", [3, 200])
def test_edit_logs(spark, most):
    rng = random.Random(most)
    logs = {d: [(seq, rng.choice(["push"] * 3 + ["undo", "undo", "redo", "jump", "odd"]), rng.choice([None, -1, 0, 1, 2, 7])) for seq in range(rng.randint(1, 60))] for d in range(9)} | {None: [(0, "push", None)]}
    logs[8] = [(seq, "push", None) for seq in range(500)]
    rows = spark.createDataFrame([(d, *e, "x") for d, log in logs.items() for e in log], "doc_id long, seq long, action string, place int, note string").repartition(4)
    want = {d: replay(log, most) for d, log in logs.items()}
    states, spans = edits.replayed(rows, most), edits.intervals(rows, most)
    got = {d: [] for d in logs}
    for r in states.orderBy("seq").collect():
        got[r["doc_id"]].append((r["seq"], r["action"], r["ok"], r["position"], r["total"], r["entry"]))
    assert got == {d: out for d, (out, _) in want.items()}
    moments = [(d, at) for d, log in logs.items() for at in range(0, len(log) + 2, 7)]
    found = {(r["doc_id"], r["at"]): (r["position"], r["entries"]) for r in edits.as_of(spans, states, spark.createDataFrame(moments, "doc_id long, at long")).collect()}
    assert found == {(d, at): want[d][1][min(at, len(logs[d]) - 1)] for d, at in moments}


# stored searches


def commands_of(spark, *lines):
    rows = stored.from_commands(spark.createDataFrame(list(enumerate(lines)), "query_id long, text string")).orderBy("query_id").collect()
    return [r.asDict() for r in rows]


def test_command_lines(spark):
    a, b, c, d, e, f = commands_of(spark, "sys:5e tag:horror !tag:undead !tag:undead level:3 dark  castle", "odd:x plain words", "level:x", "PUB:a pub:b fav:1", "!sys:osr", None)
    assert (a["game_system"], a["tag"], a["not_tags"], a["level_min"], a["q"], a["favorites"]) == ("5e", "horror", ["undead"], 3.0, "dark castle", False)
    assert (b["q"], b["game_system"]) == ("odd:x plain words", None) and c["q"] == "level:x"
    assert (d["publisher"], d["favorites"], d["q"]) == ("b", True, None) and e["game_system"] == "osr" and f["q"] is None


def test_validated_intents(spark):
    answers = [
        '```json\n{"game_system": "5e", "product_type": "Magic Items", "tags": ["horror", 3, null], "keywords": "dark, castle!", "level_min": "5", "level_max": 40}\n```',
        '{"game_system": "", "tags": null, "level_min": 3.7, "level_max": 0}', "no json", '["a"]', None,
    ]
    rows = spark.createDataFrame([(i, a, "what? a dragon's lair") for i, a in enumerate(answers)], "query_id long, answer string, question string")
    got = [r["i"].asDict() for r in rows.withColumn("i", stored.intent(F.col("answer"), F.col("question"))).orderBy("query_id").collect()]
    alone = {"game_system": None, "product_type": None, "tags": [], "keywords": "what a dragon s lair", "level_min": None, "level_max": None}
    assert got == [{"game_system": "5e", "product_type": "magic_items", "tags": ["horror"], "keywords": "dark castle", "level_min": 5, "level_max": None}, alone | {"level_min": 3}, alone, alone, alone]


BOOK = "id long, display_title string, publisher string, game_system string, series string, collection string, tags array<string>, is_old_version boolean, is_draft boolean, is_duplicate boolean, min_level long, max_level long"


def test_stored_searches_find_what_each_alone_would(spark):
    rng = random.Random(3)
    books = [(i, rng.choice(["Dark Castle", "Sunny Field", None]), rng.choice("pq"), rng.choice(["5e", "osr", None]), rng.choice(["s", None]), None, rng.choice([None, [], ["horror"], ["horror", "undead"]]), i % 9 == 0, False, False, rng.choice([None, 1, 4]), 5) for i in range(80)]
    lines = [" ".join(rng.sample(["sys:5e", "sys:osr", "pub:p", "tag:horror", "!tag:undead", "level:3", "fav:1", "castle", "src:x", "series:s"], rng.randint(0, 3))) for _ in range(60)]
    table, marks = spark.createDataFrame(books, BOOK), spark.createDataFrame([(i,) for i in range(0, 80, 3)], "book_id long")
    queries = stored.from_commands(spark.createDataFrame(list(enumerate(lines)), "query_id long, text string"))
    want = set()
    for n, line in enumerate(lines):
        parts = [p for p in line.split() if p]
        for i, title, pub, system, series, _, tags, old, _, _, lo, hi in books:
            ok = not old
            for p in parts:
                key, _, value = p.partition(":")
                ok &= {"sys": system == value, "pub": pub == value, "tag": tags is not None and value in tags, "!tag": tags is None or value not in tags, "level": lo is not None and lo <= 3 <= hi, "fav": i % 3 == 0, "castle": title == "Dark Castle", "src": False, "series": series == value}[key]
            if ok:
                want.add((n, i))
    got = stored.matched(queries, table, marks, batch=5).collect()
    assert len(got) == len(want) and {(r["query_id"], r["id"]) for r in got} == want


def test_searches_and_rows_that_are_alike_meet_once(spark, monkeypatch):
    monkeypatch.setattr(stored, "LIST", 7)  # so that lists are cut
    books = spark.createDataFrame([(i, "Dark Castle" if i % 2 else "Field_x", "p", "5e", None, None, ["horror"], False, False, False, 1, 5) for i in range(50)], BOOK)
    lines = ["sys:5e castle", "sys:5e d_x", "castle", "tag:none"] * 6
    queries = stored.from_commands(spark.createDataFrame(list(enumerate(lines)), "query_id long, text string"))
    kinds, members = stored._kinds(queries, "query_id", "searches")
    assert (kinds.count(), members.count()) == (4, 24)
    got = stored.matched(queries, books).collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(q, i) for q in range(24) for i in range(50) if q % 4 < 3 and i % 2 == (q % 4 != 1)]


def test_found_rows_are_not_shuffled(spark, monkeypatch):
    for name, n in (("LIST", 3), ("CELL", 4), ("MEMBERS", 5)):
        monkeypatch.setattr(stored, name, n, raising=False)
    books = spark.createDataFrame([(i, f"Castle {i % 4}", "pq"[i % 2], "5e", None, None, ["horror"], False, False, False, 1, 5) for i in range(60)], BOOK)
    lines = ["sys:5e castle", "pub:q 3", "castle", "tag:horror pub:p"] * 6
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = stored.matched(stored.from_commands(spark.createDataFrame(list(enumerate(lines)), "query_id long, text string")), books)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # searches and rows meet last, and what they give is filled in there
    assert "Exchange" not in plan[: plan.index("SortMergeJoin [key")]
    fits = (lambda i: True, lambda i: i % 4 == 3, lambda i: True, lambda i: i % 2 == 0)
    assert sorted((r["query_id"], r["id"]) for r in found.collect()) == [(q, i) for q in range(24) for i in range(60) if fits[q % 4](i)]


def test_intents_search_by_words(spark):
    books = [(1, "Dark Castle", "p", "5e", None, None, ["horror"], False, False, False, 1, 4), (2, "Castle", "p", "5e", None, None, [], False, False, False, 1, 4)]
    rows = spark.createDataFrame([(7, '{"tags": ["horror"], "keywords": "castle dark"}'), (8, '{"keywords": "Castle", "level_min": 5}'), (9, '{"keywords": "castle", "level_max": 2}')], "query_id long, answer string").withColumn("intent", stored.intent(F.col("answer"), F.lit("")))
    got = stored.matched(stored.from_intents(rows), spark.createDataFrame(books, BOOK)).collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(7, 1), (9, 1), (9, 2)}
