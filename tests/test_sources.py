"""Readers, writers and the change stream, on files in a temporary folder."""

import json

import pytest

from quillstack import sources, streaming


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","name":"x"}\n\nbroken\n{"id":"2","name":"y"}\n{"id":"1","name":"z"}\n')
    rows = sources.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, name string").where("id is not null").collect()
    assert [(r["id"], r["name"]) for r in rows] == [("1", "x"), ("2", "y"), ("1", "z")]
    last = sources.read_keyed_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, name string").collect()
    assert {r["id"]: r["name"] for r in last} == {"1": "z", "2": "y"}


def test_attached_catalogs(spark, tmp_path):
    for name, rows in (("own", [(1, "a"), (2, "b")]), ("other", [(2, "x"), (3, "y")])):
        spark.createDataFrame(rows, "id long, v string").write.parquet(str(tmp_path / name / "items.parquet"))
    sources.attach(spark, str(tmp_path / "own"), "cat_own", ["items"])
    other = sources.attach(spark, str(tmp_path / "other"), "cat_other", ["items"])["items"]
    got = spark.sql("SELECT a.id, a.v, b.v AS w FROM cat_own.items a JOIN cat_other.items b USING (id)").collect()
    assert [tuple(r) for r in got] == [(2, "b", "x")]
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,2)]" in other.where("id > 2").select("id")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="(?i)view"):
        spark.sql("INSERT INTO cat_own.items VALUES (9, 'z')")
    sources.attach(spark, str(tmp_path / "other"), "cat_own", ["items"])  # attached again: the new folder counts
    assert {r["id"] for r in spark.table("cat_own.items").collect()} == {2, 3}


def test_list_files(spark, tmp_path):
    for name in ("a/x.pdf", "a/._x.pdf", "__MACOSX/y.pdf", "b.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("1")
    assert [r["path"].rsplit("/", 2)[1:] for r in sources.list_files(spark, str(tmp_path)).collect()] == [["a", "x.pdf"]]


def test_front_matter(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\nname: "rule one"\nenabled: true\n---\nbody\n')
    (tmp_path / "b.md").write_text("no head")
    got = {r["path"].rsplit("/", 1)[1]: (r["fields"], r["body"]) for r in sources.read_front_matter(spark, str(tmp_path)).collect()}
    assert got["a.md"] == ({"name": "rule one", "enabled": "true"}, "body\n")
    assert got["b.md"] == ({}, "no head")


def test_transcripts(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1/subagents").mkdir()
    (tmp_path / "s1/main.jsonl").write_text('{"uuid":"1","message":{"content":"x"}}\nbroken\n')
    (tmp_path / "s1/subagents/sub.jsonl").write_text('{"uuid":"2","message":{"content":[1]}}\n')
    rows = sources.read_transcripts(spark, str(tmp_path)).selectExpr("session", "kind", "variant_get(event, '$.uuid', 'string') as uuid").collect()
    assert sorted((r["session"], r["kind"], r["uuid"]) for r in rows) == [("main", "main", "1"), ("sub", "subagent", "2")]


def test_split_and_salvage():
    assert list(sources.split_lines("aa bb\n\ncc dd", 7)) == ["aa bb", "cc dd"]
    assert "".join(sources.split_lines("x" * 25, 10)) == "x" * 25
    assert json.loads(sources.salvage_json('```json\n[{"a":1},{"b":2},{"c"')) == [{"a": 1}, {"b": 2}]
    assert sources.salvage_json("nothing") is None


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "bad")], "id long, error string")
    sources.write_split(rows, "error", str(tmp_path / "good"), str(tmp_path / "bad"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [1]
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [2]
    pages = spark.createDataFrame([("g", "T", ["x", "y"])], "k string, title string, lines array<string>")
    sources.write_pages(pages, "k", "title", "lines", str(tmp_path / "pages"))
    assert "".join(p.read_text() for p in (tmp_path / "pages").rglob("*.txt")) == "# T\n\n- x\n- y\n"
    sources.write_snapshot(rows, str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).count() == 2
    assert not sources.import_once(rows, rows, str(tmp_path / "good"))


def test_change_stream_is_idempotent(spark, tmp_path):
    feed, state, schema = tmp_path / "feed", str(tmp_path / "state"), "id string, v long"
    feed.mkdir()

    def run():
        changes = streaming.read_changes(spark, str(feed), f"{schema}, seq long, op string", 1)
        streaming.sync_changes(changes, state, str(tmp_path / "checkpoint"), schema).awaitTermination()
        return {r["id"]: r["v"] for r in streaming.read_state(spark, state, schema).collect()}

    lines = lambda name, rows: (feed / name).write_text("\n".join(json.dumps(dict(zip(("id", "v", "seq", "op"), r, strict=True))) for r in rows))
    lines("1.json", [("a", 1, 1, "upsert"), ("b", 2, 2, "upsert"), ("r", 0, 3, "root")])
    assert run() == {"a": 1, "b": 2}
    lines("2.json", [("a", 5, 4, "upsert"), ("b", None, 5, "delete"), ("c", 3, 6, "upsert")])
    assert run() == {"a": 5, "c": 3}
    assert run() == {"a": 5, "c": 3}


def test_windowed_counts_of_a_stream_equal_the_batch(spark, sf_dir):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    typed = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    query = streaming.counted_events(typed(stream), "ts", "event_type").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = streaming.counted_events(typed(events), "ts", "event_type")
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, batch.collect()))


def test_front_matter_lists(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nname: x\ntags: [a, 'b c', d]\nsources:\n  - one\n  - 2\nempty:\nlast: y # z\n---\nbody: not a key\n")
    r = sources.read_front_matter(spark, str(tmp_path)).first()
    assert r["lists"] == {"tags": ["a", "b c", "d"], "sources": ["one", "2"]} and r["fields"] == {"name": "x", "empty": "", "last": "y # z"} and r["body"] == "body: not a key\n"


def test_benchmark_tree(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text if isinstance(text, str) else json.dumps(text))

    put("eval-1/with/run-1/grading.json", {"summary": {"pass_rate": 0.5, "passed": 1, "failed": 1, "total": 2}, "execution_metrics": {"total_tool_calls": 3, "output_chars": 9}})
    put("eval-1/with/run-1/timing.json", {"total_duration_seconds": 4.5, "total_tokens": 70})
    put("eval-1/without/run-2/grading.json", {"timing": {"total_duration_seconds": 2}, "execution_metrics": {"output_chars": 9, "errors_encountered": 1}})
    put("eval-1/without/run-2/timing.json", {"total_duration_seconds": 4.5, "total_tokens": 70})
    put("eval-x/with/run-3/grading.json", "broken")
    put("eval-2/with/run-1/grading.json", {})
    put("eval-2/eval_metadata.json", {"eval_id": "two"})
    got = {(r["eval"], r["config"], r["run"]): (r["pass_rate"], r["passed"], r["time_seconds"], r["tokens"], r["tool_calls"], r["errors"]) for r in sources.read_benchmark(spark, str(tmp_path)).collect()}
    assert got == {("1", "with", 1): (0.5, 1, 4.5, 70, 3, 0), ("1", "without", 2): (0.0, 0, 2.0, 9, 0, 1), ("two", "with", 1): (0.0, 0, 0.0, 0, 0, 0)}


def test_deltas_bases_and_a_cold_rescan(spark, tmp_path):
    feed, schema = tmp_path / "feed", "id string, v long"
    feed.mkdir()
    state, point = str(tmp_path / "state"), str(tmp_path / "checkpoint")
    want = {}
    for n in range(5):
        rows = [{"id": f"k{n}", "v": n, "seq": 2 * n, "op": "upsert"}, {"id": "k0", "v": 10 * n, "seq": 2 * n + 1, "op": "delete" if n == 3 else "upsert"}]
        (feed / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        want |= {f"k{n}": n, "k0": 10 * n}
        streaming.sync_changes(streaming.read_changes(spark, str(feed), schema + ", seq long, op string"), state, point, schema, base_every=2).awaitTermination()
        if n == 3:
            del want["k0"]
        assert {r["id"]: r["v"] for r in streaming.read_state(spark, state, schema).collect()} == want
    assert streaming.newest_base(spark, state, schema) == 3
    assert {r["id"] for r in streaming.read_state(spark, state, schema, before=1).collect()} == {"k0"}
    again, query = streaming.cold_rescan(spark, str(feed), schema)
    query.awaitTermination()
    assert {r["id"]: r["v"] for r in streaming.read_state(spark, again, schema).collect()} == want


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data":\n[1]}\n')
    (tmp_path / "b.json").write_text("")
    assert {(r["path"].rsplit("/", 1)[1], r["text"]) for r in sources.read_whole(spark, str(tmp_path)).collect()} >= {("a.json", '{"data":\n[1]}\n')}
