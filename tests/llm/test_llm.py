"""The training-data operators against brute force, on a fixture with nulls, empty and long texts, copies, ties, repeated
rows, empty tables and extra columns of clashing names."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillstack.llm.queries")

from quillstack.llm import ann_forest, decontaminate, language_id, license_scan, ngram_join, packing, sharding, suffix_dedup, token_orc, warc  # noqa: E402
from quillstack.llm.common import fresh_path  # noqa: E402
from quillstack.llm.queries import word_vocabulary  # noqa: E402

KIND = "doc_id long, text string, lang string, score double, bin long, size long, n long, spans string, tie long, shard int"
RNG = np.random.default_rng(3)
WORDS = ["".join(RNG.choice(list("abcdefghiklmnoprstuvz"), RNG.integers(2, 9))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def edited(text, every, seed):
    words = text.split()
    for i in range(seed % every, len(words), every):
        words[i] = f"x{seed}y{i}"
    return " ".join(words)


BASE, PASSAGE = prose(300, 1), prose(120, 2)
ITEM = prose(25, 7)
TEXTS = [
    None, "", " \n\t ", "one", "One", "two words", "...", "%%% ###",
    BASE, BASE, BASE.upper(), BASE.replace(" ", "  "), edited(BASE, 40, 1), edited(BASE, 40, 2), edited(BASE, 12, 3), edited(BASE, 60, 4),
    prose(200, 5) + " " + PASSAGE + " " + prose(50, 6), PASSAGE + " " + prose(80, 8), "é" * 500 + PASSAGE, PASSAGE * 3,
    "a" * 3000, "ab" * 700, prose(60, 9) + " " + ITEM + " " + prose(60, 10), ITEM, " ".join(ITEM.split()[3:14]), " ".join(ITEM.split()[:9]),
    prose(6000, 11), prose(4, 12), prose(5, 13), "naïve Straße, ÉLÈVE's don't 1234! <|endoftext|> \x01 z", "x" * 5000,
    "Released under the MIT License.", prose(90, 14) + ". Licensed under the Apache License, Version 2.0. " + prose(30, 15),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, 0.5, 1, 2, 3, "s", 4, 5) for i, t in enumerate(TEXTS)]
    rows += [rows[8], rows[20]]  # rows that repeat
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def taken(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: tuple((x is not None, x) for x in (r[key], *map(str, r))))


def all_rows():
    return [*enumerate(TEXTS), (8, TEXTS[8]), (20, TEXTS[20])]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# n-gram join


def gram_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked_groups(texts):
    sets, label = {i: gram_set(t) for i, t in texts.items()}, {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                o = len(sets[a] & sets[b])
                if o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                    label[a] = label[b] = min(label[a], label[b])
    return sets, label


def test_ngram_join(docs):
    sets, label = linked_groups(dict(enumerate(TEXTS)))
    got = taken(ngram_join.jaccard_groups(docs))
    assert len(got) == len(all_rows())
    assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]]) for r in got)
    assert sum(r["component_id"] != r["doc_id"] for r in got) >= 5


def test_ngram_join_of_near_copies_and_a_common_passage(spark):
    common = prose(40, 90)
    texts = {i: edited(BASE, 20 + i % 30, i) for i in range(60)} | {i: prose(12, i) + " " + common for i in range(60, 90)} | {90: common, 91: BASE}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    _, label = linked_groups(texts)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_groups(rows).collect()} == label


def test_steps_give_back_ascending_numbers():
    for x in ([], [0], [0, 0, 3, 254, 254, 255, 510, 4000, 4000, 70_000], list(range(0, 3000, 7))):
        assert ngram_join.stepped(ngram_join.steps(np.array(x, np.uint32))).tolist() == x


def test_ngram_join_edges(spark, nothing):
    assert ngram_join.jaccard_groups(nothing).count() == 0
    rows = spark.createDataFrame([(None, BASE), (5, BASE), (5, "other words here and there now"), (9, BASE)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(rows).collect()}
    n = len(gram_set(BASE))
    assert got == {(None, n, None), (5, n, 5), (5, 2, 5), (9, n, 5)}
    with pytest.raises(ValueError):
        ngram_join.jaccard_groups(rows, 50)


# suffix dedup


def cut_of(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def spans_of(rows, **more):
    return suffix_dedup.removed(rows, suffix_dedup.repeated_spans(rows, **more), ["doc_id"])


def test_suffix_dedup(docs):
    ids, texts = zip(*sorted(all_rows(), key=lambda r: r[0]), strict=True)
    want = sorted(zip(ids, *zip(*cut_of(texts), strict=True), strict=True))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in spans_of(docs).collect())
    assert got == want
    assert any(r[2] and r[2] < r[1] for r in got)


def test_passages_and_spans(docs, nothing):
    ids, texts = zip(*sorted(all_rows(), key=lambda r: r[0]), strict=True)
    want = sorted(zip(ids, *zip(*cut_of(texts), strict=True), strict=True))
    got = suffix_dedup.removed(docs, suffix_dedup.passages_and_spans(docs), ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    counts = {r["doc_id"]: r["passages"] or 0 for r in got}
    assert all(counts[TEXTS.index(t)] for t in TEXTS if t and PASSAGE in t) and counts[TEXTS.index(BASE)]
    assert not any(counts[i] for i, t in enumerate(TEXTS) if t in (prose(6000, 11), edited(BASE, 12, 3), "x" * 5000) or len(t or "") < 200)
    assert suffix_dedup.passages_and_spans(nothing).count() == 0


def test_passages_of_51_words_count_and_shorter_ones_do_not(spark):
    shared = {n: prose(n, 900 + n) for n in (45, 51, 58)}
    texts = [prose(40, 1000 + 2 * k + i) + f" first{k}{i} " + x + f" {i}last{k} " + prose(40, 1100 + 2 * k + i) for k, x in enumerate(shared.values()) for i in (0, 1)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["passages"] or 0, r["n_removed"]) for r in suffix_dedup.removed(rows, suffix_dedup.passages_and_spans(rows), ["doc_id"]).collect()}
    assert got == {i: (i >= 2, 0) for i in range(6)}


def test_suffix_dedup_of_very_long_texts(spark):
    long = prose(300_000, 71)
    assert len(long) > 1 << 20
    texts = [long, prose(20, 72) + long[500_000:500_600] + prose(20, 73), "ab" * 600_000, long[:1500] + "!" + long[1500:3000]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = taken(suffix_dedup.removed(rows, suffix_dedup.passages_and_spans(rows), ["doc_id"]))
    assert [tuple(r)[1:5] for r in got] == cut_of(texts)


def test_suffix_dedup_of_a_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    texts = [prose(30, i) + " " + PASSAGE + " " + prose(30, 100 + i) for i in range(25)] + [BASE, edited(BASE, 100, 1)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [tuple(r)[1:] for r in taken(spans_of(rows))]
    assert got == cut_of(texts)


def test_suffix_dedup_edges(spark, nothing):
    assert spans_of(nothing).count() == 0
    rows = spark.createDataFrame([(None, BASE), (1, BASE), (1, "short")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in spans_of(rows).collect()) == [0, len(BASE), len(BASE)]
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(rows, 10)


def test_suffix_dedup_keeps_columns_and_whole_characters(spark):
    rows = spark.createDataFrame([(1, "é" * 300 + "x", "a"), (2, "y" + "é" * 300, "b")], "doc_id long, text string, kept_sha256x string")
    got = taken(suffix_dedup.removed(rows, suffix_dedup.repeated_spans(rows)))
    assert [(r["text"], r["kept_sha256x"]) for r in got] == [("x", "a"), ("y", "b")]


def test_run_length_index_statistics():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (40, 1, 25, 60)] + [b"abab" * 10]
    got = suffix_dedup.RunLengthIndex(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])).statistics()
    spots = [t[i:] for t in texts for i in range(len(t) + 1)]
    for i, s in enumerate(spots):
        best = 0
        for j, o in enumerate(spots):
            if i != j:
                n = next((k for k, (x, y) in enumerate(zip(s, o, strict=False)) if x != y), min(len(s), len(o)))
                best = max(best, n)
        assert got[i] == best


# decontamination


def word_list(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))


def hits_of(text, items):
    w, gone, names = word_list(text), set(), set()
    for name, item in items:
        v = word_list(item)
        if name is None or not v:
            continue
        size = min(10, len(v))
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                gone.update(range(i, i + size))
                names.add(str(name))
    return len(w), len(gone), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(gone)


ITEMS = [(1, ITEM), (10, ITEM), (2, "two words"), (3, "one"), (4, None), (5, ""), (None, BASE), (6, "a " * 30), (7, PASSAGE), (7, PASSAGE), (8, "... !!")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("spans", F.lit(1))
    got = taken(decontaminate.decontaminate(docs, items, block_bytes=block_bytes))
    want = sorted((i, *hits_of(t, ITEMS)) for i, t in all_rows())
    assert sorted(map(tuple, got)) == want
    assert sum(r["contaminated"] for r in got) >= 6


def test_decontamination_of_empty_tables(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(nothing, none).count() == 0
    assert decontaminate.decontaminate(docs, none).where("contaminated or n_items > 0").count() == 0


def long_words():
    """Words of 300 to 5,000 bytes in pairs that differ at the end only, and copies of some."""
    rng = np.random.default_rng(17)
    words = []
    for n in [300] * 60 + [320, 321, 400, 1000, 5000]:
        w = "".join(rng.choice(list("abcdefghij"), n - 2))
        words += [w + "ab", w + "ba", w + "abc"]
    return words + words[:3] + words[-3:]


def test_ngram_join_of_long_words(spark):
    words = long_words()
    texts = dict(enumerate([*words, *(" ".join(words[i : i + 3]) for i in range(0, 30, 3)), *(" ".join(words[i : i + 3][::-1]) for i in range(0, 30, 3))]))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    _, label = linked_groups(texts)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_groups(rows).collect()} == label


def test_decontamination_of_long_words(spark):
    words = long_words()
    items = [(i, w) for i, w in enumerate(words) if i % 3 == 0] + [(1000, " ".join(words[:30])), (1001, "日本語、" * 200 + "甲"), (1002, "日本語、" * 60 + "甲")]
    texts = [*words, " ".join(words[:30]), " ".join(words[1:31]), "日本語、" * 200 + "乙", "日本語、" * 60 + "甲", "日本語、" * 60 + "乙"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = taken(decontaminate.decontaminate(rows, spark.createDataFrame(items, "item_id long, text string")))
    assert list(map(tuple, got)) == [(i, *hits_of(t, items)) for i, t in enumerate(texts)]


# tokens and packing


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_vocabulary())
    return {i: e.ids for i, e in enumerate(tokenizer.encode_batch([t or "" for t in TEXTS], add_special_tokens=False))}


def crc(x):
    return zlib.crc32(np.asarray(x, "<u4").tobytes())


def test_encoder_shortcut_over_all_code_points():
    """Words of every code point that goes past the normaliser and pre-tokenizer get the ids of the whole way."""
    from quillstack.llm.tokens import Encoder

    enc = Encoder(word_vocabulary())
    assert enc.direct
    admitted = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and enc._plain(c)]
    assert len(admitted) > 400 and max(admitted) < "\u0250"
    words = [w for c in admitted for w in (c, f"a{c}", f"{c}e", f"re{c}S", f"{c}{c}")]
    words += ["".join(np.random.default_rng(i).choice(admitted, 6)) for i in range(3000)]
    assert all(map(enc._plain, words))
    assert [enc._word(w.lower()) for w in words] == enc._each(words)
    marked = [w + t for w in words[::7] for t in (".", "'", "'s", "!!", "###", "'ll,", "-", "<|")]
    assert enc._learned(marked) == enc._each(marked)


def test_encoder_forgets_and_takes_long_texts():
    import pyarrow as pa
    from quillstack.llm.tokens import Encoder

    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("abcdeé.'Z1"), 7)) for _ in range(900)) for _ in range(20)] + [prose(260_000, 5), None, "", " \x0b\x1c ", "\x85a\u3000b", "日本" * 4000, "y" * 70_000]
    column = pa.array(texts)
    for kept in (50, 1_500_000):
        enc = Encoder(word_vocabulary(), kept=kept)
        got = [ids[a:b].tolist() for _, _, ids, offs in enc.encode(column) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        assert got == enc._each([t or "" for t in texts])


def test_token_orc(spark, docs, ids):
    path = fresh_path(spark, "orc")
    token_orc.write_tokens(docs, path, word_vocabulary())
    start, want = 0, []
    for i, _ in sorted(all_rows(), key=lambda r: r[0]):
        own = [*ids[i], 2]
        want.append((i, start, len(own), crc(own)))
        start += len(own)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_orc.token_offsets(spark, path).collect())
    assert got == sorted(want)
    one = token_orc.read_tokens(spark, path, [22])
    assert [r["ids"] for r in one.collect()] == [[*ids[22], 2]]
    assert "doc_id" in one._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    other = fresh_path(spark, "orc")
    token_orc.write_tokens(docs.limit(0), other, word_vocabulary())
    assert token_orc.token_offsets(spark, other).count() == 0


def rows_scanned(df):
    """How many rows the scan of a plan gave, before the filter above it."""
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan orc"):
            return node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    raise AssertionError("no scan")


def test_token_orc_skips_by_row_index_and_bloom_filter(spark):
    rows = spark.range(6000).select((F.col("id") * 2).alias("doc_id"), F.lit("one two").alias("text"))
    path = fresh_path(spark, "orc")
    token_orc.write_tokens(rows, path, word_vocabulary())
    assert token_orc.read_tokens(spark, path, [4000]).count() == 1
    # the row index leaves one stride of 1,000 rows; an odd id lies between the bounds of a stride and only the Bloom filter tells
    assert 1 <= rows_scanned(token_orc.read_tokens(spark, path, [4000])) <= 1000
    assert sum(rows_scanned(token_orc.read_tokens(spark, path, [i])) == 0 for i in (1001, 4001, 7777, 9999)) >= 3
    assert rows_scanned(token_orc.read_tokens(spark, path)) == 6000


def test_token_orc_and_packing_of_null_ids_and_clashing_columns(spark):
    rows = spark.createDataFrame([(None, "one two", 1, 2, "x", 3), (5, None, 1, 2, "x", 3), (None, "one two", 1, 2, "x", 3)], "doc_id long, text string, part int, seq long, ids string, tie long")
    path = fresh_path(spark, "orc")
    token_orc.write_tokens(rows, path, word_vocabulary())
    got = [tuple(r) for r in token_orc.token_offsets(spark, path).select("doc_id", "start", "n_tokens").orderBy("start").collect()]
    assert got == [(None, 0, 3), (None, 3, 3), (5, 6, 1)]
    packed = packing.pack_documents(rows, word_vocabulary(), 4, slack=0).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in packed) == [(False, 1), (True, 3), (True, 3)] and len({r["sequence_id"] for r in packed}) == 2


def test_packing(docs, ids, nothing):
    got = packing.pack_documents(docs, word_vocabulary(), 64).collect()
    want = []
    for i, _ in all_rows():
        own = [*ids[i], 0]
        want += [(i, k, a, len(own[a : a + 64]), crc(own[a : a + 64])) for k, a in enumerate(range(0, len(own), 64))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in bins.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))]
        assert sum(n for _, n in x) <= 64
    assert len(bins) <= 1.02 * -(-sum(r["length"] for r in got) // 64) + 1
    assert packing.pack_documents(nothing, word_vocabulary()).count() == 0


def test_merge_bins_in_several_groups(spark):
    items = spark.range(3000).select(F.col("id").alias("bin"), (1 + F.col("id") * 37 % 60).alias("fill"))
    got = packing.merge_bins(items, 64, most=4000).join(items, "bin").collect()
    bins = {}
    for r in got:
        bins.setdefault(r["into"], []).append((r["base"], r["fill"]))
    assert len(got) == 3000
    for x in bins.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 64
    assert len(bins) <= 1.05 * sum(r["fill"] for r in got) / 64 + 1


# sharding


def test_sharding(docs, nothing):
    got = sharding.shard_documents(docs, 4).collect()
    texts = dict(enumerate(TEXTS))
    assert len(got) == len(all_rows())
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(nothing, 4).count() == 0


def test_sharding_cuts_a_group_of_equal_texts(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same text").otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard_documents(rows, 24).groupBy("shard").agg(F.sum("size").alias("n"), F.max("slot").alias("last"), F.count("*").alias("rows")).collect()
    sizes = [r["n"] for r in got]
    assert len(got) == 24 and max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 24 + 2 * 30
    assert all(r["last"] == r["rows"] - 1 for r in got)


def placed(rows, shards, tolerance):
    """Brute force: rows in key order, cut where the bytes before are nearest to the targets, within the tolerance."""
    rows = sorted(rows, key=lambda r: r["key"])
    total = sum(r["size"] for r in rows)
    before, keys = {}, {}
    run = 0
    for r in rows:
        before.setdefault(r["key"], run)
        run += r["size"]
    return rows, before, total


def test_sharding_against_brute_force(spark):
    """Every splitter is as near to its target as the rows at it allow, and slots number a shard in key order."""
    rng = np.random.default_rng(8)
    texts = [prose(int(n), 500 + i) for i, n in enumerate(rng.integers(0, 60, 900))] + [None, "", "x" * 9_000, "y" * 2_000_000] + ["copy of one text"] * 400
    table = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, "z", "c", 1), (5, texts[5], "c", 1)], "doc_id long, text string, key string, slot int").repartition(5)
    sizes = sharding.document_sizes(table)
    for shards, most in ((4, 4_000_000), (24, 50)):
        got = sharding.shard_rows(sizes, shards, most_rows=most).collect()
        rows, before, total = placed(got, shards, 0.001)
        assert len(got) == len(texts) + 2
        longest = max(r["size"] for r in rows)
        ordered = [r["shard"] for r in rows]
        assert ordered == sorted(ordered) and set(ordered) <= set(range(shards))
        for s in range(1, shards):
            at = next((before[r["key"]] for r in rows if r["shard"] >= s), total)
            near = min(abs(b - total * s / shards) for b in [*before.values(), total])
            assert abs(at - total * s / shards) <= max(near, 0.001 * total / shards) + 1e-6
        for s in range(shards):
            own = [r for r in rows if r["shard"] == s]
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
            assert [r["key"] for r in sorted(own, key=lambda r: r["slot"])] == [r["key"] for r in own]
        assert longest == 2_000_008


# language


def test_codewords_differ():
    for n in (1, 2, 3, 4, 5, 9):
        code = language_id.codewords(n)
        assert len(code) == n
        assert all((code[i] != code[j]).any() for i in range(n) for j in range(i))


def test_language(spark):
    some = {"xx": "kaka koko kiki kuku keke", "yy": "mnemo snefi plosk truft", "zz": "éé àà üü ññ"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(some[x].split(), 20)), x) for i, x in enumerate(list(some) * 40)]
    more = [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 ...", None), (1003, "koko", None), (1003, "koko", None)]
    table = spark.createDataFrame([(*r, 1.0, "a") for r in rows + more], "doc_id long, text string, lang string, score double, second string").repartition(3)
    got = language_id.identify(table).collect()
    assert len(got) == len(rows) + 5
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == x for i, _, x in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "xx"]
    assert language_id.identify(table.limit(0)).count() == 0
    unlabelled = language_id.identify(table.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_language_of_texts_without_a_letter_and_of_rare_languages(spark):
    some = {"xx": "kaka koko kiki kuku keke", "yy": "mnemo snefi plosk truft"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(some["xx" if i % 50 else "yy"].split(), 20)), "xx" if i % 50 else "yy") for i in range(600)]
    rows += [(9000, "²½ ⅷ ٣ 12", "xx"), (9001, "12 …", "zz"), (9002, "ª", None), (None, "plosk truft snefi", None), (9003, "kaka " * 300_000, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(table.where("doc_id < 9000"), train_rows=30, least=10)
    got = {r["doc_id"]: r for r in language_id.predict(table, model).collect()}
    assert (got[9000]["lang_pred"], got[9000]["score"], got[9001]["lang_pred"]) == ("und", 0.0, "und")
    assert got[9002]["lang_pred"] in ("xx", "yy") and got[None]["lang_pred"] == "yy" and got[9003]["lang_pred"] == "xx"
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:600])
    assert language_id.train(table.where("doc_id = 9001")) is None or language_id.train(table.where("doc_id = 9001")).languages == ["zz"]


def test_language_held_out_accuracy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = language_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    assert both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


# licenses


def license_matches(text, templates):
    """Matches by plain Python: for each template the window that holds most of its shingles; of matches that overlap the
    one that holds most of its template."""
    plain = lambda t: re.findall("[a-z0-9]+", "".join(c.lower() for c in t or ""))
    shingled = lambda v: {tuple(v[i : i + 5]) for i in range(max(1, len(v) - 4))} if v else set()
    w, out = plain(text), []
    for name, t in templates.items():
        want, most = shingled(plain(t)), 5
        while most < len(plain(t)):
            most += max(1, most // 4)
        stride = max(1, most // 4)
        window, best = most + stride - 1, None
        for begin in range(0, max(0, len(w) - window + stride - 1) + 1, stride):
            part = w[begin : begin + window]
            n = len(shingled(part) & want)
            if n >= 0.75 * len(want) and (best is None or n > best[0]):
                best = (n, begin, len(part))
        if best:
            out.append((-best[0] / len(want), -best[0], name, best))
    kept = {}
    for share, shared, name, (n, begin, size) in out:
        if not any(o[:3] < (share, shared, name) and o[3][1] < begin + size and begin < o[3][1] + o[3][2] for o in out):
            kept[name] = (n, begin)
    return kept


def test_license_scan(docs, spark, nothing):
    texts = [prose(40, i) + " " + t + " " + prose(40, 50 + i) for i, t in enumerate(license_scan.TEMPLATES.values())]
    mit = license_scan.words_of(license_scan.TEMPLATES["MIT"])
    mit[30] = "changed"
    texts += [" ".join(mit), "license " * 50, None, "", "a license", " ".join(mit[:20]), license_scan.TEMPLATES["AGPL"] + " " + prose(60, 3) + " " + license_scan.TEMPLATES["Zlib"], prose(200_000, 4) + " " + license_scan.TEMPLATES["ISC"]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("band", F.lit(1)).repartition(3)
    got = {}
    for r in license_scan.scan_licenses(rows).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = (r["n_shared"], r["begin_word"])
    assert got == {i: m for i, t in enumerate(texts) if (m := license_matches(t, license_scan.TEMPLATES))}
    # each notice is found, and by its own name
    assert all(list(license_scan.TEMPLATES)[i] in m for i, m in got.items() if i < len(license_scan.TEMPLATES))
    assert set(got[len(texts) - 2]) == {"AGPL", "Zlib"} and set(got[len(texts) - 1]) == {"ISC"}
    assert {(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(docs).collect()} == {(i, n) for i, t in enumerate(TEXTS) for n in license_matches(t, license_scan.TEMPLATES)}
    assert license_scan.scan_licenses(nothing).count() == 0


def test_bands_hardly_miss():
    assert max(license_scan.missed(len(license_scan.words_of(t))) for t in license_scan.TEMPLATES.values()) < 1e-5


def test_license_anchors_lose_nothing():
    marks = set(license_scan.anchors(license_scan.TEMPLATES))
    for x in license_scan.shingle_sets(license_scan.TEMPLATES).values():
        assert sum(not marks & set(s.split()) for s in x) < 0.75 * len(x)


# web archives


def test_warc(spark):
    pages = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, None), (4, "http://a/\r\n4", ""), (5, "u", "x\r\n\r\ny" * 9), (6, "u", "é" * 70000), (7, "u", "same"), (8, "u", "0123456789" * 600_000)]
    rows = spark.createDataFrame([(*p, 1, "s", None) for p in pages], "page_id long, url string, html string, refers_to long, sha string, revisit boolean").repartition(2)
    mono, norm = fresh_path(spark, "mono"), fresh_path(spark, "norm")
    archives = warc.write_archives(warc.with_revisits(rows), mono)
    assert archives.agg(F.sum("records")).first()[0] == len(pages)
    assert warc.normalise(spark, archives, mono, norm).agg(F.sum("records")).first()[0] == len(pages)
    index = warc.read_index(spark, norm)
    first, want = {}, {}
    for i, _, html in sorted(pages, key=lambda p: p[0]):
        raw = (html or "").encode()
        at = first.setdefault(raw, i)
        want[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if at == i else "revisit", None if at == i else at)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(index, norm).collect()}
    assert got == want
    # each member of a normalised file is a whole record, and the sidecar names where it stands
    store, base = warc._store(norm)
    for name in {r["name"] for r in index.collect()}:
        raw = store.open_input_file(f"{base}/{name}").read()
        lines = store.open_input_file(f"{base}/{name}.idx").read().decode().splitlines()
        assert sum(int(x.split("\t")[2]) for x in lines) == len(raw)
        for line in lines:
            record, at, size = line.split("\t")
            headers, _ = warc.parsed(zlib.decompress(raw[int(at) : int(at) + int(size)], 31))
            assert headers["warc-record-id"] == record
    other = fresh_path(spark, "norm")
    none = warc.write_archives(warc.with_revisits(rows.limit(0)), fresh_path(spark, "mono"))
    warc.normalise(spark, none, mono, other)
    assert warc.read_records(warc.read_index(spark, other), other).count() == 0


def test_warc_of_repeated_rows_and_null_ids(spark):
    pages = [(1, "b", "one")] * 3 + [(1, "a", "one"), (2, "c", "one"), (None, "n", "two"), (None, "n", "two"), (4, "d", "two"), (None, None, None), (5, "e", "five")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    mono, norm = fresh_path(spark, "mono"), fresh_path(spark, "norm")
    warc.normalise(spark, warc.write_archives(warc.with_revisits(rows), mono), mono, norm)
    got = [(r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_records(warc.read_index(spark, norm), norm).collect()]
    want = [(1, "a", 3, "response", None)] + [(1, "b", 3, "revisit", 1)] * 3 + [(2, "c", 3, "revisit", 1)]
    want += [(None, "n", 3, "response", None), (None, "n", 3, "revisit", None), (4, "d", 3, "revisit", None), (None, "", 0, "response", None), (5, "e", 4, "response", None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


# nearest neighbours


def nearest_of(vectors, query, k):
    scored = sorted((-float(np.dot(v, vectors[query])), i) for i, v in vectors.items() if i != query)
    return [i for _, i in scored[:k]]


def test_forest(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=16) for i in range(1500)}
    for i in range(0, 1500, 5):  # many equal vectors: ties
        vectors[i] = vectors[0]
    bad = [(2000, None), (2001, [0.0] * 16), (2020, [float("nan")] * 16), (2040, [None] + [1.0] * 15), (2060, [1.0] * 3), (2080, [float("inf")] * 16), (None, [1.0] * 16)]
    rows = [(i, [float(x) for x in v], 1.0) for i, v in vectors.items()] + [(*b, 1.0) for b in bad] + [(7, [float(x) for x in vectors[7]], 2.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double").repartition(2)
    got = {}
    for r in ann_forest.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, near in got.items():
        assert sorted(near) == list(range(1, 21))
        assert all(abs(s - float(np.dot(vectors[i], vectors[q]))) < 1e-9 for i, s in near.values())
        assert [(-near[k][1], near[k][0]) for k in range(1, 21)] == sorted((-s, i) for i, s in near.values())
        hits += len(set(nearest_of(vectors, q, 20)) & {i for i, _ in near.values()})
    assert hits / (20 * len(got)) >= 0.9
    # equal vectors are found in the order of their ids
    equal = [got[0][k][0] for k in range(1, 21) if got[0][k][0] % 5 == 0]
    assert equal and equal == list(range(5, 5 + 5 * len(equal), 5))


def test_forest_gathers_little_of_clustered_vectors():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 32))[rng.integers(0, 60, 4000)] + 0.3 * rng.normal(size=(4000, 32))
    planes = np.random.default_rng(5).normal(size=(40, ann_forest.BITS, 33))
    forest = ann_forest.Forest(np.arange(4000), vectors, planes, float(np.sqrt((vectors**2).sum(1).max())))
    asked = np.arange(0, 4000, 40)
    owner, found, _ = forest.search(asked, vectors[asked], 20, [2640 >> n for n in range(4, -1, -1)])
    hits = sum(len(set(found[owner == q]) & set(nearest_of(dict(enumerate(vectors)), int(q), 20))) for q in asked)
    assert hits >= 0.95 * 20 * len(asked) and forest.gathered <= 0.35 * 4000 * len(asked)


def test_forest_of_ids_with_several_vectors(spark):
    kind = "vec_id long, embedding array<double>, rank int"
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [0.9, 0.1], 1), (1, [0.1, 0.8], 1), (2, [0.0, 0.7], 1), (3, [0.5, 0.0], 1), (3, [0.5, 0.0], 1)]
    got = ann_forest.nearest(spark.createDataFrame(rows, kind).repartition(2), F.col("vec_id") % 20 == 0, k=3).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 0.9), (2, 2, 0.7), (3, 3, 0.5)]


def test_forest_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann_forest.nearest(spark.createDataFrame([], kind), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], kind)
    assert [(r["rank"], r["vec_id"]) for r in taken(ann_forest.nearest(few, F.col("vec_id") % 20 == 0), "rank")] == [(1, 1), (2, 2)]
    batches = ann_forest.nearest(few, F.lit(True), k=1, query_batch=2)
    assert {r["query_id"]: r["vec_id"] for r in batches.collect()} == {0: 1, 1: 0, 2: 1}


# pipeline


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {i for i, t in texts.items() if any(c.isalpha() for c in t or "")} >= set(kept["language_id"]) and len(kept["language_id"]) >= 0.97 * len(texts)
    _, label = linked_groups(kept["language_id"])
    assert set(kept["near_duplicates"]) == {i for i, x in label.items() if i == x}
    order = sorted(kept["near_duplicates"])
    for i, cut in zip(order, cut_of([kept["near_duplicates"][i] for i in order]), strict=True):
        assert (i in kept["repeated_passages"]) == (cut[1] < cut[0] or cut[0] == 0)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(kept["benchmark_passages"]) == {i for i, t in kept["repeated_passages"].items() if not hits_of(t, items)[4]}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(kept["benchmark_passages"])


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kind = "doc_id long, text string, lang string, source string, n_chars long, component_id long, items int, spans string, tk string"
    near = BASE.replace(" ", "  ")
    rows = [(1, BASE), (2, near), (3, BASE + " tail"), (5, prose(90, 31)), (5, prose(90, 32)), (5, prose(90, 31)), (None, prose(80, 33)), (7, None), (8, ""), (9, " "), (10, None)]
    docs = spark.createDataFrame([(*r, "en", None, 3, None, 1, "s", "t") for r in rows], kind).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(map(str, [(1, BASE), (5, prose(90, 31)), (5, prose(90, 32)), (None, prose(80, 33)), (7, None), (8, ""), (9, " "), (10, None)]))
    left = corpus_pipeline.repeated_passages(spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in left} >= {7, 8, 10} and {r["doc_id"] for r in corpus_pipeline.benchmark_passages(spark, docs, sf_dir).collect()} == {1, 2, 3, 5, None, 7, 8, 9, 10}
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, sf_dir).collect()} == {1, 2, 3, 5, None}
    packed = corpus_pipeline.packing(spark, docs, sf_dir).collect()
    assert len(packed) == len(rows) and sum(r["length"] == 1 for r in packed) == 4
    assert corpus_pipeline.packing(spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_cuts_passages_of_over_50_words(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    shared = {n: prose(n, 200 + n) for n in (50, 51, 55, 60)}
    shared[1] = "".join(np.random.default_rng(8).choice(list("abcdef"), 450))  # one long word
    assert all(len(shared[n]) < 400 for n in (50, 51, 55, 60))
    texts, want = {}, {}
    for k, (n, x) in enumerate(shared.items()):
        for i in (10 * k, 10 * k + 1):
            before, after = prose(30, 300 + i) + f" first{i}", f"{i % 10}last " + prose(30, 400 + i)
            texts[i] = f"{before} {x} {after}"
            want[i] = texts[i] if n == 50 else before + after
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, rows, "").collect()}
    assert {i: t.replace(" ", "") for i, t in got.items()} == {i: t.replace(" ", "") for i, t in want.items()}
