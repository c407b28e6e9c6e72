"""Ranked lexical search against scores worked out one by one."""

import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

pytest.importorskip("quillstack.llm.queries")

from quillstack.llm import lexical  # noqa: E402
from test_llm import ITEM, TEXTS, lowered, prose  # noqa: E402


def terms_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered(text))


def expected(docs, items, k=20):
    words = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in words if c]
    documents, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * documents // length
            score = sum(floor(1000 * log((2 * documents + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


def got_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def frames(spark, docs, items):
    rows = spark.createDataFrame([(i, t, "x", 1, 2, 3.0) for i, t in docs], "doc_id long, text string, key string, n long, rank int, score double").repartition(3)
    return rows, spark.createDataFrame([(i, t, 1, "k") for i, t in items], "item_id long, text string, doc_id int, key string")


ITEMS = [(1, ITEM), (2, None), (3, ""), (4, "..."), (5, prose(40, 3) + " " + prose(40, 3)), (6, "ONE two x"), (7, "nowhere known"), (8, prose(300, 11)), (None, "one é"), (9, "MIT license, one one one")]


@pytest.mark.parametrize("batch_terms", [500_000, 60])
def test_all_cases(spark, batch_terms):
    docs = [*enumerate(TEXTS), (8, TEXTS[8]), (None, "one and two"), (40, "one"), (41, "One")]
    rows, items = frames(spark, docs, ITEMS)
    assert got_of(lexical.ranked(rows, items, batch_terms=batch_terms)) == expected(docs, ITEMS)
    assert got_of(lexical.ranked(rows, items.union(items), k=3)) == expected(docs, ITEMS, 3)


def test_empty_tables(spark):
    rows, items = frames(spark, [(1, "one")], ITEMS[:1])
    for a, b in ((rows.limit(0), items), (rows, items.limit(0)), (rows.limit(0), items.limit(0)), (rows, items.where("item_id = 2"))):
        found = lexical.ranked(a, b)
        assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_many_documents_of_equal_scores_in_small_blocks(spark):
    docs = [(i, prose(12 + i % 7, i % 90) + (" zebra" if i % 3 else "")) for i in range(600)]
    items = [(i, prose(9, 500 + i) + " zebra") for i in range(12)]
    rows, asked = frames(spark, docs, items)
    assert got_of(lexical.ranked(rows, asked, block_rows=50)) == expected(docs, items)


def test_groups_are_left_out_once_safely_finished():
    rng = np.random.default_rng(5)
    n, size = 20_000, 40
    held = [np.sort(rng.choice(size, rng.integers(1, 9), replace=False)) for _ in range(n)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])])
    tfs = rng.integers(1, 3, offsets[-1])
    block = lexical.Block(np.arange(n), np.full(n, 20), offsets, np.concatenate(held), tfs, n, 20 * n, size)
    terms, weights = np.arange(12), np.arange(1, 13) * 500
    at, scores = block.best(terms, weights, 20)
    want = np.zeros(n, np.int64)
    for term, w in zip(terms, weights, strict=True):
        docs, gives = block.of(term)
        want[docs] += w * gives
    order = np.lexsort((np.arange(n), -want))[:20]
    assert at.tolist() == order.tolist() and scores.tolist() == want[order].tolist()
    assert block.evaluated < 0.2 * n
    # more terms than one integer has bits
    wide = lexical.Block(np.arange(3), np.array([100, 100, 90]), np.array([0, 100, 200, 290]), np.concatenate([np.arange(100), np.arange(100), np.arange(10, 100)]), np.ones(290, np.int64), 3, 290, 100)
    at, scores = wide.best(np.arange(100), np.ones(100, np.int64), 2)
    assert at.tolist() == [0, 1] and scores[0] == scores[1]
