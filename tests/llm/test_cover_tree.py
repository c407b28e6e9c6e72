"""Hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillstack.llm.queries")

from quillstack.llm import cover_tree  # noqa: E402


def expected(rows, anchors, positives=5, negatives=3):
    """Of rows (id, label, vector), all usable and of different ids."""
    out = []
    for a, own, q in rows:
        if not anchors(a):
            continue
        scored = [(-int(np.dot(np.array(q, object), np.array(v, object))), i, label) for i, label, v in rows if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == own)[:positives]:
            fit = sorted(x for x in scored if x[2] != own and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def got_of(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, label, None if v is None else [None if x is None else int(x) for x in v], 1, "b") for i, label, v in rows], "vec_id long, label int, vector array<long>, rank int, block string").repartition(3)


def vectors(n, width, seed, spread=0.4, centres=12):
    rng = np.random.default_rng(seed)
    return np.floor(256 * (rng.normal(size=(centres, width))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, width)))).astype(int)


@pytest.mark.parametrize("block_rows", [40, 5000])
def test_against_all_pairs(spark, block_rows):
    points = vectors(700, 12, 1)
    points[::9] = points[0]  # ties
    rows = [(i, int(i * 7 % 5) if i % 3 else 1, v) for i, v in enumerate(points)]
    rows += [(800, 1, np.zeros(12)), (850, 2, -points[3]), (801, 9, points[4])]
    want = expected(rows, lambda i: i % 50 == 0)
    odd = [(None, 1, points[0]), (900, None, points[0]), (950, 1, None), (1000, 1, [None, *points[0][1:]]), (1050, 1, [1, 2]), rows[50], rows[3]]
    got = got_of(cover_tree.hard_negatives(frame(spark, rows + odd), F.col("vec_id") % 50 == 0, block_rows=block_rows, anchor_rows=7))
    assert got == want and len(want) > 50


def test_edges(spark):
    none = frame(spark, [(1, 1, [1, 2])]).limit(0)
    assert cover_tree.hard_negatives(none, F.lit(True)).count() == 0
    alone = frame(spark, [(50, 1, [3, 4]), (1, 2, [3, 3])])
    assert cover_tree.hard_negatives(alone, F.col("vec_id") % 50 == 0).count() == 0
    few = [(50, 1, [10, 0]), (1, 1, [10, 0]), (2, 2, [5, 0]), (3, 2, [9, 0]), (4, 3, [10, 0]), (5, 1, [-10, 0]), (6, 2, [4, 9]), (7, 2, [9, 1])]
    got = got_of(cover_tree.hard_negatives(frame(spark, few), F.col("vec_id") % 50 == 0))
    assert got == [(50, 1, 1, 3, 100, 90), (50, 1, 2, 7, 100, 90), (50, 1, 3, 2, 100, 50)]
    with pytest.raises(ValueError):
        cover_tree.hard_negatives(frame(spark, [(50, 1, [2**40, 0]), (1, 1, [1, 1])]), F.lit(True))


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, rng.integers(-(2**25), 2**25, 6)) for i in range(150)]
    assert got_of(cover_tree.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)) == expected(rows, lambda i: i % 50 == 0)


def test_the_tree_covers_and_skips():
    points = vectors(3000, 24, 2, 0.15, 40)
    norm = float(np.sqrt((points**2).sum(1).max())) * (1 + 1e-9)
    labels = np.arange(3000) % 4
    tree = cover_tree.CoverTree(np.arange(3000), labels, points.astype(float), norm)
    assert sorted(np.concatenate([rows for _, _, rows in tree.leaves]).tolist()) == list(range(3000))
    queries = points[:40].astype(float)
    least, most = tree.leaf_bounds(queries, np.full(40, -np.inf), np.full(40, np.inf))
    for at, (_, _, rows) in enumerate(tree.leaves):
        inner = queries @ points[rows].T
        assert (inner >= least[:, [at]]).all() and (inner <= most[:, [at]]).all()
    tree.positives(np.arange(40), labels[:40], queries, np.full(40, -np.inf), 5)
    assert tree.verified < 0.3 * 40 * 3000
    tree.verified = 0
    windows = [[(1, int(0.5 * q @ q), int(0.95 * q @ q))] for q in queries]
    tree.negatives(labels[:40], np.arange(40), queries, windows, 3)
    assert tree.verified < 0.5 * 40 * 3000


def test_quantised_rounds_down_and_drops_what_is_not_finite(spark):
    rows = [(1, 1, [0.5, -0.001]), (2, None, [1.0, 1.0]), (3, 1, None), (4, 1, [None, 1.0]), (5, 1, [float("nan"), 1.0]), (6, 1, [float("inf"), 1.0])]
    got = cover_tree.quantised(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert [(r["vec_id"], list(r["vector"])) for r in got] == [(1, [128, -1])]
