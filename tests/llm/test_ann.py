"""Recall of the hash-prefix forest with distinct queries, however the rows lie in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillstack.llm.queries")

from quillstack.llm import ann_forest  # noqa: E402

SHARE = 0.66


def unit(n, width, seed):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1)[:, None]


def recall(vectors, blocks, k=20, trees=40):
    """Recall at k and share of rows gathered of every twentieth row (fifty of them at most), as the operator splits the work."""
    planes = np.random.default_rng(5).normal(size=(trees, ann_forest.BITS, vectors.shape[1] + 1))
    asked = np.arange(0, len(vectors), 20)[:50]
    near, gathered = {int(q): [] for q in asked}, 0
    for part in np.array_split(np.arange(len(vectors)), blocks):
        forest = ann_forest.Forest(part, vectors[part], planes, float(np.sqrt((vectors**2).sum(1).max())))
        leasts = [max(4 * k, int(SHARE * len(part)) >> n) for n in range(ann_forest.STEPS - 1, -1, -1)]
        for q, v, s in zip(*forest.search(asked, vectors[asked], k, leasts), strict=True):
            near[int(q)].append((-s, int(v)))
        gathered += forest.gathered
    hits = 0
    for q in near:
        score = vectors @ vectors[q]
        score[q] = -np.inf
        hits += len({v for _, v in sorted(near[q])[:k]} & set(np.argsort(-score, kind="stable")[:k].tolist()))
    return hits / (k * len(near)), gathered / (len(vectors) * len(near))


@pytest.mark.parametrize("blocks", [1, 2, 4, 8, 16])
@pytest.mark.parametrize("n", [100, 500, 2000, 20_000])
def test_recall_of_vectors_without_structure(n, blocks):
    found, _ = recall(unit(n, 64, n), blocks)
    assert found >= 0.9


@pytest.mark.parametrize("blocks", [1, 4, 16])
def test_recall_of_clustered_vectors(blocks):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(100, 64))[rng.integers(0, 100, 6000)] + 0.35 * rng.normal(size=(6000, 64))
    found, gathered = recall(vectors, blocks)
    assert found >= 0.95 and (blocks > 1 or gathered <= 0.4)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_recall_of_the_operator(spark, sf_dir, parts):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    ids = np.array(sorted(vectors))
    points = np.array([vectors[i] for i in ids])
    got = {}
    for r in ann_forest.nearest(rows.repartition(parts, "vec_id"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = [int(i) for i in ids if i % 20 == 0]
    assert set(got) == set(asked) and len({vectors[q].tobytes() for q in asked}) == len(asked)
    hits = 0
    for q in asked:
        score = points @ vectors[q]
        score[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.argsort(-score, kind="stable")[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(asked)
