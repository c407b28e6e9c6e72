"""MinHash near-duplicates against brute force on whole sets."""

import re

import numpy as np
import pytest

pytest.importorskip("quillstack.llm.queries")

from quillstack.llm import minhash  # noqa: E402
from test_llm import BASE, KIND, TEXTS, edited, lowered, prose  # noqa: E402


def shingles(text, k=3):
    w = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected(rows, percent=85):
    """doc_id, n, component and kept of rows (doc_id, text), by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    live = [x for x, (i, _) in enumerate(rows) if i is not None and sets[x]]
    pairs = [(rows[x][0], rows[y][0]) for x in live for y in live if x < y and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])]
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        component = label[i] if i is not None and s else i
        out.append((i, len(s), component, component == i))
    return sorted(out, key=str)


def got_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_all_cases(spark):
    rows = [*enumerate(TEXTS), (8, TEXTS[8]), (20, TEXTS[20])]
    wide = spark.createDataFrame([(i, t, None, 0.5, 1, 2, 3, "s", 4, 5) for i, t in rows], KIND).repartition(3)
    assert got_of(minhash.near_duplicates(wide)) == expected(rows)
    assert minhash.near_duplicates(wide.limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(wide, 80)


def test_chains_stars_and_texts_around_the_threshold(spark):
    long = prose(240, 71)
    rows = [(i, edited(long, 60 + i % 40, i)) for i in range(40)]  # near copies of one text, mostly linked through it
    rows += [(100, long), (101, long.upper()), (102, long + " more words at the end")]
    step = prose(200, 72).split()
    for i in range(12):  # a chain: each links with the next ones only
        rows.append((200 + i, " ".join(f"c{j}" if j < 5 * i else w for j, w in enumerate(step))))
    for i in range(30):  # many at similarities from 0.7 to 0.95
        rows.append((300 + i, edited(prose(180, 73), 18 + 4 * (i % 12), i)))
    assert got_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == expected(rows)


def test_ids_that_repeat_join_their_texts(spark):
    other = prose(90, 74)
    rows = [(None, BASE), (5, BASE), (5, other), (9, other + " x"), (3, BASE + " tail"), (7, ""), (5, None), (5, BASE)]
    got = got_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    n, m = len(shingles(BASE)), len(shingles(other))
    assert got == sorted([(None, n, None, True), (5, n, 3, False), (5, n, 3, False), (5, m, 3, False), (5, 0, 5, True), (9, m + 1, 3, False), (3, n + 1, 3, True), (7, 0, 7, True)], key=str)


def test_signatures_estimate_similarity_and_bands_hardly_miss():
    rng = np.random.default_rng(1)
    missed = apart = 0
    for _ in range(200):
        both = rng.integers(0, 2**64, 850, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**64, 75, dtype=np.uint64)])) for _ in range(2))
        least = minhash.minima([x, y])
        assert abs((least[0] == least[1]).mean() - 0.85) < 0.15
        missed += not (minhash.band_keys(least)[0] == minhash.band_keys(least)[1]).any()
        bits = minhash.sketches(least)
        apart = max(apart, sum(bin(int(a ^ b)).count("1") for a, b in zip(*bits, strict=True)))
    assert missed == 0 and apart <= int(192 * 0.075 + 6 * (192 * 0.925 * 0.075) ** 0.5)


def test_equal_bands_are_equal_sets():
    x = np.arange(5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (minhash.band_keys(minhash.minima([x, x]))[0] == minhash.band_keys(minhash.minima([x]))[0]).all()
    assert len(np.unique(minhash.band_keys(minhash.minima([x])))) == minhash.BANDS
    assert minhash.set_hash(x) == minhash.set_hash(x.copy()) != minhash.set_hash(x[:4])
