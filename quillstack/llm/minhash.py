"""Near-duplicates by MinHash: many universal hash minima, bands, signature verification, and connected components.

Every document's set of word shingles gets ``HASHES`` minima under universal hash functions (multiply-shift). Minima are cut
into ``BANDS`` bands; documents that agree in a band meet in its bucket. A pair of the threshold misses all bands with a
probability of (1 - 0.85 ** 6) ** 32, below 3 in ten million. Pairs are first verified by their signatures, one bit of each
minimum, which a linked pair fails by six standard deviations or more only, and then confirmed on the full sets. Components come
from alternating large-star and small-star rounds.

Equal sets are one class with one member in the buckets, so copies are never paired. Nor is a bucket of near copies expanded into
its pairs: its classes are first compared with the one that shares most bucket places with others, then with one drawn from those
not linked yet, and what links is merged. What is left are classes that still meet others of different components in a bucket: of these, pairs are compared
that share one of their rarest shingles, early enough in both for the overlap that the two sizes ask for. Nothing is capped.

Shingles, sets and buckets are 64-bit hashes.

Defined cases: words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of fewer than three words is one
shingle; without words or text n_shingles is 0 and nothing links; rows of equal doc_id get a row each and are one document in links
(an empty one of them stays alone); a null doc_id is never linked, its component is null and it is kept; empty tables give empty
tables; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, discard, fresh_worker, mix, narrowed, small_batches, staged
from .components import connected_components
from .ngram_join import gram_sets

#: Minima of a document, and the bands that they are cut into.
HASHES, BANDS = 192, 32
#: Parts by which full sets are compared.
PARTS = 4
_SKETCH = ["s0", "s1", "s2"]
_RNG = np.random.Generator(np.random.PCG64(1997))
_A = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**64, HASHES, dtype=np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least values of each set, none of them empty, under the hash functions: sets by functions."""
    grams = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint64)
    for h in range(HASHES):
        out[:, h] = np.minimum.reduceat(grams * _A[h] + _B[h], starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """The bucket of each set in each band."""
    parts, keys = least.reshape(len(least), BANDS, -1), np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS))
    for j in range(parts.shape[2]):
        keys = mix(keys ^ parts[:, :, j])
    return keys


def sketches(least: np.ndarray) -> np.ndarray:
    """One bit of each minimum, 64 to an integer."""
    bits = (mix(least) & np.uint64(1)).reshape(len(least), -1, 64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64)


def set_hash(grams: np.ndarray) -> np.uint64:
    """A hash of a whole set."""
    return mix(np.array([grams.sum(dtype=np.uint64) ^ (mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) << np.uint64(1)) ^ np.uint64(len(grams))]))[0]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, node (a hash of the set), n (its size), the sketch and the bands of each of ``docs`` (doc_id, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for i, j, data, offs in chunks(batch.column("text")):
                sets = gram_sets(data, offs, k)
                held = [s for s in sets if len(s)]
                at = np.flatnonzero([len(s) > 0 for s in sets])
                bits, keys = np.zeros((j - i, len(_SKETCH)), np.uint64), np.zeros((len(at), BANDS), np.uint64)
                node = np.zeros(j - i, np.uint64)
                if held:
                    least = minima(held)
                    bits[at], keys = sketches(least), band_keys(least)
                    node[at] = [set_hash(s) for s in held]
                sizes = np.zeros(j - i + 1, np.int32)
                sizes[1:][at] = BANDS
                lists = pa.ListArray.from_arrays(np.cumsum(sizes, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64)))
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(node.view(np.int64)), pa.array([len(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(bits[:, c]).view(np.int64)) for c in range(len(_SKETCH))), lists], ["doc_id", "node", "n", *_SKETCH, "bands"])

    return docs.mapInArrow(emit, f"doc_id long, node long, n long, {', '.join(f'{s} long' for s in _SKETCH)}, bands array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, node, part and grams of each of ``docs``: the sets, cut into parts by their values."""
    shift = np.uint64(64 - (PARTS - 1).bit_length())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for i, _, data, offs in chunks(batch.column("text")):
                for at, grams in enumerate(gram_sets(data, offs, k), i):
                    if not len(grams):
                        continue
                    part, first = np.unique(grams >> shift, return_index=True)  # sets are sorted
                    lists = pa.ListArray.from_arrays(np.append(first, len(grams)).astype(np.int32), pa.array(grams.view(np.int64)))
                    own = pa.array([batch.column("doc_id")[at].as_py()] * len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(part), set_hash(grams)).view(np.int64)), pa.array(part.astype(np.int32)), lists], ["doc_id", "node", "part", "grams"])

    return docs.mapInArrow(emit, "doc_id long, node long, part int, grams array<long>")


def alike(x: str, y: str, percent: int) -> Column:
    """Whether sizes and signatures allow a link."""
    sizes = (F.col(f"{x}.n") * 100 >= percent * F.col(f"{y}.n")) & (F.col(f"{y}.n") * 100 >= percent * F.col(f"{x}.n"))
    agree = (1 + percent / 100) / 2  # one bit of a minimum agrees in half of the cases where minima differ
    apart = HASHES * (1 - agree) + 6 * sqrt(HASHES * agree * (1 - agree))
    return sizes & (sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in _SKETCH), F.lit(0)) <= int(apart))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, na, b, nb) those that link by their full sets; overlaps of the parts are summed."""
    left, right = (sets.select(F.col("node").alias(x), "part", F.col("grams").alias(f"{x}_grams")) for x in ("a", "b"))
    both = pairs.join(right, "b").join(left, ["a", "part"])
    summed = both.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("a_grams", "b_grams"))).alias("o"))
    return summed.where(F.col("o") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def early_shingles(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """gram, node and pos of the shingles of ``nodes`` (node, n) that a link can begin with: shingles are ordered by the number of nodes
    that hold them, those that no other holds first, and a partner shares one of the first n less the overlap that it needs, and one."""
    grams = sets.join(nodes, "node").select("node", "n", F.explode("grams").alias("gram"))
    several = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    own = Window.partitionBy("node")
    shared = grams.join(several, "gram").withColumn("pos", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("many", "gram")) - 1)
    return shared.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("gram", "node", "pos")


def linked(postings: DataFrame, sets: DataFrame, same: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """node and label of the classes that link and aren't their component's least; ``postings``: key, node, n, sketch, central,
    ``same``: classes (a, b) that hold rows of one doc_id."""
    edges, labels, tested, last = same, None, None, False
    facts = F.struct("node", "n", *_SKETCH)
    for step in range(rounds + 1):
        last = last or step == rounds
        p = postings.withColumn("label", F.col("node"))
        if labels is not None:
            p = postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        # later leaders are drawn from those that no leader has linked yet, as far as there are any
        prior = F.xxhash64("node", F.lit(step)).cast("double") + F.when(F.col("label") == F.col("node"), 1e20).otherwise(0.0)
        p = p.withColumn("prior", F.col("central").cast("double") if step == 0 else prior)
        lead = F.max_by(F.struct("node", "n", *_SKETCH, "label", "prior"), F.struct("prior", "node"))
        lists = p.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), lead.alias("y")).where("low < high")
        x = p.select("key", F.col("label").alias("xl"), facts.alias("x"))
        if not last:
            pairs = x.join(lists.select("key", "y"), "key").where((F.col("xl") != F.col("y.label")) & alike("x", "y", percent))
            # of the leaders of its buckets a class meets the first
            best = F.max_by(F.struct("x", "y"), F.struct("y.prior", "y.node")).alias("p")
            pairs = pairs.groupBy(F.col("x.node").alias("of")).agg(best).select("p.x", "p.y")
        else:
            open_ = staged(x.join(lists.select("key"), "key", "left_semi").select("xl", "x", F.col("x.node").alias("node"), F.col("x.n").alias("n")).dropDuplicates(["node"]), "minhash-open")
            places = staged(early_shingles(open_.select("node", "n"), sets, percent).join(open_.drop("n"), "node"), "minhash-early")
            mixed = places.groupBy("gram").agg(F.min("xl").alias("low"), F.max("xl").alias("high")).where("low < high").select("gram")
            left = places.join(mixed, "gram", "left_semi").select("gram", "xl", "x", "pos")
            right = left.select("gram", F.col("xl").alias("yl"), F.col("x").alias("y"), F.col("pos").alias("y_pos"))
            # of the overlap that the sizes ask for the first shingle has at most so many before it
            needs = F.ceil((F.col("x.n") + F.col("y.n")) * F.lit(percent / (100 + percent)) - 1e-9)
            placed = (F.col("pos") <= F.col("x.n") - needs) & (F.col("y_pos") <= F.col("y.n") - needs)
            pairs = left.join(right, "gram").where((F.col("x.node") < F.col("y.node")) & (F.col("xl") != F.col("yl")) & placed & alike("x", "y", percent))
        low = F.col("x.node") < F.col("y.node")
        pairs = pairs.select(*[F.when(low, F.col(f"{s}.{c}")).otherwise(F.col(f"{t}.{c}")).alias(n) for s, t, c, n in (("x", "y", "node", "a"), ("x", "y", "n", "na"), ("y", "x", "node", "b"), ("y", "x", "n", "nb"))]).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "minhash-pairs")
        over = last
        if pairs.isEmpty():
            if over:
                break
            last = True
            continue
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        found = staged(confirmed(pairs, sets, percent), "minhash-links")
        if not found.isEmpty():
            edges = edges.unionByName(found)
            labels = connected_components(edges).select("node", "label")
        else:
            last = True
        if over:
            break
    return labels if labels is not None else connected_components(edges).select("node", "label")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each of ``docs`` (doc_id, text).

    ``percent``: 100 times the Jaccard similarity of ``k``-word shingles from which documents link; the bands are set for 85
    or more.
    """
    if percent < 85:
        raise ValueError("percent must be at least 85")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = staged(signatures(docs, k), "minhash-facts")
    known = facts.where("n > 0 and doc_id is not null")
    classes = staged(known.groupBy("node").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    # the member that stands for a class in the buckets; of rows that repeat, one
    reps = known.join(classes.withColumnRenamed("rep", "doc_id"), ["node", "doc_id"]).dropDuplicates(["node", "doc_id"])
    buckets = reps.select("node", "n", *_SKETCH, F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    # a bucket of one is no candidate; what is left is few documents' buckets
    met = staged(buckets.join(shared, "key"), "minhash-buckets")
    central = met.groupBy("node").agg(F.sum("many").alias("central"))
    postings = staged(met.drop("many").join(central, "node"), "minhash-postings")
    discard(met)
    asked = classes.join(postings.select("node").distinct(), "node", "left_semi").select("node", F.col("rep").alias("doc_id"))
    asked = staged(asked, "minhash-asked")
    texts = narrowed(docs, asked, "doc_id").join(asked.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    sets = full_sets(texts, k).join(asked, ["node", "doc_id"], "left_semi").select("node", "part", "grams")
    sets = staged(sets.dropDuplicates(["node", "part"]), "minhash-sets")
    ids = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("a < high")
    same = staged(known.join(ids, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "minhash-same")

    labels = linked(postings, sets, same, percent)
    grown = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = grown.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = grown.join(firsts, "label").select("node", "component_id")
    out = facts.select("doc_id", "node", "n").join(named, "node", "left")
    component = F.coalesce(F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")), "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
