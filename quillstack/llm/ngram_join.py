"""N-gram Jaccard join by vertical partitioning, and the groups of linked documents.

The n-gram universe is cut into fragments by hash. Each fragment counts, on its own, in how many documents its n-grams
occur, and the partial counts are summed for each document. A document of n n-grams of which more than a quarter occur
in no other has no partner at a similarity of 0.75; most documents leave here. Copies (equal sets) become one, fragments
count again, and what is left joins on its rarest n-grams: of two linked documents each has one of the other's among its
n // 4 + 1 rarest. Candidate pairs are verified by fragments again: the overlap of each fragment is counted apart and
the parts are summed for the pair. So the result is exact.

A list of documents with a rare n-gram in common isn't expanded into its pairs. First its documents are compared with
the most central of them and what links is merged; then only pairs in different groups are compared, and only where the
n-gram comes early enough in both documents for the overlap that their sizes ask for.

N-grams are 64-bit hashes. Fragment messages carry a shorter hash, which may only let a document stay that could go.

Defined cases: words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of fewer than five words is
one n-gram; without words or text n_shingles is 0 and nothing links; rows of equal doc_id get a row each and are one
document in links; a null doc_id is never linked and its component is null; empty tables give empty tables; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, chunks, discard, fresh_worker, hash_words, mix, narrowed, small_batches, staged, word_ngrams
from .components import connected_components

#: n-grams of a block of documents whose messages go together, and n-grams aimed at for a fragment.
BLOCK_GRAMS, FRAGMENT_GRAMS = 800_000, 2_000_000
#: Fragments by which pairs are verified.
PARTS = 8
_MESSAGE = "kind int, frag int, block string, docs binary, entries binary, ids binary, sizes binary, grams binary"
_NAMES = ["kind", "frag", "block", "docs", "entries", "ids", "sizes", "grams"]
_KINDS = [pa.int32(), pa.int32(), pa.string()] + [pa.binary()] * 5
_NO_ID = -(2**63)


def gram_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each of the concatenated rows."""
    words, woff = hash_words(data, offs, NOT_SPACE)
    grams, out = word_ngrams(words, k), []
    for a, b in zip(woff[:-1].tolist(), woff[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            odd = np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
            out.append(mix(np.array([(words[a:b] * odd).sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _cut(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of a block, their documents, the order by fragment, and where fragments begin in it."""
    grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    docs = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
    frags = (grams >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(frags, kind="stable")
    return grams, docs, frags, order, np.searchsorted(frags[order], np.arange((1 << bits) + 1))


def steps(docs: np.ndarray) -> bytes:
    """Ascending numbers as a byte each: the step from the one before; 255 is a step that no number follows."""
    apart = np.diff(docs.astype(np.int64), prepend=0)
    far = apart // 255
    out = np.full(len(docs) + int(far.sum()), 255, np.uint8)
    out[np.cumsum(far + 1) - 1] = apart % 255
    return out.tobytes()


def stepped(data: bytes) -> np.ndarray:
    """The numbers that :func:`steps` has put."""
    by = np.frombuffer(data, np.uint8)
    return np.cumsum(by, dtype=np.int64)[by != 255]


def _messages(block: str, ids: np.ndarray, sets: list[np.ndarray], bits: int, facts: bool) -> pa.RecordBatch:
    """A message to each fragment with n-grams of the block, and a row of kind 0 for the block itself. With ``facts``
    messages name the documents of their entries and the block row has hashes of its sets, else it has the sets."""
    grams, docs, _, order, cuts = _cut([s if i != _NO_ID else s[:0] for i, s in zip(ids.tolist(), sets, strict=True)], bits)
    short = ((grams >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")[order]
    docs = docs[order]
    if facts:  # two independent hashes of the whole set
        grams = np.array([[s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1)
    sizes = np.array([len(s) for s in sets], "<u4")
    rows = [(0, crc32(block.encode()) % (1 << bits), block, None, None, ids.astype("<i8").tobytes(), sizes.tobytes(), grams.astype("<u8").tobytes())]
    for f in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = int(cuts[f]), int(cuts[f + 1])
        rows.append((1, f, block, steps(docs[a:b]) if facts else None, short[a:b].tobytes(), None, None, None))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def blocks_of(docs: DataFrame, bits: int, facts: bool, k: int, limit: int = BLOCK_GRAMS) -> DataFrame:
    """Messages (kind 1) and block rows (kind 0) of ``docs`` (doc_id, text), as :func:`_messages` makes them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        part, serial, ids, sets, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for i, j, data, offs in chunks(batch.column("text")):
                ids.append(batch.column("doc_id").slice(i, j - i).fill_null(_NO_ID).to_numpy())
                found = gram_sets(data, offs, k)
                sets += found
                held += sum(map(len, found))
                if held >= limit:
                    yield _messages(f"{part}-{serial}", np.concatenate(ids), sets, bits, facts)
                    serial, ids, sets, held = serial + 1, [], [], 0
        if ids:
            yield _messages(f"{part}-{serial}", np.concatenate(ids), sets, bits, facts)

    return docs.mapInArrow(emit, _MESSAGE)


def _counted(entries: list[np.ndarray]) -> np.ndarray:
    """In how many documents each of the entries of a fragment's messages occurs (255 at most), one after another."""
    joined = np.concatenate(entries)
    ordered = np.sort(joined)
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.flatnonzero(first)
    many = np.minimum(np.diff(np.append(at, len(ordered))), 255).astype(np.uint8)
    return many[np.searchsorted(ordered[at], joined)]


_ANSWER = "kind int, block string, docs binary, ids binary, sizes binary, grams binary"


def _unshared(table: pa.Table) -> pa.Table:
    """For each block that has sent a message, the documents of n-grams that no other has; block rows as they are."""
    rows = table.to_pylist()
    sent = [r for r in rows if r["kind"] == 1]
    out = [{k: r[k] for k in ("kind", "block", "docs", "ids", "sizes", "grams")} for r in rows if r["kind"] == 0]
    if sent:
        entries, at = [np.frombuffer(r["entries"], "<u4") for r in sent], 0
        many = _counted(entries)
        for r, e in zip(sent, entries, strict=True):
            out.append({"kind": 1, "block": r["block"], "docs": steps(stepped(r["docs"])[many[at : at + len(e)] == 1]), "ids": None, "sizes": None, "grams": None})
            at += len(e)
    return pa.Table.from_pylist(out, pa.schema([("kind", pa.int32()), ("block", pa.string())] + [(n, pa.binary()) for n in ("docs", "ids", "sizes", "grams")]))


def _summed(table: pa.Table) -> pa.Table:
    """The documents of a block: doc_id, n, two set hashes, and n-grams that no other document has."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["kind"] == 0)
    ids, sizes = np.frombuffer(own["ids"], "<i8"), np.frombuffer(own["sizes"], "<u4").astype(np.int64)
    keys = np.frombuffer(own["grams"], "<i8").reshape(-1, 2)
    alone = np.zeros(len(ids), np.int64)
    for r in rows:
        if r["kind"] == 1:
            alone += np.bincount(stepped(r["docs"]), minlength=len(ids))
    return pa.table({"doc_id": pa.array(ids, mask=ids == _NO_ID), "n": sizes, "k1": keys[:, 0], "k2": keys[:, 1], "alone": alone})


def shared_counts(docs: DataFrame, bits: int, k: int) -> DataFrame:
    """doc_id, n (distinct n-grams), k1, k2 (hashes of the set) and alone (n-grams of no other row) of each document."""
    answers = blocks_of(docs, bits, True, k).groupBy("frag").applyInArrow(_unshared, _ANSWER)
    return answers.groupBy("block").applyInArrow(_summed, "doc_id long, n long, k1 long, k2 long, alone long")


def rare_postings(sets: DataFrame, bits: int) -> DataFrame:
    """From :func:`blocks_of` with whole sets: gram, doc_id, n, pos of the shared ones among each document's n // 4 + 1
    rarest n-grams; pos is the n-gram's place in the document, rarest first. shared: how many of all its n-grams others
    have; central: in how many documents they occur, on average."""

    def counts(table: pa.Table) -> pa.Table:
        entries, at, out = [np.frombuffer(e, "<u4") for e in table.column("entries").to_pylist()], 0, []
        many = _counted(entries)
        for block, e in zip(table.column("block").to_pylist(), entries, strict=True):
            out.append((block, many[at : at + len(e)].tobytes()))
            at += len(e)
        names, data = zip(*out, strict=True)
        n = len(out)
        return pa.table({"kind": pa.array([1] * n, pa.int32()), "frag": table.column("frag"), "block": pa.array(names, pa.string()), "entries": pa.array(data, pa.binary()), **{c: pa.nulls(n, pa.binary()) for c in ("ids", "sizes", "grams")}})

    def pick(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == 0)
        ids, sizes = np.frombuffer(own["ids"], "<i8"), np.frombuffer(own["sizes"], "<u4").astype(np.int64)
        all_grams = np.frombuffer(own["grams"], "<u8")
        ends = np.cumsum(sizes)
        grams, _, _, order, cuts = _cut([all_grams[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], bits)
        many = np.zeros(len(grams), np.uint8)
        for r in rows:
            if r["kind"] == 1:
                many[order[cuts[r["frag"]] : cuts[r["frag"] + 1]]] = np.frombuffer(r["entries"], np.uint8)
        out = [(np.zeros(0, np.uint64), 0, 0, np.zeros(0, np.int64), 0, 0.0)]
        for doc, n, end in zip(ids.tolist(), sizes.tolist(), ends.tolist(), strict=True):
            m, g = many[end - n : end], grams[end - n : end]
            if n and 4 * int((m == 1).sum()) <= n:
                rare = np.lexsort((g, m))[: n // 4 + 1]
                pos = np.flatnonzero(m[rare] > 1)
                out.append((g[rare[pos]], doc, n, pos, int((m > 1).sum()), float(m.mean())))
        sizes = [len(x[0]) for x in out]
        each = lambda i, kind: np.repeat(np.array([x[i] for x in out], kind), sizes)
        return pa.table({"gram": np.concatenate([x[0] for x in out]).view(np.int64), "doc_id": each(1, np.int64), "n": each(2, np.int64), "pos": np.concatenate([x[3] for x in out]).astype(np.int64), "shared": each(4, np.int64), "central": each(5, np.float64)})

    kind = "kind int, frag int, block string, entries binary, ids binary, sizes binary, grams binary"
    answers = sets.where("kind = 1").select("frag", "block", "entries").groupBy("frag").applyInArrow(counts, kind)
    own = sets.where("kind = 0").select("kind", "frag", "block", "entries", "ids", "sizes", "grams")
    return own.unionByName(answers).groupBy("block").applyInArrow(pick, "gram long, doc_id long, n long, pos long, shared long, central double")


def segments(sets: DataFrame, parts: int = PARTS) -> DataFrame:
    """The sets cut by fragment: doc_id, part, grams."""
    shift = np.uint64(64 - (parts - 1).bit_length())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes, grams = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<u4").astype(np.int64), np.frombuffer(row["grams"], "<u8")
                doc = np.repeat(np.arange(len(ids)), sizes)
                part = (grams >> shift).astype(np.int64)
                # sets are sorted, so the parts of a document follow each other
                first = np.flatnonzero(np.concatenate([[True], np.diff(doc * parts + part) != 0])) if len(grams) else np.zeros(0, np.int64)
                offsets = np.append(first, len(grams)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[first]]), pa.array(part[first].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(grams.view(np.int64)))], ["doc_id", "part", "grams"])

    return sets.where("kind = 0").select("ids", "sizes", "grams").mapInArrow(cut, "doc_id long, part int, grams array<long>")


def verified(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, na, b, nb) those that link: overlaps are counted for each part and summed for the pair."""
    left, right = (cut.select(F.col("doc_id").alias(x), "part", F.col("grams").alias(f"{x}_grams")) for x in ("a", "b"))
    both = pairs.join(right, "b").join(left, ["a", "part"])
    overlap = F.size(F.array_intersect("a_grams", "b_grams"))
    summed = both.groupBy("a", "b", "na", "nb").agg(F.sum(overlap).alias("o"))
    return summed.where(F.col("o") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _pair(x: str, y: str) -> list:
    first = F.col(f"{x}.doc_id") < F.col(f"{y}.doc_id")
    pick = lambda c: (F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")), F.when(first, F.col(f"{y}.{c}")).otherwise(F.col(f"{x}.{c}")))
    (a, b), (na, nb) = pick("doc_id"), pick("n")
    return [a.alias("a"), na.alias("na"), b.alias("b"), nb.alias("nb")]


def link_groups(postings: DataFrame, cut: DataFrame, percent: int = 75, rounds: int = 1) -> DataFrame:
    """node and label (the smallest node of its group) of the linked documents of ``postings`` that aren't their label.

    In each of ``rounds`` the documents of a list are compared with its most central one, which in a group of near copies
    is the one they were made from. The last step compares the documents of each list that are still in different groups.
    """
    labels = edges = tested = None
    share = percent / (100 + percent)

    def near(x: str, y: str):
        # sizes of linked documents differ by the threshold at most, and n-grams that no other has are no overlap
        sizes = (F.col(f"{x}.n") * 100 >= percent * F.col(f"{y}.n")) & (F.col(f"{y}.n") * 100 >= percent * F.col(f"{x}.n"))
        return sizes & (F.least(f"{x}.shared", f"{y}.shared") * (100 + percent) >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n")))

    for step in range(rounds + 1):
        p = postings.withColumn("label", F.col("doc_id"))
        if labels is not None:
            p = postings.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        first = F.col("central") if step == 0 else F.xxhash64("doc_id", F.lit(step)).cast("double")
        lead = F.max_by(F.struct("doc_id", "n", "shared", "label"), F.struct(first, -F.col("doc_id")))
        lists = p.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), lead.alias("y")).where("low < high")
        if step < rounds:
            x = p.select("gram", F.struct("doc_id", "n", "shared", "label").alias("x"))
            pairs = x.join(lists.select("gram", "y"), "gram").where((F.col("x.label") != F.col("y.label")) & near("x", "y"))
        else:
            # no partner leaves room for n-grams past these places
            early = p.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100))
            left = early.join(lists.select("gram"), "gram", "left_semi").select("gram", F.struct("doc_id", "n", "shared", "label", "pos").alias("x"))
            right = left.select("gram", F.col("x").alias("y"))
            # of an overlap of ``least`` the rarest n-gram has at most n - least before it on either side
            least = F.ceil((F.col("x.n") + F.col("y.n")) * F.lit(share) - 1e-9)
            placed = (F.col("x.pos") <= F.col("x.n") - least) & (F.col("y.pos") <= F.col("y.n") - least)
            pairs = left.join(right, "gram").where((F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.label") != F.col("y.label")) & placed & near("x", "y"))
        pairs = pairs.select(*_pair("x", "y")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        found = staged(verified(pairs, cut, percent), "links")
        edges = found if edges is None else edges.unionByName(found)
        labels = connected_components(edges)
    return labels if labels is not None else postings.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label")).limit(0)


def jaccard_groups(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of each of ``docs`` (doc_id, text).

    The bounds used for pruning hold for 75 percent or more.
    """
    if percent < 75:
        raise ValueError("percent must be at least 75")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits_of = lambda n: max(4, int(np.ceil(np.log2(max(1, n / FRAGMENT_GRAMS)))))
    facts = staged(shared_counts(docs, bits_of(size / 6.5), k), "facts")

    maybe = facts.where("n > 0 and doc_id is not null and 4 * alone <= n")
    classes = staged(maybe.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    bits = bits_of(classes.agg(F.sum("n")).first()[0] or 0)
    reps = classes.select(F.col("rep").alias("doc_id"))
    # a merge join at every size: after a broadcast join both Python nodes would run, and hold workers, in one stage
    kept = narrowed(docs, reps, "doc_id").join(reps.hint("merge"), "doc_id", "left_semi")
    sets = staged(blocks_of(kept, bits, False, k, 200_000), "sets")
    postings = staged(rare_postings(sets, bits), "postings")
    held = postings.select("doc_id").distinct()
    cut = staged(segments(sets).join(held, "doc_id", "left_semi"), "segments")
    discard(sets)
    labels = link_groups(postings, cut, percent)

    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("k1", "k2", "n", F.coalesce("label", "rep").alias("component"))
    out = facts.join(named, ["k1", "k2", "n"], "left")
    linked = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(linked, "doc_id").alias("component_id"))
