"""Substring deduplication: every byte within a string of ``length`` bytes that also starts elsewhere in the corpus.

1. Anchors. Of each window of ``length`` bytes the least hash of its k-grams is its anchor, so equal windows have equal
   anchors. Successive windows of one anchor are a run; the text from its first window's begin to its last window's end
   is the run's context. Anchors that occur once only are left out: those windows repeat nowhere.
2. Contexts that are equal, byte for byte, in two places repeat whole; of each such group one goes on.
3. Run-length index. Contexts of an anchor with several different ones are gathered by anchor into buckets. Each bucket
   gets a Burrows-Wheeler transform, kept as runs of equal characters. The lengths of the matches with the neighbours in
   suffix order are computed at run ends only (the samples) and streamed along the text: between samples a match loses
   a byte a step. These matching statistics mark the windows that start in another place too; a window has one anchor
   and stands in one context, so it is never matched with itself. An anchor with very many different contexts is cut
   further by the anchors of a second hash.
4. The marked windows of each document are merged to spans.

Every step is a join or aggregation by hash. Texts and contexts count as equal where their 64-bit hashes (of texts also
the lengths, of contexts also the anchors) are. Exact copies of a text are repeated whole.

:func:`passages_and_spans` looks for shorter strings first, from which come the passages of many words; the longer strings
of the contract lie within those passages, so only the text of passages is searched for them.

Defined cases: a null text is empty; texts shorter than ``length`` have no spans; rows of equal doc_id and different text
are different documents; rows that repeat are copies of each other; overlapping repeats within a document count; an
empty table gives an empty table; other columns are kept by :func:`removed` and not read by the rest. A very long text is
taken by one task, which needs about 70 times its bytes; so does a context, which is long where a text repeats itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, fresh_worker, mix, small_batches, staged

#: Bytes of a k-gram (a power of two), bytes of contexts aimed at for a bucket, contexts of an anchor that make it hot.
GRAM, BUCKET_BYTES, HOT = 32, 250_000, 1000
#: Parts into which the contexts of each anchor are dealt where they meet the list of hot anchors.
SALTS = 32
_RNG = np.random.Generator(np.random.PCG64(97))
_BYTES = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASES = [np.uint64(pow(int(_BASE), 1 << j, 2**64)) for j in range(12)]
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of the ``size`` bytes from each position on."""
    h, width = _BYTES[data], 1
    while width < size:
        h = h[:-width] * _BASES[width.bit_length() - 1] + h[width:]
        width *= 2
    return mix(h)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each position on."""
    done = 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if done < width else h


class Powers:
    """Powers of the polynomial's base and of its inverse, as many as were needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
        return cls.up[:n], cls.down[:n]


def anchor_runs(data: np.ndarray, offs: np.ndarray, length: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """Of concatenated rows: row, anchor, context hash, first and last window start (in the row) of each run, and whether
    its anchor occurs in the context more than once."""
    width = length - GRAM + 1
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    if len(data) < length:
        return empty
    grams = gram_hashes(data)
    if salt:
        grams = mix(grams ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    least = sliding_least(grams, width)
    ends = np.repeat(offs[1:], np.diff(offs))[: len(least)]
    whole = np.arange(len(least)) + length <= ends
    first = whole.copy()
    first[1:] &= ~(whole[:-1] & (least[1:] == least[:-1]) & (ends[1:] == ends[:-1]))
    begin = np.flatnonzero(first)
    if not len(begin):
        return empty
    # a run ends before the next one or at the last whole window of its row
    row = np.searchsorted(offs, begin, side="right") - 1
    end = np.minimum(np.append(begin[1:], len(data)) - 1, offs[row + 1] - length)
    up, down = Powers.of(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * up[:-1], dtype=np.uint64)])
    context = mix((sums[end + length] - sums[begin]) * down[begin] ^ (end - begin).astype(np.uint64))
    again = np.zeros(len(begin), bool)
    across = np.arange(width)
    for at in range(0, len(begin), 512):
        x, y = begin[at : at + 512], end[at : at + 512]
        leftmost = x + grams[x[:, None] + across].argmin(1)
        rightmost = y + width - 1 - grams[y[:, None] + across[::-1]].argmin(1)
        again[at : at + 512] = leftmost != rightmost
    return row, least[begin], context, begin - offs[row], end - offs[row], again


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of concatenated texts in order; a text ends with code 0 at ``ends``. Ties go by place.

    Prefix doubling. The keys and the place of a suffix are packed in one integer, as sorting integers is some times as
    fast as sorting their places by them; the first key holds as many codes as fit, counted by those that occur.
    """
    n = len(codes)
    bits = n.bit_length()
    low = (1 << bits) - 1
    place = np.arange(n, dtype=np.int32)
    present = np.zeros(257, bool)
    present[codes] = True
    small = (np.cumsum(present) - 1).astype(np.int64)[codes]
    each = max(1, int(present.sum() - 1).bit_length())
    width = max(1, (63 - bits) // each)
    packed = np.zeros(n, np.int64)
    for j in range(width):
        packed <<= each
        packed |= small[np.minimum(place + j, ends)]
    packed <<= bits
    packed |= place
    packed.sort()
    order = (packed & low).astype(np.int32)
    packed >>= bits
    new = np.concatenate([[True], packed[1:] != packed[:-1]])
    del packed, small
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    active = np.flatnonzero(~new | ~np.append(new[1:], True)).astype(np.int32)
    while len(active):
        own = order[active]
        more = own + width <= ends[own]  # the others are equal to their ends
        active, own = active[more], own[more]
        if not len(active):
            break
        both = (rank[own].astype(np.int64) << bits) | rank[own + width]
        if 3 * bits <= 63:
            both = (both << bits) | own
            both.sort()
            own = (both & low).astype(np.int32)
            both >>= bits
        else:
            by = np.lexsort((own, both))
            own, both = own[by], both[by]
        order[active] = own
        new = np.concatenate([[True], both[1:] != both[:-1]])
        rank[own] = np.maximum.accumulate(np.where(new, active, 0))
        active = active[~new | ~np.append(new[1:], True)]
        width *= 2
    return order


class RunLengthIndex:
    """A Burrows-Wheeler transform as runs, with the suffixes at run ends and their matches with their neighbours."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        """``data``: texts without separators; ``sizes``: their lengths."""
        tops = np.cumsum(sizes + 1)
        self.n = int(tops[-1])
        ends = np.repeat((tops - 1).astype(np.int32), sizes + 1)
        inside = np.ones(self.n, bool)
        inside[tops - 1] = False
        codes = np.zeros(self.n, np.uint16)
        codes[inside] = data.astype(np.uint16) + 1
        order = suffix_array(codes, ends)
        before = codes[order - 1]  # the transform; 0 before a text
        before[order == 0] = 0
        head = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])
        self.run_codes, self.run_begins = before[head], np.flatnonzero(head)
        at = self.run_begins[1:]
        # samples: the last suffix of a run and the first of the next, with the length of their match
        self.last, self.first = order[at - 1], order[at]
        del order, before, head
        raw = np.zeros(self.n + 8, np.uint8)
        raw[: self.n][inside] = data
        self.match = self._matches(raw, ends)

    def _matches(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        words = np.ndarray((self.n + 1,), np.uint64, raw, 0, (1,))  # eight bytes from each place
        p, q = self.first.copy(), self.last.copy()
        most = np.minimum(ends[p] - p, ends[q] - q)
        out, active = np.zeros(len(p), np.int32), np.flatnonzero(most > 0)
        while len(active):
            apart = words[p[active]] ^ words[q[active]]
            same = apart == 0
            lowest = apart & (~apart + np.uint64(1))
            out[active] += np.where(same, 8, np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int32) >> 3)
            active = active[same & (out[active] < most[active])]
            p[active] += 8
            q[active] += 8
        return np.minimum(out, most)

    def statistics(self) -> np.ndarray:
        """For each place the longest match with a suffix elsewhere: samples, less a byte for each step since."""
        place, found = np.arange(self.n, dtype=np.int32), np.zeros(self.n, np.int32)
        for side in (self.first, self.last):  # no suffix stands twice in a side
            reach = np.zeros(self.n, np.int32)
            reach[side] = self.match + side
            np.maximum(found, np.maximum.accumulate(reach) - place, out=found)
        return found


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _text_key() -> list:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return [F.xxhash64(text).alias("tk"), F.octet_length(text).alias("size")]


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for i, _, data, offs in chunks(batch.column("text")):
                row, anchor, context, begin, end, again = anchor_runs(data, offs, length)
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("tk").take(at), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(again)], ["doc_id", "tk", "h", "c", "a", "b", "again"])

    return docs.mapInArrow(scan, "doc_id long, tk long, h long, c long, a int, b int, again boolean")


def _bodies(docs: DataFrame, picked: DataFrame, length: int) -> DataFrame:
    """The contexts of ``picked`` (doc_id, tk, h, c, a, b, bucket), cut from the texts: bucket, h, c, at (the first window's
    place in the context of h and c), body. A context of a negative bucket -n is cut into those of the second hash's
    anchors, which are dealt to n more buckets by that anchor."""
    wanted = picked.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("h", "c", "a", "b", "bucket")).alias("runs"))
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["tk"] == wanted["tk"])
    schema = pa.schema([("bucket", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("at", pa.int32()), ("body", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs, out, held = batch.column("text"), batch.column("runs"), [], 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                for r in runs[i].as_py():
                    body = text[r["a"] : r["b"] + length]
                    if r["bucket"] >= 0:
                        out.append((r["bucket"], r["h"], r["c"], 0, body))
                        held += len(body)
                        continue
                    _, anchor, _, begin, end, _ = anchor_runs(np.frombuffer(body, np.uint8), np.array([0, len(body)]), length, 1)
                    for h2, x, y in zip(anchor.tolist(), begin.tolist(), end.tolist(), strict=True):
                        out.append((-1 - (h2 ^ (r["h"] & (2**64 - 1))) % -r["bucket"], r["h"], r["c"], x, body[x : y + length]))
                        held += y + length - x
                if held > BUCKET_BYTES or (out and i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0

    return docs.join(wanted, same).select("text", "runs").mapInArrow(cut, "bucket long, h long, c long, at int, body binary")


def _indexed(bodies: DataFrame, length: int) -> DataFrame:
    """h, c and the window starts, as first and last place in the context, that some other place of the bucket has too."""

    def mark(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        columns = ("h", "c", "at")
        h, c, at = (table.column(x).to_numpy() for x in columns)
        bodies = table.column("body").to_pylist()
        # equal bodies, which the second hash may give, are taken once and repeat whole
        places: dict[bytes, int] = {}
        which = np.array([places.setdefault(b, len(places)) for b in bodies], np.int64)
        sizes = np.array([len(b) for b in places], np.int64)
        far = RunLengthIndex(np.frombuffer(b"".join(places), np.uint8), sizes).statistics() >= length
        begins = np.cumsum(sizes + 1) - sizes - 1
        often = np.bincount(which) > 1
        out = []
        found = {}
        for i, w in enumerate(which.tolist()):
            if w not in found:
                windows = sizes[w] - length + 1
                found[w] = spans_of(np.ones(windows, bool) if often[w] else far[begins[w] : begins[w] + windows])
            x, y = found[w]
            if len(x):
                out.append((np.full(len(x), h[i]), np.full(len(x), c[i]), x + at[i], y + at[i]))
        cols = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({"h": cols[0], "c": cols[1], "x": cols[2].astype(np.int32), "y": cols[3].astype(np.int32)})

    return bodies.groupBy("bucket").applyInArrow(mark, "h long, c long, x int, y int")


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, tk (a hash of the text) and spans (array of begin and end, bytes, unordered, overlapping) of the documents
    of ``docs`` (doc_id, text) that hold a string of ``length`` bytes that also starts elsewhere."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), *_text_key()).where(F.col("size") >= length)
    found = staged(_runs(docs.drop("size"), length), "runs")

    spot = F.struct("tk", "a")
    shared = found.groupBy("h").agg(F.min(spot).alias("s0"), F.max(spot).alias("s1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.bool_or("again").alias("again")).where("s0 <> s1 or again")
    runs = staged(found.drop("again").join(shared.select("h", ((F.col("c0") != F.col("c1")) | F.col("again")).alias("mixed")), "h"), "shared-runs")
    discard(found)

    contexts = staged(runs.groupBy("h", "c", "mixed").agg(F.min(spot).alias("s0"), F.max(spot).alias("s1"), F.min(F.struct("doc_id", "tk", "a", "b")).alias("one")), "contexts")
    whole = contexts.where("s0 <> s1").select("h", "c", F.lit(0).alias("x"), F.lit(None).cast("int").alias("y"))

    several = contexts.where("mixed").select("h", "c", "one.*")
    size = several.agg(F.sum(F.col("b") - F.col("a") + length)).first()[0] or 0
    buckets = max(1, -(-int(size) // BUCKET_BYTES))
    salt = F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int").alias("salt")
    hot = several.groupBy("h", salt).agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.sum("n").alias("many")).where(F.col("many") > HOT)
    hot = hot.select("h", "many", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    bucket = F.when(F.col("many").isNull(), F.pmod(F.xxhash64("h"), F.lit(buckets))).otherwise(-(F.lit(buckets) + F.floor(F.col("many") / 64)))
    dealt = several.select("*", salt).join(hot, ["h", "salt"], "left").select("doc_id", "tk", "h", "c", "a", "b", bucket.cast("long").alias("bucket"))
    bodies = _bodies(docs.select("doc_id", "tk", "text"), dealt, length)
    marks = staged(_indexed(bodies, length), "marks")

    hits = runs.join(whole.unionByName(marks), ["h", "c"])
    spans = hits.select("doc_id", "tk", (F.col("a") + F.col("x")).alias("begin"), (F.coalesce(F.col("a") + F.col("y"), F.col("b")) + length).alias("end"))
    facts = docs.select("doc_id", "tk", "size")
    copied = facts.groupBy("tk", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tk", "size")
    copies = facts.join(copied, ["tk", "size"]).select("doc_id", "tk", F.lit(0).alias("begin"), F.col("size").alias("end"))
    return spans.unionByName(copies).groupBy("doc_id", "tk").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def joined_windows(spans: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Ascending ``spans`` of windows of ``length`` bytes, those whose windows start at successive bytes made one."""
    out: list[list[int]] = []
    for begin, end in spans:
        if out and begin <= out[-1][1] - length + 1:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def whole_words(text: bytes, begin: int, end: int) -> int:
    """The words of ``text`` that lie whole between ``begin`` and ``end``."""
    edges = [text[at - 1 : at + 1] for at in (begin, end) if 0 < at < len(text)]
    return len(text[begin:end].split()) - sum(not any(x in b" \t\n\r\x0b\x0c" for x in edge) for edge in edges)


def passages(text: bytes, spans: list[tuple[int, int]], length: int, words: int, size: int) -> list[tuple[int, int]]:
    """Of ascending ``spans`` of windows of ``length`` bytes, joined: those that hold more than ``words`` whole words or at
    least ``size`` bytes."""
    return [(b, e) for b, e in joined_windows(spans, length) if e - b >= size or whole_words(text, b, e) > words]


def passages_and_spans(docs: DataFrame, length: int = 400, least: int = 200, words: int = 50) -> DataFrame:
    """doc_id, tk, spans (as :func:`repeated_spans` gives them for ``length``) and passages (how many passages of more than
    ``words`` words repeat, each in windows of ``least`` bytes that all stand elsewhere too)."""
    wide = staged(repeated_spans(docs, least), "wide-spans")
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), _text_key()[0])
    other = wide.select(F.col("doc_id").alias("d"), F.col("tk").alias("k"), "spans")
    same = keyed["doc_id"].eqNullSafe(other["d"]) & (keyed["tk"] == other["k"])
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("begin", pa.int32()), ("passages", pa.int32()), ("text", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for i, (doc, key, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tk", "spans")), strict=True)):
                text = batch.column("text")[i].as_py()
                found = joined_windows(sorted((s["begin"], s["end"]) for s in spans), least)
                out.append((doc, key, -1, sum(whole_words(text, b, e) > words for b, e in found), None))
                out += [(doc, key, b, None, text[b:e]) for b, e in found if e - b >= length]
                held += sum(e - b for b, e in found)
                if held > BUCKET_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0

    parts = staged(keyed.join(other, same).select("doc_id", "tk", "text", "spans").mapInArrow(cut, "doc_id long, tk long, begin int, passages int, text binary"), "passages")
    # a piece is known by a hash of its place; two of one hash and one text would have the same spans
    place = F.xxhash64("doc_id", "tk", "begin")
    pieces = parts.where("begin >= 0").select("doc_id", "tk", "begin", place.alias("piece"), "text", _text_key()[0].alias("own"))
    exact = repeated_spans(pieces.select(F.col("piece").alias("doc_id"), "text"), length).select(F.col("doc_id").alias("piece"), F.col("tk").alias("own"), "spans")
    moved = F.transform("spans", lambda x: F.struct((x["begin"] + F.col("begin")).alias("begin"), (x["end"] + F.col("begin")).alias("end")))
    found = pieces.drop("text").join(exact, ["piece", "own"]).select("doc_id", "tk", moved.alias("spans"), F.lit(0).alias("passages"))
    counts = parts.where("begin < 0").select("doc_id", "tk", F.array().cast("array<struct<begin:int,end:int>>").alias("spans"), "passages")
    # repeated rows have the same spans and the same count
    return counts.unionByName(found).groupBy("doc_id", "tk").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.max("passages").alias("passages"))


def removed(docs: DataFrame, spans: DataFrame, keep: list[str] | None = None, chosen: Callable[[bytes, list[tuple[int, int]]], list[tuple[int, int]]] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, where none are named) with text less the bytes within ``spans`` (and less the
    bytes of characters that were cut through), and n_bytes, n_removed, n_spans and kept_sha256, all of the bytes, and the
    further columns of ``spans``. Where ``chosen`` is given, it takes a text and its ascending spans and returns those that
    count."""
    small_batches(docs.sparkSession)
    names, keep = docs.columns, docs.columns if keep is None else keep
    keyed = docs.withColumns(dict(zip(("__tk", "__size"), _text_key(), strict=True))).alias("d")
    more = [c for c in spans.columns if c not in ("doc_id", "tk", "spans")]
    other = spans.select(F.col("doc_id").alias("__doc"), F.col("tk").alias("__key"), F.col("spans").alias("__spans"), *[F.col(c).alias(f"__{c}") for c in more])
    joined = keyed.join(other, F.col("d.doc_id").eqNullSafe(F.col("__doc")) & (F.col("d.__tk") == F.col("__key")), "left").select(*[F.col(f"d.`{n}`") for n in names], "__spans", *[f"__{c}" for c in more])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            texts = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
            kept, sizes, gone, runs, digests = [], [], [], [], []
            for i, spans in enumerate(batch.column("__spans").to_pylist()):
                text, rest, at, count = texts[i].as_py() or b"", [], 0, 0
                last = -1
                found = sorted((s["begin"], s["end"]) for s in spans or ())
                for s in chosen(text, found) if chosen else found:
                    if s[0] > last:  # spans that touch are one
                        rest.append(text[at : s[0]])
                        count += 1
                    at = last = max(last, s[1])
                rest.append(text[at:])
                kept.append(b"".join(rest))
                sizes.append(len(text))
                gone.append(len(text) - len(kept[-1]))
                runs.append(count)
                digests.append(hashlib.sha256(kept[-1]).hexdigest())
            texts = pa.array([k.decode("utf-8", "ignore") for k in kept], column.type) if "text" in keep else None
            columns = [texts if n == "text" else batch.column(n) for n in keep] + [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
            columns += [batch.column(f"__{c}") for c in more]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", *more])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[n] for n in keep))
    extra = "".join(f", `{c}` {spans.schema[c].dataType.simpleString()}" for c in more)
    return joined.mapInArrow(strip, f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}")
