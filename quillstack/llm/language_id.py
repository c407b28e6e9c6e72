"""Language identification with error-correcting output codes.

Each language has a binary codeword; for each bit a naive Bayes classifier over hashed byte n-grams of the lower-cased
letters says on which side a text lies. Loss-weighted decoding takes the codeword of least summed logistic loss, each
bit weighted by how well it separates its own training rows, and flags texts whose two best codewords are close.

Training takes a bounded sample of labelled rows (``train_rows``, expected size, and ``least`` rows of a rarer language,
or all it has), chosen by a hash of doc_id; its counts are summed by Spark. Prediction reads every whole text, in chunks
of bounded size; a text longer than a chunk is one chunk, which takes about 100 times its bytes in memory.

Defined cases: a null text or one without a letter (a character of the Unicode categories L*) is ``und`` with score 0 and
not ambiguous; repeated rows get a row each; with one learned language that one is always predicted; a language whose
sample has no n-gram isn't learned; with none all are ``und``; ties go to the language that sorts first; a null doc_id is
not held out; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh_worker, small_batches

BITS = 16
FEATURES = 1 << BITS
SIZES = (1, 2, 3, 4)
_SLICES = 64
#: Bytes kept as they are: lower-case ASCII letters and all of multi-byte characters; others become a space.
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def features(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """For each n-gram size the hashed feature of each byte position; FEATURES where the n-gram leaves its row or is a space."""
    b = _KEEP[data].astype(np.uint32)
    ends = np.repeat(offs[1:], np.diff(offs))
    at = np.arange(len(b))
    gram = np.zeros(len(b), np.uint32)
    blank = np.ones(len(b), bool)
    for n in range(1, max(SIZES) + 1):
        last = len(b) - n + 1
        if last <= 0:
            return
        gram = (gram[:last] << np.uint32(8)) | b[n - 1 :]
        blank = blank[:last] & (b[n - 1 :] == 32)
        if n in SIZES:
            f = ((gram ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            f[(at[:last] + n > ends[:last]) | blank] = FEATURES
            yield f


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of bits for each language: all splits in two for up to 5, else the best of 200 random dense codes."""
    if languages <= 5:
        width = max(1, 2 ** (languages - 1) - 1)
        return np.array([[1 if r == 0 else ((c + 1) >> (r - 1)) & 1 ^ 1 for c in range(width)] for r in range(languages)], np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    width = int(np.ceil(10 * np.log2(languages)))
    for _ in range(200):
        code = rng.integers(0, 2, (languages, width), dtype=np.int8)
        mixed = code[:, (code.min(0) != code.max(0))]
        gap = min(int((mixed[i] != mixed[j]).sum()) for i in range(languages) for j in range(i))
        if gap > far:
            best, far = mixed, gap
    return best


class Model:
    """Weights of the bit classifiers (n-gram features by bits), their weights in decoding, and the codewords."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        signs = self.code.astype(bool)
        weights = np.zeros((FEATURES + 1, signs.shape[1]), np.float32)
        self.alpha = np.ones(signs.shape[1])
        smooth = 0.5
        total = counts.sum(0).astype(float)
        for b in range(signs.shape[1]):
            yes, no = counts[:, signs[:, b]].sum(1) + smooth, counts[:, ~signs[:, b]].sum(1) + smooth
            w = np.log(yes / yes.sum()) - np.log(no / no.sum())
            weights[:FEATURES, b] = w
            # a bit's weight: how far apart, in nats a feature, its two sides lie
            means = [float((counts[:, r] * w).sum() / total[r]) if total[r] else 0.0 for r in range(len(languages))]
            self.alpha[b] = max(1e-3, min([abs(m) for m in means if m] or [1e-3]))
        self.alpha /= self.alpha.sum()
        self.weights = weights

    def margins(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed weights of each row by bit, and the number of its features."""
        n, width = len(offs) - 1, self.weights.shape[1]
        sums, seen = np.zeros((n, width)), np.zeros(n)
        rows = np.flatnonzero(np.diff(offs) > 0)
        if not len(rows):
            return sums, seen
        for f in features(data, offs):
            starts = offs[rows]
            ok = starts < len(f)
            sums[rows[ok]] += np.add.reduceat(self.weights[f], starts[ok], axis=0)
            seen[rows[ok]] += np.add.reduceat((f != FEATURES).astype(np.int32), starts[ok])
        return sums, seen

    def decode(self, sums: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best and second language and the score of the best, in (0, 1]."""
        # the n-grams of a text overlap, so their evidence is taken to the power 1 / 4
        z = sums / len(SIZES)
        signs = 2.0 * self.code - 1
        loss = (np.logaddexp(0, -z[:, None, :] * signs[None]) * self.alpha * z.shape[1]).sum(2)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        second = order[:, 1] if loss.shape[1] > 1 else best
        likely = np.exp(-(loss - loss.min(1, keepdims=True)))
        return best, second, likely.max(1) / likely.sum(1)


def train(docs: DataFrame, train_rows: int = 20_000, least: int = 1_000) -> Model | None:
    """A model from ``docs`` (doc_id, text, lang); rows without a text or label are left out."""
    small_batches(docs.sparkSession)
    labelled = docs.where("lang is not null and text is not null")
    by_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not by_lang:
        return None
    languages, grain = sorted(by_lang), 1_000_000
    # of each language an equal share, or what gives ``least`` rows
    share = {x: min(grain, -(-grain * max(train_rows * n // sum(by_lang.values()), least) // n)) for x, n in by_lang.items()}
    shares = F.create_map(*[F.lit(v) for pair in share.items() for v in pair])
    sample = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(grain)) < shares[F.col("lang")]).select("text", "lang")
    place = {x: i for i, x in enumerate(languages)}
    width = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        counts = np.zeros(((FEATURES + 1) * width), np.int64)
        for batch in batches:
            texts, langs = pc.utf8_lower(batch.column("text")), batch.column("lang").to_pylist()
            for i, j, data, offs in chunks(texts):
                own = np.repeat(np.array([place[x] for x in langs[i:j]], np.int64), np.diff(offs))
                for f in features(data, offs):
                    counts += np.bincount(f.astype(np.int64) * width + own[: len(f)], minlength=len(counts))
        cut = np.split(counts[: FEATURES * width].astype("<i8"), _SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES, dtype=np.int32)), pa.array([c.tobytes() for c in cut], pa.binary())], ["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
        return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "slice int, counts binary"
    parts = sample.mapInArrow(count, kind).groupBy("slice").applyInArrow(add, kind).collect()
    counts = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in sorted(parts, key=lambda r: r["slice"])])
    counts = counts.reshape(FEATURES, width)
    some = np.flatnonzero(counts.sum(0))
    return Model([languages[i] for i in some], counts[:, some]) if len(some) else None


def predict(docs: DataFrame, model: Model | None, near: float = 0.6, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """lang_pred, score, second (language) and ambiguous (score below ``near``) of each of ``docs`` (text), after the
    columns ``keep`` (doc_id, where none are named); ``prefix`` is put before the new names."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]
    names = [*keep, *(prefix + n for n in ("lang_pred", "score", "second", "ambiguous"))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        own = shared.value
        for batch in batches:
            texts = pc.utf8_lower(batch.column("text"))
            for i, j, data, offs in chunks(texts):
                some = batch.slice(i, j - i)
                lettered = np.array([any(map(str.isalpha, t or "")) for t in some.column("text").to_pylist()])
                if own is None:
                    lettered[:] = False
                    langs, seconds, score = ["und"] * (j - i), [None] * (j - i), np.zeros(j - i)
                else:
                    best, second, score = own.decode(*own.margins(data, offs))
                    langs = [own.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                    seconds = [own.languages[b] if ok else None for b, ok in zip(second.tolist(), lettered.tolist(), strict=True)]
                    score = np.where(lettered, score, 0.0)
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in keep), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(seconds, pa.string()), pa.array((score < near) & lettered)], names)

    kinds = [docs.schema[n].dataType.simpleString() for n in keep] + ["string", "double", "string", "boolean"]
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    return rows.mapInArrow(scan, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether a document is kept from training: by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, train_rows: int = 20_000) -> DataFrame:
    """Trains on the rows of ``docs`` (doc_id, text, lang) that aren't held out and predicts all."""
    model = train(docs.where(~held_out()), train_rows)
    return predict(docs, model).withColumn("held_out", held_out())
