"""Helpers shared by the training-data operators: staged tables, text chunks and vectorised hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import discard, fresh_path, shared_dir, small_batches, staged  # noqa: F401

#: Bytes of text that one round of vectorised work takes, so few that its arrays stay in a core's cache; a longer document is
#: taken alone.
CHUNK_BYTES = 1 << 17

#: What operators keep in a Python worker between tasks. Workers live on when another operator begins.
WORKER_CACHES: list[dict] = []


def fresh_worker() -> None:
    """Gives back the memory that other operators have left in this Python worker."""
    if any(WORKER_CACHES):
        for cache in WORKER_CACHES:
            cache.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can trim its heap
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def narrowed(rows: DataFrame, keys: DataFrame, key: str, bits: int = 25) -> DataFrame:
    """``rows`` less most of those whose ``key`` isn't in ``keys``; none that is there gets lost.

    A bitmap of ``2 ** bits`` places (4 MB) holds the hashes of the keys; its size is fixed, so the more keys there are,
    the more rows pass, and a join has to follow. It spares the shuffle of texts that few keys ask for.
    """
    slot = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(1 << bits))
    spots = keys.select((slot + 1).alias("n")).where(F.col(key).isNotNull())
    parts = spots.groupBy(F.bitmap_bucket_number("n").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits")).collect()
    places = np.zeros(1 << bits >> 3, np.uint8)
    for r in parts:
        at = (r["part"] - 1) * 4096
        places[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(places)
    names, extra = rows.columns, "__slot"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n = batch.column(extra).to_numpy()
            held = (known[n >> 3] >> (n & 7).astype(np.uint8)) & 1
            kept = batch.select(names).filter(pa.array(held.astype(bool)))
            if kept.num_rows:
                yield kept

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.where(F.col(key).isNotNull()).withColumn(extra, slot).mapInArrow(keep, fields)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets of its rows (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(offs[-1] - offs[0])
    buf = np.frombuffer(data, np.uint8, size, int(offs[0])) if size else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole rows of a string array, about ``limit`` bytes at a time: first row, end row, bytes, offsets."""
    yield from row_chunks(*text_buffers(texts), limit)


def row_chunks(buf: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same of concatenated rows."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1))
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Random 64-bit values by position in a word (mod 64) and byte.
_TABLE = _RNG.integers(0, 2**64, 64 * 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of the n-gram join: runs of bytes other than ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words of decontamination: runs of digits, letters and non-ASCII bytes.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_starts(low: np.ndarray, offs: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated rows: which bytes are of words, which of those begin one, and the places where words begin."""
    inside = in_word[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offs[:-1][offs[:-1] < len(low)]
    first[edges] = inside[edges]
    return inside, first, np.flatnonzero(first)


def hash_words(data: np.ndarray, offs: np.ndarray, in_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of concatenated rows (A-Z lower-cased first, unless told not to), and the word offsets of
    the rows."""
    low = _LOWER[data] if lower else data
    inside, first, starts = word_starts(low, offs, in_word)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    at = np.flatnonzero(inside)
    begins = first[at]
    pos = at - starts[np.cumsum(begins) - 1]
    parts = _TABLE[((pos & 63) << 8) | low[at]]
    if (deep := int(pos.max()) >> 6) > 0:
        powers = np.full(deep + 1, 0x9E3779B97F4A7C15, np.uint64)
        powers[0] = 1
        parts *= np.cumprod(powers, dtype=np.uint64)[pos >> 6]
    return mix(np.add.reduceat(parts, np.flatnonzero(begins))), np.searchsorted(starts, offs)


def word_ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, rows ignored: value i covers words i to i + k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0xD1342543DE82EF95)
        h += words[j : j + n]
    return mix(h)
