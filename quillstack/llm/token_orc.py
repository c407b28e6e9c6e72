"""Token ids in ORC files: documents in ascending order, stripes of run-length encoded integers.

Each file holds a range of documents, sorted; ORC keeps row indexes (min and max of ``doc_id`` for each stride of
rows) and a Bloom filter on ``doc_id``, so that a reader of some documents skips files, stripes and strides. Stripes
are read in parallel. ``part`` numbers the files in order, ``seq`` the rows of a file.

Defined cases: a null text is empty; an empty text has the end id alone; rows of equal ``doc_id`` follow each other in
the order of a hash of their texts; a null ``doc_id`` comes first; an empty table gives an empty table; other columns
are not read. A very long text is one row of one stripe.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches
from .tokens import encoder, with_end

SCHEMA = "doc_id long, part int, seq long, n_tokens int, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, stripe_mb: int = 16, stride: int = 1000, split_spaces: bool = True) -> None:
    """Encodes ``docs`` (doc_id, text) with the tokenizer file ``vocabulary`` and writes ORC files to ``path``."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary, split_spaces)
        for batch in batches:
            for i, j, ids, offs in enc.encode(batch.column("text")):
                ids, offs = with_end(ids, offs, end_id)
                lists = pa.ListArray.from_arrays(offs.astype(np.int32), pa.array(ids.view(np.int32)))
                n = j - i
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(np.diff(offs).astype(np.int32)), lists], ["doc_id", "part", "seq", "n_tokens", "ids"])
                seq += n

    tie = F.xxhash64("text")
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    out = ranged.select("doc_id", "text").mapInArrow(encode, SCHEMA)
    out.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", stride).option("orc.stripe.size", stripe_mb << 20).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows written, or those of ``doc_ids``: that filter reaches ORC's row indexes and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """For each document of the files: doc_id, part, seq, start (ids before it in all files), n_tokens, ids_crc32."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offs = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("seq"), pa.array(np.diff(offs).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "part", "seq", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "part", "seq", "ids").mapInArrow(sums, "doc_id long, part int, seq long, n_tokens long, ids_crc32 long")
    # one row a file
    parts = read_tokens(spark, path).groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ran = rows.withColumn("ran", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return ran.join(bases, "part").select("doc_id", "part", "seq", (F.col("base") + F.col("ran")).alias("start"), "n_tokens", "ids_crc32")
