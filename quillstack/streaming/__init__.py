"""Change feeds as streams: each micro-batch is folded into a keyed state table.

The state is a folder of versions: a delta for each batch, with the last change of each key in it, and now and then a base,
the whole state so far. The state is the newest base and the deltas after it. A batch that runs again writes its version
anew, so that a restart changes nothing; what stands before the newest base is no longer read. Lost or unusable
checkpoints are met by :func:`cold_rescan`: a fresh checkpoint and an empty state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import latest
from ..sources.paged import stream_pages
from ..staging import fresh_path


def read_changes(spark: SparkSession, path: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """A stream of the JSON change files of a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).json(path)


def version_path(state: str, version: int, base: bool) -> str:
    return f"{state}/version={version:012d}/base={str(base).lower()}"


def _versions(spark: SparkSession, state: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{schema}, op string, version long, base boolean").parquet(state)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def newest_base(spark: SparkSession, state: str, schema: str, before: int | None = None) -> int:
    """The version of the newest base (older than ``before``), -1 where there is none. What is older can be removed."""
    rows = _versions(spark, state, schema)
    if rows is None:
        return -1
    found = rows.where("base") if before is None else rows.where(F.col("base") & (F.col("version") < before))
    newest = found.agg(F.max("version")).first()[0]
    return -1 if newest is None else newest


def read_state(spark: SparkSession, state: str, schema: str, before: int | None = None, key: str = "id") -> DataFrame:
    """The state (before batch ``before``): the newest base with the later deltas applied; empty where there is none."""
    rows = _versions(spark, state, schema)
    if rows is None:
        return spark.createDataFrame([], schema)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    base = newest_base(spark, state, schema, before)
    rows = rows.where((F.col("base") & (F.col("version") == base)) | (~F.col("base") & (F.col("version") > base)))
    return latest(rows, [key], ["version"]).where("coalesce(op, '') <> 'delete'").drop("op", "version", "base")


def sync_changes(changes: DataFrame, state: str, checkpoint: str, schema: str, key: str = "id", base_every: int = 20) -> StreamingQuery:
    """Folds a stream of changes (the state's columns, seq and op) into the state, all there is at once: a delta for each
    batch, a base after each ``base_every``."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = latest(batch.where("op <> 'root'"), [key], ["seq"]).select(*columns, "op")
        last.write.mode("overwrite").parquet(version_path(state, number, False))
        if number % base_every == base_every - 1:
            whole = read_state(spark, state, schema, number + 1, key).select(*columns).withColumn("op", F.lit(None).cast("string"))
            whole.write.mode("overwrite").parquet(version_path(state, number, True))

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_pages(spark: SparkSession, path: str, state: str, checkpoint: str, schema: str, key: str = "id", base_every: int = 20) -> StreamingQuery:
    """Folds the pages of a listing (see ``sources.paged``) into the state, all complete walks that there are: records with ``deleted`` are
    deletes, those with ``root`` are left out. After a restart of the walk the state begins anew with what it gives."""
    rows = stream_pages(spark, path)
    columns = [c.strip().split()[0] for c in schema.split(",")]
    has = lambda name: F.try_variant_get(F.try_parse_json("record"), f"$.{name}", "variant").isNotNull()
    op = F.when(has("deleted"), "delete").when(has("root"), "root").otherwise("upsert")
    changes = rows.select("restart", F.from_json("record", schema).alias("r"), F.struct("page", "place").alias("seq"), op.alias("op")).select("restart", "r.*", "seq", "op")

    def fold(batch: DataFrame, number: int) -> None:
        anew = not batch.where("restart").isEmpty()
        last = latest(batch.where("op <> 'root'"), [key], ["seq"]).select(*columns, "op")
        if anew:
            last = last.where("op <> 'delete'").withColumn("op", F.lit(None).cast("string"))
        last.write.mode("overwrite").parquet(version_path(state, number, anew))
        if not anew and number % base_every == base_every - 1:
            whole = read_state(batch.sparkSession, state, schema, number + 1, key).select(*columns).withColumn("op", F.lit(None).cast("string"))
            whole.write.mode("overwrite").parquet(version_path(state, number, True))

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cold_rescan(spark: SparkSession, path: str, schema: str, key: str = "id") -> tuple[str, StreamingQuery]:
    """Reads all changes of ``path`` again into a state of its own with a checkpoint of its own: the state's folder and the
    query. For checkpoints or states that can't be used any more."""
    state = fresh_path(spark, "state")
    changes = read_changes(spark, path, f"{schema}, seq long, op string")
    return state, sync_changes(changes, state, f"{state}-checkpoint", schema, key)


def counted_events(events: DataFrame, ts: str, key: str, minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """Counts by fixed windows of event time, for batch or stream; late rows are taken until the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, f"{minutes} minutes"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("begin"), key, "n")
