"""Keyed state inside the stream: change feeds folded in the state store, and rows that are emitted once.

The state lives in Spark's state store (RocksDB) and is committed with each micro-batch, so a restart goes on where the last committed
batch ended. It can be read back as a table from the checkpoint.

Timers and times to live run by processing time, for which Spark plans batches for as long as a query runs: such a query is run
continuously, or a batch at a time with the trigger ``once``; with ``availableNow`` it would not end.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that keyed state needs, in this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Latest(StatefulProcessor):
    """The newest change of a key; a deleted key is remembered for a while, so that late older changes don't bring it back."""

    def __init__(self, key: str, columns: list[str], kept: T.StructType, remember_ms: int):
        self.key, self.columns, self.kept, self.remember_ms = key, columns, kept, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", self.kept)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        best = max((r for r in rows if r["op"] != "root"), key=lambda r: r["seq"], default=None)
        known = self.state.get() if self.state.exists() else None
        if best is None or (known is not None and best["seq"] <= known[0]):
            return
        gone = best["op"] == "delete"
        if known is not None and known[1] and known[2]:
            self.handle.deleteTimer(known[2])
        until = timerValues.getCurrentProcessingTimeInMs() + self.remember_ms if gone else None
        self.state.update((best["seq"], gone, until, *[None if gone else best[c] for c in self.columns]))
        if gone:
            self.handle.registerTimer(until)
        yield Row(**{c: best[c] for c in (self.key, *self.columns, "seq", "op")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        known = self.state.get() if self.state.exists() else None
        if known is not None and known[1] and known[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_changes(changes: DataFrame, key: str = "id", remember_ms: int = 86_400_000) -> DataFrame:
    """The changes (key, columns, seq, op) of a stream that change its keyed state, for the output mode ``update``.

    Of a key the change of the greatest seq counts, ``delete`` removes it, and ``root`` rows are left out. A removed key is
    remembered for ``remember_ms`` of processing time; older changes that come later than that count as new.
    """
    use_rocksdb(changes.sparkSession)
    fields = {f.name: f for f in changes.schema}
    columns = [c for c in changes.columns if c not in (key, "seq", "op")]
    # state values are nullable, as those of a deleted key are empty
    kept = T.StructType([T.StructField("seq", T.LongType()), T.StructField("deleted", T.BooleanType()), T.StructField("until", T.LongType()), *[T.StructField(c, fields[c].dataType) for c in columns]])
    out = T.StructType([fields[key], *[fields[c] for c in columns], T.StructField("seq", T.LongType()), T.StructField("op", T.StringType())])
    return changes.groupBy(key).transformWithState(_Latest(key, columns, kept, remember_ms), outputStructType=out, outputMode="Update", timeMode="ProcessingTime")


def keyed_table(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """The state of :func:`keyed_changes` as of the last committed batch: key and columns of the keys that aren't deleted."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", "last").load()
    columns = [c for c in rows.schema["value"].dataType.names if c not in ("seq", "deleted", "until")]
    return rows.where("not value.deleted").select("key.*", *[f"value.{c}" for c in columns])


class _First(StatefulProcessor):
    """Lets the first row of a key through."""

    def __init__(self, order: str, keep_ms: int | None):
        self.order, self.keep_ms = order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = T.StructType([T.StructField("seen", T.BooleanType())])
        self.state = handle.getValueState("seen", kind, self.keep_ms) if self.keep_ms else handle.getValueState("seen", kind)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = min(rows, key=lambda r: r[self.order])
        if not self.state.exists():
            self.state.update((True,))
            yield first

    def close(self) -> None:
        pass


def emit_once(rows: DataFrame, keys: list[str], order: str, keep_ms: int | None = None) -> DataFrame:
    """The first row of each key of a stream (within a micro-batch the first by ``order``, which isn't null), once, over restarts too.

    With ``keep_ms`` a key is forgotten so long after its row, and its next row comes through; without, never.
    """
    use_rocksdb(rows.sparkSession)
    return rows.groupBy(*keys).transformWithState(_First(order, keep_ms), outputStructType=rows.schema, outputMode="Append", timeMode="ProcessingTime" if keep_ms else "None")
