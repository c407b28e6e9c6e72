"""Change feeds: compaction of upserts and deletes, states of an at-least-once worker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import latest

#: States after which an item isn't tried again.
TERMINAL = ("uploaded", "skipped_existing")


def compact(changes: DataFrame, key: str = "id", seq: str = "seq", op: str = "op") -> DataFrame:
    """The state after ``changes``: the last change of each key, less deletes; changes of the root are left out."""
    return latest(changes.where(F.col(op) != "root"), [key], [seq]).where(F.col(op) != "delete")


def apply_changes(state: DataFrame, changes: DataFrame, key: str = "id", seq: str = "seq", op: str = "op") -> DataFrame:
    """``state`` with ``changes`` applied; keys that don't change are kept as they are."""
    last = latest(changes.where(F.col(op) != "root"), [key], [seq])
    kept = state.join(last, key, "left_anti")
    return kept.unionByName(last.where(F.col(op) != "delete").select(*state.columns))


def pending(items: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Items whose last logged action (id, seq, action) isn't terminal, or that have none."""
    done = latest(log, [key], ["seq"]).where(F.col("action").isin(*TERMINAL)).select(key)
    return items.join(done, key, "left_anti")


def worker_totals(log: DataFrame, key: str = "id") -> DataFrame:
    last = latest(log, [key], ["seq"])
    return last.agg(*[F.count_if(F.col("action") == a).alias(a) for a in (*TERMINAL, "failed")], F.count(F.lit(1)).alias("total"))
