"""Edit logs: what pushes, undos, redos and jumps make of each document's versions.

A log holds at most ``most`` entries and a position. A push drops what lies after the position (the branch that was undone), appends its
snapshot and goes there; where the log gets too long its oldest entry goes. An undo gives the entry at the position and steps back, a
redo steps on and gives the entry there, a jump goes to a place. Requests that can't be met change nothing.

Rows are walked in order once, with no more than a log in memory, however many a document has. Entries become validity intervals, from
the push that made one to the push that removed it, so any moment can be looked up later without a replay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a log at most.
MOST = 200
_KIND = "kind int, doc {doc}, seq long, action string, ok boolean, position int, total int, entry long, until long"


class _Log:
    def __init__(self, doc, most: int):
        self.doc, self.most, self.position = doc, most, -1
        self.entries: list[tuple[int, int]] = []  # seq of the push

    def apply(self, seq: int, action: str, place: int | None) -> Iterator[tuple]:
        """The row of an event, and before it the intervals that it ends."""
        ok, entry, total = True, None, len(self.entries)
        if action == "push":
            gone, self.entries = self.entries[self.position + 1 :], [*self.entries[: self.position + 1], seq]
            over = max(0, len(self.entries) - self.most)
            gone, self.entries = [*gone, *self.entries[:over]], self.entries[over:]
            self.position, entry = len(self.entries) - 1, seq
            for old in gone:
                yield 1, self.doc, old, None, None, None, None, old, seq
        elif action == "undo" and self.position >= 0:
            entry = self.entries[self.position]
            self.position -= 1
        elif action == "redo" and self.position + 1 < total:
            self.position += 1
            entry = self.entries[self.position]
        elif action == "jump" and place is not None and 0 <= place < total:
            self.position = place
            entry = self.entries[place]
        else:
            ok = False
        yield 0, self.doc, seq, action, ok, self.position, len(self.entries), entry, None

    def rest(self) -> Iterator[tuple]:
        for old in self.entries:
            yield 1, self.doc, old, None, None, None, None, old, None


def _walked(events: DataFrame, most: int, doc: str, seq: str, action: str, place: str) -> DataFrame:
    kind = _KIND.format(doc=events.schema[doc].dataType.simpleString())
    rows = events.select(F.col(doc).alias("doc"), F.col(seq).cast("long").alias("seq"), F.col(action).alias("action"), F.col(place).cast("int").alias("place"))
    fields = [pa.int32(), None, pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, types = None, list(fields)

        def put(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            types[1] = batch.schema.field("doc").type
            out: list[tuple] = []
            for d, s, a, p in zip(*(batch.column(c).to_pylist() for c in ("doc", "seq", "action", "place")), strict=True):
                if log is None or d != log.doc:
                    out += log.rest() if log else ()
                    log = _Log(d, most)
                out += log.apply(s, a, p)
            if out:
                yield put(out)
        if log and log.entries:
            yield put(list(log.rest()))

    return rows.repartition("doc").sortWithinPartitions("doc", "seq").mapInArrow(run, kind)


def replayed(events: DataFrame, most: int = MOST, doc: str = "doc_id", seq: str = "seq", action: str = "action", place: str = "place") -> DataFrame:
    """doc, seq, action, ok, position, total and entry (the push whose snapshot it gives) after each event."""
    return _walked(events, most, doc, seq, action, place).where("kind = 0").select(F.col("doc").alias(doc), F.col("seq").alias(seq), F.col("action").alias(action), "ok", "position", "total", "entry")


def intervals(events: DataFrame, most: int = MOST, doc: str = "doc_id", seq: str = "seq", action: str = "action", place: str = "place") -> DataFrame:
    """doc, entry, since and until (null: still there) of the entries of each log."""
    return _walked(events, most, doc, seq, action, place).where("kind = 1").select(F.col("doc").alias(doc), "entry", F.col("seq").alias("since"), "until")


def as_of(spans: DataFrame, states: DataFrame, moments: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """For each of ``moments`` (doc, at): position and entries, oldest first, of the log as it was after the last event up to then."""
    asked = moments.select(F.col(doc).alias("__doc"), "at").distinct()
    last = states.join(asked, states[doc].eqNullSafe(asked["__doc"]) & (states[seq] <= asked["at"])).groupBy("__doc", "at").agg(F.max_by("position", seq).alias("position"))
    own = spans.join(asked, spans[doc].eqNullSafe(asked["__doc"]) & (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("until") > F.col("at"))))
    held = own.groupBy("__doc", "at").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    found = last.join(held.withColumnsRenamed({"__doc": "__d", "at": "__at"}), F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("at") == F.col("__at")), "left")
    return found.select(F.col("__doc").alias(doc), "at", "position", F.coalesce("entries", F.array().cast("array<bigint>")).alias("entries"))
