"""WARC archives: one record a page, a normaliser for monolithic gzip files, and reading back by an offset index.

Pages are written as archives that are each a single gzip stream. The normaliser inflates such a file once, as a stream,
rewrites every record as a gzip member of its own and writes a sidecar index (record id, offset, length), from which any
record can be read without inflating what stands before it. Files lie in a folder that all executors share; a task
writes under a temporary name and renames, so that a task that runs again leaves one whole file.

Pages of equal payload: that of the smallest page_id is a ``response``, the others are ``revisit`` records without a
payload that name its digest and length. Defined cases: a null html is an empty payload; a null url an empty target; a
null page_id sorts first, and a revisit of such a response has a null refers_to; of rows that agree in payload and page_id
the one of the smallest url is the response, of rows that agree in all three one, the others revisit it; an empty table
writes no file; other columns are not read; a very long page is one record, which a task holds whole.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: Bytes of records after which a task begins another archive, and the step of streamed reading.
ARCHIVE_BYTES, STEP = 64 << 20, 1 << 18
_CRLF = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest_of(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, kind: str, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has the headers alone."""
    block = _HTTP + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + _CRLF * 2 + block + _CRLF * 2


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(_CRLF * 2)
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    return headers, rest[: int(headers["content-length"])]


def records_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of inflated bytes; holds one record at a time."""
    held = bytearray()
    need = 0
    for piece in pieces:
        held += piece
        while True:
            if not need:
                at = held.find(_CRLF * 2)
                if at < 0:
                    break
                low = bytes(held[:at]).lower()
                size = int(low.rpartition(b"\r\ncontent-length:")[2].split(b"\r\n")[0])
                need = at + 4 + size + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("an archive ends within a record")


def inflated(source, step: int = STEP) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, as a stream."""
    engine = zlib.decompressobj(31)
    while data := source.read(step):
        while data:
            yield engine.decompress(data)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class _Writer:
    """A file that appears under its name when it is closed."""

    def __init__(self, folder: str, name: str):
        self.store, base = _store(folder)
        self.store.create_dir(base, recursive=True)
        self.name, self.path = name, f"{base}/{name}"
        self.temp = f"{self.path}.{TaskContext.get().taskAttemptId()}.tmp"
        self.out = self.store.open_output_stream(self.temp, compression=None)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.temp, self.path)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, sha, size, revisit and refers_to of each page; html is null and refers_to set for a revisit.

    A payload moves once for each task that holds it, however many pages have it; of the pages only ids and urls move.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("sha"), F.octet_length(html).cast("long").alias("size"))
    firsts = rows.groupBy("sha", "size").agg(F.min(F.struct("page_id", "url")).alias("f"), F.first("html").alias("html"))
    responses = firsts.select("f.page_id", "f.url", "html", "sha", "size", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to"))
    named = rows.groupBy("sha", "size", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    heads = named.groupBy("sha").agg(F.min(F.struct("page_id", "url")).alias("f"), F.sum("n").alias("all")).where(F.col("all") > 1).select("sha", "f")
    again = F.col("n") - F.when(F.struct("page_id", "url").eqNullSafe(F.col("f")), 1).otherwise(0)
    others = named.join(heads, "sha").withColumn("again", again).where(F.col("again") > 0).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("again"))))
    return responses.unionByName(others.select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha", "size", F.lit(True).alias("revisit"), F.col("f.page_id").alias("refers_to")))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes monolithic archives of ``pages`` (as :func:`with_revisits` gives them) to ``folder``: name and records of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, out, engine, count, held = TaskContext.get().partitionId(), 0, None, None, 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal out
            out.write(engine.flush())
            out.close()
            done = pa.RecordBatch.from_pydict({"name": [out.name], "records": pa.array([count], pa.int64())})
            out = None
            return done

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if out is None:
                        out, engine, count, held = _Writer(folder, f"mono-{part:05d}-{serial:04d}.warc.gz"), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                        serial += 1
                    kind, digest = "revisit" if row["revisit"] else "response", base64.b32encode(bytes.fromhex(row["sha"])).decode()
                    raw = record(row["page_id"], row["url"], kind, (row["html"] or "").encode(), digest, row["size"], row["refers_to"])
                    out.write(engine.compress(raw))
                    count, held = count + 1, held + len(raw)
                    if held >= ARCHIVE_BYTES:
                        yield closed()
        if out is not None:
            yield closed()

    return staged(pages.mapInArrow(write, "name string, records long"), "archives")


def normalise(spark: SparkSession, archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites ``archives`` (name) of folder ``source`` with a gzip member a record, in ``target``, and a sidecar of each.

    Returns the names of the new files. An archive is one task's work, streamed.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(source)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                new = name.replace("mono-", "norm-", 1) if name.startswith("mono-") else f"norm-{name}"
                out, index = _Writer(target, new), []
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for raw in records_of(inflated(stream)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(raw) + engine.flush()
                        headers, _ = parsed(raw)
                        index.append((headers["warc-record-id"], out.at, len(member)))
                        out.write(member)
                out.close()
                side = _Writer(target, f"{new}.idx")
                side.write("".join(f"{a}\t{b}\t{c}\n" for a, b, c in index).encode())
                side.close()
                yield pa.RecordBatch.from_pydict({"name": [new], "records": pa.array([len(index)], pa.int64())})

    tasks = max(1, archives.count())
    spread = archives.select("name").repartition(tasks, "name")
    return staged(spread.mapInArrow(rewrite, "name string, records long"), "normalised")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of ``folder``: name, record_id, offset, length."""
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    lines = spark.read.schema("value string").option("pathGlobFilter", "*.warc.gz.idx").text(folder)
    parts = F.split("value", "\t")
    return lines.select(F.regexp_replace("_metadata.file_name", r"\.idx$", "").alias("name"), parts[0].alias("record_id"), parts[1].cast("long").alias("offset"), parts[2].cast("long").alias("length"))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Reads the records of ``index`` (name, offset, length), one seek each: page_id, url, record_type, payload (null for a
    revisit), payload_bytes, payload_digest, refers_to."""
    kind = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"

    def page(urn: str | None) -> int | None:
        text = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "None"
        return None if text == "None" else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        opened, source, schema = None, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for row in batch.slice(at, 64).to_pylist():
                    if row["name"] != opened:
                        if source:
                            source.close()
                        source, opened = store.open_input_file(f"{base}/{row['name']}"), row["name"]
                    headers, block = parsed(zlib.decompress(source.read_at(row["length"], row["offset"]), 31))
                    kind_, payload = headers["warc-type"], None
                    digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
                    if kind_ == "response":
                        payload = block.partition(_CRLF * 2)[2]
                        digest, size = digest_of(payload), len(payload)
                    rows.append({"page_id": page(headers["warc-record-id"]), "url": headers["warc-target-uri"], "record_type": kind_, "payload": payload, "payload_bytes": size, "payload_digest": digest, "refers_to": page(headers.get("warc-refers-to"))})
                schema = schema or pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
                yield pa.RecordBatch.from_pylist(rows, schema)
        if source:
            source.close()

    return index.select("name", "offset", "length").sortWithinPartitions("name", "offset").mapInArrow(read, kind)
