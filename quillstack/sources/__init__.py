"""Readers and writers: JSON lines, directories, front matter, matrix sheets, nested documents, state tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .published import publish

FILE_RECORD = "id string, name string, mimeType string, parentPath string, size string, modifiedTime string, parents array<string>"


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables by name, also as temporary views."""
    out = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


def attach(spark: SparkSession, folder: str, catalog: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables of a further catalog by name, in SQL as ``catalog.name`` beside those of other catalogs. They are views, so
    queries prune and push filters down into the files, and nothing can be inserted. Names are letters, digits and ``_``."""
    quoted = lambda x: "`" + x.replace("`", "``") + "`"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(catalog)}")
    for n in names:
        spark.sql(f"CREATE OR REPLACE VIEW {quoted(catalog)}.{quoted(n)} AS SELECT * FROM parquet.{quoted(f'{folder}/{n}.parquet')}")
    return {n: spark.table(f"{quoted(catalog)}.{quoted(n)}") for n in names}


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank and malformed lines give no row."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", kind).alias("r")).where("r is not null").select("r.*")


def read_keyed_jsonl(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """JSON lines as a keyed store: of lines with one key the last wins, by file and place in it."""
    kind = T.StructType.fromDDL(schema)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", kind).alias("r"), "file", "block", "seq").where(f"r.{key} is not null")
    last = rows.groupBy(F.col(f"r.{key}").alias("k")).agg(F.max_by("r", F.struct("file", "block", "seq")).alias("r"))
    return last.select("r.*")


def list_files(spark: SparkSession, folder: str, glob: str = "*.pdf", skip: tuple[str, ...] = ("__MACOSX", "_gsdata_")) -> DataFrame:
    """path, size and modified of the files below a folder; hidden twins (``._*``) and skipped folders are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    parts = F.split("path", "/")
    ok = ~F.exists(parts, lambda p: p.isin(*skip)) & ~F.element_at(parts, -1).startswith("._")
    return found.where(ok).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_front_matter(spark: SparkSession, path: str) -> DataFrame:
    """path, fields (a map of the ``key: value`` lines between the ``---`` lines), lists (a map of the keys whose value is a
    list, on their line in brackets or below it with hyphens) and body of Markdown files."""
    whole = read_whole(spark, path)
    head = F.regexp_extract("text", r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    body = F.regexp_replace("text", r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", "")
    bare = lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")
    # a key with the lines that follow it and aren't keys themselves
    blocks = F.regexp_extract_all(head, F.lit(r"(?m)^[\w-]+\s*:.*(?:\n(?![\w-]+\s*:).*)*"), 0)
    key = lambda x: F.trim(F.regexp_extract(x, r"^([\w-]+)\s*:", 1))
    inline = lambda x: F.trim(F.regexp_extract(x, r"^[\w-]+\s*:(.*)", 1))
    items = lambda x: F.when(inline(x).rlike(r"^\[.*\]$"), F.filter(F.transform(F.split(F.regexp_replace(inline(x), r"^\[|\]$", ""), ","), bare), lambda i: i != "")).otherwise(F.transform(F.regexp_extract_all(x, F.lit(r"(?m)^\s*-\s+(.*)$"), 1), bare))
    is_list = lambda x: inline(x).rlike(r"^\[.*\]$") | ((inline(x) == "") & x.rlike(r"(?m)^\s*-\s+"))
    fields = F.map_from_entries(F.transform(F.filter("blocks", lambda x: ~is_list(x)), lambda x: F.struct(key(x).alias("key"), bare(inline(x)).alias("value"))))
    lists = F.map_from_entries(F.transform(F.filter("blocks", is_list), lambda x: F.struct(key(x).alias("key"), items(x).alias("value"))))
    return whole.select("path", F.array_distinct(blocks).alias("blocks"), body.alias("body")).select("path", fields.alias("fields"), lists.alias("lists"), "body")


def read_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of a tree ``eval-*/config/run-*/grading.json``: eval, config, run, pass_rate, passed, failed, total,
    time_seconds, tokens, tool_calls and errors. The time is that of the grading, else of ``timing.json`` beside it, as are
    the tokens; the eval's id that of ``eval_metadata.json``, else of its folder. Files that aren't JSON give no row."""

    def files(name: str) -> DataFrame:
        found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(folder, wholetext=True)
        return found.select(F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]+$", "").alias("at"), F.col("value").alias("json"))

    number = lambda c, field, kind="double": F.get_json_object(c, f"$.{field}").try_cast(kind)
    place = r"eval-([^/]+)/([^/]+)/run-(\d+)$"
    graded = files("grading.json").where(F.try_parse_json("json").isNotNull() & F.col("at").rlike(place))
    timing = files("timing.json").select("at", number("json", "total_duration_seconds").alias("seconds"), number("json", "total_tokens", "long").alias("counted"))
    named = files("eval_metadata.json").select(F.col("at").alias("eval_at"), F.get_json_object("json", "$.eval_id").alias("named"))
    rows = graded.withColumn("eval_at", F.regexp_replace("at", r"/[^/]+/run-\d+$", "")).join(timing, "at", "left").join(named, "eval_at", "left")
    own = F.coalesce(number("json", "timing.total_duration_seconds"), F.lit(0.0))
    untimed = own == 0
    some = lambda c: F.coalesce(c, F.lit(0))
    counted = F.when(untimed, F.nullif(F.col("counted"), F.lit(0)))
    return rows.select(
        F.coalesce("named", F.regexp_extract("at", place, 1)).alias("eval"), F.regexp_extract("at", place, 2).alias("config"), F.regexp_extract("at", place, 3).cast("int").alias("run"),
        F.coalesce(number("json", "summary.pass_rate"), F.lit(0.0)).alias("pass_rate"), *[some(number("json", f"summary.{f}", "long")).alias(f) for f in ("passed", "failed", "total")],
        F.when(untimed, F.coalesce("seconds", F.lit(0.0))).otherwise(own).alias("time_seconds"), some(F.coalesce(counted, number("json", "execution_metrics.output_chars", "long"))).alias("tokens"),
        some(number("json", "execution_metrics.total_tool_calls", "long")).alias("tool_calls"), some(number("json", "execution_metrics.errors_encountered", "long")).alias("errors"),
    )


def read_sheet(spark: SparkSession, path: str, sheet: str, header_rows: int = 3) -> DataFrame:
    """A matrix sheet as rows: ord, label and a column for each cell column, named by its joined headers.

    Needs ``openpyxl``; a sheet is a small hand-written table, so it is read on the driver.
    """
    try:
        from openpyxl import load_workbook
    except ImportError as e:
        raise ImportError("read_sheet needs openpyxl") from e
    rows = [list(r) for r in load_workbook(path, read_only=True, data_only=True)[sheet].iter_rows(values_only=True)]
    heads = rows[1 : 1 + header_rows]
    filled = []
    for h in heads:
        now, line = None, []
        for x in h[1:]:
            now = x if x is not None else now
            line.append("" if now is None else str(now))
        filled.append(line)
    names = ["|".join(x) for x in zip(*filled, strict=False)]
    data = [(i, str(r[0]), *[None if x is None else str(x) for x in r[1 : 1 + len(names)]]) for i, r in enumerate(rows[1 + header_rows :]) if r and r[0] is not None]
    kind = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("label", T.StringType()), *[T.StructField(n, T.StringType()) for n in names]])
    return spark.createDataFrame(data, kind)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Event lines as variants, with session and kind (main or subagent) by their path and seq by their place."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("seq"))
    name = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    kind = F.when(F.col("path").contains("/subagents/"), "subagent").otherwise("main")
    event = F.try_parse_json("value")
    return lines.where(F.trim("value") != "").select("path", "seq", name.alias("session"), kind.alias("kind"), event.alias("event")).where("event is not null")


def grouped_listing(files: DataFrame, pattern: str) -> DataFrame:
    """stem and the numbers, in numeric order, of the files whose name matches ``pattern`` (groups: stem, number)."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.regexp_extract(name, pattern, 1).alias("stem"), F.regexp_extract(name, pattern, 2).try_cast("long").alias("number")).where("stem <> '' and number is not null")
    return rows.groupBy("stem").agg(F.array_sort(F.collect_set("number")).alias("numbers"))


def split_lines(text: str, limit: int) -> Iterator[str]:
    """Pieces of at most ``limit`` characters, cut at a blank line, else a line end, else a space, else anywhere."""
    while len(text) > limit:
        at = next((x for x in (text.rfind(s, 1, limit + 1) for s in ("\n\n", "\n", " ")) if x > 0), limit)
        yield text[:at]
        text = text[at:].lstrip()
    if text:
        yield text


def chunked(docs: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """key, piece and part of each text, cut greedily under ``limit`` characters."""
    kind = f"{key} {docs.schema[key].dataType.simpleString()}, piece int, part string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, p) for k, t in zip(pdf[key], pdf[text], strict=True) if t for i, p in enumerate(split_lines(t, limit))]
            yield pd.DataFrame(rows, columns=[key, "piece", "part"])

    return docs.select(key, text).mapInPandas(run, kind)


def salvage_json(text: str | None) -> str | None:
    """A JSON array or object from text that may stand in a code fence or break off; what is incomplete is dropped.

    One pass finds the closed values; the longest part that ends with one and parses, with what is open closed, is taken.
    """
    import json

    if not text:
        return None
    body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text)
    depth: list[str] = []
    ends: list[tuple[int, str]] = []
    quoted = escaped = False
    for i, c in enumerate(body):
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth.append("]" if c == "[" else "}")
        elif c in "]}" and depth:
            depth.pop()
            ends.append((i + 1, "".join(reversed(depth))))
    for end, close in [(len(body), ""), *reversed(ends)]:
        try:
            json.loads(fixed := body[:end] + close)
        except ValueError:
            continue
        return fixed
    return None


def salvaged(text: str):
    """:func:`salvage_json` of a column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(salvage_json)

    return run(text)


def write_replace(df: DataFrame, path: str) -> None:
    """A full refresh, read by ``published.read_published``: the new version is written aside and then published, so a reader sees the old
    one or the new one, also where a writer fails midway. ``df`` may read the old one."""
    publish(df, path)


def write_split(df: DataFrame, error: str, good: str, bad: str) -> None:
    """Rows without an error are appended to ``good``, the others, as dead letters, to ``bad``."""
    df.where(F.col(error).isNull()).drop(error).write.mode("append").parquet(good)
    df.where(F.col(error).isNotNull()).write.mode("append").parquet(bad)


def write_snapshot(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_pages(df: DataFrame, key: str, title: str, lines: str, path: str) -> None:
    """A Markdown text for each row, in a folder for each key."""
    page = F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))
    df.select(page.alias("value"), key).write.mode("overwrite").partitionBy(key).text(path)


def import_once(target: DataFrame, legacy: DataFrame, path: str) -> bool:
    """Appends ``legacy`` only where ``target`` has no row; whether it did."""
    if not target.isEmpty():
        return False
    legacy.write.mode("append").parquet(path)
    return True


def first_rows(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("nth") <= most).drop("nth")
