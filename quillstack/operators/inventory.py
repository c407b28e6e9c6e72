"""File inventories: paths from parents, roll-ups, near names, differences of two drives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import container, near_name
from . import trees


def under(path, prefix: str):
    """Whether a path lies below ``prefix``, by whole segments."""
    parts = [p for p in prefix.split("/") if p]
    own = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.slice(own, 1, len(parts)) == F.array(*[F.lit(p) for p in parts]).cast("array<string>") if parts else F.lit(True)


def without(rows: DataFrame, path: str, excluded: list[str]) -> DataFrame:
    """Rows whose path holds none of the strings, whatever their case."""
    test = F.lit(False)
    for x in excluded:
        test |= F.lower(path).contains(x.lower())
    return rows.where(~test)


def folder_paths(nodes: DataFrame) -> DataFrame:
    """id, path and depth of each of ``nodes`` (id, name, parent): names from the root down; a missing parent is the root."""
    return trees.root_paths(nodes)


def roll_up(files: DataFrame, depth: int = 2) -> DataFrame:
    """bucket, files, folders, bytes and deepest of each folder down to ``depth``, with a TOTAL row, of ``files`` (path,
    size). folders: how many different folders hold the files, each counted by its whole path."""
    bucket, _ = container(F.col("path"), depth)
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    rows = files.select(bucket, F.col("size"), F.size(parts).alias("level"), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("folder"))
    # a row a folder first, so that the files of a large folder are summed where they are
    folders = rows.groupBy("bucket", "folder").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("level").alias("level"))
    out = folders.rollup("bucket").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("folders"), F.sum("bytes").alias("bytes"), F.max("level").alias("deepest"), F.grouping_id().alias("gid"))
    return out.select(F.when(F.col("gid") == 1, "TOTAL").otherwise(F.col("bucket")).alias("bucket"), "files", "folders", "bytes", "deepest")


def without_tops(files: DataFrame, excluded: list[str], path: str = "path") -> DataFrame:
    """skipped (bool) of each row: whether its first folder is one of those excluded, whatever the case."""
    top = F.lower(F.try_element_at(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(1)))
    return files.withColumn("skipped", F.coalesce(top.isin([x.lower() for x in excluded]), F.lit(False)))


def already_there(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Files of ``ours`` (path, name, size) that stand at the same path of ``theirs`` with the same name and size."""
    return ours.join(theirs.select("path", "name", "size").distinct(), ["path", "name", "size"], "left_semi")


def near_name_groups(files: DataFrame, least: int = 2) -> DataFrame:
    """near_key, members and the number of them, of files (name, path) with names that copies have."""
    keyed = files.withColumn("near_key", near_name(F.col("name")))
    return keyed.groupBy("near_key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("path")).alias("members")).where(F.col("n") >= least)


def unmatched(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Files of ``ours`` (name, size) that ``theirs`` hasn't by lower-case name and size."""
    key = lambda d: d.withColumn("match_name", F.lower("name"))
    return key(ours).join(key(theirs).select("match_name", "size"), ["match_name", "size"], "left_anti").drop("match_name")


def matched(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    key = lambda d: d.withColumn("match_name", F.lower("name"))
    return key(ours).join(key(theirs).select("match_name", "size"), ["match_name", "size"], "left_semi").drop("match_name")


def missing_folders(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """Folders to create for ``paths`` (path): every prefix that ``existing`` (folder) hasn't."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    depth = F.size("parts") - 1
    folders = paths.select(parts.alias("parts")).where(F.size("parts") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, i), "/")))).alias("folder"))
    return folders.distinct().join(existing, "folder", "left_anti")
