"""Tables that are replaced whole: written aside, then published by one file.

``path/data/<version>`` holds a version, ``path/_commits/<number>-<version>`` says that it is there. The name of that file is all it holds,
so it appears complete or not at all; a reader takes the version of the greatest name. A writer that fails on its way leaves a version
that no reader sees, and the one before it stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[str]:
    """The names of the versions that have been published, the oldest first."""
    where, files = _place(spark, f"{path}/_commits")
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def publish(df: DataFrame, path: str, keep: int = 2) -> str:
    """Replaces the table at ``path`` by ``df``, which may read it; the version's name. The last ``keep`` versions stay for those who
    are reading them."""
    spark, path, version = df.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{version}")
    known = commits(spark, path)
    number = int(known[-1].partition("-")[0]) + 1 if known else 0
    where, files = _place(spark, f"{path}/_commits/{number:012d}-{version}")
    files.create(where, True).close()
    for old in known[: len(known) + 1 - keep]:
        # the file goes first, so that none names a version that isn't there
        for name in (f"_commits/{old}", f"data/{old.partition('-')[2]}"):
            where, files = _place(spark, f"{path}/{name}")
            files.delete(where, True)
    return version


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table as it was published last."""
    path = path.rstrip("/")
    known = commits(spark, path)
    if not known:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/data/{known[-1].partition('-')[2]}")
