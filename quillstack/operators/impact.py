"""A full-text index kept on disk in impact order: a search reads its terms' blocks only, and of those the ones that can matter.

A posting's impact is its part of BM25 before the weight of the term: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean)). Each term's
postings are sorted by impact, best first, and cut into blocks; a block carries the greatest impact in it, so it bounds what its
documents get from the term. Blocks lie in folders by a hash of the term (read by partition pruning), sorted by term within files (read
by the statistics of row groups). Document frequencies stand in the blocks, document lengths with the postings, and the facts of the
collection (documents, mean length) in a table of one row; so no search passes over the index again.

A term of very many documents is cut into strands by a hash of the document, each in impact order, so that no task holds a whole term.
"""

from __future__ import annotations

import json
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fulltext

K1, B = 1.2, 0.75


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}/blocks"


def write(docs: DataFrame, key: str, columns: list[str], path: str, block: int = 128, folders: int = 64, strand: int = 100_000, k1: float = K1, b: float = B) -> None:
    """Builds the index of ``docs`` (words of ``columns``) below ``path``.

    ``block``: postings of a block; ``folders``: parts that a search reads one of for each term; ``strand``: documents of a
    term from which it is cut.
    """
    spark = docs.sparkSession
    base = f"{path.rstrip('/')}/postings"
    # texts are dealt by document, so that words are counted and summed where they are and only postings move once more, by term
    dealt = fulltext.postings(docs.select(key, *columns).repartition(key), key, columns)
    dealt.withColumn("dl", F.sum("tf").over(Window.partitionBy("doc"))).write.mode("overwrite").parquet(base)
    index = spark.read.parquet(base)
    lengths = index.groupBy("doc").agg(F.first("dl").alias("dl"))
    facts = lengths.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("mean"))
    facts.withColumn("meta", F.lit(json.dumps({"k1": k1, "b": b, "folders": folders}))).write.mode("overwrite").parquet(f"{path.rstrip('/')}/facts")
    mean = spark.read.parquet(f"{path.rstrip('/')}/facts").first()["mean"]
    # terms of several strands have over ``strand`` documents each, so they are few; others are counted where they lie
    often = index.groupBy("term").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > strand)
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean)))
    rows = index.join(F.broadcast(often), "term", "left").withColumn("impact", impact)
    rows = rows.withColumn("strand", F.pmod(F.xxhash64("doc"), F.ceil(F.coalesce("often", F.lit(1)) / strand)))
    own = Window.partitionBy("term", "strand")
    place = F.row_number().over(own.orderBy(F.desc("impact"), "doc"))
    cut = rows.withColumn("df", F.coalesce("often", F.count(F.lit(1)).over(own))).withColumn("block", F.floor((place - 1) / block))
    # the posting is kept with its impact first, so that a block's list is in impact order
    entry = F.struct(F.negate("impact").alias("order"), "doc", "tf", "dl")
    blocks = cut.groupBy("term", "strand", "block").agg(F.max("impact").alias("bound"), F.first("df").alias("df"), F.array_sort(F.collect_list(entry)).alias("p"))
    kept = blocks.select("term", "strand", "block", "bound", "df", *[F.col(f"p.{n}").alias(f"{n}s") for n in ("doc", "tf", "dl")])
    kept = kept.withColumn("folder", F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(folders)).cast("int"))
    kept.repartition("folder", "strand").sortWithinPartitions("folder", "term", F.desc("bound")).write.mode("overwrite").partitionBy("folder").parquet(_folder(path))


def facts_of(spark: SparkSession, path: str) -> dict:
    """docs, mean, k1, b and folders of an index."""
    row = spark.read.parquet(f"{path.rstrip('/')}/facts").first()
    return {"docs": row["docs"], "mean": row["mean"]} | json.loads(row["meta"])


def blocks_of(spark: SparkSession, path: str, terms: list[str], facts: dict | None = None) -> DataFrame:
    """The blocks of ``terms``; only their folders, and row groups that may hold them, are read."""
    facts = facts or facts_of(spark, path)
    wanted = sorted(set(terms))
    own = sorted({crc32(t.encode()) % facts["folders"] for t in wanted})
    return spark.read.parquet(_folder(path)).where(F.col("folder").isin(own) & F.col("term").isin(wanted))


def _idf(docs: int, df: Column) -> Column:
    return F.log((F.lit(docs) - df + 0.5) / (df + 0.5) + 1)


def _scored(blocks: DataFrame, wanted: list[str], facts: dict, within: DataFrame | None) -> DataFrame:
    """doc and score of the documents that have all of ``wanted`` in ``blocks``; the parts are added in the order of terms."""
    k1, b = facts["k1"], facts["b"]
    lists = blocks.select("term", "df", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p"))
    tf, dl = F.col("p.tfs"), F.col("p.dls")
    part = _idf(facts["docs"], F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(facts["mean"])))
    rows = lists.select("term", F.col("p.docs").alias("doc"), part.alias("part"))
    if within is not None:
        rows = rows.join(within.select("doc"), "doc", "left_semi")
    parts = rows.groupBy("doc").agg(*[F.max(F.when(F.col("term") == t, F.col("part"))).alias(f"p{i}") for i, t in enumerate(wanted)])
    total = F.lit(0.0)
    for i in range(len(wanted)):
        total += F.col(f"p{i}")  # null where a term is missing
    return parts.select("doc", total.alias("score")).where("score is not null")


def search(spark: SparkSession, path: str, terms: list[str], most: int = 30, within: DataFrame | None = None, first_blocks: int = 8) -> DataFrame:
    """doc and score of the ``most`` best documents that have all ``terms`` (ties: the smaller doc); ``within`` (doc): of those only.

    First the best blocks of every term are read, more and more of them, until they hold ``most`` documents with all terms. The last
    of these sets the mark: a document above it gets from each term at least the mark less what the other terms can give at most.
    Blocks bounded below that can't matter, and the rest is read once. The result is that of ranking all documents.
    """
    facts, wanted = facts_of(spark, path), sorted(set(terms))
    blocks = blocks_of(spark, path, wanted, facts)
    tops = {r["term"]: r for r in blocks.groupBy("term").agg(F.max("bound").alias("bound"), F.first("df").alias("df"), F.max("block").alias("last")).collect()}
    empty = spark.createDataFrame([], f"doc {fulltext_key(blocks)}, score double")
    if not wanted or len(tops) < len(wanted):
        return empty
    idf = {r["term"]: r["idf"] for r in spark.createDataFrame([(t, tops[t]["df"]) for t in wanted], "term string, df long").select("term", _idf(facts["docs"], F.col("df")).alias("idf")).collect()}
    mark, many, last = None, first_blocks, max(r["last"] for r in tops.values())
    while mark is None and many <= last:
        best = _scored(blocks.where(F.col("block") < many), wanted, facts, within).orderBy(F.desc("score"), "doc").limit(most).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).first()
        if best["n"] == most:
            mark = best["low"]
        many *= 4
    useful = blocks.where(_can_matter(tops, idf, wanted, mark)) if mark is not None else blocks
    return _scored(useful, wanted, facts, within).orderBy(F.desc("score"), "doc").limit(most)


def _can_matter(tops: dict, idf: dict, wanted: list[str], mark: float) -> Column:
    """Whether a block of a term may hold a document of a score of ``mark`` or more; a little room for rounding."""
    test = F.lit(False)
    for t in wanted:
        others = sum(idf[u] * tops[u]["bound"] for u in wanted if u != t)
        test |= (F.col("term") == t) & (F.col("bound") >= (mark - others) / idf[t] - 1e-9)
    return test


def fulltext_key(blocks: DataFrame) -> str:
    """The type of the documents' key."""
    return blocks.schema["docs"].dataType.elementType.simpleString()
