"""Full-text search: an inverted index as tables, all-terms matching, BM25 ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """term, doc and tf of the words (a-z, 0-9, lower case) of the columns; nulls are empty."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return docs.select(F.col(key).alias("doc"), F.explode(words).alias("term")).groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))


def lengths(index: DataFrame) -> DataFrame:
    return index.groupBy("doc").agg(F.sum("tf").alias("dl"))


def matching(index: DataFrame, terms: list[str]) -> DataFrame:
    """doc of the documents that have all terms."""
    wanted = sorted(set(terms))
    return index.where(F.col("term").isin(wanted)).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("doc")


def bm25(index: DataFrame, terms: list[str], most: int | None = 30, k1: float = 1.2, b: float = 0.75, within: DataFrame | None = None) -> DataFrame:
    """doc and score of the documents that have all terms, best first; ties by doc. ``within`` (doc): only those are ranked;
    the statistics stay those of all documents.

    One pass over the index gives each document's length and its counts of the terms; the rest works on that.
    """
    wanted = sorted(set(terms))
    tf = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(wanted)]
    docs = index.groupBy("doc").agg(F.sum("tf").alias("dl"), *tf)
    facts = docs.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("mean"), *[F.count(f"tf{i}").alias(f"df{i}") for i in range(len(wanted))])
    have = F.lit(True)
    for i in range(len(wanted)):
        have &= F.col(f"tf{i}").isNotNull()
    rows = docs.where(have)
    if within is not None:
        rows = rows.join(within.select("doc"), "doc", "left_semi")
    rows = rows.crossJoin(F.broadcast(facts))  # one row of facts
    score = F.lit(0.0)
    for i in range(len(wanted)):
        n = F.col(f"tf{i}")
        idf = F.log((F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        score += idf * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    scored = rows.select("doc", score.alias("score"))
    return scored if most is None else scored.orderBy(F.desc("score"), "doc").limit(most)


def search_text(books: DataFrame, index: DataFrame, terms: list[str], test: Column, most: int = 30, key: str = "id") -> DataFrame:
    """``books`` that have all terms and pass ``test`` (structured filters), the ``most`` best by BM25, with their score."""
    found = books.where(test)
    ranked = bm25(index, terms, most, within=found.select(F.col(key).alias("doc")))
    return found.join(ranked, found[key] == ranked["doc"]).drop("doc")


def write_index(index: DataFrame, path: str) -> None:
    """Keeps an index as a table, so that searches don't build it again: rows of a term lie together and files know their
    first and last term."""
    index.repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(path)


def like_fallback(docs: DataFrame, words: str, columns: list[str]) -> DataFrame:
    test = F.lit(False)
    for c in columns:
        test |= F.coalesce(F.col(c).ilike(f"%{words}%"), F.lit(False))
    return docs.where(test)
