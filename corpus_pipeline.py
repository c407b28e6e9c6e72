"""From documents to training sequences: language, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What a
stage keeps is written as Parquet and read again by the next one.

Defined cases: a null or empty text has no language and goes in the first stage; where a stage meets one it stays (it is
linked with nothing, holds no passage, and is packed as its end id). Rows that repeat are one document after the second
stage; for rows of one doc_id and different texts, and for those without an id, see there. A text of which the third
stage leaves only white space goes. An empty table gives an empty table. Further columns of documents, whatever their
names, come through to the last stage, which doesn't read them; nulls in them stay.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import fresh_path
from quillstack.llm.decontaminate import find_hits
from quillstack.llm.language_id import held_out, predict, train
from quillstack.llm.ngram_join import jaccard_groups
from quillstack.llm.packing import pack_documents
from quillstack.llm.queries import table, word_vocabulary
from quillstack.llm.suffix_dedup import passages, removed, repeated_spans

#: A repeated passage has more than PASSAGE_WORDS words and PASSAGE_BYTES at least, which 51 words of prose have, or LONG_BYTES,
#: however few its words are.
PASSAGE_WORDS, PASSAGE_BYTES, LONG_BYTES = 50, 200, 400


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter and those between two languages go."""
    model = train(docs.where(~held_out()))
    seen = predict(docs, model, keep=docs.columns, prefix="__")
    return seen.where((F.col("__lang_pred") != "und") & ~F.col("__ambiguous")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group that the n-gram join links, once.

    Rows without an id stay, as do rows of one id and different texts, which no link can tell apart; of rows that agree in
    id and text one stays.
    """
    text = F.struct(F.xxhash64("text"), F.octet_length("text"))
    several = docs.groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low <> high")
    others = jaccard_groups(docs).where("component_id <> doc_id").select("doc_id").distinct().join(several, "doc_id", "left_anti")
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    named = kept.where("doc_id is not null").withColumn("__text", text).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return named.unionByName(kept.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that occur elsewhere too; those of which nothing is left go."""
    chosen = partial(passages, length=PASSAGE_BYTES, words=PASSAGE_WORDS, size=LONG_BYTES)
    cut = removed(docs, repeated_spans(docs, PASSAGE_BYTES), chosen=chosen)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"\S")
    text = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cut.where(left).withColumns(text).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    hits = find_hits(docs.withColumnsRenamed({c: f"d_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}), table(spark, sf_dir, "benchmark"), keep=[c if c in ("doc_id", "text") else f"d_{i}" for i, c in enumerate(docs.columns)])
    clean = hits.where(F.size("items") == 0)
    return clean.select(*[F.col(c if c in ("doc_id", "text") else f"d_{i}").alias(c) for i, c in enumerate(docs.columns)])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of at most 2048 tokens."""
    return pack_documents(docs, word_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: Tokenising and byte-level repeats can't be put in SQL; tests compare with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
