"""A corpus pipeline over documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkring.llm import byte_bpe, decontaminate, jaccard, language, queries, secrets, tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter go."""
    tables.bound_batches(spark)
    model = language.train(docs, ~language.held_out(5, 0))
    return language.identify(docs.select(*COLUMNS), model, keep=COLUMNS).where(F.col("lang_pred") != language.UNDETERMINED).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that links by shingles; rows without a doc_id stay.

    Rows that share a doc_id and the text are one document.  Where a doc_id has different texts, each of them is a document
    with a key of its own, so that none goes unless it links.
    """
    tables.bound_batches(spark)
    rows, digest = docs.select(*COLUMNS).where("doc_id is not null"), F.xxhash64("text")
    several = rows.groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").select(F.col("doc_id").alias("several"))
    several = tables.Workspace(spark, "distinct").put(several, "several")
    if several.isEmpty():
        keyed = rows.withColumn("key", F.col("doc_id"))
    else:
        named = rows.join(several.hint("merge"), F.col("doc_id") == F.col("several"), "left")
        keyed = named.select(*COLUMNS, F.when(F.col("several").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text")).alias("key"))
    found = jaccard.join(keyed.select(F.col("key").alias("doc_id"), "text"), size=5, percent=80)
    first = found.where(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias("key")).distinct()
    kept = keyed.join(first, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)
    return kept.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without(docs.select(*COLUMNS), tables.load(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.redact(docs.select(*COLUMNS), secrets.scan(docs, model))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the text decoded from them."""
    tables.bound_batches(spark)
    return byte_bpe.round_trip(docs, queries._tokenizer_file("byte_bpe_50k.tiktoken"), queries._pattern(), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identified),
    ("near_duplicates", distinct),
    ("decontamination", decontaminated),
    ("secrets", redacted),
    ("tokens", encoded),
]

#: SQL expresses none of the stages; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = tables.load(spark, sf_dir, "documents"), tables.Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = work.put(stage(spark, docs, sf_dir), name)
    return docs
