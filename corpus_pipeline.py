"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cablewright.llm import decontam, mixing, near, quality, tokenfile
from cablewright.llm._shared import saved

#: Near duplicates: shingles of five words, a similarity of 0.8.
SHINGLE, NUM, DEN = 5, 80, 100


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, by row: every column as it was.

    A null or empty text has too few words and goes; a null doc_id counts as unlabelled; repeated rows share their fate.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "doc_id", "text")
    return quality.quality_filter(rows, labels).filter("kept").select("own.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each near-duplicate component.

    Where ids repeat, each row has a key of its own, so that distinct texts under one id stay and of
    equal ids in a component one row does. A row without a doc_id can't be named by its component and stays.
    """
    if not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        found = near.ngram_jaccard_join(docs, SHINGLE, NUM, DEN)
        return near.without_ids(docs, found.filter("doc_id <> component_id").select("doc_id"))
    unnamed = docs.filter(F.col("doc_id").isNull())
    # Written, as keys would differ from one reading to the next.
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    keyed = saved(docs.select(own, "text", F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias("doc_id")), "keyed")
    found = near.ngram_jaccard_join(keyed.select("doc_id", "text"), SHINGLE, NUM, DEN).filter("doc_id IS NOT NULL")
    least = found.join(keyed.select("doc_id", "id"), "doc_id").groupBy("component_id").agg(F.min(F.struct("id", "doc_id")).alias("least"))
    kept = keyed.join(least.select(F.col("least.doc_id").alias("doc_id")), "doc_id", "left_semi")
    return kept.select("own.*").unionByName(unnamed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by a benchmark item, by row: a null or empty text has no word that could be and stays, as does a null doc_id."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of source, language and topic (of the docs, or fitted: see `mixing`).

    Nulls are names like others; a text without words has no weight and stays where its cell has none either. Rows of one doc_id and cell share their fate.
    """
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and where each document lies in them: a row for each row of docs. A null or empty text is the end id alone; null doc_ids come first."""
    return tokenfile.token_files(docs)


STAGES = [("quality_rules", rules), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("token_output", tokens)]
#: No SQL: hashed n-grams, the tokenizer and the files have none in DuckDB.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
