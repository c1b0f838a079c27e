"""The operators applied to their whole tables, with production parameters, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, extract, lm, mixing, near, oracles, quality, secrets, spelling, tokenfile, toxicity, urls, vectors
from ._shared import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.deleted_interpolation(documents(spark, sf_dir))


def op2_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_filter(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.ngram_jaccard_join(documents(spark, sf_dir), k=3, num=90, den=100)


def op4_url_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(_table(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chat(rows))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir))
    return out.withColumn("weight", F.round("weight", 9)).withColumn("probability", F.round("probability", 9))


def op7_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compress(_table(spark, sf_dir, "embeddings"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_deleted_interpolation, op2_quality_llr, op3_ngram_jaccard_join, op4_url_propagation, op5_chat_format, op6_mix_sources, op7_secret_battery, op8_toxicity_grammar, op9_decontaminate, op10_token_files, op11_spelling_variants, op12_vector_codes, op13_html_extraction)
}
ORACLES = oracles.ORACLES
