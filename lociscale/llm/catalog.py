"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lociscale.llm import anchors, chat, curves, divergence, forest, langid, linespread, mixing, packing, sharding, tiff, toxicity
from lociscale.llm.common import table
from lociscale.llm.sql import SQL as OPERATORS

Query = Callable[[SparkSession, str], DataFrame]

#: A conversation that says what the template's control strings say.
CONTROL = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.format_conversations(turns.unionByName(planted), with_output=False)


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8, keep=["doc_id"])


def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.store_texts(table(spark, sf_dir, "documents"))


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    graded = labels.select("doc_id", toxicity.severity(F.col("toxic"), F.col("quality")).alias("grade"))
    model = toxicity.train(docs, graded)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", "toxic", "severity", F.get("at_least", F.lit(0)).alias("p_toxic"), "grade")


def op7_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return linespread.remove_boilerplate(docs).select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"))


def op9_ngram_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.language_id(docs).select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = anchors.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_histogram_sort": op2_histogram_sort,
    "op3_hilbert_neighbours": op3_hilbert_neighbours,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_tiff_pages": op5_tiff_pages,
    "op6_ordinal_toxicity": op6_ordinal_toxicity,
    "op7_water_filling_mix": op7_water_filling_mix,
    "op8_line_spread": op8_line_spread,
    "op9_ngram_forest": op9_ngram_forest,
    "op10_language_id": op10_language_id,
    "op11_source_divergence": op11_source_divergence,
    "op12_anchor_dedup": op12_anchor_dedup,
    "pipeline": pipeline,
}

SQL: dict[str, str] = OPERATORS | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
