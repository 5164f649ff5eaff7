"""A corpus pipeline of five operators: each stage takes documents and gives what the next one takes.

Every stage works on all rows of its predecessor. All but the last return the columns of ``documents``, whatever
other columns come with them. Nulls are taken in any column, repeated rows are rows, texts are read whole, and
an empty table gives an empty one; what else a stage defines is said there.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociscale.llm import forest, langid, linespread, mixing, packing
from lociscale.llm.common import delete, shared_folder, table
from lociscale.llm.sql import over

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that no language can be told of: a null or empty text, or one without a letter (all, if
    no row has a lang to learn from). A missing lang is filled in with the prediction; equal scores go to the
    commoner language. Copies all stay."""
    found = langid.language_id(docs.select(*COLUMNS)).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes cross-site boilerplate lines from the texts; every row stays, null and empty texts as they are, and
    a text of boilerplate alone whole. A null source is no site. n_chars is counted anew where lines went."""
    kept = linespread.remove_boilerplate(docs.select(*COLUMNS))
    return kept.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of linked documents: the one of the least doc_id, of repeated rows one.
    Rows without a text all stay; texts without words are one class."""
    return forest.one_of_each(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come to their target weights. Documents without words stay
    once; a null source is a source."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixed documents into bins, one row a piece. Documents without words are in none; repeated ones
    are in different ones."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("best_fit", best_fit),
]

#: The stages on one another. What the last returns doesn't have lang, so of the first only the rejections count: of
#: documents without a letter.
ORACLE_SQL = f"""
    WITH named AS (SELECT * FROM documents WHERE regexp_matches(text, '\\p{{L}}')),
    cleaned AS (SELECT l.doc_id, l.text, named.source FROM ({over("op8_line_spread", "named")}) l JOIN named USING (doc_id)),
    single AS (SELECT cleaned.* FROM cleaned JOIN ({over("op9_ngram_forest", "cleaned")}) c USING (doc_id) WHERE c.class_id = cleaned.doc_id),
    taken AS (SELECT doc_id, CASE WHEN size = 0 THEN 1 ELSE taken // size + CASE WHEN taken % size * 2 >= size THEN 1 ELSE 0 END END AS times FROM ({over("op7_water_filling_mix", "single")})),
    mixed AS (SELECT doc_id, text, source, unnest(range(times)) AS time FROM single JOIN taken USING (doc_id))
    SELECT * FROM ({over("op4_best_fit_packing", "mixed")})
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and the one
    before it is deleted."""
    docs, folder = table(spark, sf_dir, "documents"), posixpath.join(shared_folder(spark), f"corpus-pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        out = posixpath.join(folder, f"{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if i:
            delete(spark, posixpath.join(folder, f"{i - 1}-{STAGES[i - 1][0]}"))
    return docs
