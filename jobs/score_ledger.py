"""Keeps a ledger of sequence scores: each run scores what is new, and nothing twice.

A stream takes the files that came since the last run. Sequences are known by a cache key (SHA-256 of the sequence
and of the model's parameters), so a sequence that was scored before, in this batch or any earlier one, isn't
scored again. The score is the log-likelihood ratio of two letter compositions, a letter: a stand-in for a language
model, of which ``scored`` is the only place that knows.

``out``/scores has a row for each key, by the batch that scored it and the side of the hash split; ``out``/items has
a row for each row read, by batch and status (scored, cached, or why it can't be scored). A batch writes
folders of its own and reads only those of earlier batches, so one that is run again after a failure
replaces what it had written. The checkpoint says which files were taken.

    python -m jobs.score_ledger --sequences PATH --out PATH --checkpoint PATH [--config FILE]
"""

from __future__ import annotations

import argparse
import logging
from functools import reduce
from operator import add

from jobs.common import columns, configuration, read, session
from lociscale.functions.columns import cache_key, discovery_side
from lociscale.operators.contracts import eligibility
from lociscale.streaming.scores import table_files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("score_ledger")

SCORES = "key string, first_id string, n_letters long, score double, batch long, side string"
FOLDERS = ("batch", "side"), ("batch", "status")


def letters(sequence: Column, letter: str) -> Column:
    return F.length(sequence) - F.length(F.translate(sequence, letter + letter.upper(), ""))


def n_letters(sequence: Column, model: dict) -> Column:
    return reduce(add, [letters(sequence, x) for x in sorted(model)]).cast("long")


def scored(rows: DataFrame, sequence: str, model: dict, digits: int) -> DataFrame:
    """``rows`` with the score of ``sequence``."""
    total = reduce(add, [letters(F.col(sequence), x) * (F.ln(F.lit(p)) - F.ln(F.lit(q))) for x, (p, q) in sorted(model.items())])
    return rows.withColumn("score", F.round(F.try_divide(total, F.col("n_letters")), digits) + F.lit(0.0))


def items(rows: DataFrame, config: dict) -> DataFrame:
    """Rows with key, number of letters and status (eligible, or why not)."""
    own = columns(rows, {"sequence": config["sequence"], **config["carry"]})
    n = n_letters(F.col("sequence"), config["model"])
    ladder = [(F.col("sequence").isNull(), "no_sequence"), (F.col("n_letters") < config["least_letters"], "too_short")]
    return own.withColumn("n_letters", n).withColumn("status", eligibility(ladder)).withColumn("key", F.when(F.col("status") == "eligible", cache_key(F.col("sequence"), config["model"])))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def earlier(spark: SparkSession, out: str, batch: int) -> DataFrame:
    """The scores of batches before ``batch``."""
    if not exists(spark, f"{out}/scores"):
        return spark.createDataFrame([], SCORES)
    return spark.read.schema(SCORES).parquet(f"{out}/scores").where(F.col("batch") < batch)


def take(out: str, config: dict):
    """Writes the scores of a batch's new keys, then its items."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        known = items(rows, config)
        before = earlier(spark, out, number).select("key")
        new = known.where("key IS NOT NULL").groupBy("key").agg(F.min(config["id"]).cast("string").alias("first_id"), F.any_value("sequence").alias("sequence"), F.any_value("n_letters").alias("n_letters"))
        new = new.join(before, "key", "left_anti")
        done = scored(new, "sequence", config["model"], config["digits"]).withColumn("side", discovery_side(F.col("key")))
        done.select("key", "first_id", "n_letters", "score", "side").write.mode("overwrite").partitionBy("side").parquet(f"{out}/scores/batch={number}")
        was = before.withColumn("was", F.lit(True))
        status = F.when(F.col("status") != "eligible", F.col("status")).when(F.col("was"), "cached").otherwise("scored")
        named = known.join(was, "key", "left").withColumn("status", status)
        named.select(*config["carry"], "n_letters", "key", "status").write.mode("overwrite").partitionBy("status").parquet(f"{out}/items/batch={number}")
        for name in ("scores", "items"):
            log.info("batch %d: wrote %d rows to %s", number, spark.read.schema("key string").parquet(f"{out}/{name}/batch={number}").count(), f"{out}/{name}")

    return batch


def run(spark: SparkSession, sequences: str, out: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Takes the files of ``sequences`` that no run before took; rows and batches of this run."""
    stream = table_files(spark, sequences, files_per_trigger=config["files_per_batch"])
    query = stream.writeStream.foreachBatch(take(out, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    batches = sorted({p["batchId"] for p in query.recentProgress if p["numInputRows"]})
    taken = spark.read.schema("key string, batch long").parquet(f"{out}/items").where(F.col("batch").isin(batches)).count() if batches else 0
    log.info("read %d new rows of %s in %d batches", taken, sequences, len(batches))
    return {"read": taken, "batches": len(batches)}


def output(spark: SparkSession, sequences: str, out: str, config: dict) -> DataFrame:
    """The ledger: each item with its score and the batches of both. Empty if nothing ever came."""
    fields = items(spark.read.parquet(sequences).limit(0), config).select(*config["carry"], "n_letters", "key", F.lit(0).cast("long").alias("batch"), "status").schema
    if not exists(spark, f"{out}/items"):
        return spark.createDataFrame([], fields).selectExpr("*", "CAST(NULL AS STRING) AS first_id", "CAST(NULL AS DOUBLE) AS score", "CAST(NULL AS STRING) AS side", "CAST(NULL AS BIGINT) AS scored_in")
    own = read(spark, f"{out}/items", fields)
    scores = spark.read.schema(SCORES).parquet(f"{out}/scores").select("key", "first_id", "score", "side", F.col("batch").alias("scored_in"))
    return own.join(scores, "key", "left")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("--sequences", "--out", "--checkpoint"):
        parser.add_argument(name, required=True)
    parser.add_argument("--config")
    given = parser.parse_args()
    spark = session("score_ledger")
    try:
        run(spark, given.sequences, given.out, given.checkpoint, configuration(spark, given.config, __file__))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
