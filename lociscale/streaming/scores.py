"""Structured Streaming forms of scans that take one pass: orientation, reason counts, bottom-k.

Each is the batch operator's own expression on a streaming frame; state is bounded by its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lociscale.functions.columns import frequency_class, hash_rank, orient
from lociscale.operators.contracts import eligibility

SCHEMA = "chrom string, pos long, ref string, alt string, af_alt double, score double"


def score_files(spark: SparkSession, folder: str, *, files_per_trigger: int = 100) -> DataFrame:
    """New tab-separated score files of a folder, as they come."""
    return spark.readStream.schema(SCHEMA).options(sep="\t", header=True, maxFilesPerTrigger=files_per_trigger).csv(folder)


def table_files(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder, as they come, or one file; the schema is that of what is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    given = path if folder else f"{path[:-1]}[{path[-1]}]"  # a stream takes one file only by a pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(given)


def oriented(stream: DataFrame) -> DataFrame:
    """Rows with their orientation and frequency class; stateless."""
    own = stream.withColumn("o", orient(F.col("ref"), F.col("alt"), F.col("af_alt"), F.col("score")))
    return own.select("chrom", "pos", "ref", "alt", "o.*").withColumn("frequency_class", frequency_class(F.col("maf")))


def reason_totals(stream: DataFrame, ladder: list) -> DataFrame:
    """reason, rows so far: state is one row a reason."""
    return stream.groupBy(eligibility(ladder).alias("reason")).agg(F.count("*").alias("rows"))


def keep_bottom_k(stream: DataFrame, k: int, namespace: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the k keys of least hash over all that has come, in ``path``/batch=N, the last one complete.

    Each batch merges its own k least keys with the k kept before, so the work of a batch doesn't grow. A key
    that comes again is one row; of rows that differ in other columns that of the least values stays.
    """
    key = ["chrom", "pos", "ref", "alt"]

    def least(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*key, "selection_hash")]
        once = rows.groupBy(*key, "selection_hash").agg(F.min(F.struct(*rest)).alias("rest"))  # copies of a key go before rows are cut
        return once.orderBy("selection_hash").limit(k).select(*key, "rest.*", "selection_hash")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = least(batch.withColumn("selection_hash", hash_rank(namespace, *[F.col(c) for c in key])))
        if number:
            own = least(own.unionByName(spark.read.parquet(f"{path}/batch={number - 1}")))
        own.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_totals(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps an aggregation over all that has come in ``path``, written anew by each batch."""
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    return totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
