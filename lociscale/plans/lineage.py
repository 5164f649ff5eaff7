"""Materialising intermediate results where recomputing them would grow a plan without end."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir. Only local mode
    may leave it out and gets a temporary one; on a cluster that would lose data, and raises."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _temporary()


@lru_cache(maxsize=1)
def _temporary() -> str:
    folder = tempfile.mkdtemp(prefix="lociscale-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so a lost executor costs no more
    than the tasks after it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0, in the column ``name``: ranges are sorted side by
    side, and the rows of the ranges before are added. No task sees all rows."""
    placed = cut(df.orderBy(*order).select("*", F.spark_partition_id().alias("__range"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)).alias("__place")))
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__place")).drop("__range", "__place", "__start")
