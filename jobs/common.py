"""What the jobs share: their configuration, and partitioned tables with a fixed schema."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def configuration(spark: SparkSession, path: str | None, job: str) -> dict:
    """The JSON file at ``path``, read by Spark; without one, the file beside the job."""
    if path is None:
        return json.loads(Path(job).with_suffix(".json").read_text())
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def columns(df: DataFrame, named: dict[str, str]) -> DataFrame:
    """``df`` in the names that a configuration gives to SQL expressions over it."""
    return df.selectExpr(*[f"{expression} AS `{name}`" for name, expression in named.items()])


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table as it was written: values of partition columns aren't guessed to be numbers."""
    return spark.read.schema(schema).parquet(path)


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return SparkSession.builder.appName(name).getOrCreate()
