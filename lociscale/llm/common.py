"""What the operators of this subpackage share: table access, lineage cuts and streamed groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociscale.plans.lineage import cut, numbered, shared_folder

__all__ = ["aside", "cut", "delete", "fresh", "hash60", "numbered", "replaced", "shared_folder", "small_batches", "spread", "stored", "streamed_groups", "table", "uniform", "words"]

#: Words are runs of anything but space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: for wide rows of which later passes read few
    columns. It stays until the folder is cleaned."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/lociscale-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """A written table that nothing reads any more goes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what one Arrow batch of whole texts holds; long texts make the default too large."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def spread(df: DataFrame, mb_per_core: int = 8) -> DataFrame:
    """``df``, dealt evenly to all cores if it is under ``mb_per_core`` a core as Spark estimates it: a small
    file is one split however costly its rows are. Larger inputs have splits enough and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * mb_per_core << 20 else df


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` at its end, in place of any that have those names already."""
    taken = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return [next(c for c in (f"__{'_' * i}{name}" for i in range(len(taken) + 1)) if c.lower() not in taken) for name in names]


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """``df`` with columns that begin with two underscores, which operators take for their own, under other names; what
    ``names`` are called there; and what gives a result the old names again."""
    taken, own = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.startswith("__"):
            own[c] = next(x for x in (f"own{'_' * i}{c}" for i in range(len(taken) + 1)) if x.lower() not in taken)
            taken.add(own[c].lower())
    lower = {k.lower(): v for k, v in own.items()}
    back = {v: k for k, v in own.items()}
    return df.withColumnsRenamed(own), [lower.get(n.lower(), n) for n in names], lambda out: out.withColumnsRenamed(back)


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(value: Column) -> Column:
    """The first 60 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def uniform(*columns: Column, seed: int = 0) -> Column:
    """A number in [0, 2**40) from a hash of ``columns``, the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40))


def streamed_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal ``keys`` from batches sorted by them, at most ``most`` rows at a time.

    A run that is longer comes in several parts, so no group has to fit into memory.
    """
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    count = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        while start < n:
            if rows[start] != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                held, key, count = [], rows[start], 0
            end = start
            while end < n and end - start + count < most and rows[end] == key:
                end += 1
            if end > start:
                held.append(batch.slice(start, end - start))
                count += end - start
            if count >= most:
                yield key, pa.Table.from_batches(held)
                held, count = [], 0
            start = end
    if held:
        yield key, pa.Table.from_batches(held)
