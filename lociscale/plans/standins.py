"""Genome-shaped views of the driver's tables, on which the catalogue runs its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as scored variants: tenths of a frequency from the discount, ties at one half included."""
    k = F.round(F.col("l_discount") * 100).cast("int")
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    ref = (F.col("l_partkey") % 4).cast("int")
    alt = ((F.col("l_partkey") % 4 + 1 + F.col("l_suppkey") % 3) % 4).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("site"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("chrom"), F.col("l_linestatus").alias("status"),
        F.get(bases, ref).alias("ref"), F.get(bases, alt).alias("alt"), (k / 10).alias("af_alt"), (F.col("l_extendedprice") - 53000).alias("score"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"),
    )


VARIANTS_SQL = """
    SELECT l_orderkey AS site, l_linenumber AS line, l_returnflag AS chrom, l_linestatus AS status,
        substr('ACGT', CAST(l_partkey % 4 AS INTEGER) + 1, 1) AS ref, substr('ACGT', CAST((l_partkey % 4 + 1 + l_suppkey % 3) % 4 AS INTEGER) + 1, 1) AS alt,
        CAST(round(l_discount * 100) AS INTEGER) / 10.0::DOUBLE AS af_alt, l_extendedprice - 53000 AS score, l_quantity AS quantity, l_extendedprice AS price, l_tax AS tax
    FROM lineitem
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidate variants of ten loci, with missing values where real tables have them."""
    s = F.col("s_suppkey")
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.avg("l_extendedprice"), 4).alias("price"), F.round(F.avg("l_quantity"), 4).alias("quantity"))
    pick = lambda n, x: F.when(s % n != 0, x)
    return table(spark, sf_dir, "supplier").join(own, "s_suppkey").select(
        F.concat(F.lit("G"), (F.col("s_nationkey") % 10).cast("string")).alias("gene"), (F.col("s_nationkey") % 10 % 4).cast("long").alias("block"), F.col("s_name").alias("variant_id"),
        (F.col("price") / 1000).alias("discovery_neglogp"), pick(7, (s % 10) / 10).alias("ld_r2_lead"), (F.col("s_acctbal") - 5000).alias("tss_distance"), pick(5, F.col("s_acctbal") / 1000 - 5).alias("phylop"),
        F.get(F.array(F.lit("CDS"), F.lit("exon_nonCDS"), F.lit("genic"), F.lit("intergenic")), (s % 4).cast("int")).alias("context"),
        ((s * 37 % 101 + 1) / 1000).alias("heldout_p"), pick(11, F.col("quantity") - 25).alias("model_a"), pick(13, F.col("s_acctbal") / 100 - F.col("quantity") * 2).alias("model_b"),
    )


CANDIDATES_SQL = """
    SELECT 'G' || CAST(s_nationkey % 10 AS VARCHAR) AS gene, CAST(s_nationkey % 10 % 4 AS BIGINT) AS block, s_name AS variant_id,
        price / 1000 AS discovery_neglogp, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 10) / 10.0::DOUBLE END AS ld_r2_lead, s_acctbal - 5000 AS tss_distance,
        CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 1000 - 5 END AS phylop,
        CASE s_suppkey % 4 WHEN 0 THEN 'CDS' WHEN 1 THEN 'exon_nonCDS' WHEN 2 THEN 'genic' ELSE 'intergenic' END AS context,
        (s_suppkey * 37 % 101 + 1) / 1000.0::DOUBLE AS heldout_p, CASE WHEN s_suppkey % 11 <> 0 THEN quantity - 25 END AS model_a,
        CASE WHEN s_suppkey % 13 <> 0 THEN s_acctbal / 100 - quantity * 2 END AS model_b
    FROM supplier JOIN (SELECT l_suppkey AS s_suppkey, round(avg(l_extendedprice), 4) AS price, round(avg(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1) USING (s_suppkey)
"""


def compared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two tables of suppliers: values missing in either, keys of one only, and a null key."""
    li, s = table(spark, sf, "lineitem"), F.col("l_suppkey")
    own = lambda d, n: d.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("t")).select(F.nullif(s, F.lit(4)).alias("k"), F.when(s % n != 0, F.col("q")).alias("q"), "t")
    return own(li.where(s % 11 != 0), 7), own(li.where((F.col("l_linenumber") > 1) & (s % 13 != 0)), 5)


COMPARED_SQL = """
    a AS (SELECT nullif(l_suppkey, 4) AS k, CASE WHEN l_suppkey % 7 <> 0 THEN avg(l_quantity) END AS q, avg(l_tax) AS t FROM lineitem WHERE l_suppkey % 11 <> 0 GROUP BY l_suppkey),
    b AS (SELECT nullif(l_suppkey, 4) AS k, CASE WHEN l_suppkey % 5 <> 0 THEN avg(l_quantity) END AS q, avg(l_tax) AS t FROM lineitem WHERE l_linenumber > 1 AND l_suppkey % 13 <> 0 GROUP BY l_suppkey),
    long AS (
        SELECT coalesce(a.k, b.k) AS k, unnest(['q', 't']) AS "column", unnest([a.q, a.t]) AS x, unnest([b.q, b.t]) AS y, a.t IS NULL OR b.t IS NULL AS alone FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k
    ), judged AS (
        SELECT k, "column", abs(x - y) AS difference, CASE WHEN alone THEN 'missing_key' WHEN x IS NULL AND y IS NULL THEN NULL WHEN x IS NULL OR y IS NULL THEN 'missing_value' WHEN abs(x - y) > 0.2 + 1e-6 * abs(y) THEN 'difference' END AS why FROM long
    )"""
