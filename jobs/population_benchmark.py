"""Builds a population-aware benchmark of variant scores: what may be used, oriented, and what it says by class.

``out``/variants has every variant, in folders by reason (eligible, or the first that keeps it out), chromosome and
frequency class; the eligible ones with their score turned to the minor allele and the side of the hash split that they
are on. ``out``/summary has, by chromosome, a row for each frequency class of eligible variants, and the rank correlation
of frequency and score over the chromosome. Each table is replaced as a whole, so a run after a failed one, or a second
one, gives the same.

    python -m jobs.population_benchmark --variants PATH --out PATH [--config FILE]
"""

from __future__ import annotations

import argparse
import logging

from jobs.common import columns, configuration, read, session
from lociscale.functions.columns import discovery_side, finite, frequency_class, orient, substitution_class
from lociscale.operators.contracts import BASE, VARIANT, eligibility
from lociscale.operators.ranks import medians
from lociscale.operators.stats import correlations
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

log = logging.getLogger("population_benchmark")

GROUP = ["chrom", "frequency_class"]


def ladder() -> list[tuple[Column, str]]:
    """Why a variant can't be used; the first reason counts."""
    af = F.col("af_alt")
    return [
        (F.col("chrom").isNull() | F.col("pos").isNull() | F.col("ref").isNull() | F.col("alt").isNull(), "malformed"),
        (~(F.col("ref").rlike(BASE) & F.col("alt").rlike(BASE)), "noncanonical"),
        (F.col("ref") == F.col("alt"), "no_change"),
        (finite(F.col("score")).isNull(), "no_score"),
        (finite(af).isNull() | ~af.between(0, 1), "no_frequency"),
        ((af == 0) | (af == 1), "nonpolymorphic"),
        (F.col("rows_of_key") > 1, "duplicate_key"),
    ]


def judged(variants: DataFrame) -> DataFrame:
    """Each variant with the reason against it, or eligible."""
    same = F.count("*").over(W.partitionBy(*VARIANT))
    return variants.withColumn("rows_of_key", same).withColumn("reason", eligibility(ladder())).drop("rows_of_key")


def oriented(known: DataFrame, namespace: str) -> DataFrame:
    """Variants with their orientation, class and side; null for those that aren't eligible."""
    usable = F.col("reason") == "eligible"
    o = orient(F.col("ref"), F.col("alt"), F.col("af_alt"), F.col("score"))
    own = {f: F.when(usable, o.getField(f)) for f in ("minor_allele", "major_allele", "maf", "orientation")} | {"score_minor_vs_major": F.when(usable, o.getField("minor_vs_major"))}
    side = discovery_side(F.concat_ws("|", F.lit(namespace), *VARIANT))
    return known.withColumns(own).withColumns({"frequency_class": frequency_class(F.col("maf")), "substitution": F.when(usable, substitution_class(F.col("ref"), F.col("alt"))), "side": F.when(usable, side)})


def summary(variants: DataFrame, digits: int) -> DataFrame:
    """chrom, frequency_class, n, n_scored, mean, sd, median, proportion_negative, spearman."""
    x = F.col("score_minor_vs_major")
    own = variants.groupBy(*GROUP).agg(
        F.count("*").alias("n"), F.count(x).alias("n_scored"), F.avg(x).alias("mean"), F.when(F.count(x) > 1, F.stddev_samp(x)).alias("sd"), F.avg(F.when(x.isNotNull(), (x < 0).cast("double"))).alias("proportion_negative"),
    )
    ranks = correlations(variants, "maf", "score_minor_vs_major", ["chrom"]).where("method = 'spearman'").select("chrom", F.col("estimate").alias("spearman"))
    whole = own.join(medians(variants, "score_minor_vs_major", GROUP), GROUP, "left").join(ranks, "chrom", "left")
    shown = [F.round(c, digits).alias(c) for c in ("mean", "sd", "median", "proportion_negative", "spearman")]
    return whole.select(*GROUP, "n", "n_scored", *shown)


def prepared(spark: SparkSession, variants: str, config: dict, seen: Observation | None = None) -> DataFrame:
    rows = columns(spark.read.parquet(variants), config["columns"] | config["carry"])
    return oriented(judged(rows.observe(seen, F.count(F.lit(1)).alias("rows")) if seen else rows), config["namespace"])


def run(spark: SparkSession, variants: str, out: str, config: dict) -> dict[str, int]:
    """Rows read, and rows of each table written."""
    seen = Observation()
    rows = prepared(spark, variants, config, seen)
    # by ranges, so that a large class is written by many tasks and a task writes few folders
    dealt = rows.repartitionByRange("reason", *GROUP, "pos").sortWithinPartitions("reason", *GROUP, "pos", "ref", "alt")
    dealt.write.mode("overwrite").partitionBy("reason", *GROUP).parquet(f"{out}/variants")
    written = read(spark, f"{out}/variants", rows.schema)
    table = summary(written.where("reason = 'eligible'"), config["digits"])
    table.coalesce(1).write.mode("overwrite").partitionBy("chrom").parquet(f"{out}/summary")  # a few rows a chromosome
    reasons = {r["reason"]: r["count"] for r in written.groupBy("reason").count().collect()}  # a row for each reason
    counts = {"read": rows.count() if "rows" not in seen.get else seen.get["rows"], "variants": sum(reasons.values()), "summary": read(spark, f"{out}/summary", table.schema).count()}
    log.info("read %d rows of %s", counts["read"], variants)
    log.info("wrote %d rows to %s/variants: %s", counts["variants"], out, ", ".join(f"{k} {n}" for k, n in sorted(reasons.items())))
    log.info("wrote %d rows to %s/summary", counts["summary"], out)
    if counts["variants"] != counts["read"]:
        raise RuntimeError(f"{counts['read']} rows were read, but {counts['variants']} written")
    return counts


def output(spark: SparkSession, variants: str, out: str, config: dict) -> DataFrame:
    """All that ``run`` has written: variants with what their class's row of the summary says."""
    rows = prepared(spark, variants, config)
    table = read(spark, f"{out}/summary", summary(rows, config["digits"]).schema)
    return read(spark, f"{out}/variants", rows.schema).join(F.broadcast(table), GROUP, "left")  # a row for each chromosome and class


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("--variants", "--out"):
        parser.add_argument(name, required=True)
    parser.add_argument("--config")
    given = parser.parse_args()
    spark = session("population_benchmark")
    try:
        run(spark, given.variants, given.out, configuration(spark, given.config, __file__))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
