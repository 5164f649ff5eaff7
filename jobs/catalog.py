"""The jobs as queries, and their SQL."""

from __future__ import annotations

import json
import uuid

from jobs import population_benchmark, score_ledger
from jobs.common import configuration
from lociscale.functions.columns import FREQUENCY_CLASSES, FREQUENCY_LIMITS, ORIENTATIONS
from lociscale.plans.lineage import shared_folder
from lociscale.plans.standins import VARIANTS_SQL
from pyspark.sql import DataFrame, SparkSession


def job1_population_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one new folder, and what stands there then."""
    config = configuration(spark, None, population_benchmark.__file__)
    given, out = f"{sf_dir}/lineitem.parquet", f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        population_benchmark.run(spark, given, out, config)
    return population_benchmark.output(spark, given, out, config)


def job2_score_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one new folder and checkpoint; the second finds nothing new."""
    config = configuration(spark, None, score_ledger.__file__)
    given, folder = f"{sf_dir}/documents.parquet", f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        score_ledger.run(spark, given, f"{folder}/ledger", f"{folder}/checkpoint", config)
    return score_ledger.output(spark, given, f"{folder}/ledger", config)


MODEL = json.loads(open(score_ledger.__file__.removesuffix(".py") + ".json").read())["model"]
COUNT = "length(text) - length(replace(replace(text, '{0}', ''), upper('{0}'), ''))"
LETTERS = " + ".join(f"({COUNT.format(x)})" for x in sorted(MODEL))
TOTAL = " + ".join(f"({COUNT.format(x)}) * (ln({p}::DOUBLE) - ln({q}::DOUBLE))" for x, (p, q) in sorted(MODEL.items()))

QUERIES = {"job1_population_benchmark": job1_population_benchmark, "job2_score_ledger": job2_score_ledger}

SQL = {
    "job1_population_benchmark": f"""
        WITH variants AS (SELECT site AS pos, CAST(line AS INTEGER) AS line, chrom, status, ref, alt, af_alt, score FROM ({VARIANTS_SQL})),
        judged AS (
            SELECT *, CASE WHEN af_alt IN (0, 1) THEN 'nonpolymorphic' WHEN count(*) OVER (PARTITION BY chrom, pos, ref, alt) > 1 THEN 'duplicate_key' ELSE 'eligible' END AS reason FROM variants
        ), known AS (
            SELECT *, reason = 'eligible' AS ok, CASE WHEN reason = 'eligible' THEN least(af_alt, 1 - af_alt) END AS maf,
                CASE WHEN reason <> 'eligible' THEN NULL WHEN af_alt < 0.5 THEN score WHEN af_alt > 0.5 THEN -score END AS score_minor_vs_major
            FROM judged
        ), classed AS (SELECT *, CASE WHEN maf < {FREQUENCY_LIMITS[0]} THEN '{FREQUENCY_CLASSES[0]}' WHEN maf < {FREQUENCY_LIMITS[1]} THEN '{FREQUENCY_CLASSES[1]}' WHEN maf IS NOT NULL THEN '{FREQUENCY_CLASSES[2]}' END AS frequency_class FROM known),
        ranked AS (
            SELECT chrom, rank() OVER (PARTITION BY chrom ORDER BY maf) + (count(*) OVER (PARTITION BY chrom, maf) - 1) / 2 AS a,
                rank() OVER (PARTITION BY chrom ORDER BY score_minor_vs_major) + (count(*) OVER (PARTITION BY chrom, score_minor_vs_major) - 1) / 2 AS b
            FROM classed WHERE ok AND score_minor_vs_major IS NOT NULL
        ), rho AS (SELECT chrom, corr(a, b) AS spearman FROM ranked GROUP BY 1),
        summary AS (
            SELECT chrom, frequency_class, CAST(count(*) AS BIGINT) AS n, CAST(count(score_minor_vs_major) AS BIGINT) AS n_scored, avg(score_minor_vs_major) AS mean, stddev_samp(score_minor_vs_major) AS sd,
                median(score_minor_vs_major) AS median, avg(CASE WHEN score_minor_vs_major < 0 THEN 1.0::DOUBLE WHEN score_minor_vs_major IS NOT NULL THEN 0 END) AS proportion_negative
            FROM classed WHERE ok GROUP BY 1, 2
        )
        SELECT c.chrom, c.pos, c.ref, c.alt, c.af_alt, c.score, c.line, c.status, c.reason, c.maf, c.score_minor_vs_major, c.frequency_class,
            CASE WHEN NOT ok THEN NULL WHEN af_alt < 0.5 THEN alt WHEN af_alt > 0.5 THEN ref END AS minor_allele, CASE WHEN NOT ok THEN NULL WHEN af_alt < 0.5 THEN ref WHEN af_alt > 0.5 THEN alt END AS major_allele,
            CASE WHEN NOT ok THEN NULL WHEN af_alt < 0.5 THEN '{ORIENTATIONS[0]}' WHEN af_alt > 0.5 THEN '{ORIENTATIONS[1]}' ELSE '{ORIENTATIONS[2]}' END AS orientation,
            CASE WHEN ok THEN CASE WHEN ref IN ('A', 'G') THEN translate(ref, 'ACGT', 'TGCA') || '>' || translate(alt, 'ACGT', 'TGCA') ELSE ref || '>' || alt END END AS substitution,
            CASE WHEN NOT ok THEN NULL WHEN CAST('0x' || substr(sha256('benchmark-v1|' || c.chrom || '|' || pos || '|' || ref || '|' || alt), 1, 8) AS BIGINT) % 10 < 7 THEN 'discovery' ELSE 'heldout' END AS side,
            n, n_scored, round(mean, 6) AS mean, round(sd, 6) AS sd, round(median, 6) AS median, round(proportion_negative, 6) AS proportion_negative, round(spearman, 6) AS spearman
        FROM classed c LEFT JOIN summary s ON c.chrom = s.chrom AND c.frequency_class = s.frequency_class LEFT JOIN rho ON rho.chrom = s.chrom
    """,
    "job2_score_ledger": f"""
        WITH counted AS (SELECT doc_id, source, text, CAST({LETTERS} AS BIGINT) AS n_letters, {TOTAL} AS total FROM documents),
        judged AS (SELECT *, CASE WHEN text IS NULL THEN 'no_sequence' WHEN n_letters < 20 THEN 'too_short' ELSE 'scored' END AS status FROM counted),
        keyed AS (SELECT *, CASE WHEN status = 'scored' THEN sha256(text || '{json.dumps(MODEL, sort_keys=True)}') END AS key FROM judged)
        SELECT doc_id, source, n_letters, key, CAST(0 AS BIGINT) AS batch, status, CASE WHEN key IS NOT NULL THEN CAST(min(doc_id) OVER (PARTITION BY key) AS VARCHAR) END AS first_id,
            CASE WHEN key IS NOT NULL THEN round(total / n_letters, 9) + 0.0 END AS score,
            CASE WHEN key IS NOT NULL THEN CASE WHEN CAST('0x' || substr(sha256(key), 1, 8) AS BIGINT) % 10 < 7 THEN 'discovery' ELSE 'heldout' END END AS side,
            CASE WHEN key IS NOT NULL THEN CAST(0 AS BIGINT) END AS scored_in
        FROM keyed
    """,
}
