"""Joining population summaries to model scores, fail-loud, and orienting them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociscale.functions.columns import finite, left_edge_padded, map_chromosome, orient
from lociscale.operators.contracts import VARIANT, ContractError, enforce, require_columns, variant_rules


def integrate_population_scores(population: DataFrame, scores: DataFrame, contigs: Mapping[str, str], *, window: int = 512) -> DataFrame:
    """``population`` (chrom, pos, ref, alt, af_alt, ...) with its score and orientation.

    ``contigs`` maps the scores' contig names to the population's. Raises ContractError for missing
    columns, unknown contigs (listed), duplicate keys, non-finite scores or frequencies, unmatched variants
    and a minor allele frequency that isn't min(af, 1 - af) to 1e-12.
    """
    if window <= 0:
        raise ValueError("window must be positive")
    require_columns(population, [*VARIANT, "af_alt"], "population")
    require_columns(scores, [*VARIANT, "score"], "scores")
    named = scores.withColumn("fasta_chrom", F.col("chrom").cast("string")).withColumn("chrom", map_chromosome(F.col("chrom"), contigs))
    typed = lambda df: df.withColumns({"__chrom": F.col("chrom").cast("string"), "__pos": F.col("pos").try_cast("long")})
    key = ["__chrom", "__pos", "ref", "alt"]
    try:  # of each table, rules and keys in one pass
        enforce(typed(named), {"unknown contig": F.col("chrom").isNotNull(), "score is not finite": finite(F.col("score")).isNotNull()}, "scores", unique=key)
    except ContractError as e:
        if "unknown contig" not in e.violations:
            raise
        unknown = sorted(r[0] or "" for r in named.where("chrom IS NULL").select("fasta_chrom").distinct().limit(50).collect())
        raise ContractError("scores", {f"unknown contig {x}": 1 for x in unknown}) from e
    af = finite(F.col("af_alt"))
    rules = {k: v for k, v in variant_rules("af_alt").items() if not k.startswith("score")} | {"af_alt is not in [0, 1]": af.between(0, 1)}
    if "maf" in population.columns:
        rules["maf disagrees with af_alt"] = F.abs(finite(F.col("maf")) - F.least(af, 1 - af)) <= 1e-12
    enforce(typed(population), rules, "population", unique=key)
    keyed = lambda df: df.withColumns({"chrom": F.col("chrom").cast("string"), "pos": F.col("pos").cast("long")})
    carried = "fasta_chrom" in population.columns
    side = keyed(named).select(*VARIANT, finite(F.col("score")).alias("score_ref_alt"), F.col("fasta_chrom").alias("__contig"))
    joined = keyed(population).join(side.withColumn("matched", F.lit(True)), VARIANT, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    same = F.col("fasta_chrom").cast("string") == F.col("__contig") if carried else F.lit(True)
    enforce(joined, {"unmatched rows": F.col("matched"), "contig mapping disagrees": ~F.col("matched") | same}, "scores")  # one pass over the join
    joined = joined.drop("matched")
    o = orient(F.col("ref"), F.col("alt"), af, F.col("score_ref_alt"))
    out = joined.withColumn("fasta_chrom", F.col("__contig")).drop("__contig").withColumn("__o", o)
    if "maf" not in population.columns:
        out = out.withColumn("maf", F.col("__o.maf"))
    names = ["minor_allele", "major_allele", "orientation", "flipped"]
    out = out.withColumns({c: F.col(f"__o.{c}") for c in names} | {"score_paper_oriented": F.col("__o.paper_oriented"), "score_minor_vs_major": F.col("__o.minor_vs_major")})
    return out.withColumn("edge_padded", left_edge_padded(F.col("pos"), window)).drop("__o")
