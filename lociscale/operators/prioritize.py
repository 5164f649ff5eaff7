"""Candidate ranking, scopes, held-out targets and paired top-k recovery."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociscale.functions.columns import distance_decay, filled
from lociscale.operators.ranks import percentile_rank


#: Weights of a ranking's parts, the scale of distances, and the least group that is ranked; the
#: weights that a family of rules gives the model.
ASSOCIATION, LINKAGE = 0.9, 0.1
BASELINE, DISTANCE, CONSERVATION, NONCODING = 0.8, 0.1, 0.05, 0.05
MODEL, SCALE, LEAST_GROUP, TOP = 0.2, 2000.0, 6, 5
FAMILY_WEIGHTS = (0.1, 0.2, 0.4)


@dataclass(frozen=True)
class Rule:
    """How model scores enter a ranking: their weight, and whether by magnitude, sign or its reverse. Several
    scores (of a variant in contexts of several lengths) enter as the mean of these."""

    weight: float = MODEL
    form: str = "magnitude"

    def term(self, *scores: Column) -> Column:
        own = [{"magnitude": F.abs, "signed": lambda x: x, "negative": lambda x: -x}[self.form](x) for x in scores]
        return sum(own[1:], own[0]) / len(own)


def rule_family() -> dict[str, Rule]:
    """All forms at all weights, by name."""
    return {f"{form}_{weight:g}": Rule(weight, form) for form in ("magnitude", "signed", "negative") for weight in FAMILY_WEIGHTS}


def rank_candidates(df: DataFrame, score: str | list[str] | None = None, *, by: list[str] | None = None, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """``df`` with association, baseline, annotated, priority, rank (priority down, then variant_id) and
    baseline_rank (the same without the model).

    Percentiles are inside the rows given, so a subset has to be ranked anew. Candidates of a locus are
    few; the windows run over one locus each.
    """
    by = by or ["gene"]
    p = lambda c: percentile_rank(c, by)
    out = df.withColumn("association", p(F.col("discovery_neglogp")))
    out = out.withColumn("baseline", ASSOCIATION * F.col("association") + LINKAGE * filled(F.col("ld_r2_lead")))
    bonus = F.when(F.col("context") != "CDS", NONCODING).otherwise(0.0)
    out = out.withColumn("annotated", BASELINE * F.col("baseline") + DISTANCE * distance_decay(F.col("tss_distance"), SCALE) + CONSERVATION * p(filled(F.col("phylop"))) + bonus)
    if score is None:
        out = out.withColumn("priority", F.col("annotated"))
    else:
        out = out.withColumn("priority", (1 - rule.weight) * F.col("annotated") + rule.weight * p(rule.term(*map(F.col, [score] if isinstance(score, str) else score))))
    place = lambda c: F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.round(c, 12)), "variant_id"))
    return out.withColumns({"rank": place("priority"), "baseline_rank": place("annotated")})


def rank_family(df: DataFrame, score: str | list[str], *, by: list[str] | None = None, rules: dict[str, Rule] | None = None) -> DataFrame:
    """rule, then the columns of ``rank_candidates``, for each of ``rules`` (``rule_family`` by default): all of them
    from one base. What doesn't depend on the rule is ranked once; its rows are then repeated by rule where they are, since
    a locus's rows of every rule are together already."""
    by, rules = by or ["gene"], rules or rule_family()
    base = rank_candidates(df, by=by).drop("priority", "rank")
    scores = [F.col(c) for c in ([score] if isinstance(score, str) else score)]
    items = [F.struct(F.lit(name).alias("rule"), F.lit(r.weight).alias("weight"), r.term(*scores).alias("term")) for name, r in rules.items()]
    each = base.withColumn("__r", F.explode(F.array(*items))).select(F.col("__r.rule").alias("rule"), *df.columns, "association", "baseline", "annotated", "baseline_rank", "__r.weight", "__r.term")
    own = percentile_rank(F.col("term"), [*by, "rule"])
    out = each.withColumn("priority", (1 - F.col("weight")) * F.col("annotated") + F.col("weight") * own)
    place = F.row_number().over(W.partitionBy(*by, "rule").orderBy(F.desc(F.round("priority", 12)), "variant_id"))
    return out.withColumn("rank", place).drop("weight", "term")


def held_out_targets(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """gene, target, target_p, full_candidates, replicated: the least positive finite held-out p of the full
    group, ties to the smaller id; replicated below threshold / candidates."""
    p = F.col("heldout_p")
    usable = (p > 0) & (p < float("inf")) & ~F.isnan(p)
    own = df.groupBy("gene").agg(F.min(F.when(usable, F.struct(p.alias("p"), F.col("variant_id").alias("v")))).alias("m"), F.count("*").alias("full_candidates"))
    return own.select("gene", F.col("m.v").alias("target"), F.col("m.p").alias("target_p"), "full_candidates", (F.col("m.p") < threshold / F.col("full_candidates")).alias("replicated"))


def scoped_rankings(df: DataFrame, methods: dict[str, str], scopes: dict[str, Iterable[str]], *, least: int = LEAST_GROUP, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """scope, method, gene, variant_id, rank, baseline_rank, target: in each scope the rows with scores of
    all its models; groups of fewer than ``least`` are left out, the baseline is ranked anew. All scopes
    and methods are ranked in one exchange by scope, method and gene."""
    targets = held_out_targets(df).select("gene", "target")
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c))
    items = []
    for scope, needed in scopes.items():
        whole = F.lit(True)
        for c in needed:
            whole = whole & there(c)
        items += [F.when(whole, F.struct(F.lit(scope).alias("scope"), F.lit(method).alias("method"), F.col(c).alias("score"))) for method, c in methods.items() if c in needed]
    by = ["scope", "method", "gene"]
    rows = df.withColumn("__i", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull()))).select("*", "__i.*")
    rows = rows.withColumn("candidates", F.count("*").over(W.partitionBy(*by))).where(F.col("candidates") >= least)
    ranked = rank_candidates(rows, "score", by=by, rule=rule)
    out = ranked.select("scope", "method", "gene", "block", "variant_id", "rank", "baseline_rank", "candidates")
    return out.join(targets, "gene").withColumn("target", F.col("variant_id") == F.col("target"))


def paired_outcomes(rankings: DataFrame, k: int = TOP) -> DataFrame:
    """scope, method, gene, block, target ranks and hits where the target is in the scope."""
    hit = rankings.where("target")
    return hit.select("scope", "method", "gene", "block", "variant_id", F.col("rank").alias("target_rank"), F.col("baseline_rank").alias("target_baseline_rank"), (F.col("rank") <= k).alias("model_hit"), (F.col("baseline_rank") <= k).alias("baseline_hit"), "candidates")


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """scope, method, loci, model_hits, baseline_hits, into_top, out_of_top, stayed_in, stayed_out."""
    m, b = F.col("model_hit"), F.col("baseline_hit")
    return outcomes.groupBy("scope", "method").agg(F.count("*").alias("loci"), F.count_if(m).alias("model_hits"), F.count_if(b).alias("baseline_hits"), F.count_if(m & ~b).alias("into_top"), F.count_if(~m & b).alias("out_of_top"), F.count_if(m & b).alias("stayed_in"), F.count_if(~m & ~b).alias("stayed_out"))


def recovery_curve(outcomes: DataFrame, most: int = 20) -> DataFrame:
    """scope, method, k, recovery, baseline: the share of loci with their target among the first k."""
    rows = outcomes.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    share = lambda c: F.avg((F.col(c) <= F.col("k")).cast("double"))
    return rows.groupBy("scope", "method", "k").agg(share("target_rank").alias("recovery"), share("target_baseline_rank").alias("baseline"))


def method_pairs(outcomes: DataFrame) -> DataFrame:
    """scope, one, two, loci, same_candidates, only_one, only_two: methods against each other by locus."""
    a = outcomes.select("scope", "gene", F.col("method").alias("one"), F.col("model_hit").alias("h1"), F.col("candidates").alias("c1"))
    b = outcomes.select("scope", "gene", F.col("method").alias("two"), F.col("model_hit").alias("h2"), F.col("candidates").alias("c2"))
    both = a.join(b, ["scope", "gene"]).where("one < two")
    return both.groupBy("scope", "one", "two").agg(F.count("*").alias("loci"), F.count_if(F.col("c1") == F.col("c2")).alias("same_candidates"), F.count_if(F.col("h1") & ~F.col("h2")).alias("only_one"), F.count_if(~F.col("h1") & F.col("h2")).alias("only_two"))


def locus_screen(loci: DataFrame) -> Column:
    """The first reason for which a locus is left out, or selected."""
    c = F.col
    return (
        F.when(c("overlapping"), "overlapping_window").when(c("common_snps") < 6, "too_few_common_snps").when(~c("expression_finite"), "expression_nonfinite")
        .when(~c("association_valid"), "invalid_association").when(~c("cis_signal"), "no_discovery_cis_signal").when(c("linked_snps") < 6, "fewer_than_six_linked").otherwise("selected")
    )


def family_threshold(p: Column, genes: Column, snps: Column, alpha: float = 0.05) -> Column:
    return p <= F.lit(alpha) / (genes * snps)


def direction_agreement(df: DataFrame, score: str, effect: str) -> DataFrame:
    """n, agreeing: rows in which score and effect have one sign, neither of them 0."""
    a, b = F.signum(score), F.signum(effect)
    return df.agg(F.count_if((a != 0) & (b != 0)).alias("n"), F.count_if((a == b) & (a != 0)).alias("agreeing"))
