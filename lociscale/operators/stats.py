"""Group summaries, correlations and rank statistics, each one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociscale.operators.ranks import count_ranks, quantiles, value_ranks, with_quantiles


QUARTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75}


def group_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, mean, sd, median, quartiles, min and max; quartiles come from the ranks of distinct values."""
    x = F.col(value)
    out = with_quantiles(df, value, by, QUARTILES, [F.count(x).alias("n"), F.avg(x).alias("mean"), F.when(F.count(x) > 1, F.stddev_samp(x)).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max")])
    return out.select(*by, "n", "mean", "sd", *QUARTILES, "min", "max")


def score_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``group_summary`` and the share of negative values."""
    negative = F.avg(F.when(F.col(value).isNotNull(), (F.col(value) < 0).cast("double")))
    own, shares = group_summary(df, value, by), df.groupBy(*by).agg(negative.alias("proportion_negative"))
    met = F.lit(True)
    for c in by:
        met = F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) & met
    return own.alias("a").join(shares.alias("b"), met).select("a.*", "b.proportion_negative")


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson over complete pairs; null for fewer than two, or where either is constant (where the
    built-in divides by zero)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(spread, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def moment_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson from sums."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    return F.when((n > 1) & (vx > 0) & (vy > 0), F.try_divide(sxy - sx * sy / n, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))))


def complete(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))


def correlations(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """by, method, n, estimate for pearson and spearman, ranks taken inside each group's complete pairs.

    Pearson is one aggregation of the rows. For Spearman these are summed to distinct pairs first: one exchange, from which both
    columns' counts are made and to whose rows the ranks are joined.
    """
    by = by or []
    rows = complete(df, x, y).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    plain = rows.groupBy(*by).agg(F.count("*").alias("n"), safe_corr(F.col("x"), F.col("y")).alias("pearson"))
    grouped = rows  # null groups have no ranks; filtered here, all that follows can share one exchange
    for c in by:
        grouped = grouped.where(F.col(c).isNotNull())
    pairs = grouped.groupBy(*by, "x", "y").agg(F.count("*").alias("w"))
    ranked = pairs
    for value, name in (("x", "rx"), ("y", "ry")):
        ranks = count_ranks(pairs.groupBy(*by, value).agg(F.sum("w").alias("n")), value, by)
        ranked = ranked.join(ranks.select(*by, value, (2 * F.col("rank")).alias(name)), [*by, value], "left")  # whole numbers
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy(*by).agg(*[F.sum(w * v).alias(f"__{n}") for n, v in (("n", F.lit(1.0)), ("a", a), ("b", b), ("aa", a * a), ("bb", b * b), ("ab", a * b))], ((F.min(a) < F.max(a)) & (F.min(b) < F.max(b))).alias("__spread"))
    n, sa, sb = F.col("__n"), F.col("__a"), F.col("__b")
    rho = F.try_divide(n * F.col("__ab") - sa * sb, F.sqrt((n * F.col("__aa") - sa * sa) * (n * F.col("__bb") - sb * sb)))
    found = sums.select(*by, F.when(F.col("__spread"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("spearman"))
    met = F.lit(True)
    for c in by:
        met = F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) & met
    both = plain.alias("a").join(found.alias("b"), met, "left").select("a.*", "b.spearman")
    return both.select(*by, "n", F.expr("stack(2, 'pearson', pearson, 'spearman', spearman) AS (method, estimate)"))


def comparison_grid(df: DataFrame, pairs: list[tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """comparison, by, method, n, estimate over several pairs of score columns in one pass."""
    by = by or []
    items = F.array(*[F.struct(F.lit(f"{a}__{b}").alias("comparison"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])
    long = df.select(*by, F.explode(items).alias("p")).select(*by, "p.*")
    return correlations(long, "x", "y", ["comparison", *by])


def leave_one_out(df: DataFrame, x: str, y: str, by: str, groups: list) -> DataFrame:
    """analysis (only, without), group, method, n, estimate; ``groups`` is the short list of groups."""
    items = F.array(*[F.struct(F.when(F.col(by) == g, "only").otherwise("without").alias("analysis"), F.lit(g).alias("group")) for g in groups])
    return correlations(df.withColumn("__a", F.explode(items)).select(x, y, "__a.*"), x, y, ["analysis", "group"])


def sensitivity(df: DataFrame, x: str, y: str, subsets: dict[str, Column]) -> DataFrame:
    """subset, method, n, estimate for overlapping subsets of the rows."""
    flags = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in subsets.items()]), lambda v: v.isNotNull())
    return correlations(df.withColumn("subset", F.explode(flags)), x, y, ["subset"])


def subset_medians(df: DataFrame, x: str, y: str, subsets: dict[str, Column]) -> DataFrame:
    """subset, n, median_x, median_y over the complete rows of overlapping subsets."""
    flags = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in subsets.items()]), lambda v: v.isNotNull())
    rows = complete(df, x, y).withColumn("subset", F.explode(flags))
    own = with_quantiles(rows, x, ["subset"], {"median_x": 0.5}, [F.count("*").alias("n")])
    return own.join(quantiles(rows, y, ["subset"], {"median_y": 0.5}), "subset").select("subset", "n", "median_x", "median_y")


def rank_biserial(df: DataFrame, value: str, label: str, a: object, b: object) -> DataFrame:
    """n_a, n_b, rank_biserial: (pairs with a above b - below) / all pairs, from pooled ranks."""
    rows = df.where(F.col(label).isin(a, b) & F.col(value).isNotNull()).withColumn("__a", (F.col(label) == a).cast("int"))
    own = rows.groupBy(value).agg(F.sum("__a").alias("na"), F.count("*").alias("m"))
    ranks = value_ranks(rows, value, []).select(value, "rank")
    s = own.join(ranks, value).agg(F.sum(F.col("na") * F.col("rank")).alias("ra"), F.sum("na").alias("n_a"), (F.sum("m") - F.sum("na")).alias("n_b"))
    return s.select("n_a", "n_b", (2 * F.try_divide(F.col("ra") - F.col("n_a") * (F.col("n_a") + 1) / 2, F.col("n_a") * F.col("n_b")) - 1).alias("rank_biserial"))


def log_histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, rows: counts between ``bins`` + 1 edges that are evenly spaced in the logarithm."""
    at = F.floor((F.ln(F.col(value)) - F.ln(F.lit(low))) / (F.ln(F.lit(high)) - F.ln(F.lit(low))) * bins)
    inside = F.col(value).between(low, high)
    return df.where(inside).select(F.least(F.lit(bins - 1), at).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("rows"))


def density_grid(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    cell = lambda c, w: F.floor(F.col(c) / F.lit(w)).cast("long")
    return df.groupBy(cell(x, x_width).alias("x_bin"), cell(y, y_width).alias("y_bin")).agg(F.count("*").alias("rows"))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """step, name, rows: how many rows meet each condition and all before it."""
    met, items = F.lit(True), []
    for i, (name, c) in enumerate(steps.items()):
        met = met & F.coalesce(c, F.lit(False))
        items.append(F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), F.count_if(met).alias("rows")))
    return df.agg(F.array(*items).alias("steps")).select(F.inline("steps"))


def genotype_summary(calls: DataFrame, by: list[str], genotype: str = "gt") -> DataFrame:
    """Counts and frequencies of diploid calls by variant; alleles of half-missing calls count singly.

    ``invalid`` counts calls that aren't two alleles of 0, 1 or missing: a contract for the caller.
    """
    field = F.get(F.split(genotype, ":"), F.lit(0))
    a = F.split(field, r"[|/]")
    first, second = F.get(a, F.lit(0)), F.get(a, F.lit(1))
    ok = (F.size(a) == 2) & F.forall(a, lambda x: x.isin("0", "1", "."))
    count = lambda v: (first == v).cast("int") + (second == v).cast("int")
    rows = calls.select(*by, ok.alias("ok"), count("0").alias("r"), count("1").alias("x"), (first != second).alias("differ"))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n_genotypes"), F.count_if((F.col("r") + F.col("x")) == 0).alias("n_missing"),
        F.count_if((F.col("r") == 1) & (F.col("x") == 1)).alias("n_heterozygous"), F.sum("r").alias("ac_ref"), F.sum("x").alias("ac_alt"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("invalid"),
    )
    an = F.col("ac_ref") + F.col("ac_alt")
    out = sums.withColumn("an", an).withColumn("mac", F.least("ac_ref", "ac_alt"))
    return out.withColumns({"af_alt": F.try_divide("ac_alt", "an"), "maf": F.try_divide("mac", "an"), "allele_call_rate": F.try_divide(F.col("an"), 2 * F.col("n_genotypes"))})


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    """reason, rows from a column of reasons joined by semicolons."""
    return df.select(F.explode(F.split(reasons, ";")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("rows"))


def coverage_table(df: DataFrame, models: list[str], group: str) -> DataFrame:
    """model, covered, total, complete_groups: rows with a value, and groups in which all rows have one."""
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).isNotNull().alias("has")) for m in models])
    own = df.select(group, F.explode(items).alias("i")).groupBy(group, "i.model").agg(F.count_if("i.has").alias("has"), F.count("*").alias("n"))
    return own.groupBy("model").agg(F.sum("has").alias("covered"), F.sum("n").alias("total"), F.count_if(F.col("has") == F.col("n")).alias("complete_groups"))
