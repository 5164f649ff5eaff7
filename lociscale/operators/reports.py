"""Picks, counts and tables that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociscale.functions.columns import normal_quantile
from lociscale.operators.contracts import ContractError
from lociscale.operators.ranks import average_ranks, with_quantiles
from lociscale.operators.stats import correlations
from lociscale.plans.lineage import cut, numbered


def lead_variant(df: DataFrame, by: list[str], p: str, key: str) -> DataFrame:
    """by, lead, p: the row of least finite p in each group, ties to the smaller key."""
    fine = F.col(p).isNotNull() & ~F.isnan(F.col(p)) & (F.abs(F.col(p)) < float("inf"))
    best = F.min(F.when(fine, F.struct(F.col(p).alias("p"), F.col(key).alias("k"))))
    return df.groupBy(*by).agg(best.alias("m")).select(*by, F.col("m.k").alias("lead"), F.col("m.p").alias("p"))


def longest(df: DataFrame, by: list[str], length: Column, key: str) -> DataFrame:
    """by, pick, length: the longest item of each group, ties to the smaller key."""
    own = df.groupBy(*by).agg(F.min(F.struct((-length).alias("l"), F.col(key).alias("k"))).alias("m"))
    return own.select(*by, F.col("m.k").alias("pick"), (-F.col("m.l")).alias("length"))


def carriers(calls: DataFrame, by: list[str], dosage: Column, least: int = 10) -> DataFrame:
    """by, ref_carriers, alt_carriers, eligible: homozygous samples of either allele, enough of both."""
    own = calls.groupBy(*by).agg(F.count_if(dosage == 0).alias("ref_carriers"), F.count_if(dosage == 2).alias("alt_carriers"))
    return own.withColumn("eligible", (F.col("ref_carriers") >= least) & (F.col("alt_carriers") >= least))


def member_counts(df: DataFrame, members: str) -> DataFrame:
    """member, rows: in how many rows' sets each member is."""
    return df.select(F.explode(F.array_distinct(members)).alias("member")).groupBy("member").agg(F.count("*").alias("rows"))


def concordance(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """scope, form, method, n, estimate: raw and absolute scores, in each group and over all of them."""
    forms = F.array(*[F.struct(F.lit(f).alias("form"), g(F.col(x)).alias("__x"), g(F.col(y)).alias("__y")) for f, g in (("raw", lambda c: c), ("absolute", F.abs))])
    scopes = F.array(F.col(by).cast("string"), F.lit("all"))
    rows = df.select(F.explode(scopes).alias("scope"), forms.alias("f")).select("scope", F.explode("f").alias("f")).select("scope", "f.*")
    return correlations(rows, "__x", "__y", ["scope", "form"])


def key_sets(tables: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """present, keys: how many distinct keys are in which of the tables (their names joined by commas).

    Equal key sets give one row. All tables are counted in one aggregation of their union.
    """
    both = None
    for name, df in tables.items():
        own = df.select(*key, F.lit(name).alias("__t"))
        both = own if both is None else both.unionByName(own)
    held = both.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("__t")), ",").alias("present"))
    return held.groupBy("present").agg(F.count("*").alias("keys"))


def genotype_groups(df: DataFrame, dosage: str, value: str) -> DataFrame:
    """dosage, n, quartiles and mean of a value by genotype class."""
    return with_quantiles(df.where(F.col(dosage).isNotNull()), value, [dosage], {"q25": 0.25, "median": 0.5, "q75": 0.75}, [F.count(value).alias("n"), F.avg(value).alias("mean")])


def panels(tables: dict[str, DataFrame]) -> DataFrame:
    """Statistics of several panels as one long table; columns that a panel lacks are null."""
    out = None
    for name, df in tables.items():
        own = df.withColumn("panel", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def capped_selection(loci: DataFrame, *, group: str, pos: str, order: str, apart: int, cap: int) -> DataFrame:
    """``loci`` (group, order, pos) with ``status``: selected, overlapping_window or block_full, in the order given within
    each group: at most ``cap``, none within ``apart`` of one selected before. The cap only ends what ``exclusion``
    keeps: all that come after the last one selected find the group full."""
    from lociscale.operators.ld import exclusion

    own = loci.select(group, order, F.col(pos).cast("long").alias(pos), F.monotonically_increasing_id().alias("__row"))
    told = cut(exclusion(own, group=group, pos=pos, order=order, apart=apart))
    turn = F.struct(order, pos, ~F.col("kept"), "__row")  # of copies the one that is kept came first
    nth = told.where("kept").withColumn("n", F.row_number().over(W.partitionBy(group).orderBy(turn))).where(F.col("n") == cap)
    last = nth.select(F.col(group).alias("__group"), turn.alias("__last"))
    joined = told.join(last, F.col(group).eqNullSafe(F.col("__group")), "left")
    status = F.when(F.lit(cap <= 0) | (turn > F.col("__last")), "block_full").when(F.col("kept"), "selected").otherwise("overlapping_window")
    return joined.select(group, order, pos, status.alias("status"))


def normal_scores(df: DataFrame, value: str, by: list[str] | None = None, out: str = "normal_score") -> DataFrame:
    """``df`` with the normal quantile of (rank - 1/2) / n, ranks averaged over ties."""
    by = by or []
    ranked = average_ranks(df, value, by, "__rank")
    n = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("__n"))
    joined = ranked.join(n, by, "left") if by else ranked.crossJoin(F.broadcast(n))  # one row
    return joined.withColumn(out, normal_quantile((F.col("__rank") - 0.5) / F.col("__n"))).drop("__rank", "__n")


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in ``order`` (then by the other columns, so that reruns agree)."""
    rest = [c for c in df.columns if c not in key]
    ranked = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *rest)
    return df.groupBy(*key).agg(F.min(ranked).alias("__m")).select(*key, *[F.col(f"__m.{c}").alias(c) for c in rest]).select(*df.columns)


def reindexed(df: DataFrame, column: str, categories: list[str], fill: dict) -> DataFrame:
    """``ordinal``, ``column`` and the rest: a row for each of ``categories`` in their order, with ``fill`` where
    ``df`` has none; rows of other categories are left out, as they have no place."""
    fixed = df.sparkSession.createDataFrame(list(enumerate(categories)), f"ordinal int, `{column}` string")
    rest = [c for c in df.columns if c != column]
    return F.broadcast(fixed).join(df, column, "left").select("ordinal", column, *rest).fillna(fill)


def ordered_join(left: DataFrame, right: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Left join whose rows carry the place of the left row in ``order`` in ``ordinal``, whatever the join does
    to their order; sort by it at the end."""
    return numbered(left, "ordinal", *order).join(right, key, "left")


def canonical(df: DataFrame, columns: list[str], table: str = "table") -> DataFrame:
    """``df`` with ``columns`` alone, in this order; a missing one, or one that is there twice whatever its case,
    raises."""
    seen = [c.lower() for c in df.columns]
    bad = {f"column {c} is there {n} times": 0 for c in columns if (n := seen.count(c.lower())) != 1}
    if bad:
        raise ContractError(table, bad)
    return df.select(*[f"`{c}`" for c in columns])


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """by, column, n, missing, mean, sd, min, the quartiles and max of numeric columns, NaN counting as missing."""
    by = by or []
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    items = F.array(*[F.struct(F.lit(c).alias("column"), clean(c).alias("x")) for c in columns])
    long = df.select(*by, F.explode(items).alias("i")).select(*by, "i.*")
    own = [F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"), F.when(F.count("x") > 1, F.stddev_samp("x")).alias("sd"), F.min("x").alias("min"), F.max("x").alias("max")]
    quartiles = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    return with_quantiles(long, "x", [*by, "column"], quartiles, own).select(*by, "column", "n", "missing", "mean", "sd", "min", *quartiles, "max")


def worked_locus(rankings: DataFrame, k: int = 5) -> DataFrame:
    """The first k of the least gene."""
    gene = rankings.agg(F.min("gene").alias("gene"))
    return rankings.join(F.broadcast(gene), "gene").where(F.col("rank") <= k)  # one row is broadcast


def single_token_change(a: Column, b: Column, target: Column, mask: int = 1) -> Column:
    """Whether two token arrays differ in exactly one place, the masked 0-based target."""
    changed = F.filter(F.zip_with(F.transform(a, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), b, lambda x, y: F.when(x["v"] != y, x["i"])), lambda x: x.isNotNull())
    return (F.size(a) == F.size(b)) & (F.size(changed) == 1) & (F.get(changed, F.lit(0)) == target) & (F.get(b, target) == mask)
