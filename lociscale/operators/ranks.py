"""Tie-averaged ranks, percentiles, hash samples, quotas and spacing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociscale.functions.columns import hash_rank


#: Distinct values of a group are cut into CELLS parts, and each of these into as many cells.
CELLS = 8


def value_cells(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``counts`` with ``__cell``, from 0, ascending with ``value`` in each group. The splitters are quantiles of a group's
    distinct values, so cells hold about equally many of these wherever on the scale they lie, and values that are
    equal as doubles share one. A hot value is one row here; it can't fill a cell."""
    x, n = F.col(value).cast("double"), CELLS * CELLS
    marks = counts.groupBy(*by).agg(F.percentile_approx(x, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(20 * n)).alias("__marks"))
    firsts = F.array(*[F.get("__marks", F.lit(i - 1)) for i in range(CELLS, n, CELLS)])
    marks = marks.select(*by, "__marks", firsts.alias("__firsts"))
    joined = counts.join(marks, by) if by else counts.crossJoin(F.broadcast(marks))  # without groups, one row
    below = lambda marks: F.size(F.filter(marks, lambda m: m < x))
    part = joined.withColumn("__part", below(F.col("__firsts")) * CELLS)
    return part.withColumn("__cell", F.col("__part") + below(F.slice("__marks", F.col("__part") + 1, CELLS - 1))).drop("__marks", "__firsts", "__part")


def value_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by``, value, n, rank: the tie-averaged rank of each distinct value in its group, at any size and any
    distribution. Rows are summed to distinct values first; these are ordered cell by cell, and a running sum over a
    group's cells gives each cell its start."""
    return count_ranks(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), value, by)


def count_ranks(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``value_ranks`` from the counts ``n`` of distinct values."""
    cells = value_cells(counts, value, by).repartition(*by, "__cell")  # the one exchange that sums and ranks share
    sums = cells.groupBy(*by, "__cell").agg(F.sum("n").alias("__n"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # at most CELLS squared rows a group
    sums = sums.withColumn("__start", F.coalesce(F.sum("__n").over(group.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = W.partitionBy(*by, "__cell").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("__start") + F.coalesce(F.sum("n").over(own), F.lit(0))
    return cells.join(sums, [*by, "__cell"]).withColumn("rank", before + (F.col("n") + 1) / 2).drop("__start", "__cell")


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """``df`` with the tie-averaged rank of ``value`` (null for null), at any size of group."""
    by = by or []
    ranks = value_ranks(df, value, by).select(*by, value, F.col("rank").alias(out))
    return df.join(ranks, [*by, value], "left")


def rank_pairs(df: DataFrame, x: str, y: str, by: list[str] | None = None, out: tuple[str, str] = ("rx", "ry")) -> DataFrame:
    """``df`` with the ranks of two columns, each from counts of its own; the rows are read for both
    counts and once more to be joined, and don't pass through one ranking to get to the other."""
    by = by or []
    ranked = df
    for value, name in ((x, out[0]), (y, out[1])):
        own = value_ranks(df.select(*by, value), value, by).select(*by, value, F.col("rank").alias(name))
        ranked = ranked.join(own, [*by, value], "left")
    return ranked


def medians(df: DataFrame, value: str, by: list[str], out: str = "median") -> DataFrame:
    """``by``, out: exact medians of groups of any size, from the ranks of their distinct values."""
    ranks = value_ranks(df, value, by)
    total = ranks.groupBy(*by).agg(F.sum("n").alias("__total"))
    before = F.col("rank") - (F.col("n") + 1) / 2
    low, high = F.floor((F.col("__total") + 1) / 2), F.ceil((F.col("__total") + 1) / 2)
    has = lambda place: (before < place) & (place <= before + F.col("n"))
    middle = ranks.join(total, by).groupBy(*by).agg(F.max(F.when(has(low), F.col(value))).alias("__low"), F.max(F.when(has(high), F.col(value))).alias("__high"))
    return middle.select(*by, ((F.col("__low") + F.col("__high")) / 2).alias(out))


def quantiles(df: DataFrame, value: str, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """``by`` and the exact quantiles of ``wanted`` (name: share), interpolated as ``percentile`` does, of groups of any size, from
    the ranks of their distinct values: no task gathers a group's. A null in ``by`` is a group like others; groups without
    a value have no row."""
    rows = df.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("__all"), *by).alias("__by"), F.col(value).cast("double").alias("__v"))
    ranks = value_ranks(rows, "__v", ["__by"])
    ranks = ranks.join(ranks.groupBy("__by").agg((F.sum("n") - 1).alias("__last")), "__by")
    before = F.col("rank") - (F.col("n") + 1) / 2
    at = lambda place: F.max(F.when((before <= place) & (place < before + F.col("n")), F.col("__v")))
    ends = [f(at_(F.col("__last") * F.lit(q))).alias(f"__{e}{i}") for i, q in enumerate(wanted.values()) for e, f, at_ in (("l", at, F.floor), ("h", at, F.ceil))]
    found = ranks.groupBy("__by").agg(F.max("__last").alias("__last"), *ends)
    out = []
    for i, (name, q) in enumerate(wanted.items()):
        place, low, high = F.col("__last") * F.lit(q), F.col(f"__l{i}"), F.col(f"__h{i}")
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name))
    return found.select(*[F.col(f"__by.`{c}`").alias(c) for c in by], *out)


def with_quantiles(df: DataFrame, value: str, by: list[str], wanted: dict[str, float], columns: list[Column]) -> DataFrame:
    """``by``, the aggregates ``columns`` and the ``quantiles`` of each group."""
    own, found = df.groupBy(*by).agg(*columns), quantiles(df, value, by, wanted)
    met = F.lit(True)
    for c in by:
        met = F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) & met
    return own.alias("a").join(found.alias("b"), met, "left").select("a.*", *[F.col(f"b.`{n}`") for n in wanted])


def group_average_rank(value: Column, by: list[Column | str]) -> Column:
    """The same as a window expression, for groups that fit in one task (candidates of a locus)."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def percentile_rank(value: Column, by: list[Column | str], *, strict: bool = False) -> Column:
    """(rank - 1/2) / n inside a group; with ``strict`` a value that isn't finite raises."""
    if strict:
        x = value.cast("double")
        value = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), value).otherwise(F.raise_error(F.lit("a value to rank is not finite")).cast("double"))
    return (group_average_rank(value, by) - 0.5) / F.count("*").over(W.partitionBy(*by))


def bottom_k(df: DataFrame, k: int, namespace: str, *key: str) -> DataFrame:
    """The ``k`` rows of least hash, with selection_hash and selection_rank from 1. Planned as a top-k:
    each task keeps k rows."""
    hashed = df.withColumn("selection_hash", hash_rank(namespace, *[F.col(c) for c in key]))
    kept = hashed.orderBy("selection_hash", *key).limit(k)
    return kept.withColumn("selection_rank", F.row_number().over(W.orderBy("selection_hash", *key)))


def bottom_k_eligible(df: DataFrame, candidates: int, target: int, eligible: Column, namespace: str, *key: str) -> DataFrame:
    """Of the ``candidates`` rows of least hash, the first ``target`` that are eligible, ranked anew.

    Exact only if that many are: fewer raise, since rows beyond the candidates might be among them.
    """
    from lociscale.operators.contracts import ContractError

    pool = bottom_k(df, candidates, namespace, *key).where(eligible)
    out = pool.orderBy("selection_hash", *key).limit(target)
    n = out.count()
    if n < target:
        raise ContractError("selection", {f"only {n} eligible of {target}": target - n})
    return out.withColumn("selection_rank", F.row_number().over(W.orderBy("selection_hash", *key)))


def quota_fill(df: DataFrame, classes: list[tuple[str, Column, int]], order: list[str | Column]) -> DataFrame:
    """The first rows of each class up to its quota, with selection_class; a row that meets several conditions
    counts for the first in ``classes`` that takes it. Repeated rows are rows, and nulls may be in any column; a
    condition that is null doesn't hold. Ties of ``order`` go by the rows' places in the table.

    A class can lose no more rows to the classes before it than their quotas, so its first rows up to the
    sum of quotas so far decide; each task keeps these, and one task goes through what is left (quotas, not rows).
    """
    place = [F.col(c) if isinstance(c, str) else c for c in order]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    met = F.filter(F.array(*[F.when(c, F.lit(i)) for i, (_, c, _) in enumerate(classes)]), lambda i: i.isNotNull())
    placed = df.select(row.alias("row"), *[p.alias(f"o{i}") for i, p in enumerate(place)], met.alias("met"), F.monotonically_increasing_id().alias("id"))
    base = placed.select("*", F.explode("met").alias("class")).drop("met")  # a step of its own: a row's copies share its id
    by = [*[f"o{i}" for i in range(len(place))], "id"]
    upto = F.element_at(F.array(*[F.lit(sum(q for _, _, q in classes[: i + 1])) for i in range(len(classes))]), F.col("class") + 1)
    most = sum(q for _, _, q in classes)
    first = base.withColumn("n", F.row_number().over(W.partitionBy("class").orderBy(*by))).where(F.col("n") <= most).where(F.col("n") <= upto)
    ids = first.groupBy("id").agg(F.any_value("row").alias("row"), *[F.any_value(c).alias(c) for c in by[:-1]], F.collect_set("class").alias("classes"), F.lit(None).cast("int").alias("taken"))
    for i, (_, _, quota) in enumerate(classes):
        free = F.col("taken").isNull() & F.array_contains("classes", i)
        n = F.sum(F.when(free, 1)).over(W.orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
        ids = ids.withColumn("taken", F.when(free & (n <= quota), i).otherwise(F.col("taken")))
    names = F.element_at(F.array(*[F.lit(name) for name, _, _ in classes]), F.col("taken") + 1)
    return ids.where("taken IS NOT NULL").select("row.*", names.alias("selection_class"))


def per_group_bottom_k(df: DataFrame, k: int, by: list[str], namespace: str, *key: str, first: Column | None = None) -> DataFrame:
    """The ``k`` rows of least hash in each group, those where ``first`` holds before the others."""
    hashed = df.withColumn("selection_hash", hash_rank(namespace, *[F.col(c) for c in key]))
    order = [F.desc(F.coalesce(first, F.lit(False)))] if first is not None else []
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order, "selection_hash", *key))
    return hashed.withColumn("group_rank", n).where(F.col("group_rank") <= k)


def hash_subset(df: DataFrame, key: str, k: int = 5, namespace: str = "alpha") -> DataFrame:
    return df.withColumn("subset_hash", F.sha2(F.concat(F.lit(f"{namespace}:"), F.col(key).cast("string")), 256)).orderBy("subset_hash").limit(k)


def _exits(p: np.ndarray, low: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """What a bin of sorted positions from ``low`` on does to the threshold that is let in: (upto, out), where a threshold
    up to ``upto`` (the least such) leaves as ``out``. Which position follows a kept one is a map of places; composed
    with itself until nothing moves, it leads from each place to the last one kept."""
    after = np.searchsorted(p, p + apart)
    last = np.where(after < len(p), after, np.arange(len(p)))
    while (last != last[last]).any():
        last = last[last]
    first = int(np.searchsorted(p, low + apart)) + 1  # no threshold from before reaches further
    upto, out = p[:first], p[last[:first]] + apart
    ends = np.append(out[1:] != out[:-1], True)
    return upto[ends], out[ends]


def spaced(df: DataFrame, *, group: str, pos: str, apart: int, width: int = 1 << 20) -> DataFrame:
    """group, pos of those kept: each at least ``apart`` beyond the one kept before it; the first of a group is.

    Positions are cut into bins of ``width`` (or ``apart``, if that is more). What came before matters to a bin only as
    the least position that it may keep, so a bin is a monotone map from one such threshold to the next, a few rows.
    The maps of a group are composed in order; then each bin keeps its own positions from its threshold on. No row
    or task holds a contig's positions.
    """
    width = max(width, apart)
    kind = dict(df.dtypes)[group]
    rows = df.where(F.col(pos).isNotNull()).select(F.col(group).alias("g"), F.col(pos).cast("long").alias("p")).distinct().withColumn("bin", F.floor(F.col("p") / width))

    def mapped(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        upto, out = _exits(np.sort(own.column("p").to_numpy()), key[1].as_py() * width, apart)
        n = len(upto)
        return pa.table([pa.repeat(key[0], n), pa.repeat(key[1], n), pa.array(upto), pa.array(out)], names=["g", "bin", "upto", "out"])

    def entered(key: tuple[pa.Scalar, ...], maps: pa.Table) -> pa.Table:
        maps = maps.sort_by([("bin", "ascending"), ("upto", "ascending")])
        bins, upto, out = (maps.column(c).to_numpy() for c in ("bin", "upto", "out"))
        starts = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
        threshold, entries = np.iinfo(np.int64).min, []
        for a, b in zip(starts, np.append(starts[1:], len(bins)), strict=True):
            entries.append(threshold)
            at = a + int(np.searchsorted(upto[a:b], threshold))
            threshold = int(out[at]) if at < b else threshold
        return pa.table([pa.repeat(key[0], len(starts)), pa.array(bins[starts]), pa.array(entries, pa.int64())], names=["g", "bin", "entry"])

    def kept(key: tuple[pa.Scalar, ...], own: pa.Table, entry: pa.Table) -> pa.Table:
        p = np.sort(own.column("p").to_numpy())
        after = np.searchsorted(p, p + apart)
        at, out = int(np.searchsorted(p, entry.column("entry")[0].as_py())), []
        while at < len(p):
            out.append(p[at])
            at = after[at]
        return pa.table([pa.repeat(key[0], len(out)), pa.array(out, pa.int64())], names=["g", "p"])

    maps = rows.groupBy("g", "bin").applyInArrow(mapped, f"g {kind}, bin long, upto long, out long")
    entries = maps.groupBy("g").applyInArrow(entered, f"g {kind}, bin long, entry long")
    out = rows.groupBy("g", "bin").cogroup(entries.groupBy("g", "bin")).applyInArrow(kept, f"g {kind}, p long")
    return out.select(F.col("g").alias(group), F.col("p").alias(pos))


def genome_order(df: DataFrame) -> DataFrame:
    from lociscale.operators.contracts import genome_keys

    return df.orderBy(*genome_keys())
