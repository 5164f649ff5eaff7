"""Ranks at any skew, permutations by arithmetic, and medians down a tree of counts."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociscale.operators import ranks, resample


def test_cells_are_even_wherever_values_lie(spark):
    """One value far below, and 20,000 within twenty of a million: a thousandth of the range holds all but one."""
    x = [0.5, *(1_000_000 + 20 * i / 20_000 for i in range(20_000))]
    counts = spark.createDataFrame([(v,) for v in x], "x double").groupBy("x").agg(F.count("*").alias("n"))
    sizes = Counter(r[0] for r in ranks.value_cells(counts, "x", []).select("__cell").collect())
    assert len(sizes) == 64 and max(sizes.values()) < 1.5 * 20_001 / 64


def test_cells_ascend_and_groups_stand_alone(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g, scale in (("a", 1e-6), ("b", 1e9), ("c", 1.0)) for v in rng.standard_normal(700) * scale] + [("d", 1.0), ("e", float("inf")), ("e", float("-inf")), ("e", 0.0), (None, 3.0), (None, 2.0)]
    counts = spark.createDataFrame(rows, "g string, x double").groupBy("g", "x").agg(F.count("*").alias("n"))
    for _, own in ranks.value_cells(counts, "x", ["g"]).toPandas().groupby("g"):
        own = own.sort_values("x")
        assert (np.diff(own["__cell"]) >= 0).all() and own["__cell"].between(0, 63).all()


@pytest.mark.parametrize("kind", ["long", "double", "int"])
def test_ranks_of_groups_against_pandas(spark, kind):
    rng = np.random.default_rng(3)
    df = pd.DataFrame({"g": rng.integers(0, 4, 3000), "x": np.where(rng.random(3000) < 0.4, 7, rng.integers(-50, 2000, 3000) ** 3 % 1_000_003)})
    own = spark.createDataFrame(df).select("g", F.col("x").cast(kind).alias("x"))
    got = ranks.average_ranks(own, "x", ["g"]).toPandas().sort_values(["g", "x"])
    want = df.assign(r=df.groupby("g")["x"].rank()).sort_values(["g", "x"])
    assert np.allclose(got["rank"], want["r"])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 100, 1000, 4097])
def test_places_are_permuted(n):
    for r in range(3):
        out = resample.permuted(np.arange(n), n, "seed", r, "s")
        assert sorted(out) == list(range(n))
        parts = np.concatenate([resample.permuted(np.arange(n)[i::3], n, "seed", r, "s") for i in range(3)])
        assert sorted(parts) == list(range(n))
    if n >= 16:
        first, second = (resample.permuted(np.arange(n), n, "seed", r, "s") for r in (0, 1))
        assert (first != second).any() and (first != np.arange(n)).any()


def test_permutations_are_even():
    """Where a place goes is spread evenly over replicates, and so are pairs of places."""
    n, times = 12, 6000
    at = np.array([resample.permuted(np.arange(n), n, "even", r, "s") for r in range(times)])
    for i in range(n):
        share = np.bincount(at[:, i], minlength=n) / times
        assert abs(share - 1 / n).max() < 0.02
    assert abs((at[:, 0] < at[:, 1]).mean() - 0.5) < 0.03 and abs((at[:, 5] < at[:, 9]).mean() - 0.5) < 0.03


def test_permutation_p_against_direct_draws(spark, monkeypatch):
    rng = np.random.default_rng(4)
    s, x = rng.integers(0, 3, 90), rng.standard_normal(90)
    y = x * 0.25 + rng.standard_normal(90) + s
    df = spark.createDataFrame([(None if g == 2 else int(g), i, float(a), float(b)) for i, (g, a, b) in enumerate(zip(s, x, y, strict=True))], "s int, k int, x double, y double").repartition(3)
    args = {"stratum": "s", "key": "k", "replicates": 800, "seed": "q"}
    found = resample.stratified_permutation(df, "x", "y", **args).first()
    rx, ry = pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy()
    rho = np.corrcoef(rx, ry)[0, 1]
    direct = []
    for _ in range(4000):
        p = ry.copy()
        for g in range(3):
            p[s == g] = rng.permutation(p[s == g])
        direct.append(abs(np.corrcoef(rx, p)[0, 1]) >= abs(rho))
    assert found.observed == pytest.approx(rho) and abs(found.p - np.mean(direct)) < 0.05 and 0 < found.p < 1
    monkeypatch.setattr(resample, "GATHERED", 0)
    args["replicates"] = 50
    some = resample.stratified_permutation(df, "x", "y", **args).first()
    monkeypatch.setattr(resample, "GATHERED", 1000)
    assert tuple(resample.stratified_permutation(df, "x", "y", **args).first()) == pytest.approx(tuple(some))


@pytest.mark.parametrize("shape", ["even", "ties", "pair", "one"])
def test_medians_down_the_tree_are_distributed_as_drawn_ones(spark, shape):
    rng = np.random.default_rng(5)
    x = {"even": np.exp(rng.standard_normal(901)), "ties": rng.integers(0, 6, 300).astype(float), "pair": np.array([1.0, 2.0]), "one": np.array([4.0])}[shape]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(3)
    found = resample.order_bootstrap(df, "x", replicates=1500, seed="t")
    own = np.sort([r.estimate for r in found.collect()])
    direct = np.sort([np.median(rng.choice(x, len(x))) for _ in range(6000)])
    assert len(own) == 1500
    grid = np.unique(direct)
    gap = abs(np.searchsorted(own, grid, "right") / len(own) - np.searchsorted(direct, grid, "right") / len(direct)).max()
    assert gap < 0.06, gap  # Kolmogorov's distance; 0.06 is beyond one chance in a thousand
    assert [r.estimate for r in resample.order_bootstrap(df.repartition(5), "x", replicates=1500, seed="t").orderBy("replicate").collect()] == [r.estimate for r in found.orderBy("replicate").collect()]


def test_tree_of_no_rows(spark):
    assert resample.order_bootstrap(spark.createDataFrame([], "x double"), "x", replicates=5, seed="t").collect() == []
