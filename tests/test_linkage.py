"""Bit planes, spacing by composed maps, and components from a random range, against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociscale.operators import assoc, ld, ranks


def dosages(seed, loci, samples):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 3, samples)
    out = np.where(rng.random((loci, samples)) < 0.5, base, rng.integers(0, 3, (loci, samples))).astype(object)
    out[rng.random((loci, samples)) < 0.1] = None
    out[0], out[1] = 1, None
    return out.tolist()


@pytest.mark.parametrize("samples", [1, 63, 64, 65, 200])
def test_planes_equal_the_plain_kernel(spark, samples):
    v = dosages(samples, 12, samples)
    pos = [10, 10, 15, 20, 39, 40, 41, 70, 71, 90, 95, 150]
    df = spark.createDataFrame([("c" if i % 5 else None, p, i, x) for i, (p, x) in enumerate(zip(pos, v, strict=True))] + [("d", 1, 50, [3] * samples), ("d", 2, 51, v[3])], "g string, pos long, k int, v array<int>")
    found = {(r.left_key, r.right_key): r for r in ld.dosage_r2(df, group="g", pos="pos", key="k", vector="v", reach=30, least=min(20, samples)).collect()}
    want = {(i, j) for i in range(12) for j in range(i + 1, 12) if i % 5 and j % 5 and pos[j] - pos[i] <= 30} | {(50, 51)}
    assert set(found) == want
    for (i, j), r in found.items():
        a, b = (np.array([np.nan if x is None or x == 3 else x for x in ([3] * samples if k == 50 else v[3] if k == 51 else v[k])], float) for k in (i, j))
        n, r2, status = ld.r2_of(a, b, min(20, samples))
        assert (r.n_complete, r.status) == (n, status) and (r.r2 is None) == (r2 is None) and (r2 is None or r.r2 == pytest.approx(r2, abs=1e-12))


def test_pairs_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("c", i, i, [0, 1, 2]) for i in range(5)], "g string, pos long, k int, v array<int>")
    plan = ld.dosage_r2(df, group="g", pos="pos", key="k", vector="v", reach=3, least=1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def folded(positions, apart):
    out = []
    for p in sorted(set(positions)):
        if not out or p - out[-1] >= apart:
            out.append(p)
    return out


@pytest.mark.parametrize("apart,width", [(1, 5), (7, 7), (7, 50), (50, 10), (50, 1000)])
def test_spacing_equals_the_fold(spark, apart, width):
    rng = np.random.default_rng(apart + width)
    groups = {"a": rng.integers(-300, 3000, 400), "b": rng.integers(0, 100_000, 300), "c": np.arange(0, 2000, apart), None: np.array([5, 5, 6, 900]), "d": np.array([-1])}
    df = spark.createDataFrame([(g, int(p)) for g, own in groups.items() for p in own] + [("a", None)], "g string, p long")
    got = {}
    for r in ranks.spaced(df, group="g", pos="p", apart=apart, width=width).collect():
        got.setdefault(r.g, []).append(r.p)
    assert {g: sorted(p) for g, p in got.items()} == {g: folded(own.tolist(), apart) for g, own in groups.items()}


def test_chain_of_a_million(spark):
    """Every position is exactly as far as it must be from the one before: the first decides on the last."""
    df = spark.range(1_000_000).select(F.lit("1").alias("g"), (F.col("id") * 10).alias("p"))
    both = df.unionByName(df.select("g", (F.col("p") + 5).alias("p")))
    out = ranks.spaced(both, group="g", pos="p", apart=10, width=100_000)
    assert out.agg(F.count("*"), F.max("p"), F.sum(F.col("p") % 10)).first() == (1_000_000, 9_999_990, 0)
    late = both.where("p > 3")
    assert ranks.spaced(late, group="g", pos="p", apart=10, width=100_000).agg(F.min("p"), F.sum("p") % 10).first()[0] == 5


def test_random_range_finds_structured_components(spark):
    rng = np.random.default_rng(8)
    n, d, k = 600, 150, 50
    scores, axes = rng.standard_normal((n, k)) * np.linspace(30, 3, k), np.linalg.qr(rng.standard_normal((d, k)))[0]
    x = scores @ axes.T + 0.01 * rng.standard_normal((n, d)) + rng.standard_normal(d) * 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "key long, v array<double>").repartition(7)
    out = assoc.randomised_components(df, "v", "key", k)
    assert out.dtypes == [("key", "bigint"), ("component", "int"), ("value", "double")]
    wide = out.toPandas().pivot(index="key", columns="component", values="value").sort_index().to_numpy()
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    exact = u[:, :k] * s[:k]
    assert wide.shape == (n, k)
    assert np.allclose(np.linalg.norm(wide, axis=0), s[:k], rtol=1e-6)
    overlap = np.linalg.svd(np.linalg.qr(wide)[0].T @ np.linalg.qr(exact)[0])[1]
    assert overlap.min() > 1 - 1e-6
    assert np.allclose(np.abs(wide), np.abs(exact), atol=1e-3 * s[0])


def test_random_range_of_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0])], "key long, v array<double>")
    wide = assoc.randomised_components(df, "v", "key", 5).toPandas().pivot(index="key", columns="component", values="value").to_numpy()
    assert np.allclose((wide**2).sum(1), 2) and wide.shape == (2, 3)
    assert assoc.randomised_components(df.limit(0), "v", "key", 2).collect() == []


def test_factor_tree_of_many_levels(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 6))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(40)
    r = assoc._factor(df, lambda m: m, 6, fan=3)
    assert np.allclose(r.T @ r, x.T @ x)


def plain_neighbours(rows, k):
    return {a: [o for _, o in sorted((sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), o) for o, w in rows if o != a)][:k] for a, v in rows}


def test_blocks_of_far_clusters_are_ruled_out(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 5)) * 100
    rows = [(int(i), [float(c) for c in centres[i % 12] + rng.standard_normal(5)]) for i in rng.permutation(600)]
    df = spark.createDataFrame([*rows, (10_000, None)], "k long, v array<double>")
    plan = assoc.near_blocks(df, "v", "k", 5, 32).collect()
    met = sum(len(r.targets) for r in plan)
    assert sum(len(r.key) for r in plan) == 600 and met < len(plan) ** 2 / 2
    got = {r.key: r.neighbours for r in assoc.neighbour_sets(df, "v", "k", 5, 32).collect()}
    assert got == plain_neighbours(rows, 5)


@pytest.mark.parametrize("pivots", [1, 3, 2048])
def test_any_number_of_pivots_gives_the_same(spark, monkeypatch, pivots):
    monkeypatch.setattr(assoc, "MOST_PIVOTS", pivots)
    rng = np.random.default_rng(pivots)
    x = rng.integers(-9, 9, (150, 3)).astype(float)  # with ties, and sums that are exact
    x[40:90] = x[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    got = {r.key: r.neighbours for r in assoc.neighbour_sets(spark.createDataFrame(rows, "k long, v array<double>"), "v", "k", 4, 16).collect()}
    assert got == plain_neighbours(rows, 4)


def test_no_rows_and_few_rows(spark):
    empty = spark.createDataFrame([], "k long, v array<double>")
    assert assoc.neighbour_sets(empty, "v", "k").collect() == []
    two = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "k long, v array<double>")
    assert {r.key: r.neighbours for r in assoc.neighbour_sets(two, "v", "k").collect()} == {1: [2], 2: [1]}


def test_rules_from_one_base_rank_as_one_by_one(spark):
    from lociscale.operators import prioritize

    rng = np.random.default_rng(6)
    schema = "gene string, block long, variant_id string, discovery_neglogp double, ld_r2_lead double, tss_distance double, phylop double, context string, heldout_p double, model double"
    rows = [(f"g{i % 4}", i % 2, f"v{i}", float(rng.integers(0, 9)), None if i % 7 == 0 else 0.5, float(rng.integers(-9000, 9000)), None if i % 5 == 0 else float(rng.standard_normal()), "CDS" if i % 3 else "genic", 0.1, None if i % 11 == 0 else float(rng.standard_normal())) for i in range(80)]
    df = spark.createDataFrame(rows, schema)
    family = prioritize.rank_family(df, "model")
    got = {(r.rule, r.variant_id): (round(r.priority, 9) if r.priority is not None else None, r["rank"], r.baseline_rank) for r in family.collect()}
    for name, rule in prioritize.rule_family().items():
        for r in prioritize.rank_candidates(df, "model", rule=rule).collect():
            assert got[name, r.variant_id] == (round(r.priority, 9) if r.priority is not None else None, r["rank"], r.baseline_rank)
    assert len(got) == 9 * 80


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_segments_are_cut_where_no_link_crosses(spark, width):
    rng = np.random.default_rng(width)
    links = [(int(a), int(a + d)) for a, d in zip(rng.integers(0, 190, 60), rng.integers(1, 9, 60), strict=True)]
    nodes = spark.createDataFrame([(i,) for i in range(200)], "i long").repartition(3)
    got = {r.i: r.segment for r in ld.segments(nodes, spark.createDataFrame(links, "l long, r long"), width).collect()}
    want, start, far = {}, 0, -1
    for i in range(200):
        start = start if far >= i else i
        want[i] = start
        far = max([far, *(r for x, r in links if x == i)])
    assert got == want


def test_thinning_of_many_segments_and_a_long_chain(spark):
    """A chain of 1,000 decisions beside pairs; keys that aren't numbers; links to what isn't a node."""
    keys = [f"k{i:05d}" for i in range(2000)]
    links = [(keys[i], keys[i + 1]) for i in range(1000)] + [(keys[i], keys[i + 1]) for i in range(1010, 1990, 3)] + [("a", keys[5]), (keys[7], "z")]
    edges = spark.createDataFrame([("c", a, b, 1, 0.5) for a, b in links], "chrom string, left_key string, right_key string, distance int, r2 double")
    nodes = spark.createDataFrame([("c", k) for k in keys], "chrom string, k string")
    got = {r.k: (r.retained, r.removed_by) for r in ld.greedy_thinning(nodes, edges, key="k", by=["chrom"], local=1500).collect()}
    for i in range(1001):
        assert got[keys[i]] == ((True, None) if i % 2 == 0 else (False, keys[i - 1]))
    assert [got[keys[i + 1]] for i in range(1010, 1990, 3)] == [(False, keys[i]) for i in range(1010, 1990, 3)] and got[keys[1999]] == (True, None)


def excluded(rows, apart):
    """kept of each row, in the order of (order, position), group by group."""
    out, kept = {}, {}
    for g, o, p, i in sorted(rows, key=lambda x: (x[1], x[2], x[3])):
        own = kept.setdefault(g, [])
        out[i] = all(abs(p - q) >= apart for q in own)
        if out[i]:
            own.append(p)
    return out


@pytest.mark.parametrize("local", [50_000, 7, 0])
@pytest.mark.parametrize("apart", [1, 40])
def test_exclusion_in_any_order(spark, apart, local):
    rng = np.random.default_rng(apart)
    rows = [(["a", "b", None][int(g)], int(o), int(p), i) for i, (g, o, p) in enumerate(zip(rng.integers(0, 3, 300), rng.permutation(300), rng.integers(-500, 3000, 300), strict=True))]
    df = spark.createDataFrame(rows, "g string, o int, p long, i int").repartition(4)
    found = ld.exclusion(df, group="g", pos="p", order="o", apart=apart, local=local, most=3)
    assert found.columns == ["g", "o", "p", "i", "kept"]
    assert {r.i: r.kept for r in found.collect()} == excluded(rows, apart)


def test_exclusion_of_copies_and_missing_positions(spark):
    from lociscale.operators import joins, reports

    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 2, None), ("a", None, 9), ("b", 1, 5)], "g string, o int, p long")
    kept = [(r.g, r.o, r.p, r.kept) for r in ld.exclusion(df, group="g", pos="p", order="o", apart=10).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [("a", None, 9, True), ("a", 1, 5, False), ("a", 1, 5, False), ("a", 2, None, True), ("b", 1, 5, True)]))
    both = joins.spaced_exclusion(df.where("o = 1"), group="g", pos="p", order="o", apart=10).collect()
    assert [r.kept for r in both] == [True] * 3
    told = reports.capped_selection(df.where("o = 1"), group="g", pos="p", order="o", apart=10, cap=2).collect()
    assert sorted((r.g, r.status) for r in told) == [("a", "overlapping_window"), ("a", "selected"), ("b", "selected")]
    assert {r.status for r in reports.capped_selection(df, group="g", pos="p", order="o", apart=10, cap=0).collect()} == {"block_full"}


def test_capped_selection_by_turns(spark):
    from lociscale.operators import reports

    rng = np.random.default_rng(4)
    rows = [("ab"[int(g)], int(o), int(p), i) for i, (g, o, p) in enumerate(zip(rng.integers(0, 2, 120), rng.permutation(120), rng.integers(0, 2000, 120), strict=True))]
    want, state = {}, {}
    for g, o, p, _ in sorted(rows, key=lambda x: x[1]):
        own = state.setdefault(g, [])
        want[o] = "block_full" if len(own) >= 6 else "overlapping_window" if any(abs(p - q) < 90 for q in own) else "selected"
        if want[o] == "selected":
            own.append(p)
    df = spark.createDataFrame([r[:3] for r in rows], "g string, o int, p long")
    assert {r.o: r.status for r in reports.capped_selection(df, group="g", pos="p", order="o", apart=90, cap=6).collect()} == want
