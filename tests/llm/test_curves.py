import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lociscale.llm")
from lociscale.llm import curves  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k):
    own = {i: np.asarray(v, float) for i, v in rows}
    out = {}
    for q in queries:
        scores = sorted((-float(own[q] @ v / np.linalg.norm(own[q]) / np.linalg.norm(v)), i) for i, v in own.items() if i != q)
        out[q] = [i for _, i in scores[:k]]
    return out


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours_are_adjacent(dims, bits):
    grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    keys = curves.hilbert(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.RandomState(2)
    centres = rng.randn(40, 16) * (3 if kind == "clustered" else 0)
    x = (rng.randn(3000, 16) + centres[rng.randint(0, 40, 3000)]).astype(np.float32)
    rows = [(i, [float(a) for a in v], "s") for i, v in enumerate(x)]
    found = curves.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k=5).collect()
    truth = brute([(i, v) for i, v, _ in rows], range(0, 3000, 50), 5)
    mine = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        mine.setdefault(r.query_id, []).append(r.vec_id)
        v, w = x[r.query_id].astype(float), x[r.vec_id].astype(float)
        assert abs(r.score - v @ w / np.linalg.norm(v) / np.linalg.norm(w)) < 1e-12
    assert all(len(v) == 5 for v in mine.values()) and len(mine) == 60
    assert np.mean([len(set(mine[q]) & set(truth[q])) / 5 for q in truth]) >= 0.9


def test_ties_copies_and_unusable_vectors(spark):
    same = [(i, [1.0, 2.0], None) for i in range(1, 2001)]
    bad = [(5000, None, None), (5050, [0.0, 0.0], None), (5100, [1.0, None], None), (5150, [float("nan"), 1.0], None), (5200, [float("inf"), 1.0], None), (5250, [1.0], None), (None, [1.0, 2.0], None)]
    rows = same + bad + [(0, [-1.0, 2.0], None), (0, [-1.0, 2.0], None), (100, [-1.0, -2.0], None)]
    found = curves.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k=5).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(by) == {0, *range(50, 2001, 50)}
    assert sorted(by[0]) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]  # a repeat of the query's own row is one candidate
    assert all(sorted(v) == [(i, i) for i in range(1, 6)] for q, v in by.items() if q not in (0, 100))
    assert {v for _, v in by[100]} >= {1, 2, 3} and len(by[100]) == 10  # two queries of one id, by vector


def test_a_row_of_the_querys_id_with_another_vector_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0], None), (0, [1.0, 0.1], None), (3, [0.0, 1.0], None)]
    found = curves.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k=1).collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(0, 0), (0, 0)]


@pytest.mark.parametrize("dim", [2, 24])
def test_each_pair_is_scored_once_and_queries_in_parts(spark, monkeypatch, dim):
    """With little structure few curves are taken, with much more and narrower ones; many parts change nothing."""
    rng = np.random.RandomState(4)
    x = rng.randn(6000, dim)
    rows = [(i, [float(np.float32(a)) for a in v], None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    once = sorted(map(tuple, curves.nearest(df, F.col("vec_id") % 50 == 0, k=5).collect()))
    monkeypatch.setattr(curves, "PART_QUERIES", 10)
    assert sorted(map(tuple, curves.nearest(df, F.col("vec_id") % 50 == 0, k=5).collect())) == once
    truth = brute([(i, np.asarray(v)) for i, v, _ in rows], range(0, 6000, 50), 5)
    mine = {}
    for q, _, i, _ in once:
        mine.setdefault(q, set()).add(i)
    assert np.mean([len(mine[q] & set(truth[q])) / 5 for q in truth]) >= 0.9
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = curves.fit(unit[:3000], np.arange(3000), 6000, curves=16, recall=0.96, k=5, range_rows=20_000, seed=3)
    at = index.ranges(index.keys(unit, np.arange(6000) % 16))
    met = (np.abs(at[:120, None] - at[None]) <= index.reach).any(axis=2)
    assert met.mean() < (0.7 if dim == 2 else 1) and len(index.turns) == 2


def test_few_rows(spark):
    assert curves.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    (r,) = curves.nearest(spark.createDataFrame([(0, [1.0, 0.0], None), (3, [1.0, 1.0], None)], SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert (r.query_id, r["rank"], r.vec_id) == (0, 1, 3)
    assert curves.nearest(spark.createDataFrame([(0, [1.0], None)], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
