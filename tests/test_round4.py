"""What the fourth round's findings turned up."""

from itertools import combinations

import numpy as np

from lociscale.operators import joins


def written(spark):
    """Rows that the session's stages have put into exchanges."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages, rows = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")()).iterator(), 0
    while stages.hasNext():
        rows += stages.next().shuffleWriteRecords()
    return rows


def test_pairs_of_crowded_positions_take_little_disk(spark, tmp_path):
    """6,000 points on 60 positions: the exchanges hold lists, not a point for each block of a bin, and the 5 million pairs come in
    runs."""
    rows = [(1, int(p), i) for i, p in enumerate(np.random.default_rng(1).integers(0, 60, 6000))]
    df = spark.createDataFrame(rows, "g int, pos long, k long")
    before, out = written(spark), str(tmp_path / "pairs")
    joins.band_pairs(df, group="g", pos="pos", key="k", reach=20).write.parquet(out)
    assert written(spark) - before < 2 * len(rows)
    at = np.bincount([p for _, p, _ in rows], minlength=81)
    pairs = sum(int(at[p]) * (int(at[p]) - 1) // 2 + int(at[p]) * int(at[p + 1 : p + 21].sum()) for p in range(60))
    assert spark.read.parquet(out).count() == pairs
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < pairs


def test_band_pairs_by_blocks_and_lists_match_brute_force(spark):
    """many blocks a bin, several lists a position, negative positions, keys and positions that are null."""
    rng = np.random.default_rng(2)
    rows = [(int(g), int(p), i) for i, (g, p) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(-30, 30, 400), strict=True))]
    df = spark.createDataFrame([*rows, (1, 5, None), (1, 7, None), (1, None, 900), (None, 5, 901)], "g int, pos long, k int")
    got = [(r.g, r.left_pos, r.left_key, r.right_pos, r.right_key, r.distance) for r in joins.band_pairs(df, group="g", pos="pos", key="k", reach=10, most=2, longest=3).collect()]
    want = [(a[0], a[1], a[2], b[1], b[2], b[1] - a[1]) for a, b in combinations(sorted(rows), 2) if a[0] == b[0] and b[1] - a[1] <= 10]
    assert sorted(x for x in got if None not in x) == sorted(want)
    bare = [(g, p, q) for g, p, a, q, b, _ in got if a is None or b is None]
    ones = [p for g, p, _ in rows if g == 1]
    assert sorted(bare) == sorted([(1, 5, 7)] + [(1, p, n) for n in (5, 7) for p in ones if 0 < n - p <= 10] + [(1, n, p) for n in (5, 7) for p in ones if 0 < p - n <= 10])
