import random
from collections import Counter

import pytest

pytest.importorskip("lociscale.llm")
from lociscale.llm import packing  # noqa: E402
from tests.conftest import SMALL  # noqa: E402

SCHEMA = "doc_id long, text string, source string, bin string"


def slow_best_fit(items, capacity, per_source):
    """The same by scanning all bins."""
    bins, placed = [], []
    for size, source, cluster in items:
        fits = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins) if size <= capacity - sum(x[0] for x in b) and (cluster not in [x[2] for x in b]) and sum(x[1] == source for x in b) < per_source]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        placed.append((i, sum(x[0] for x in bins[i])))
        bins[i].append((size, source, cluster))
    return placed


def test_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        items = [(rng.randint(1, 20), rng.choice(["a", "b", None]), rng.choice([1, 2, 3, 10 + i])) for i in range(60)]
        items.sort(key=lambda x: -x[0])
        placed, filled = packing.best_fit([(n, {src: 1}, frozenset((c,))) for n, src, c in items], 20, 2)
        assert placed == slow_best_fit(items, 20, 2)
        assert all(sum(s for (s, _, _), (b, _) in zip(items, placed) if b == k) == n for k, n in enumerate(filled))


def test_packs_hold_everything_within_limits(spark):
    rows = [(i, " ".join(["w"] * (i % 90)) + (f" {i}" if i % 3 else ""), f"s{i % 2}" if i % 5 else None, "x") for i in range(900)] + [(9000, "long " * 250, "s1", "x"), (9001, None, None, "x"), (None, "a b", "s0", "x")]
    found = [r.asDict() for r in packing.pack(spark.createDataFrame(rows, SCHEMA), capacity=100, max_per_source=3, block_items=200).collect()]
    words = {}
    bins = {}
    for r in found:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
        if r["bin"] is not None:
            bins.setdefault((r["block"], r["bin"]), []).append(r)
        else:
            assert r["n_words"] == 0
    assert words == {i: len((t or "").split()) for i, t, _, _ in rows}
    for own in bins.values():
        assert sum(r["n_words"] for r in own) == own[0]["bin_words"] <= 100
        assert len({r["cluster"] for r in own}) == len(own)
        assert all(sum(r["source"] == s for r in own) <= 3 for s in {r["source"] for r in own})
        at = 0
        for r in sorted(own, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["n_words"]


def test_bundles_against_brute_force():
    """Items that hold several documents meet the same limits as these would one by one."""
    rng = random.Random(6)
    for _ in range(60):
        items = []
        for i in range(50):
            own = [(rng.choice("abc"), rng.choice([1, 2, 3, 100 + 9 * i + j])) for j in range(rng.randint(1, 4))]
            count = Counter(x for x, _ in own)
            if max(count.values()) <= 2 and len({c for _, c in own}) == len(own):
                items.append((rng.randint(1, 20), own))
        items.sort(key=lambda x: -x[0])
        bins, expected = [], []
        for size, own in items:
            fits = []
            for k, held in enumerate(bins):
                docs = [d for _, ds in held for d in ds]
                room = 20 - sum(n for n, _ in held)
                if size <= room and not {c for _, c in docs} & {c for _, c in own} and max(Counter(x for x, _ in docs + own).values()) <= 2:
                    fits.append((room, k))
            k = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([])
            expected.append((k, sum(n for n, _ in bins[k])))
            bins[k].append((size, own))
        assert packing.best_fit([(n, dict(Counter(x for x, _ in own)), frozenset(c for _, c in own)) for n, own in items], 20, 2)[0] == expected


def test_blocks_exchange_their_open_bins(spark):
    """Small blocks end with open bins; exchanged, they need hardly more bins than one block does."""
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([3, 30, 55, 61, 70])) + f" {i}", f"s{rng.randrange(40)}", "x") for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    bins = lambda **o: len({(r.block, r.bin) for r in packing.pack(df, capacity=100, **o).collect()})
    one, apart, met = bins(block_items=1200), bins(block_items=40, full=0.0), bins(block_items=40)
    assert one <= met < apart and met - one <= (apart - one) // 2


def test_copies_never_share_a_bin_and_parts_are_bounded(spark):
    rows = [(1, "a b c", "s", "")] * 100
    found = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity=10, block_items=10).collect()
    assert len(found) == 100 == len({(r.block, r.bin) for r in found})


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("size", [8, 20, 64])
def test_blocks_and_parts_against_sql(spark, size):
    """Many blocks, and more open bins than one part takes: the query's SQL with blocks of ``size``."""
    import duckdb

    from lociscale.llm.sql import PACKING

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    rel = con.execute(PACKING.replace("BLOCK_ITEMS", str(size)))
    names = [d[0] for d in rel.description]
    want = Counter(rel.fetchall())
    found = packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet"), block_items=size)
    assert Counter(tuple(r[c] for c in names) for r in found.collect()) == want
    moved = {(r.block, r.bin) for r in found.where("bin_offset > 0 AND bin IS NOT NULL").collect()}
    assert len({r.block for r in found.collect()}) > 2 and moved
