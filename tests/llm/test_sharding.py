import hashlib
import zlib

import pytest

pytest.importorskip("lociscale.llm")
from lociscale.llm import sharding  # noqa: E402

SCHEMA = "doc_id long, text string, shard string, SLOT int"


def shards(df, **options):
    return [r.asDict() for r in sharding.shard_documents(df, **options).collect()]


def test_bytes_are_near_equal_and_slots_gapless(spark):
    rows = [(i, "x" * (i * 37 % 300) + str(i % 500), "old", 1) for i in range(3000)]
    found = shards(spark.createDataFrame(rows, SCHEMA), shards=8, rows_per_range=100)
    assert sorted(r["doc_id"] for r in found) == list(range(3000))
    texts = {r[0]: r[1] for r in rows}
    total = {}
    for r in found:
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None and r["text"] == texts[r["doc_id"]]
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    assert set(total) == set(range(8)) and max(total.values()) - min(total.values()) <= 2 * 305
    for k in total:
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(sum(r["shard"] == k for r in found)))


def test_a_group_of_copies_is_cut_and_stays_together(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}", None, None) for i in range(1200)]
    found = shards(spark.createDataFrame(rows, SCHEMA), shards=6)
    sizes = [sum(r["size"] for r in found if r["shard"] == k) for k in range(6)]
    assert max(sizes) - min(sizes) <= 20
    hot = {r["shard"] for r in found if r["text"] == "same"}
    assert max(hot) - min(hot) == len(hot) - 1 < 5


def test_identical_rows_are_spread(spark):
    found = shards(spark.createDataFrame([(7, "one row", None, None)] * 800, SCHEMA), shards=8)
    assert sorted(sum(r["shard"] == k for r in found) for k in range(8)) == [100] * 8


def test_odd_inputs(spark):
    assert shards(spark.createDataFrame([], SCHEMA)) == []
    found = shards(spark.createDataFrame([(None, None, None, None), (1, "", None, None), (1, "é" * 50_000, None, None)], SCHEMA), shards=2, keep=["doc_id"])
    assert sorted(r["size"] for r in found) == [1, 1, 100_001]
    assert {r["text_crc32"] for r in found if r["size"] == 1} == {0}


def test_more_shards_than_rows(spark):
    found = shards(spark.createDataFrame([(1, "a", None, None), (2, "bb", None, None)], SCHEMA), shards=8)
    assert len(found) == 2 and all(0 <= r["shard"] < 8 for r in found)


def brute(rows, shards):
    """doc_id to shard, by sorting all rows and cutting at the nearest row to each even part of the bytes."""
    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    own = sorted((0 if t is None else h(t), h("" if i is None else str(i)), len((t or "").encode()) + 1, str(i)) for i, t, *_ in rows)
    total, upto, out = sum(r[2] for r in own), 0, []
    for *_, size, i in own:
        cuts = [total * k // shards for k in range(1, shards)]
        out.append((i, sum(upto >= c or (upto + size > c and c - upto <= upto + size - c) for c in cuts)))
        upto += size
    return sorted(out)


@pytest.mark.parametrize("shards_", [2, 5, 8])
def test_against_brute_force(spark, shards_):
    rows = [(i, f"text {i} " * (i % 13), None, None) for i in range(700)] + [(1000 + i, "a copy", None, None) for i in range(400)] + [(None, None, None, None)] * 3 + [(7, "x" * 30_000, None, None)] * 2
    found = shards(spark.createDataFrame(rows, SCHEMA), shards=shards_, rows_per_range=40)
    assert sorted((str(r["doc_id"]), r["shard"]) for r in found) == brute(rows, shards_)
    for k in range(shards_):
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(sum(r["shard"] == k for r in found)))


def test_parts_grow_with_a_group_of_copies(spark):
    """Copies of one text fill a range; it is cut into as many parts as they need, and slots stay gapless."""
    rows = [(i, "the same text", None, None) for i in range(3000)]
    found = shards(spark.createDataFrame(rows, SCHEMA), shards=2, rows_per_range=100)
    assert sorted((str(r["doc_id"]), r["shard"]) for r in found) == brute(rows, 2)
    assert all(sorted(r["slot"] for r in found if r["shard"] == k) == list(range(1500)) for k in (0, 1))
