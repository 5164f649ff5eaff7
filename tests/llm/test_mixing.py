from collections import defaultdict

import pytest

pytest.importorskip("lociscale.llm")
from lociscale.llm import mixing  # noqa: E402

SCHEMA = "doc_id long, text string, source string, size string, target string"


def fill(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        level = rest / sum(w for s, w in weights.items() if s not in full)
        new = {s for s in names if s not in full and weights[s] * level > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else weights[s] * level for s in names}
        full |= new


@pytest.mark.parametrize("shape", ["even", "capped", "hot"])
def test_targets_and_taken_words(spark, shape):
    words = {"even": lambda s, i: 5 + i % 7, "capped": lambda s, i: 1 if s in ("b", "c") else 40, "hot": lambda s, i: 200 if s == "a" else 3}[shape]
    rows = [(i * 10 + j, " ".join(["w"] * words(s, i)), s, "old", "old") for i in range(60) for j, s in enumerate(["a", "b", "c", "d", None])]
    found = [r.asDict() for r in mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()]
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        assert r["size"] == len(r["text"].split()) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(found) == 300 and all(r["source_size"] == sizes[r["source"]] for r in found)
    expected = fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s], rel=1e-12)
        assert abs(taken[s] - expected[s]) <= 1


def test_reruns_agree_on_other_partitions(spark):
    rows = [(i, "w " * (i % 11), f"s{i % 4}", None, None) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    pick = lambda d: sorted((r.doc_id, r.taken) for r in mixing.mix_sources(d).collect())
    assert pick(df) == pick(df.repartition(13).orderBy("text"))


def test_odd_inputs(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = mixing.mix_sources(spark.createDataFrame([(1, None, "a", None, None), (2, " \t\n", None, None, None)], SCHEMA)).collect()
    assert all((r["size"], r.target, r.taken) == (0, 0.0, 0) for r in blank)
    same = mixing.mix_sources(spark.createDataFrame([(1, "a b c", "s", None, None)] * 7 + [(None, "x y \x1f z", "t", None, None)], SCHEMA)).collect()
    assert len(same) == 8 and {r["size"] for r in same if r.doc_id is None} == {3}


def test_documents_are_repeated(spark):
    rows = [(i, "w " * 10, "big" if i < 80 else "small", "keep", None) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    n = {r.source: r.n for r in out.groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert n == {"big": 40, "small": 60}


def test_a_very_long_document_and_many_sources(spark):
    rows = [(i, "w " * (i % 5 + 1), f"s{i % 700:03d}", None, None) for i in range(2100)] + [(9999, "long " * 200_000, "s000", None, None)]
    found = [r.asDict() for r in mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()]
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    expected = fill(sizes)
    assert len(found) == 2101 and all(target[s] == pytest.approx(expected[s], rel=1e-9) and abs(taken[s] - expected[s]) <= 1 for s in sizes)
