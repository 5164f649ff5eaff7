import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

anchors = pytest.importorskip("lociscale.llm.anchors")


def brute(texts, window):
    """Per text: number of words, of words removed, and what is kept."""
    split = [[] if t is None else t.encode().split() for t in texts]
    times = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for t, w in zip(texts, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), None if t is None else b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def texts(seed=3, n=60):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz é")
    say = lambda k: " ".join(word() for _ in range(k))
    shared = [say(k) for k in (34, 35, 36, 60, 90, 200)]
    out = [None, "", "  \t\n", "one", "a " * 34, "b " * 35, "c " * 36, shared[3], shared[3], shared[1], shared[0], shared[0] + "  end", "x y " + shared[1]]
    for _ in range(n):
        parts = [say(r.randrange(0, 50)) for _ in range(3)]
        parts.insert(r.randrange(4), r.choice(shared))
        if r.random() < 0.3:
            parts.insert(r.randrange(5), r.choice(shared))
        out.append(r.choice(["\n", " ", " \x0b"]).join(parts))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


@pytest.mark.parametrize("window", [35, 6, 1])
def test_against_brute_force(spark, window):
    rows = texts()
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in anchors.remove_repeats(frame(spark, rows), window=window).collect()}
    assert [found[i] for i in range(len(rows))] == brute(rows, window)


def test_across_spans_tasks_and_joins(spark, monkeypatch):
    """A span for each document or two, no broadcast: what is met is met across tasks."""
    rows = texts(8)
    monkeypatch.setattr(anchors, "SPAN", 150)
    monkeypatch.setattr(anchors, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(anchors, "WORDS", 20)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in anchors.remove_repeats(frame(spark, rows).repartition(7)).collect()}
    assert [found[i] for i in range(len(rows))] == brute(rows, 35)


def test_spans_are_maximal_and_columns_pass_through(spark):
    words = [f"w{i}" for i in range(200)]
    passage = " ".join(f"p{i}" for i in range(51))
    docs = spark.createDataFrame([(1, " ".join(words[:20]) + " " + passage + " tail", "mine", 5), (2, passage + " other", "mine", 6), (3, " ".join(words), None, None)], "doc_id long, text string, kept string, __spans int")
    rows = {r.doc_id: r for r in anchors.remove_repeats(docs).collect()}
    assert anchors.remove_repeats(docs).columns == ["doc_id", "text", "__spans", "kept", "n_words", "n_removed", "removed"]
    assert [(s.low, s.high) for s in rows[1].removed] == [(20, 71)] and rows[1].kept == " ".join([*words[:20], "tail"]) and rows[1]["__spans"] == 5
    assert rows[2].kept == "other" and rows[3].n_removed == 0 and rows[3].removed == [] and rows[3].text == " ".join(words)


def test_many_copies_long_texts_and_empty_tables(spark):
    rows = ["same text all over " * 10] * 300 + [" ".join(f"word{i}" for i in range(50_000))] * 2 + [" ".join(f"once{i}" for i in range(50_000))]
    found = anchors.remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed").collect()
    assert Counter((r.n_words, r.n_removed) for r in found) == {(40, 40): 300, (50_000, 50_000): 2, (50_000, 0): 1}
    assert anchors.remove_repeats(frame(spark, [])).collect() == []


def test_rolling_hashes_tell_windows_apart():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, 400, dtype=np.uint64)
    for size in (1, 2, 3, 18, 35, 400):
        own = anchors.rolling(h, size)
        assert len(own) == 401 - size == len(set(own.tolist()))
        shifted = anchors.rolling(np.concatenate([h[7:], h]), size)
        assert (shifted[: max(0, len(own) - 7)] == own[7:]).all()
    assert len(anchors.rolling(h, 401)) == 0
    swapped = h.copy()
    swapped[[3, 19]] = swapped[[19, 3]]
    assert anchors.rolling(swapped, 35)[0] != anchors.rolling(h, 35)[0]


def test_batches_cut_runs(spark):
    docs = frame(spark, texts(5)).withColumn("n", F.lit(1))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r.doc_id: r.n_removed for r in anchors.remove_repeats(docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [found[i] for i in range(len(found))] == [x[1] for x in brute(texts(5), 35)]
