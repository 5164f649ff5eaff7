import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lociscale.llm")
from lociscale.llm import forest  # noqa: E402

SCHEMA = "doc_id long, text string, class_id string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    sets = [None if t is None else shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a is not None and b is not None and (a == b or (a and b and len(a & b) >= 0.8 * len(a | b))):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    classes = {}
    for i, (doc, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(doc)
    names = {k: min((d for d in v if d is not None), default=None) for k, v in classes.items()}
    return sorted(((rows[i][0], names[find(i)], links[i]) for i in range(len(rows))), key=str)


def corpus(groups, copies, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 12, 60, 200]))]
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
            rows.append((len(rows), (" ".join(own)).upper() if rng.random() < 0.2 else " ".join(own)))
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in forest.similarity_classes(df).collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus(60, 14) + [(5000, None), (5001, None), (None, "alone without any key at all"), (5002, ""), (5003, " \n "), (5004, "one"), (5005, "One")]
    rows += rows[:3]
    assert run(spark, rows) == brute(rows)


def test_a_large_group_of_near_copies_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 25)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(150)] = f"x{rng.randrange(100)}"
        rows.append((i, " ".join(own)))
    assert run(spark, rows) == brute(rows)


def test_hot_copies_and_empty_table(spark):
    rows = [(i, "the very same text in every row") for i in range(500)] + [(900, "another one that is alone here")]
    assert run(spark, rows) == sorted([(i, 0, 499) for i in range(500)] + [(900, 900, 0)], key=str)
    assert run(spark, []) == []


def test_lengths_end_where_the_target_is_met():
    for t in (0.8, 0.85, 0.9):
        lengths = forest.prefix_lengths(t, 0.99999)
        assert lengths == list(range(forest.DEPTH, lengths[-1] - 1, -1))
        assert [1 - (1 - t**d) ** forest.TREES >= 0.99999 for d in lengths] == [False] * (len(lengths) - 1) + [True]


def test_sets_stop_at_different_lengths(spark):
    """Near partners end a walk at the full length; weaker ones, or none, send it on to shorter prefixes."""
    rng = random.Random(2)
    texts = []
    for kind, changes in (("near", 1), ("weak", 4), ("alone", 0)):
        for group in range(30):
            base = [f"{kind}{group}_{i}" for i in range(200)]
            texts.append((kind, " ".join(base)))
            for _ in range(3 if changes else 0):
                own = list(base)
                for at in rng.sample(range(10, 190), changes):
                    own[at] = f"y{rng.randrange(10**9)}"
                texts.append((kind, " ".join(own)))
    own = [forest.Shingler()(t) for _, t in texts]
    sets = spark.createDataFrame([(i, bytearray(forest.signature(s).tobytes()), len(s)) for i, s in enumerate(own)], "id long, signature binary, size int")
    met, stops = forest.walk(sets)
    length = {r.id: r.length for r in stops.collect()}
    by_kind = {k: Counter(length.get(i, 4) for i, (x, _) in enumerate(texts) if x == k) for k in ("near", "weak", "alone")}
    assert by_kind["near"][6] > 100 and set(by_kind["alone"]) == {4} and 6 not in by_kind["weak"]
    assert [m.first() is not None for m in met][0]


def test_recall_of_weak_links(spark):
    """Of links at 0.80 to 0.85 nearly all are found."""
    rng = random.Random(9)
    rows = []
    for group in range(150):
        base = [f"g{group}_{i}" for i in range(300)]
        rows.append((len(rows), " ".join(base)))
        own = list(base)
        for at in rng.sample(range(10, 290), rng.choice([5, 6])):
            own[at] = f"z{rng.randrange(10**9)}"
        rows.append((len(rows), " ".join(own)))
    sets = [shingles(t) for _, t in rows]
    weak = [i for i in range(0, len(rows), 2) if 0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) <= 0.85]
    found = {r[0]: r[2] for r in run(spark, rows)}
    assert len(weak) > 60 and sum(found[i] for i in weak) >= 0.99 * len(weak)


def test_each_pair_is_met_once():
    rng = np.random.RandomState(3)
    base = np.unique(rng.randint(0, 1 << 62, 300, dtype=np.int64).astype(np.uint64))
    own = [np.unique(np.where(rng.rand(len(base)) < 0.08, rng.randint(0, 1 << 62, len(base)).astype(np.uint64), base)) for _ in range(30)]
    sig = np.stack([forest.signature(s) for s in own])
    counts = np.zeros((30, 30), dtype=int)
    everyone, one = np.ones(30, dtype=bool), np.zeros(30, dtype=np.int32)
    for length in (6, 5, 4):
        for tree in range(forest.TREES):
            for i, js, _ in forest.meeting(sig, one, everyone, False, tree, length, 0.0):
                counts[i, js] += 1
    assert counts.max() == 1 and counts.sum() > 300


def test_signatures_estimate_similarity():
    rng = np.random.RandomState(1)
    own = rng.randint(0, 1 << 62, 1200, dtype=np.int64).astype(np.uint64)
    a, b = np.unique(own[:1000]), np.unique(own[200:])
    assert abs((forest.signature(a) == forest.signature(b)).mean() - forest.jaccard(a, b)) < 0.15


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(101, 100), (100, 101), (300, 300)]
    found = {r.node: r.root for r in forest.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and found[101] == 100 and 300 not in found


def test_one_row_of_each_class_stays(spark):
    rows = corpus(40, 10, 3) + [(5000, None), (5001, None), (None, "alone without any key at all"), (None, "alone without any key at all"), (None, "some keyed text of six words"), (70, "some keyed text of six words")]
    rows += rows[:5] * 3 + [(7, "another text under a key that is taken already")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)
    found = [(r.doc_id, r.text) for r in forest.one_of_each(df).collect()]
    assert forest.one_of_each(df).columns == df.columns
    assert [r for r in found if r[1] is None].__len__() == 2
    texts = [r for r in rows if r[1] is not None]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(t) for _, t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(texts):
        least.setdefault(find(i), []).append(doc)
    assert sorted((r[0] for r in found if r[1] is not None), key=str) == sorted((min((d for d in v if d is not None), default=None) for v in least.values()), key=str)


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60_000)]
    near = list(base)
    for at in rng.sample(range(60_000), 500):
        near[at] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[:30_000])), (4, "short one"), (5, None)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, id int, sid int, signature string")
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_texts) for r in forest.similarity_classes(df).collect()) == [(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 0, 0), (4, 4, 0, 0), (5, 5, 0, 0)]
    assert forest.one_of_each(df).columns == df.columns and sorted(r.doc_id for r in forest.one_of_each(df).collect()) == [1, 3, 4, 5]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_sweep_finds_the_longest_shared_prefixes(spark, parts):
    """Over any number of parts, of which some are empty, each label's longest prefix that another label of its tree has."""
    rng = np.random.RandomState(parts)
    base = rng.randint(0, 3, (5, forest.TREES * forest.DEPTH)).astype(np.uint16)
    sig = np.concatenate([base, base[:2], rng.randint(0, 3, (20, forest.TREES * forest.DEPTH)).astype(np.uint16), rng.randint(0, 60_000, (4, forest.TREES * forest.DEPTH)).astype(np.uint16)])
    sets = spark.createDataFrame([(i, bytearray(s.tobytes()), i + 1) for i, s in enumerate(sig)], "id long, signature binary, size int")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = {(r.tree, r.id): (r.longest, bytes(r.label), r["size"]) for r in forest.tries(sets, 2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    want = {}
    labels = sig.reshape(len(sig), forest.TREES, forest.DEPTH)
    for t in range(forest.TREES):
        for i in range(len(sig)):
            same = np.logical_and.accumulate(np.delete(labels[:, t], i, axis=0) == labels[i, t], axis=1).sum(axis=1).max()
            if same >= 2:
                want[t, i] = (int(same), labels[i, t].tobytes(), i + 1)
    assert found == want
