import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

divergence = pytest.importorskip("lociscale.llm.divergence")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang, source in counts:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        total = Counter()
        for c in groups.values():
            total.update(c)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = share(groups[source]), share(total)
        gain = lambda a, b: (a - b) ** 2 // b
        pairs = [("pair", o, sum(gain(p[t], r[t]) for t in kept)) for o in groups if o != source for r in [share(groups[o])]]
        terms = [("term", t, gain(p[t], q[t])) for t in kept if groups[source][t] and p[t] > q[t]]
        for found, most in ((pairs, None), (terms, top)):
            ordered = sorted(found, key=lambda x: (-x[2], x[1].encode()))[:most]
            out |= {(lang, source, *x, i + 1) for i, x in enumerate(ordered)}
    return out


def documents(n=90):
    words = ["Alpha", "beta", "GAMMA", "delta's", "Äpfel", "äpfel", "x1y", "zeta-eta", "日本", "theta"]
    r = np.random.default_rng(5)
    rows = [(" ".join(r.choice(words, r.integers(0, 12)) if i % 9 else ["rare%s" % chr(97 + i % 26)]), ["en", "de", None, ""][i % 4], [None, "s1", "s2", "S2", "é"][int(r.integers(0, 5))]) for i in range(n)]
    return [*rows, *rows[:5], (None, "xx", "only"), ("", "xx", "too"), ("one two three", "yy", "alone")]


def frame(spark, rows):
    return spark.createDataFrame([(i, *row, 0) for i, row in enumerate(rows)], SCHEMA)


def test_audit_against_brute_force(spark):
    rows = documents()
    docs = frame(spark, rows).withColumns({c: F.lit("mine") for c in ("term", "item", "value", "p", "count", "n", "v")})
    found = divergence.audit(docs)
    assert found.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows))
    assert sorted(map(tuple, divergence.audit(docs, top=2, min_docs=1).collect())) == sorted(brute(rows, 1, 2))


@pytest.mark.parametrize("name,value", [("HELD", 3), ("PART_ROWS", 4), ("CELLS", 7), ("BROADCAST_GROUPS", 1)])
def test_parts_of_any_size(spark, monkeypatch, name, value):
    """Spans, parts and chunks of a few rows, and joins by exchange, in blocks of a source or two."""
    monkeypatch.setattr(divergence, name, value)
    rows = documents(40)
    found = divergence.audit(frame(spark, rows).repartition(3), block=2)
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows))


def test_scan_over_batch_edges():
    import pyarrow as pa

    rows = [(t + b"\0en", g, 1, 2) for t in (b"a", b"b", b"c") for g in (7, 8) for _ in range(3 if t != b"b" else 1)]
    for step in (1, 2, 5, 50):
        batches = [pa.RecordBatch.from_pylist([dict(zip(["run", "g", "docs", "count"], r, strict=True)) for r in rows[i : i + step]]) for i in range(0, len(rows), step)]
        out = [r for b in divergence._scanned(3)(iter(batches)) for r in b.to_pylist()]
        assert [(r["term"], r["g"], r["docs"], r["count"], r["lang_docs"], r["lang_count"], r["first"]) for r in out] == [(t, g, 3, 6, 6, 12, g == 7) for t in (b"a", b"c") for g in (7, 8)]


def test_numbers_of_groups_that_meet_are_dealt_anew(spark, monkeypatch):
    """With a hash of few values the first seeds give two groups one number."""
    plain = divergence._number
    monkeypatch.setattr(divergence, "_number", lambda seed, *names: F.pmod(plain(seed, *names), F.lit(40)))
    rows = documents(40)
    names, seed = divergence.named_groups(frame(spark, rows), "lang", "source")
    numbers = [r.g for r in names.collect()]
    assert seed > 0 and len(set(numbers)) == len(numbers)
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == sorted(brute(rows))


def test_shares_are_exact_in_numpy_and_in_the_plan(spark):
    cases = [(0, 0, 1), (0, 5, 3), (10**12, 3 * 10**12, 7), (9 * 10**15 - 2, 9 * 10**15 - 2, 1), (123_456_789, 987_654_321, 1_000)]
    assert [int(divergence.share(np.int64(c), np.int64(n), np.int64(v))) for c, n, v in cases] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in cases]
    df = spark.createDataFrame(cases, "c long, n long, v long").select(divergence.share_column(F.col("c"), F.col("n"), F.col("v")))
    assert sorted(r[0] for r in df.collect()) == sorted(1 + 10**9 * (c + 1) // (n + v) for c, n, v in cases)


def test_hot_term_and_long_text(spark):
    rows = [("the " * 200_000 + "end", "en", "s1")] + [("the end", "en", f"s{i % 3}") for i in range(60)]
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == sorted(brute(rows))


def test_empty_table(spark):
    assert divergence.audit(frame(spark, [])).collect() == []


def test_ranks_have_no_gaps(spark):
    ranks = defaultdict(list)
    for r in divergence.audit(frame(spark, documents())).collect():
        ranks[r.lang, r.source, r.part].append((r.rank, r.value))
    for own in ranks.values():
        own.sort()
        assert [r for r, _ in own] == list(range(1, len(own) + 1)) and all(a[1] >= b[1] for a, b in pairwise(own))
