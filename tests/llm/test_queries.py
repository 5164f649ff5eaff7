import hashlib
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lociscale.llm")
from tests.conftest import SMALL  # noqa: E402

from lociscale.llm import catalog  # noqa: E402

#: With labels enough to speak of shares.
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, SMALL)
    cols = sorted(found.columns)
    rel = con.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    other = Counter(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())
    assert sorted(names) == cols and Counter(tuple(r) for r in found.select(*cols).collect()) == other


def test_op2_law(spark):
    found = catalog.QUERIES["op2_histogram_sort"](spark, SMALL).collect()
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in found)


def test_op3_recall(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [r.vec_id for r in rows]
    mine = {}
    for r in catalog.QUERIES["op3_hilbert_neighbours"](spark, SMALL).collect():
        mine.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i, q in enumerate(ids):
        if q % 50 == 0:
            s = x @ x[i]
            s[i] = -9
            hits.append(len(mine[q] & {ids[j] for j in np.argsort(-s)[:5]}) / 5)
    assert np.mean(hits) >= 0.9


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as cp
    from tests.llm.test_forest import brute

    assert 4 <= len(cp.STAGES) <= 5 and (cp.ORACLE_SQL is None or isinstance(cp.ORACLE_SQL, str))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, "en", "src1", 0), (90_002, "1234 5678", "en", "src1", 9), (90_003, "only here", None, None, 9)], docs.schema)
    docs = docs.unionByName(extra)
    steps = []
    for name, stage in cp.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps.append(docs)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == cp.COLUMNS
    ids = [Counter(r.doc_id for r in s.collect()) for s in steps]
    assert 90_001 not in ids[0] and 90_002 not in ids[0] and 90_003 in ids[0] and len(ids[0]) == 201
    assert ids[1] == ids[0]
    classes = brute([(r.doc_id, r.text) for r in steps[1].collect()])
    assert ids[2] == Counter({c: 1 for c in {c for _, c, _ in classes}})
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].values()) <= 3
    words = Counter()
    for r in steps[3].collect():
        words[r.doc_id] += len((r.text or "").split())
    packed = Counter()
    for r in steps[4].collect():
        packed[r.doc_id] += r.n_words
    assert packed == words


def odd_documents(spark):
    rows = [(1, None, None, None, None), (None, "words without a key in them", None, "src1", 3), (2, "", "en", None, 0), (3, "many words of text here " * 40_000, "en", "src2", None), (3, "many words of text here " * 40_000, "en", "src2", None)]
    rows += [(10 + i, f"the text of number {i} says this and that", "en", f"src{i % 3}", 9) for i in range(40)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_every_stage_takes_odd_rows_and_empty_tables(spark):
    """Nulls in any column, repeated rows, empty and very long texts; more columns with names of results."""
    import corpus_pipeline as cp

    docs = odd_documents(spark)
    clash = docs.withColumns({c: F.lit("old") for c in ("score", "lang_pred", "n_removed", "class_id", "taken", "bin", "size")})
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SMALL).collect() == []
        found = stage(spark, clash, SMALL)
        rows = found.collect()
        if name != cp.STAGES[-1][0]:
            assert found.columns == cp.COLUMNS
        ids = Counter(r.doc_id for r in rows)
        if name == "language_id":
            assert 1 not in ids and 2 not in ids and ids[3] == 2 and ids[10] == 2 and ids[None] == 1
        elif name == "line_dedup":
            assert sum(ids.values()) == docs.count()
        elif name == "near_duplicates":
            assert ids[1] == ids[2] == ids[3] == ids[None] == ids[10] == 1
        elif name == "source_mix":
            assert ids[1] == ids[2] == 1 and max(ids.values()) <= 6
        else:
            assert set(ids) == {1, None, 2, 3, *range(10, 50)} and sum(r.n_words for r in rows if r.doc_id == 3) == 2 * 200_000


def test_language_stage_against_brute_force(spark):
    import corpus_pipeline as cp
    from tests.llm.test_classifiers import brute_language

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, "en", "src1", 0), (90_002, "1234 5678", "en", "src1", 9), (90_003, "only here", None, None, 9)], docs.schema)
    docs = docs.unionByName(extra)
    expected = brute_language([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    found = {r.doc_id: r.lang for r in cp.language_id(spark, docs, SMALL).collect()}
    assert set(found) == {i for i, (lang, _) in expected.items() if lang != "und"} and found[90_003] == expected[90_003][0]


def test_op5_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = catalog.QUERIES["op5_tiff_pages"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    for r in found:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_op10_contract(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {r.doc_id: r for r in catalog.QUERIES["op10_language_id"](spark, SMALL).collect()}
    learned = {r.lang for r in docs.collect() if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    for r in docs.collect():
        own = found[r.doc_id]
        assert own.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= own.score <= 1
        assert own.lang_pred in learned if r.text and any(c.isalpha() for c in r.text) else own.lang_pred == "und"


def test_op6_flags_what_is_labelled(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    found = {r.doc_id: r for r in catalog.QUERIES["op6_ordinal_toxicity"](spark, LARGER).collect()}
    toxic = [found[i].toxic for i, t in labels.items() if t == 1 and i in found]
    clean = [found[i].toxic for i, t in labels.items() if t == 0 and i in found]
    assert len(toxic) > 30 and sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.05 * len(clean)
    assert all(0 <= r.p_toxic <= r.severity <= 2 and r.toxic == (r.p_toxic >= 0.5) for r in found.values())


def test_control_conversation(spark):
    (r,) = [r for r in catalog.QUERIES["op1_chat_formatting"](spark, SMALL).collect() if r.conv_id == -7]
    assert r.loss_sha256 == hashlib.sha256(catalog.CONTROL.encode()).hexdigest() and r.n_turns == 2
