"""Both jobs as a user runs them: on copies of tables, twice, with input that grows between runs."""

import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from jobs import catalog, population_benchmark, score_ledger
from jobs.common import configuration
from tests.conftest import ROOT, SMALL


def rows_of(df):
    return Counter(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, SMALL)
    cols = sorted(found.columns)
    result = con.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    assert {c: kinds[t] for c, t in found.dtypes} == {d[0]: str(d[1]) for d in result.description}
    assert Counter(map(tuple, found.select(*cols).collect())) == Counter(tuple(r[names.index(c)] for c in cols) for r in result.fetchall())


LEDGER = configuration(None, None, score_ledger.__file__)
SEQUENCES = "doc_id long, text string, source string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SEQUENCES).coalesce(1).write.mode("append").parquet(folder)


def test_ledger_takes_only_what_is_new(spark, tmp_path):
    given, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    one = "acgt " * 10
    put(spark, given, [(5, one, "a"), (3, one, None), (1, None, "a"), (2, "gattaca", "b"), (7, "ttta" * 9, "b")])
    assert score_ledger.run(spark, given, out, mark, LEDGER) == {"read": 5, "batches": 1}
    first = score_ledger.output(spark, given, out, LEDGER)
    status = {r.doc_id: (r.status, r.first_id, r.scored_in) for r in first.collect()}
    assert status == {5: ("scored", "3", 0), 3: ("scored", "3", 0), 1: ("no_sequence", None, None), 2: ("too_short", None, None), 7: ("scored", "7", 0)}
    before = rows_of(first)

    assert score_ledger.run(spark, given, out, mark, LEDGER) == {"read": 0, "batches": 0}
    assert rows_of(score_ledger.output(spark, given, out, LEDGER)) == before

    put(spark, given, [(0, one, "c"), (9, "ccgg" * 6, "c"), (9, "ccgg" * 6, "c")])
    assert score_ledger.run(spark, given, out, mark, LEDGER) == {"read": 3, "batches": 1}
    after = score_ledger.output(spark, given, out, LEDGER)
    assert not before - rows_of(after)  # what was there stays as it was
    new = [r for r in after.collect() if r.batch == 1]
    assert Counter((r.doc_id, r.status, r.first_id, r.scored_in) for r in new) == {(0, "cached", "3", 0): 1, (9, "scored", "9", 1): 2}
    assert after.select("key").where("key IS NOT NULL").distinct().count() == spark.read.parquet(f"{out}/scores").count() == 3


def test_ledger_batch_that_is_run_again_replaces_what_it_wrote(spark, tmp_path):
    """As Spark does after a failure: the same batch with the same rows."""
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "acgt" * 8, "a"), (2, "ttga" * 8, "a")], SEQUENCES)
    more = spark.createDataFrame([(3, "acgt" * 8, "b"), (4, "ccga" * 8, "b")], SEQUENCES)
    rows.write.parquet(str(tmp_path / "in"))
    take = score_ledger.take(out, LEDGER)
    take(rows, 0)
    take(more, 1)
    before = rows_of(score_ledger.output(spark, str(tmp_path / "in"), out, LEDGER))
    take(more, 1)
    take(rows, 0)
    assert rows_of(score_ledger.output(spark, str(tmp_path / "in"), out, LEDGER)) == before and len(before) == 4


def test_ledger_of_the_whole_equals_one_that_grew(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = str(tmp_path / "in")
    for k in range(3):
        docs.where(f"doc_id % 3 = {k}").coalesce(1).write.mode("append").parquet(given)
        score_ledger.run(spark, given, str(tmp_path / "out"), str(tmp_path / "mark"), LEDGER)
    grown = score_ledger.output(spark, given, str(tmp_path / "out"), LEDGER)
    whole = catalog.QUERIES["job2_score_ledger"](spark, SMALL)
    same = ["doc_id", "source", "n_letters", "key", "score", "side"]
    assert rows_of(grown.select(*same)) == rows_of(whole.select(*same))
    assert {r.batch for r in grown.select("batch").distinct().collect()} == {0, 1, 2}


def test_ledger_scores_by_hand(spark):
    import math

    rows = spark.createDataFrame([(1, "AaC-g" * 5, "x")], SEQUENCES)
    (r,) = score_ledger.scored(score_ledger.items(rows, LEDGER), "sequence", LEDGER["model"], 9).collect()
    m = {k: math.log(p) - math.log(q) for k, (p, q) in LEDGER["model"].items()}
    assert r.n_letters == 20 and r.score == round((10 * m["a"] + 5 * m["c"] + 5 * m["g"]) / 20, 9)


def test_benchmark_reasons_and_rerun(spark, tmp_path):
    config = configuration(spark, None, population_benchmark.__file__) | {"columns": {c: c for c in ("chrom", "pos", "ref", "alt", "af_alt", "score")}, "carry": {}}
    rows = [("1", 5, "A", "C", 0.004, -1.0), ("1", 6, "A", "C", 0.03, 2.0), ("1", 7, "G", "T", 0.7, 2.5), ("2", 5, "A", "C", 0.5, 1.0), ("2", 8, "T", "A", 0.2, -3.0)]
    rows += [(None, 1, "A", "C", 0.1, 1.0), ("1", 9, "AT", "C", 0.1, 1.0), ("1", 9, "C", "C", 0.1, 1.0), ("1", 10, "A", "G", 0.1, None), ("1", 11, "A", "G", float("nan"), 1.0), ("1", 12, "A", "G", 1.0, 1.0), ("3", 1, "A", "G", 0.1, 1.0), ("3", 1, "A", "G", 0.2, 1.0)]
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, af_alt double, score double").write.parquet(given)
    assert population_benchmark.run(spark, given, out, config) == {"read": 13, "variants": 13, "summary": 4}
    found = population_benchmark.output(spark, given, out, config)
    assert Counter(r.reason for r in found.collect()) == {"eligible": 5, "malformed": 1, "noncanonical": 1, "no_change": 1, "no_score": 1, "no_frequency": 1, "nonpolymorphic": 1, "duplicate_key": 2}
    own = {(r.chrom, r.pos): r for r in found.where("reason = 'eligible'").collect()}
    assert own["1", 7].score_minor_vs_major == -2.5 and own["1", 7].minor_allele == "G" and own["2", 5].score_minor_vs_major is None and own["2", 8].median == -3.0 and own["1", 5].spearman == -0.5
    before = rows_of(found)
    population_benchmark.run(spark, given, out, config)
    assert rows_of(population_benchmark.output(spark, given, out, config)) == before


def test_exact_medians(spark):
    import statistics

    from lociscale.operators.ranks import medians

    groups = {"a": [1.0], "b": [1.0, 2.0], "c": [3.0, 3.0, 9.0, 9.0], "d": [5.0, 1.0, 7.0, None], "e": [2.0] * 7 + [8.0] * 7, "f": [None]}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, x double")
    assert {r.g: r.median for r in medians(df, "x", ["g"]).collect()} == {g: statistics.median(x for x in v if x is not None) for g, v in groups.items() if g != "f"}


def test_configuration_is_read_by_spark(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"digits": 3}))
    assert configuration(spark, str(tmp_path / "c.json"), "") == {"digits": 3}


@pytest.mark.parametrize("job,args", [("population_benchmark", ["--variants", f"{SMALL}/lineitem.parquet"]), ("score_ledger", ["--sequences", f"{SMALL}/documents.parquet", "--checkpoint", "{}/mark"])])
def test_command_line(tmp_path, job, args):
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *[a.format(tmp_path) for a in args], "--out", f"{tmp_path}/out"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f" {job} read " in done.stderr and "wrote" in done.stderr and list(Path(tmp_path, "out").glob("*/*"))


def test_jobs_import_nothing_of_the_optional_parts():
    for p in [*Path(ROOT, "jobs").glob("*.py"), Path(__file__)]:
        assert "lociscale" + ".llm" not in p.read_text() and "import corpus" + "_pipeline" not in p.read_text()
