"""Every query against its SQL in DuckDB, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lociscale.plans import catalog
from tests.conftest import SMALL

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def text(v):
    return f"{v:.10g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SMALL)
    cols = sorted(found.columns)
    mine = Counter(tuple(map(text, r)) for r in found.select(*[f"`{c}`" for c in cols]).collect())
    if name not in catalog.SQL:
        assert mine
        return
    result = duck.execute(catalog.SQL[name])
    names, kinds = [d[0] for d in result.description], {d[0]: str(d[1]) for d in result.description}
    assert sorted(names) == cols and {c: KINDS[t] for c, t in found.dtypes} == kinds
    assert mine == Counter(tuple(text(r[names.index(c)]) for c in cols) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_neighbour_jaccard_has_every_row(spark):
    found = catalog.QUERIES["neighbour_jaccard"](spark, SMALL)
    assert {r.key for r in found.collect()} == {r.vec_id for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}


def test_reference_report_checks_every_line(spark):
    found = catalog.QUERIES["reference_report"](spark, SMALL)
    assert sum(r.rows for r in found.collect()) == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()


def test_membership_counts_every_order(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    found = catalog.QUERIES["crosswalk_status"](spark, SMALL).collect()
    assert sum(r.right_rows for r in found) == orders.count()
    assert {r.status: r["keys"] for r in catalog.QUERIES["key_set_difference"](spark, SMALL).collect()} == Counter(r.status for r in found)


def test_kinship_has_every_component(spark):
    size = {(i, j) for i in range(64) for j in range(64)}
    assert {(r.i, r.j) for r in catalog.QUERIES["kinship"](spark, SMALL).collect()} == size
    out = catalog.QUERIES["kinship_leave_one_out"](spark, SMALL).collect()
    labels = {r.label for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    assert {(r.label, r.i, r.j) for r in out} == {(g, *x) for g in labels for x in size}
