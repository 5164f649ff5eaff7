"""Contracts, comparisons and quotas where values are missing, keys stand alone, rows repeat and names are odd."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociscale.operators import contracts, joins, ranks, stats

ROWS = "a string, b int, c double"


def quota(rows, classes):
    """In turn: of the rows not yet taken, the first that meet a class."""
    taken, out = set(), []
    for name, ok, n in classes:
        own = [i for i, r in enumerate(rows) if i not in taken and ok(r)][:n]
        taken.update(own)
        out += [(*rows[i], name) for i in own]
    return Counter(out)


@pytest.mark.parametrize("seed", range(4))
def test_quotas_against_turns(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, "x", "y"]), r.choice([None, 1, 2, 3]), r.choice([None, 0.5])) for _ in range(40)]
    at = [(*row, i) for i, row in enumerate(rows)]
    df = spark.createDataFrame(at, f"{ROWS}, i int").repartition(3)
    classes = [("few", F.col("b") > 2, 3), ("named", F.col("a") == "x", 6), ("late", F.col("c").isNull() & (F.col("b") < 3), 5), ("any", F.lit(True), 7), ("rest", F.lit(True), 4)]
    plain = [("few", lambda x: x[1] is not None and x[1] > 2, 3), ("named", lambda x: x[0] == "x", 6), ("late", lambda x: x[2] is None and x[1] is not None and x[1] < 3, 5), ("any", lambda x: True, 7), ("rest", lambda x: True, 4)]
    found = ranks.quota_fill(df, classes, ["i"])
    assert found.columns == ["a", "b", "c", "i", "selection_class"]
    assert Counter(map(tuple, found.collect())) == quota(at, plain)


def test_quota_of_repeated_rows_with_nulls(spark):
    df = spark.createDataFrame([(None, 1, None)] * 5, ROWS)
    found = ranks.quota_fill(df, [("rare", F.col("b") == 1, 2), ("any", F.lit(True), 2)], ["b"])
    assert Counter(r.selection_class for r in found.collect()) == {"rare": 2, "any": 2}
    assert ranks.quota_fill(df.limit(0), [("any", F.lit(True), 2)], ["b"]).collect() == []


LEFT = [("k1", 1.0, 1.0), ("k2", None, 1.0), ("k3", 1.0, 1.0), ("k4", None, None), ("k5", float("nan"), 1.0), ("k6", float("inf"), 1.0), ("k7", float("inf"), 1.0), ("only", 1.0, 1.0), (None, 5.0, 1.0)]
RIGHT = [("k1", 1.0, 1.5), ("k2", 2.0, 1.0), ("k3", None, 1.0), ("k4", None, float("nan")), ("k5", None, 1.0), ("k6", float("inf"), 1.0), ("k7", 3.0, 1.0), ("other", 1.0, 1.0), (None, 5.5, 1.0)]


def test_comparison_counts_what_is_missing(spark):
    a, b = (spark.createDataFrame(x, "k string, x double, y double") for x in (LEFT, RIGHT))
    got = {r.column: (r.rows, r.unmatched, r.missing, r.failing) for r in joins.compare_tables(a, b, ["k"], ["x", "y"]).collect()}
    assert got == {"x": (10, 2, 2, 6), "y": (10, 2, 0, 3)}
    rows = {(r.k, r.column): (r.why, r.difference) for r in joins.failing_rows(a, b, ["k"], ["x", "y"]).collect()}
    assert rows == {
        ("k1", "y"): ("difference", 0.5), ("k2", "x"): ("missing_value", None), ("k3", "x"): ("missing_value", None), ("k7", "x"): ("difference", float("inf")), (None, "x"): ("difference", 0.5),
        **{(k, c): ("missing_key", None) for k in ("only", "other") for c in "xy"},
    }


def test_comparison_of_a_table_with_itself_and_with_nothing(spark):
    a = spark.createDataFrame(LEFT, "k string, x double, y double")
    assert joins.failing_rows(a, a, ["k"], ["x", "y"]).collect() == []
    got = {r.column: (r.rows, r.unmatched, r.failing) for r in joins.compare_tables(a, a.limit(0), ["k"], ["x"]).collect()}
    assert got == {"x": (9, 9, 9)}


def test_rules_and_steps_of_any_name(spark):
    df = spark.createDataFrame([(None, 1, None), ("x", None, 2.0)], ROWS)
    rules = {"a isn't there": F.col("a").isNotNull(), 'b "quoted" \\ and so on': F.col("b") > 0, "c's": F.col("c") > 5}
    assert {r.rule: r.rows for r in contracts.violations(df, rules).collect()} == {"a isn't there": 1, 'b "quoted" \\ and so on': 1, "c's": 2}
    steps = stats.funnel(df, {"it's all": F.lit(True), "has 'a'": F.col("a").isNotNull(), "b too": F.col("b") > 0})
    assert steps.dtypes == [("step", "int"), ("name", "string"), ("rows", "bigint")]
    assert list(map(tuple, steps.orderBy("step").collect())) == [(1, "it's all", 2), (2, "has 'a'", 1), (3, "b too", 0)]
    assert {r.rows for r in contracts.violations(df.limit(0), rules).collect()} == {0}
