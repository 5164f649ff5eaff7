"""Columns of the caller's whose names operators use themselves."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("lociscale.llm")
from lociscale.llm import anchors, divergence, linespread, mixing, sharding  # noqa: E402
from lociscale.llm.common import aside, fresh  # noqa: E402

ODD = ["__size", "__u", "__source", "__time", "__lines", "__kept", "__out", "__h", "__shard", "__k1", "own__u", "___time", "__Text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, None if i % 9 == 0 else f"line of text number {i % 7} and more\nthe same line everywhere in here\nown {i}", f"s{i % 10}", "en") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def rows_of(df, columns):
    return Counter(map(str, df.select(*[f"`{c}`" for c in columns]).collect()))


OPERATORS = {
    "op2": lambda d: sharding.shard_documents(d, shards=3),
    "op7": mixing.mix_sources,
    "op7_documents": mixing.mixed_documents,
    "op8": lambda d: linespread.remove_boilerplate(d, min_sites=3),
    "op8_joined": lambda d: linespread.remove_boilerplate(d, min_sites=3, inline=0),
    "op12": lambda d: anchors.remove_repeats(d, window=4),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_columns_pass_through(docs, name):
    plain = OPERATORS[name](docs)
    odd = docs.withColumns({c: F.concat(F.lit(f"{c} "), "doc_id") for c in ODD})
    found = OPERATORS[name](odd)
    assert set(found.columns) == {*plain.columns, *ODD}
    assert rows_of(found, plain.columns) == rows_of(plain, plain.columns)
    for c in ODD:
        assert found.where(~F.col(f"`{c}`").eqNullSafe(F.concat(F.lit(f"{c} "), "doc_id"))).count() == 0


def test_a_text_may_have_an_odd_name_itself(docs):
    odd = docs.select("doc_id", F.col("text").alias("__lines"), F.col("source").alias("__source"))
    found = linespread.remove_boilerplate(odd, min_sites=3, text="__lines", site="__source")
    plain = linespread.remove_boilerplate(docs.select("doc_id", "text", "source"), min_sites=3)
    assert found.columns == ["doc_id", "__lines", "__source", "n_lines", "n_removed"]
    assert rows_of(found.toDF(*plain.columns), plain.columns) == rows_of(plain, plain.columns)
    assert mixing.mix_sources(odd, text="__lines", source="__source").agg(F.sum("taken")).first() == mixing.mix_sources(docs).agg(F.sum("taken")).first()


def test_op11_reads_no_other_column(docs):
    odd = docs.withColumns({c: F.lit(1) for c in ("run", "span", "count", "term", *ODD[:6])})
    assert rows_of(divergence.audit(odd), ["lang", "source", "part", "item", "value", "rank"]) == rows_of(divergence.audit(docs), ["lang", "source", "part", "item", "value", "rank"])


def test_names_that_are_free(spark):
    df = spark.createDataFrame([(1, 2, 3)], "__a int, own__a int, b int")
    renamed, (a, b), back = aside(df, "__A", "b")
    assert renamed.columns == ["own___a", "own__a", "b"] and (a, b) == ("own___a", "b") and back(renamed).columns == df.columns
    assert fresh(df, "a", "b") == ["___a", "__b"]
