import hashlib
import math

import pytest
from pyspark.sql import functions as F

from lociscale.functions import columns as C


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("af,expected", [
    (0.2, ("T", "C", 0.2, "alt_minor", False, 1.5, 1.5)),
    (0.9, ("C", "T", 0.1, "ref_minor", True, -1.5, -1.5)),
    (0.5, (None, None, 0.5, "frequency_tie", False, 1.5, None)),
])
def test_orientation(spark, af, expected):
    got = one(spark, C.orient(F.lit("C"), F.lit("T"), F.lit(af), F.lit(1.5)))
    assert tuple(got)[:2] + (round(got.maf, 12),) + tuple(got)[3:] == expected


def test_frequency_classes(spark):
    assert [one(spark, C.frequency_class(F.lit(x))) for x in (0.0, 0.0099, 0.01, 0.0499, 0.05, 0.5)] == ["rare", "rare", "low_frequency", "low_frequency", "common", "common"]


@pytest.mark.parametrize("text,value", [("1.5", 1.5), ("NaN", None), ("inf", None), ("-Infinity", None), ("", None), ("abc", None), ("-2", -2.0)])
def test_finite(spark, text, value):
    assert one(spark, C.finite(F.lit(text))) == value


def test_booleans(spark):
    assert [one(spark, C.parse_bool(F.lit(x))) for x in (" True", "1", "YES", "no", "0", "false", "t", "")] == [True, True, True, False, False, False, None, None]
    assert [one(spark, C.parse_bool(F.lit(x), strict=True)) for x in ("TRUE", "1")] == [True, None]


def test_tolerances_differ(spark):
    assert one(spark, C.near(F.lit(1.1), F.lit(1.0), atol=0.0, rtol=0.1)) is not None
    assert not one(spark, C.near(F.lit(1.0), F.lit(0.9), atol=0.0, rtol=0.1001))
    assert one(spark, C.close(F.lit(1.0), F.lit(0.9), rel=0.1001))


@pytest.mark.parametrize("gt,value", [("0|1", 1), ("1/1:99:3", 2), ("0/0", 0), ("./1", None), ("./.", None), ("0", None), ("0/2", None), ("0/1/1", None)])
def test_dosage(spark, gt, value):
    assert one(spark, C.dosage(F.lit(gt))) == value


def test_sequences(spark):
    assert one(spark, C.reverse_complement(F.lit("acgtN"))) == "NACGT"
    assert one(spark, C.reverse_complement_iupac(F.lit("ACRYN"))) == "NRYGT"
    seq = F.lit("ACGTACGTAC")
    assert one(spark, C.padded_context(seq, F.lit(1), 6, 2)) == "NNACGT"
    assert one(spark, C.padded_context(seq, F.lit(10), 6, 2)) == "TACNNN"
    assert one(spark, C.padded_context(F.lit("AC"), F.lit(1), 8, 3)) == "NNNACNNN"
    assert one(spark, C.inner_context(seq, F.lit(3), 6)) == "ACGTAC"
    assert one(spark, C.inner_context(seq, F.lit(2), 6)) is None and one(spark, C.inner_context(seq, F.lit(8), 6)) is None
    assert one(spark, C.inner_context(seq, F.lit(4), 6, 3)) == "ACGTAC"
    assert [one(spark, C.reference_matches(seq, F.lit(p), F.lit("c"))) for p in (2, 3, 0, 11)] == [True, False, False, False]
    assert one(spark, C.substituted(seq, F.lit(2), F.lit("T"))) == "ACTTACGTAC"
    assert one(spark, C.difference_position(F.lit("ACGT"), F.lit("ACCT"))) == 3
    assert one(spark, C.difference_position(F.lit("ACGT"), F.lit("TCCT"))) is None and one(spark, C.difference_position(F.lit("ACGT"), F.lit("ACG"))) is None


def test_oligos(spark):
    hit = lambda s, o, **k: one(spark, C.oligo_hit(F.lit(s), F.lit(o), **k))
    assert tuple(hit("TTTACGGTTT", "ACGG")) == ("+", 4)
    assert tuple(hit("TTTCCGTTTT", "ACGG")) == ("-", 4)
    assert hit("ACGGACGG", "ACGG") is None and hit("GGGG", "ACGG") is None
    assert tuple(hit("ACGGCCGTCCGT", "ACGG")) == ("+", 1) and hit("ACGGCCGTCCGT", "ACGG", strict=True) is None
    assert hit("AAAA", "AAA") is None


def test_model_arithmetic(spark):
    logits = F.array(*[F.lit(x) for x in (1.0, 2.0, 0.5, -1.0)])
    p = one(spark, C.log_softmax(logits))
    assert sum(math.exp(x) for x in p) == pytest.approx(1)
    assert one(spark, C.log_ratio(C.log_softmax(logits), F.lit("A"), F.lit("T"))) == pytest.approx(-2)
    assert one(spark, C.log_ratio(C.log_softmax(logits), F.lit("N"), F.lit("T"))) is None
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, C.transfer_magnitude(arr(0, 1), arr(1, 1))) == pytest.approx(math.log(2) / 2)
    assert one(spark, C.central(arr(1, 2, 3, 4), 2)) == [2.0, 3.0]
    assert one(spark, C.central(arr(1, 2, 3), 2)) is None and one(spark, C.central(arr(1, -2, 3, 4), 2)) is None and one(spark, C.central(arr(1), 2)) is None
    assert one(spark, C.tokens(F.lit("AcNT"), F.lit(1))) == [3, 1, 2, 6]
    assert one(spark, C.one_hot(F.lit("GN"))) == [[0.0, 0.0, 1.0, 0.0], [0.0] * 4]


def test_hashes(spark):
    assert one(spark, C.hash_rank("ns", F.lit("a"), F.lit(3))) == hashlib.sha256(b"ns|a|3").hexdigest()
    h = int(hashlib.sha256(b"G1").hexdigest()[:8], 16) % 10
    assert one(spark, C.discovery_side(F.lit("G1"))) == ("discovery" if h < 7 else "heldout")
    assert one(spark, C.cache_key(F.lit("ACG"), {"b": 1, "a": 2})) == hashlib.sha256(b'ACG{"a": 2, "b": 1}').hexdigest()


def test_places_and_labels(spark):
    assert [one(spark, C.physical_bin(F.lit("1"), F.lit(p), 50_000)) for p in (1, 50_000, 50_001)] == ["1:1", "1:1", "1:2"]
    assert one(spark, C.tss_distance(F.lit(90), C.tss(F.lit(10), F.lit(100), F.lit("-")), F.lit("-"))) == 10
    assert [one(spark, C.edge_padded(F.lit(p), F.lit(1000), 512)) for p in (256, 257, 745, 746)] == [True, False, False, True]
    assert one(spark, C.substitution_class(F.lit("A"), F.lit("C"))) == "T>G" and one(spark, C.substitution_class(F.lit("C"), F.lit("A"))) == "C>A"
    assert one(spark, C.gene_context(F.lit(False), F.lit(True), F.lit(True))) == "exonic_non_cds"
    assert one(spark, C.locus_context(F.lit(False), F.lit(False), F.lit(True))) == "genic"
    m = one(spark, C.attributes(F.lit("ID=g%3B1;Name=a+b;Note=x=y;bad")))
    assert m == {"ID": "g;1", "Name": "a+b", "Note": "x=y"}
    assert tuple(one(spark, C.split_variant_id(F.lit("1:55:A:T")))) == ("1", 55, "A", "T")
    assert one(spark, C.masked(F.lit("ACGTACGT"), F.array(F.struct(F.lit(2).alias("start"), F.lit(3).alias("end")), F.struct(F.lit(7).alias("start"), F.lit(8).alias("end"))))) == "ANNTACNN"
    w = one(spark, C.regulatory_window(F.lit(10_000), F.lit(20_000), F.lit("-")))
    assert (w.promoter.start, w.promoter.end, w.terminator.start, w.terminator.end, w.reversed) == (18_801, 25_000, 5_000, 11_199, True)
    assert one(spark, C.reasons((F.lit(True), "a"), (F.lit(False), "b"), (F.lit(True), "c"))) == "a;c"
    assert [one(spark, C.shortlist_change(F.lit(b), F.lit(r))) for b, r in ((3, 2), (9, 5), (5, 6), (6, 6))] == ["retained", "entered", "left", "outside"]
    assert [one(spark, C.coverage_status(F.lit(c), F.lit(m))) for c, m in ((True, False), (True, True), (False, True))] == ["covered", "CDS_masked", "outside_windows"]
