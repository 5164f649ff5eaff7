"""FASTA by byte ranges and the store of chunks, against plain strings."""

import random

import pytest
from pyspark.sql import functions as F

from lociscale.functions import columns as C
from lociscale.operators.contracts import reference_report
from lociscale.sources import readers
from lociscale.sources.sequences import beside, fasta, fasta_pieces, lengths, sequence_store


def serial(text):
    """name, sequence of each record, read line by line."""
    out, name = [], None
    for line in text.splitlines():
        if line.startswith(">"):
            name = (line[1:].split() or [""])[0]
            out.append([name, ""])
        elif name is not None:
            out[-1][1] += line.strip().upper()
    return [tuple(x) for x in out]


@pytest.fixture
def ranges(spark):
    """Byte ranges of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def joined(df, by=("contig",)):
    rows = df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("s"))
    return sorted((r[0], r.s) for r in rows.collect())


@pytest.mark.parametrize("seed", range(3))
def test_ranges_that_cut_records(spark, ranges, tmp_path, seed):
    r = random.Random(seed)
    text = "lost before any record\n" if seed else ""
    for i in range(25):
        seq = "".join(r.choice("acgtN") for _ in range(r.choice([0, 1, 59, 60, 61, 700, 2500])))
        width = r.choice([7, 60])
        text += f">r{i} of {seed}\n" + "".join(seq[j : j + width] + r.choice(["\n", "\r\n", " \n"]) for j in range(0, len(seq), width))
    (tmp_path / "g.fa").write_bytes(text.encode())
    want = sorted(x for x in serial(text) if x[1])
    pieces = fasta_pieces(spark, str(tmp_path / "g.fa"))
    assert spark.read.text(str(tmp_path / "g.fa")).rdd.getNumPartitions() > 10
    assert joined(fasta(spark, str(tmp_path / "g.fa"), chunk=100)) == want
    for row in pieces.collect():
        assert dict(serial(text))[row.contig][row.at :].startswith(bytes(row.seq).decode())
    for row in fasta(spark, str(tmp_path / "g.fa"), ["r3", "r7"], chunk=64, halo=10).collect():
        whole = dict(want)[row.contig]
        low, high = max(0, row.chunk * 64 - 10), min(len(whole), row.chunk * 64 + 74)
        assert row.contig in ("r3", "r7") and row.start == low and row.seq == whole[low:high]


def test_one_record_by_many_tasks(spark, ranges, tmp_path):
    r = random.Random(9)
    seq = "".join(r.choice("ACGT") for _ in range(200_000))
    (tmp_path / "one.fa").write_text(">big\n" + "\n".join(seq[i : i + 80] for i in range(0, len(seq), 80)))
    pieces = fasta_pieces(spark, str(tmp_path / "one.fa"))
    assert pieces.count() > 500
    assert joined(fasta(spark, str(tmp_path / "one.fa"), chunk=1000)) == [("big", seq)]


def test_files_names_and_compression(spark, tmp_path):
    import gzip

    (tmp_path / "a.fa").write_text(">x one\nAC\nGT\n>y\n\n>z\nTT")
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(b">x two\nGGGG\n>\nA\n"))
    rows = sorted(map(tuple, readers.fasta(spark, str(tmp_path), chunk=3).collect()))
    assert rows == [("", 0, "A"), ("x", 0, "ACG"), ("x", 0, "GGG"), ("x", 1, "G"), ("x", 1, "T"), ("z", 0, "TT")]
    assert readers.contig_lengths(readers.fasta(spark, str(tmp_path / "a.fa"))).where("contig = 'x' AND length = 4").count() == 1


@pytest.mark.parametrize("width,halo", [(10, 12), (10, 25), (64, 12), (1000, 12)])
def test_windows_are_those_of_the_contig(spark, width, halo):
    r = random.Random(width)
    contigs = {"c1": "".join(r.choice("ACGT") for _ in range(95)), "c2": "A", "c3": "".join(r.choice("ACGT") for _ in range(40)), "c4": "", "c5": None}
    store = sequence_store(spark.createDataFrame(list(contigs.items()), "chrom string, seq string"), width=width, halo=halo)
    assert {x.chrom: x.length for x in lengths(store).collect()} == {"c1": 95, "c2": 1, "c3": 40}
    v = spark.createDataFrame([(c, p) for c in [*contigs, None, "none"] for p in [None, -1, *range(100)]], "chrom string, pos long")
    at = (F.col("pos") - F.col("chunk_start")).cast("int")
    inside = at <= F.length("chunk_seq")
    found = beside(v, store, width=width).select("chrom", "pos", F.when(inside, C.padded_context(F.col("chunk_seq"), at, 12, 5)).alias("padded"), F.when(inside, C.inner_context(F.col("chunk_seq"), at, 12)).alias("inner"))
    rows = found.collect()
    assert len(rows) == v.count()
    for x in rows:
        seq = contigs.get(x.chrom) or ""
        if x.pos is None or not 1 <= x.pos <= len(seq):
            assert x.padded is None and x.inner is None
        else:
            whole = "N" * 12 + seq + "N" * 12
            assert x.padded == whole[x.pos + 12 - 6 : x.pos + 12 + 6]
            assert x.inner == (seq[x.pos - 6 : x.pos + 6] if x.pos >= 6 and x.pos + 6 <= len(seq) else None)


def test_report_on_either_form(spark):
    v = spark.createDataFrame([("1", "2", "c"), ("1", "3", "A"), ("1", "9", "A"), ("1", "0", "A"), ("1", None, "A"), ("2", "1", "A"), (None, "1", "A")], "chrom string, pos string, ref string")
    whole = spark.createDataFrame([("1", "ACGTAC")], "chrom string, seq string")
    for given in (whole, sequence_store(whole, width=2, halo=3)):
        got = {r.outcome: (r.rows, r.examples) for r in reference_report(v, given, width=2).collect()}
        assert got == {"match": (1, ["1:2:c"]), "mismatch": (1, ["1:3:A"]), "out_of_bounds": (3, ["1:0:A", "1:9:A", "1:A"]), "mapping": (2, ["1:A", "2:1:A"])}


def test_no_row_holds_a_contig(spark):
    big = spark.createDataFrame([("1", "ACGT" * 50_000)], "chrom string, seq string")
    store = sequence_store(big, width=1000, halo=100)
    assert store.agg(F.max(F.length("seq"))).first()[0] == 1200 and store.count() == 200
