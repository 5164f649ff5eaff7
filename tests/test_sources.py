import gzip
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lociscale.operators.contracts import ContractError
from lociscale.sources import readers, writers
from lociscale.streaming import scores


def test_tsv_contracts(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("chrom\tpos\tscore\n1\t5\t\n01\t6\t2.5\n")
    df = readers.tsv(spark, str(tmp_path / "a.tsv"), required=["chrom"])
    assert [r.chrom for r in df.collect()] == ["1", "01"] and df.where("score IS NULL").count() == 1
    assert readers.tsv(spark, str(tmp_path / "a.tsv"), "chrom string, pos long, score double").agg(F.sum("pos")).first()[0] == 11
    with pytest.raises(ContractError):
        readers.tsv(spark, str(tmp_path / "a.tsv"), required=["alt"])
    with pytest.raises(ContractError):
        readers.tsv(spark, str(tmp_path / "a.tsv"), header=["pos", "chrom", "score"])


def test_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿ID,Name,Latitude\n1,—,48.5\n2,B,NA\n".encode())
    got = readers.metadata_csv(spark, str(tmp_path / "m.csv"), ["Latitude"]).collect()
    assert [tuple(r) for r in got] == [("1", None, 48.5), ("2", "B", None)]


def test_tracks_and_annotations(spark, tmp_path):
    with gzip.open(tmp_path / "t.bg.gz", "wt") as f:
        f.write("track type=bedGraph\n#c\n\nChr1 0 10 -1.5\nChr1\t10\t20\t2\n")
    got = readers.bedgraph(spark, str(tmp_path / "t.bg.gz"), {"Chr1": "1"}).collect()
    assert [tuple(r)[:4] for r in got] == [("1", 0, 10, -1.5), ("1", 10, 20, 2.0)] and got[0].line < got[1].line
    assert readers.bedgraph(spark, str(tmp_path / "t.bg.gz"), excluded=["Chr1"]).count() == 0
    assert [tuple(r) for r in readers.track_counts(readers.bedgraph(spark, str(tmp_path / "t.bg.gz"))).collect()] == [("Chr1", 2, 20)]
    (tmp_path / "bad.bg").write_text("Chr1 0 10\n")
    with pytest.raises(Exception, match="four fields"):
        readers.bedgraph(spark, str(tmp_path / "bad.bg")).collect()
    with gzip.open(tmp_path / "a.gff.gz", "wt") as f:
        f.write("##gff-version 3\n#!genome-build B1\n##sequence-region c1 1 900\nc1\ts\tgene\t5\t90\t.\t-\t.\tID=g1;Name=AT1G01010;note=a%20b\n")
    r = readers.gff3(spark, str(tmp_path / "a.gff.gz")).first()
    assert (r.type, r.start, r.end, r.strand, r.gene, r.attributes["note"]) == ("gene", 5, 90, "-", "AT1G01010", "a b")
    pragmas = {r.pragma: r["values"] for r in readers.gff3_pragmas(spark, str(tmp_path / "a.gff.gz")).collect()}
    assert pragmas["genome-build"] == ["B1"] and pragmas["sequence-region"] == ["c1", "1", "900"]


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1 first\nacgt\nAC\n>c2\nTTTT\n>c3\nGG\n")
    got = readers.fasta(spark, str(tmp_path / "r.fa"), ["c1", "c3"], chunk=4)
    assert sorted(map(tuple, got.collect())) == [("c1", 0, "ACGT"), ("c1", 1, "AC"), ("c3", 0, "GG")]
    assert readers.contig_lengths(got, {"c1": 6}).count() == 2
    with pytest.raises(ContractError, match="c3"):
        readers.contig_lengths(got, {"c3": 5})


VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\t.\tA\tC\t.\tPASS\t.\tGT\t0|1\t1|1\n1\t6\t.\tA\tC,T\t.\tPASS\t.\tGT\t0|1\t.\n1\t7\t.\tAT\tC\t.\tPASS\t.\tGT\t0\t0\n1\t8\t.\tG\tC\t.\tq10\t.\tGT\t0|0\t0|1\n1\t9\t.\tG\tT\t.\tPASS\t.\tGT\t./.\t0|1\n"


def test_vcf(spark, tmp_path):
    (tmp_path / "v.vcf").write_text(VCF)
    assert [r.pos for r in readers.vcf_sites(spark, str(tmp_path / "v.vcf")).collect()] == [5, 9]
    assert readers.vcf_sites(spark, str(tmp_path / "v.vcf"), passing=False).count() == 5
    keys = spark.createDataFrame([("1", 9, "G", "T")], "chrom string, pos long, ref string, alt string")
    got = readers.vcf_genotypes(spark, str(tmp_path / "v.vcf"), keys).collect()
    assert sorted((r["sample"], r.gt) for r in got) == [("s1", "./."), ("s2", "0|1")]


def workbook():
    out = io.BytesIO()
    ns = readers.SHEET_NS.strip("{}")
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row/><row><c r="AB3" t="s"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_and_archives(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook())
    assert [r.cells for r in readers.xlsx(spark, str(tmp_path / "w.xlsx"), 1).orderBy("row_number").collect()] == [{"A": "name", "C": "2.5"}, {"AB": "ab", "AC": "in"}]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/1_two_x.txt", "l1\nl2\n")
        z.writestr("d/2_one.txt", "m1")
    assert [r.line for r in readers.zip_members(spark, str(tmp_path / "z.zip"), r".*_two_x\.txt").orderBy("line_number").collect()] == ["l1", "l2"]
    assert [r.name for r in readers.zip_names(spark, str(tmp_path / "z.zip")).collect()] == ["one.txt", "two_x.txt"]


def test_writers_refuse_and_verify(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, ["b", "a"], None), (2, None, [], "x")], "k int, v double, s array<string>, t string")
    first = writers.write_table(df, str(tmp_path / "t"))
    assert first == writers.table_digest(df.repartition(3)) and first["rows"] == 2
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_table(df, str(tmp_path / "t"))
    assert readers.tsv(spark, str(tmp_path / "t")).orderBy("k").first().v == "0.1"
    assert writers.write_checked(df, str(tmp_path / "p")).count() == 2
    writers.write_json(spark, {"b": 1, "a": None}, str(tmp_path / "j.json"))
    assert readers.json_document(spark, str(tmp_path / "j.json")) == {"a": None, "b": 1}
    with pytest.raises(FileExistsError):
        writers.write_json(spark, {}, str(tmp_path / "j.json"))
    with pytest.raises(ValueError):
        writers.write_json(spark, {"a": float("nan")}, str(tmp_path / "k.json"))
    kept, digest = writers.withheld(df, ["v"])
    assert "v" not in kept.columns and digest["rows"] == 2
    assert writers.markdown(df.select("k", "v")).splitlines()[2] == "| 1 | 0.1 |"
    with pytest.raises(ContractError, match="more than 200 rows"):
        writers.markdown(spark.range(201))
    assert len(writers.markdown(spark.range(200)).splitlines()) == 202
    ordered = writers.write_checked(spark.range(1000).repartition(7), str(tmp_path / "o"), ["id"])
    assert ordered.where("id <> ordinal").count() == 0 and ordered.count() == 1000


def test_resuming(spark, tmp_path):
    df = spark.range(5)
    t = writers.ResumableTable(spark, str(tmp_path / "r"), {"model": 1})
    assert not t.done("chr1")
    assert t.write("chr1", df).count() == 5 and t.done("chr1")
    assert t.write("chr1", spark.range(99)).count() == 5
    with pytest.raises(ContractError, match="other inputs"):
        writers.ResumableTable(spark, str(tmp_path / "r"), {"model": 2}).done("chr1")
    df.write.parquet(str(tmp_path / "r/chr2/data"))
    with pytest.raises(ContractError, match="half-written"):
        t.done("chr2")


def test_manifests(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data/a.tsv").write_text("k\n1\n")
    (tmp_path / "data/b.txt").write_text("notes")
    writers.write_manifest(spark, str(tmp_path))
    listed = readers.json_document(spark, str(tmp_path / "manifest.json"))["files"]
    assert {n: (e["bytes"], e["sha256"]) for n, e in listed.items()} == {f"data/{n}": (len(t), hashlib.sha256(t.encode()).hexdigest()) for n, t in (("a.tsv", "k\n1\n"), ("b.txt", "notes"))}
    tables = writers.load_verified(spark, str(tmp_path))
    assert list(tables) == ["a"] and tables["a"].count() == 1
    (tmp_path / "data/a.tsv").write_text("k\n2\n")
    with pytest.raises(ContractError, match="checksum data/a.tsv"):
        writers.load_verified(spark, str(tmp_path))
    (tmp_path / "data/a.tsv").unlink()
    with pytest.raises(ContractError, match="missing file data/a.tsv"):
        writers.load_verified(spark, str(tmp_path))
    for name in ("../x", "/etc/x", "file:x", "data/../../x"):
        with pytest.raises(ContractError, match="unsafe path"):
            writers.verify_manifest(spark, str(tmp_path), {"files": {name: {"sha256": "0"}}})


def test_written_vcf_is_in_genome_order(spark, tmp_path):
    rows = [("10", 3, "A", "C"), ("2", 7, "G", "T"), ("2", 7, "A", "T"), ("2", 7, "A", "C"), ("Mt", 1, "A", "C"), ("1", 900, "G", "T"), ("1", 30, "G", "T"), ("2", 70, "A", "C"), ("2", 8, "A", "C")]
    df = spark.createDataFrame([(*r, "PASS") for r in rows], "chrom string, pos long, ref string, alt string, filter string")
    writers.write_vcf(df.repartition(5), str(tmp_path / "o"), ["##fileformat=VCFv4.2", "##second"])
    lines = [x for f in sorted((tmp_path / "o").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[:2] == ["##fileformat=VCFv4.2", "##second"] and lines[2].startswith("#CHROM\tPOS")
    assert [(c[0], int(c[1]), c[3], c[4]) for c in (x.split("\t") for x in lines[3:])] == sorted(rows, key=lambda r: (not r[0].isdigit(), int(r[0]) if r[0].isdigit() else 0, r))
    assert readers.vcf_sites(spark, str(tmp_path / "o")).count() == 9


def test_markers_are_held_before_parts_are_joined(spark, tmp_path):
    t = writers.ResumableTable(spark, str(tmp_path / "r"), {"model": 1})
    t.write("b", spark.range(3))
    t.write("a", spark.range(2))
    assert sorted((r.id, r.shard) for r in t.whole(["b", "a"]).collect()) == [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "b")]
    with pytest.raises(ContractError, match="part c is missing"):
        t.whole(["a", "c"])
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "r/a/data"))
    with pytest.raises(ContractError, match="changed since"):
        t.whole(["a", "b"])


def test_fallback_chain(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("k\n1\n")
    gone, there = (lambda: readers.tsv(spark, str(tmp_path / "gone.tsv"))), (lambda: readers.tsv(spark, str(tmp_path / "a.tsv")))
    assert readers.first_readable(gone, there).count() == 1
    with pytest.raises(ExceptionGroup):
        readers.first_readable(gone, gone)


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    head = "chrom\tpos\tref\talt\taf_alt\tscore\n"
    (folder / "a.tsv").write_text(head + "".join(f"1\t{i}\tA\tC\t0.{i % 9 + 1}\t1.5\n" for i in range(30)))
    (folder / "b.tsv").write_text(head + "".join(f"2\t{i}\tA\tC\t0.2\t1.5\n" for i in range(30)))
    stream = scores.score_files(spark, str(folder), files_per_trigger=1)
    query = scores.oriented(stream).writeStream.format("memory").queryName("oriented").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(120)
    assert spark.table("oriented").count() == 60 and spark.table("oriented").where("orientation = 'frequency_tie'").count() == 3
    scores.keep_bottom_k(stream, 7, "ns", str(tmp_path / "k"), str(tmp_path / "c2")).awaitTermination(120)
    from lociscale.operators.ranks import bottom_k

    batch = spark.read.schema(scores.SCHEMA).options(sep="\t", header=True).csv(str(folder))
    expected = {r.selection_hash for r in bottom_k(batch, 7, "ns", "chrom", "pos", "ref", "alt").collect()}
    assert {r.selection_hash for r in spark.read.parquet(str(tmp_path / "k/batch=1")).collect()} == expected


def test_repeated_keys_of_a_stream_take_one_place(spark, tmp_path):
    from lociscale.operators.ranks import bottom_k

    folder = tmp_path / "in"
    folder.mkdir()
    head = "chrom\tpos\tref\talt\taf_alt\tscore\n"
    rows = [f"1\t{i}\tA\tC\t0.2\t1.5\n" for i in range(20)]
    (folder / "a.tsv").write_text(head + "".join(rows))
    keys = spark.read.schema(scores.SCHEMA).options(sep="\t", header=True).csv(str(folder))
    expected = {r.pos for r in bottom_k(keys, 5, "ns", "chrom", "pos", "ref", "alt").collect()}
    least = min(expected, key=lambda p: next(r.selection_hash for r in bottom_k(keys, 20, "ns", "chrom", "pos", "ref", "alt").collect() if r.pos == p))
    (folder / "a.tsv").write_text(head + "".join(rows) + rows[least] * 5)
    stream = scores.score_files(spark, str(folder))
    scores.keep_bottom_k(stream, 5, "ns", str(tmp_path / "k"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r.pos for r in spark.read.parquet(str(tmp_path / "k/batch=0")).collect()) == sorted(expected)


def test_embedded_tables_and_stable_archives(spark, tmp_path):
    import base64

    payload = base64.b64encode(gzip.compress(b"chrom\tpos\n1\t5\n2\t\n")).decode()
    assert [tuple(r) for r in readers.embedded(spark, payload).collect()] == [("1", "5"), ("2", None)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/b").write_text("x")
    (tmp_path / "d/e").mkdir()
    (tmp_path / "d/e/a").write_text("y" * 100_000)
    writers.write_zip(spark, str(tmp_path / "d"), str(tmp_path / "1.zip"))
    (tmp_path / "d/b").touch()
    writers.write_zip(spark, str(tmp_path / "d"), str(tmp_path / "2.zip"))
    assert (tmp_path / "1.zip").read_bytes() == (tmp_path / "2.zip").read_bytes()
    with zipfile.ZipFile(tmp_path / "1.zip") as z:
        assert z.namelist() == ["b", "e/a"] and z.read("e/a") == b"y" * 100_000 and z.read("b") == b"x"
    with pytest.raises(FileExistsError):
        writers.write_zip(spark, str(tmp_path / "d"), str(tmp_path / "1.zip"))


def test_fetches_open_only_the_folders_of_their_keys(spark, tmp_path):
    """All other files of the table are spoilt: reading any of them would fail."""
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
    rows = [(c, p, r, a) for c in ("01", "1", "X") for p, r, a in ((5, "A", "C"), (5, "A", "G"), (1_500, "G", "T"), (9_999, "C", "T"))]
    (tmp_path / "v.vcf").write_text(head + "".join(f"{c}\t{p}\t.\t{r}\t{a}\t.\tPASS\t.\tGT\t0|{i % 2}\t./.\n" for i, (c, p, r, a) in enumerate(rows)))
    writers.index_vcf(spark, str(tmp_path / "v.vcf"), str(tmp_path / "i"), width=1_000)
    keys = spark.createDataFrame([("01", 5, "A", "G"), ("01", 5, "A", "T"), ("X", 1_500, "G", "T"), ("Y", 5, "A", "C")], "chrom string, pos long, ref string, alt string")
    for f in (tmp_path / "i" / "sites").glob("*/*/*.parquet"):
        if f"{f.parent.parent.name}/{f.parent.name}" not in ("chrom=01/bin=0", "chrom=X/bin=1"):
            f.write_bytes(b"no table")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    found = readers.indexed_genotypes(spark, str(tmp_path / "i"), keys)
    want = [(c, p, r, a, s, g) for i, (c, p, r, a) in enumerate(rows) if (c, p, r, a) in (("01", 5, "A", "G"), ("X", 1_500, "G", "T")) for s, g in (("s1", f"0|{i % 2}"), ("s2", "./."))]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    with pytest.raises(Exception, match="(?i)parquet"):
        readers.indexed_genotypes(spark, str(tmp_path / "i"), keys.unionByName(spark.createDataFrame([("1", 5, "A", "C")], keys.schema))).collect()


def test_regions_keep_numbers_as_names(spark, tmp_path):
    sites = spark.createDataFrame([("01", 5), ("1", 5), ("1", 2_500)], "chrom string, pos long")
    writers.write_indexed_sites(sites, str(tmp_path / "t"), width=1_000)
    regions = spark.createDataFrame([("1", 1, 3_000)], "chrom string, start long, end long")
    assert sorted(map(tuple, readers.indexed_sites(spark, str(tmp_path / "t"), regions, width=1_000).select("chrom", "pos").collect())) == [("1", 5), ("1", 2_500)]


def test_archive_is_what_the_plain_module_writes(spark, tmp_path):
    members = {"a.txt": b"text\n" * 5_000, "b/naïve.bin": bytes(range(256)) * 40, "c": b"x"}
    for name, content in members.items():
        (tmp_path / "d" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / name).write_bytes(content)
    writers.write_zip(spark, str(tmp_path / "d"), str(tmp_path / "out.zip"))
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        for name in sorted(members):
            entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            entry.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(entry, members[name])
    assert (tmp_path / "out.zip").read_bytes() == plain.getvalue()
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == members
