"""Readers. Everything goes through Spark's own file sources, so any store that Spark reads will do."""

from __future__ import annotations

import base64
import gzip
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociscale.functions.columns import attributes, finite, gene_name
from lociscale.operators.contracts import ContractError, require_columns, require_header
from lociscale.operators.ranks import quota_fill
from lociscale.plans.lineage import numbered
from lociscale.sources.sequences import fasta as fasta

#: Folders (contig and bin) up to which a fetch names them to the scan; of more than these all are read.
NAMED_FOLDERS = 10_000
#: Keys or bins of regions up to which they are broadcast.
BROADCAST_KEYS = 100_000
TAB = {"sep": "\t", "header": True}


def tsv(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, *, required: list[str] | None = None, header: list[str] | None = None) -> DataFrame:
    """A table with a header. Without a schema all columns are strings and empty cells null."""
    read = spark.read.options(**TAB, enforceSchema=False, mode="FAILFAST")
    df = read.schema(schema).csv(path) if schema else read.csv(path)
    if header is not None:
        require_header(df, header, str(path))
    return require_columns(df, required or [], str(path))


def metadata_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV with or without a byte order mark; dashes, NA and text in ``numbers`` are null."""
    df = spark.read.options(header=True, encoding="UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = lambda c: F.when(~F.trim(F.col(c)).isin("—", "-", "NA", ""), F.trim(F.col(c)))
    return df.withColumns({c: finite(missing(c)) if c in numbers else missing(c) for c in df.columns})


def bedgraph(spark: SparkSession, path: str, names: dict[str, str] | None = None, *, excluded: list[str] | None = None) -> DataFrame:
    """chrom, start, end, score of half-open intervals, and ``line``, which ascends in the order of the file;
    blank, track and comment lines are skipped, and so are those of contigs in ``excluded`` (names of the file).

    A line without four fields raises. A gzipped track is one split: convert it to Parquet once.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where("trim(value) <> '' AND NOT startswith(value, 'track') AND NOT startswith(value, '#')")
    if excluded:
        lines = lines.where(~F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).isin(excluded))
    f = F.split(F.trim("value"), r"\s+")
    chrom = F.get(f, F.lit(0))
    if names:
        chrom = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), chrom)
    bad = F.raise_error(F.concat(F.lit("bedGraph line without four fields: "), F.col("value")))
    cell = lambda i: F.when(F.size(f) == 4, F.get(f, F.lit(i))).otherwise(bad.cast("string"))
    return lines.select(chrom.alias("chrom"), cell(1).cast("long").alias("start"), cell(2).cast("long").alias("end"), finite(cell(3)).alias("score"), "line")


def track_counts(intervals: DataFrame) -> DataFrame:
    """chrom, intervals, covered: how many intervals and bases a track has on each contig."""
    return intervals.groupBy("chrom").agg(F.count("*").alias("intervals"), F.sum(F.col("end") - F.col("start")).alias("covered"))


def gff3(spark: SparkSession, path: str) -> DataFrame:
    """seqid, source, type, start, end, score, strand, phase, attributes (map), gene; nine fields or an error."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')")
    f = F.split("value", "\t")
    bad = F.raise_error(F.concat(F.lit("GFF3 line without nine fields: "), F.col("value"))).cast("string")
    cell = lambda i: F.when(F.size(f) == 9, F.get(f, F.lit(i))).otherwise(bad)
    text = [cell(i).alias(n) for i, n in ((0, "seqid"), (1, "source"), (2, "type"))]
    return lines.select(*text, cell(3).cast("long").alias("start"), cell(4).cast("long").alias("end"), *[cell(i).alias(n) for i, n in ((5, "score"), (6, "strand"), (7, "phase"))], attributes(cell(8)).alias("attributes"), gene_name(cell(8)).alias("gene"))


def gff3_pragmas(spark: SparkSession, path: str) -> DataFrame:
    """pragma, values: genome build, accession and sequence regions of a GFF3 file."""
    lines = spark.read.text(path).where("startswith(value, '#!') OR startswith(value, '##')")
    f = F.split(F.trim("value"), r"\s+")
    return lines.select(F.regexp_replace(F.get(f, F.lit(0)), "^#[#!]", "").alias("pragma"), F.slice(f, F.lit(2), F.size(f)).alias("values"))


def contig_lengths(sequence: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """contig, length; raises where ``expected`` says otherwise."""
    out = sequence.groupBy("contig").agg(F.sum(F.length("seq")).alias("length"))
    if expected is not None:
        found = {r["contig"]: r["length"] for r in out.where(F.col("contig").isin(list(expected))).collect()}
        if bad := {k: v for k, v in expected.items() if found.get(k) != v}:
            raise ContractError("sequence", {f"length of {k} is {found.get(k)}, not {v}": 1 for k, v in bad.items()})
    return out


def vcf_sites(spark: SparkSession, path: str, *, passing: bool = True) -> DataFrame:
    """chrom, pos, id, ref, alt, filter, info; with ``passing`` only biallelic single-base PASS sites, as
    predicates on the scan."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("NOT startswith(value, '#') AND value <> ''")
    names = [(0, "chrom"), (2, "id"), (3, "ref"), (4, "alt"), (6, "filter"), (7, "info")]
    out = rows.select(*[F.get(f, F.lit(i)).alias(n) for i, n in names], F.get(f, F.lit(1)).cast("long").alias("pos"), F.slice(f, 10, 1 << 30).alias("calls"))
    if passing:
        out = out.where((F.col("filter") == "PASS") & F.upper("ref").rlike("^[ACGTN]$") & F.upper("alt").rlike("^[ACGTN]$"))
    return out.select("chrom", "pos", "id", "ref", "alt", "filter", "info", "calls")


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    header = spark.read.text(path).where("startswith(value, '#CHROM')").first()
    if header is None:
        raise ContractError(path, {"no header line": 1})
    return header[0].split("\t")[9:]


def _calls(sites: DataFrame, samples: list[str]) -> DataFrame:
    """chrom, pos, ref, alt, sample, gt: one row a call."""
    names = F.array(*map(F.lit, samples)) if samples else F.array().cast("array<string>")
    long = sites.select("chrom", "pos", "ref", "alt", F.explode(F.arrays_zip(names.alias("sample"), F.col("calls").alias("gt"))).alias("c"))
    return long.select("chrom", "pos", "ref", "alt", F.col("c.sample").alias("sample"), F.col("c.gt").alias("gt"))


def vcf_genotypes(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """chrom, pos, ref, alt, sample, gt: one row a call, of the variants in ``keys`` if given (a semi-join
    before calls are exploded)."""
    sites = vcf_sites(spark, path)
    if keys is not None:
        sites = sites.join(keys.select("chrom", "pos", "ref", "alt"), ["chrom", "pos", "ref", "alt"], "left_semi")
    return _calls(sites, vcf_samples(spark, path))


def _pruned(sites: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sites`` (in folders by chrom and bin) of the folders that ``wanted`` (chrom, bin) names, as a filter of the scan."""
    named = wanted.select("chrom", "bin").where("chrom IS NOT NULL AND bin IS NOT NULL").distinct().limit(NAMED_FOLDERS + 1).collect()
    if len(named) > NAMED_FOLDERS:
        return sites
    bins: dict[str, list[int]] = {}
    for chrom, at in named:
        bins.setdefault(chrom, []).append(at)
    hit = F.lit(False)
    for chrom, own in bins.items():
        hit = hit | ((F.col("chrom") == chrom) & F.col("bin").isin(own))
    return sites.where(hit)


def _folder(at: Column, shift: int) -> Column:
    """The bin after which the folder of a bin is named."""
    return F.shiftleft(F.shiftright(at, shift), shift)


def indexed_genotypes(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The calls of the variants in ``keys`` (chrom, pos, ref, alt) from what ``index_vcf`` wrote: only the folders that a
    key's position is in are read, and there the whole key has to be equal. Keys that aren't there give no rows."""
    index = json_document(spark, f"{path}/index.json")
    sites = spark.read.schema(T.StructType.fromJson(index["columns"])).parquet(f"{path}/sites")
    wanted = keys.select(F.col("chrom").cast("string").alias("chrom"), F.col("pos").cast("long").alias("pos"), "ref", "alt", _folder(F.floor(F.col("pos") / index["width"]), index.get("shift", 0)).alias("bin"))
    hit = F.broadcast(wanted) if wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else wanted
    return _calls(_pruned(sites, wanted).join(hit, ["chrom", "bin", "pos", "ref", "alt"], "left_semi"), index["samples"])


def first_readable(*ways: Callable[[], DataFrame]) -> DataFrame:
    """The table of the first of several ways to get it that can be read (a store, then a release, then an
    embedded copy). What the others failed with is raised if none can."""
    failures = []
    for way in ways:
        try:
            df = way()
            df.limit(1).collect()
        except Exception as e:  # noqa: BLE001  whatever a source fails with, the next one is tried
            failures.append(e)
        else:
            return df
    raise ExceptionGroup("no source can be read", failures)


def vcf_quota(spark: SparkSession, path: str, classes: list[tuple[str, Column, int]]) -> DataFrame:
    """The first passing sites of each class in the order of the file, up to its quota, with selection_class and
    ``ordinal``. The order of a folder of files is that of their names. Nothing is stopped early: each class is a
    top-k over the scan, so tasks keep a quota's rows at most."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("__file"), F.monotonically_increasing_id().alias("__at"))
    f = F.split("value", "\t")
    rows = lines.where("NOT startswith(value, '#') AND value <> ''").select("__file", "__at", F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("pos"), F.get(f, F.lit(3)).alias("ref"), F.get(f, F.lit(4)).alias("alt"), F.get(f, F.lit(6)).alias("filter"), F.get(f, F.lit(7)).alias("info"))
    passing = rows.where((F.col("filter") == "PASS") & F.upper("ref").rlike("^[ACGTN]$") & F.upper("alt").rlike("^[ACGTN]$"))
    placed = numbered(passing, "ordinal", "__file", "__at").drop("__file", "__at")
    return quota_fill(placed, classes, ["ordinal"])


def indexed_sites(spark: SparkSession, path: str, regions: DataFrame, *, width: int = 1 << 20) -> DataFrame:
    """The sites of a table that ``write_indexed_sites`` wrote which lie in any of ``regions`` (chrom, start, end,
    1-based, inclusive), each once. Contigs and bins are folders: the regions' are named to the scan, which reads no
    others."""
    found = spark.read.parquet(path).schema
    shift = found["pos"].metadata.get("shift", 0)
    named = F.explode(F.sequence(*[F.shiftright(F.floor(F.col(c) / width), shift) for c in ("start", "end")]))
    wanted = regions.select(F.col("chrom").cast("string").alias("chrom"), named.alias("bin"), "start", "end").withColumn("bin", F.shiftleft("bin", shift))
    schema = T.StructType([T.StructField("chrom", T.StringType()) if f.name == "chrom" else T.StructField(f.name, f.dataType) for f in found])
    sites = _pruned(spark.read.schema(schema).parquet(path), wanted)  # names of contigs stay text, numbers too
    hit = F.broadcast(wanted) if wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else wanted
    met = sites.alias("s").join(hit.alias("r"), (F.col("s.chrom") == F.col("r.chrom")) & (F.col("s.bin") == F.col("r.bin")) & F.col("s.pos").between(F.col("r.start"), F.col("r.end")), "left_semi")
    return met.drop("bin")


def embedded(spark: SparkSession, payload: str) -> DataFrame:
    """A small table from a base64 text of gzipped tab-separated lines, for where no file can be read."""
    lines = gzip.decompress(base64.b64decode(payload)).decode().splitlines()
    names, *rows = [x.split("\t") for x in lines if x]
    return spark.createDataFrame([[v or None for v in r] for r in rows], ", ".join(f"`{n}` string" for n in names))


def json_document(spark: SparkSession, path: str) -> dict:
    """One JSON file, such as a protocol or a completion marker."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def zip_members(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """archive, member, line_number, line of the text members whose names match."""
    wanted = re.compile(pattern)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(m for m in z.namelist() if wanted.fullmatch(m) and not m.endswith("/")):
                        own = z.read(member).decode().splitlines()
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array([member] * len(own), pa.string()), pa.array(range(1, len(own) + 1), pa.int64()), pa.array(own, pa.string())], names=["archive", "member", "line_number", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "archive string, member string, line_number long, line string")


def zip_names(spark: SparkSession, path: str) -> DataFrame:
    """The part of each member's name after its first underscore, distinct and in order."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    own = [m.rsplit("/", 1)[-1].split("_", 1)[-1] for m in z.namelist() if not m.endswith("/")]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], names=["name"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(names, "name string").distinct().orderBy("name")


#: Fixed value: the namespace of spreadsheet XML.
SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _tag(name: str) -> str:
    return f"{SHEET_NS}{name}"


def sheet_rows(content: bytes, number: int) -> list[dict[str, str]]:
    """The non-empty rows of a sheet as maps from column letters to text.

    The sheet is read as a stream of elements, each row let go when it ends. A cell is shared (type ``s``: its
    value numbers an entry of the workbook's strings), inline (``inlineStr``: its text runs), or has its value
    as it stands; a cell without a reference follows the one before it.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings: list[str] = []
        if (part := "xl/sharedStrings.xml") in book.namelist():
            with book.open(part) as f:
                strings = ["".join(t.text or "" for t in entry.iter(_tag("t"))) for _, entry in ElementTree.iterparse(f) if entry.tag == _tag("si")]
        out = []
        with book.open(f"xl/worksheets/sheet{number}.xml") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != _tag("row"):
                    continue
                if own := dict(_cells(row, strings)):
                    out.append(own)
                row.clear()
    return out


def _cells(row: ElementTree.Element, strings: list[str]) -> Iterator[tuple[str, str]]:
    place = 0
    for cell in row.iterfind(_tag("c")):
        letters = re.match("[A-Z]*", cell.get("r", "")).group()
        place = _column_number(letters) if letters else place + 1
        kind, value = cell.get("t", "n"), cell.findtext(_tag("v"))
        if kind == "inlineStr":
            value = "".join(t.text or "" for t in cell.iter(_tag("t")))
        elif kind == "s" and value:
            value = strings[int(value)]
        if value is not None and value != "":
            yield _column_letters(place), value


def _column_number(letters: str) -> int:
    out = 0
    for x in letters:
        out = out * 26 + ord(x) - 64
    return out


def _column_letters(number: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def xlsx(spark: SparkSession, path: str, sheet: int) -> DataFrame:
    """row_number, cells (map from column letter to text) of one sheet."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                own = sheet_rows(content, sheet)
                yield pa.RecordBatch.from_arrays([pa.array(range(1, len(own) + 1), pa.int64()), pa.array([list(x.items()) for x in own], pa.map_(pa.string(), pa.string()))], names=["row_number", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "row_number long, cells map<string,string>")


def dosage_matrix(spark: SparkSession, path: str, samples: int) -> DataFrame:
    """The Parquet form of a dosage matrix: key columns and ``dosages``, an array of -1, 0, 1, 2 for each
    variant; other lengths or values raise."""
    df = spark.read.parquet(path)
    bad = df.where((F.size("dosages") != samples) | F.exists("dosages", lambda x: x.isNull() | ~x.isin(-1, 0, 1, 2))).count()
    if bad:
        raise ContractError(path, {"bad dosage vectors": bad})
    return df
