"""Writers: atomic, refusing to overwrite, with markers and manifests that a reader can verify."""

from __future__ import annotations

import hashlib
import io
import json
import math
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociscale.operators.contracts import ContractError
from lociscale.plans.lineage import numbered


def table_digest(df: DataFrame) -> dict:
    """rows and an order-free digest of all values: equal tables, equal digests, at any partitioning."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = df.agg(F.count("*"), F.sum(h)).first()
    return {"rows": n, "sha256": hashlib.sha256(str(total or 0).encode()).hexdigest()}


def write_table(df: DataFrame, path: str, *, digits: int = 17, partition_by: list[str] | None = None) -> dict:
    """Tab-separated with a header; doubles with ``digits`` significant digits (17: the shortest text that
    reads back as the same double). Fails if ``path`` exists; files appear only when the job commits."""
    shown = lambda c: F.col(c).cast("string") if digits >= 17 else F.format_string(f"%.{digits}g", c)
    text = [shown(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    flat = [F.array_join(F.col(c), "|").alias(c) if t == "array<string>" else x for (c, t), x in zip(df.dtypes, text, strict=True)]
    df.select(*flat).write.mode("errorifexists").options(sep="\t", header=True, emptyValue="").csv(path)
    return table_digest(df)


def write_checked(df: DataFrame, path: str, order: list[str] | None = None) -> DataFrame:
    """Parquet, read again and held against what was written; with ``order`` (columns that tell all rows
    apart) it is sorted by them, with each row's place in ``ordinal``, and the order is held too."""
    if order is not None:
        placed = numbered(df, "ordinal", *order)  # materialised, its ranges in order
        placed.write.mode("errorifexists").parquet(path)
        again = df.sparkSession.read.parquet(path)
        if table_digest(placed.drop("ordinal")) != table_digest(again.drop("ordinal")):
            raise ContractError(path, {"the table read back differs": 1})
        ends = again.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.countDistinct("ordinal").alias("places"))
        if bad := ends.where((F.col("high") - F.col("low") + 1 != F.col("n")) | (F.col("places") != F.col("n"))).count():
            raise ContractError(path, {"files out of order": bad})
        return again
    df.write.mode("errorifexists").parquet(path)
    again = df.sparkSession.read.parquet(path)
    if table_digest(df) != table_digest(again):
        raise ContractError(path, {"the table read back differs": 1})
    return again


def write_vcf(df: DataFrame, path: str, header: list[str]) -> None:
    """One folder of text: site rows in genome order (numbered contigs by number, then the others by name)
    below their header lines."""
    fields = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"]
    rows = df.select(F.lit(1).alias("part"), F.col("chrom").cast("string").alias("c"), F.col("pos").cast("long").alias("p"), F.col("ref").alias("r"), F.col("alt").alias("a"), F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in df.columns else F.lit(".") for c in fields]).alias("value"))
    spark = df.sparkSession
    top = [*header, "#" + "\t".join(x.upper() for x in fields)]
    lead = spark.createDataFrame([(0, i, x) for i, x in enumerate(top)], "part int, p long, value string")
    both = lead.unionByName(rows, allowMissingColumns=True)
    both.orderBy("part", F.col("c").try_cast("int").asc_nulls_last(), "c", "p", "r", "a").select("value").write.mode("errorifexists").text(path)


#: Most folders of an indexed table, beside one for each contig.
FOLDERS = 2_000


def write_indexed_sites(df: DataFrame, path: str, *, width: int = 1 << 20) -> int:
    """Sites (chrom, pos, ...) as Parquet in folders by contig and bin of positions, sorted inside them: the
    partitions that ``indexed_sites`` fetches. Where that would be more than ``FOLDERS``, a folder has 2, 4, 8, ... bins and
    the first one's name, so their number doesn't grow with the span of positions. The power is told and kept with ``pos``."""
    at = F.floor(F.col("pos") / width)
    ends = df.groupBy("chrom").agg(F.min(at).alias("low"), F.max(at).alias("high"))  # a row a contig
    spans = ends.agg(*[F.coalesce(F.sum(F.shiftright("high", s) - F.shiftright("low", s) + 1), F.lit(0)).alias(str(s)) for s in range(63)]).first()
    shift = next(s for s, n in enumerate(spans) if n <= FOLDERS + spans[-1])
    binned = df.withColumn("bin", F.shiftleft(F.shiftright(at, shift), shift)).withMetadata("pos", {SHIFT: shift})
    binned.repartition("chrom", "bin").sortWithinPartitions("chrom", "bin", "pos").write.mode("errorifexists").partitionBy("chrom", "bin").parquet(path)
    return shift


INDEX = "index.json"
#: What the power of two of an indexed table's bins is called where it is kept.
SHIFT = "shift"


def index_vcf(spark: SparkSession, path: str, out: str, *, width: int = 1 << 20, passing: bool = True) -> None:
    """A table of a VCF's sites with their calls, in ``out``, from which ``indexed_genotypes`` and ``indexed_sites`` fetch
    what they need without reading the rest: folders by contig and bin of ``width`` positions, sorted inside them. The
    VCF's positions are read first, then it is read once; what a fetch must know of it (samples, width, columns) is in one small file."""
    from lociscale.sources.readers import vcf_samples, vcf_sites

    sites = vcf_sites(spark, path, passing=passing)
    shift = write_indexed_sites(sites, f"{out}/sites", width=width)
    write_json(spark, {"samples": vcf_samples(spark, path), "width": width, SHIFT: shift, "columns": json.loads(sites.withColumn("bin", F.lit(0).cast("long")).schema.json())}, f"{out}/{INDEX}")


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and the path in its form: any store that Spark reads and writes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One file with sorted keys. NaN and infinities raise; an existing file is not overwritten."""
    text = json.dumps(value, sort_keys=True, indent=1, allow_nan=False)
    fs, p = _file_system(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


class ResumableTable:
    """A table written part by part, each with a marker of what it was made from.

    A part counts as done only if data and marker are both there and agree; half a part, or one made from
    another configuration, raises instead of being replaced.
    """

    def __init__(self, spark: SparkSession, path: str, config: dict):
        self.spark, self.path, self.fingerprint = spark, path.rstrip("/"), fingerprint(config)

    def _exists(self, path: str) -> bool:
        fs, p = _file_system(self.spark, path)
        return fs.exists(p)

    def done(self, part: str) -> bool:
        data, mark = self._exists(f"{self.path}/{part}/data/_SUCCESS"), self._exists(f"{self.path}/{part}/marker/_SUCCESS")
        if not data and not mark and not self._exists(f"{self.path}/{part}"):
            return False
        if not (data and mark):
            raise ContractError(part, {"half-written part kept for inspection": 1})
        marker = json.loads(self.spark.read.text(f"{self.path}/{part}/marker").first()[0])
        if marker["fingerprint"] != self.fingerprint or marker["table"] != table_digest(self.read(part)):
            raise ContractError(part, {"part was made from other inputs or changed since": 1})
        return True

    def read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}/data")

    def whole(self, parts: list[str]) -> DataFrame:
        """All of ``parts``, in order of their names, with the part of each row in ``shard``; each is held
        against its marker first, and one that isn't done raises."""
        if missing := [p for p in sorted(parts) if not self.done(p)]:
            raise ContractError(self.path, {f"part {p} is missing": 1 for p in missing})
        out = None
        for part in sorted(parts):
            own = self.read(part).withColumn("shard", F.lit(part))
            out = own if out is None else out.unionByName(own)
        return out

    def write(self, part: str, df: DataFrame) -> DataFrame:
        """The part's table: what is there, or ``df`` after writing it."""
        if not self.done(part):
            df.write.mode("errorifexists").parquet(f"{self.path}/{part}/data")
            marker = json.dumps({"fingerprint": self.fingerprint, "table": table_digest(self.read(part))}, sort_keys=True)
            self.spark.createDataFrame([(marker,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{self.path}/{part}/marker")
        return self.read(part)


MANIFEST = "manifest.json"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, bytes, sha256 of the files under ``folder`` but its manifest. The digests are taken where the
    files are read, one task a file; Spark leaves out hidden files (names with a leading dot or underscore)."""
    root = _qualified(spark, folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.substr(F.col("path"), F.length(F.lit(root)) + 2)
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where(F.col("name") != MANIFEST)


def _qualified(spark: SparkSession, folder: str) -> str:
    fs, p = _file_system(spark, folder.rstrip("/"))
    return fs.makeQualified(p).toString()


def write_manifest(spark: SparkSession, folder: str) -> None:
    """The manifest of what ``folder`` holds, in it."""
    listed = {r["name"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in manifest(spark, folder).collect()}  # one row a file
    write_json(spark, {"files": listed}, f"{folder.rstrip('/')}/{MANIFEST}")


def manifest_differences(spark: SparkSession, folder: str, expected: dict) -> DataFrame:
    """name, problem: listed files that are missing, changed or named outside the folder. Files that aren't
    listed are no fault."""
    outside = lambda n: n.startswith("/") or ":" in n or ".." in n.split("/")
    entries = [(n, e["sha256"], outside(n)) for n, e in expected["files"].items()]
    listed = spark.createDataFrame(entries, "name string, wanted string, outside boolean")
    both = listed.join(manifest(spark, folder), "name", "left")
    problem = F.when(F.col("outside"), "unsafe path").when(F.col("sha256").isNull(), "missing file").when(F.col("sha256") != F.col("wanted"), "checksum")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def verify_manifest(spark: SparkSession, folder: str, expected: dict) -> None:
    if found := manifest_differences(spark, folder, expected).collect():
        raise ContractError(folder, {f"{r['problem']} {r['name']}": 1 for r in found})


def load_verified(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tab-separated tables directly under data/ by name, once the folder's manifest holds."""
    from lociscale.sources.readers import json_document, tsv

    expected = json_document(spark, f"{folder}/{MANIFEST}")
    verify_manifest(spark, folder, expected)
    tables = sorted(n for n in expected["files"] if n.startswith("data/") and n.endswith(".tsv") and n.count("/") == 1)
    return {n[len("data/") : -len(".tsv")]: tsv(spark, f"{folder}/{n}") for n in tables}


def withheld(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict]:
    """``df`` without ``columns``, and a digest of what they held."""
    return df.drop(*columns), {"columns": columns, **table_digest(df.select(*columns))}


class _Stream(io.RawIOBase):
    """A Hadoop output stream as a file that can only be written forwards."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        return len(data)


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members as an archive holds them: name, checksum and size of the contents, and these deflated."""
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            packer = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
            packed = packer.compress(content) + packer.flush()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([zlib.crc32(content)]), pa.array([len(content)]), pa.array([packed], pa.binary())], names=["name", "crc", "size", "packed"])


def write_zip(spark: SparkSession, folder: str, path: str) -> None:
    """An archive that depends on names and contents alone: sorted, with one fixed date. Members are deflated where they
    are read; the driver puts the deflated ones into the file one after the other and holds none but that. Spark leaves
    out empty files. An existing archive is not overwritten."""
    root = _qualified(spark, folder)
    fs, p = _file_system(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = files.select(F.substr(F.col("path"), F.length(F.lit(root)) + 2).alias("name"), "content")
    rows = named.mapInArrow(_deflated, "name string, crc long, size long, packed binary").orderBy("name")
    stream = fs.create(p, False)
    try:
        with zipfile.ZipFile(_Stream(stream), "w", zipfile.ZIP_DEFLATED) as z:
            for name, crc, size, packed in rows.toLocalIterator():
                entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                entry.compress_type, entry.CRC, entry.file_size, entry.compress_size = zipfile.ZIP_DEFLATED, crc, size, len(packed)
                entry.external_attr, entry.header_offset = 0o600 << 16, z.fp.tell()
                z.fp.write(entry.FileHeader())
                z.fp.write(bytes(packed))
                z.filelist.append(entry)
                z.NameToInfo[name], z.start_dir, z._didModify = entry, z.fp.tell(), True
    finally:
        stream.close()


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table as text. It is for reports: more than ``most`` rows raise, none are left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ContractError("report", {f"more than {most} rows": len(rows)})
    text = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(map(text, r)) + " |" for r in rows]])
