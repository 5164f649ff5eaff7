"""Sequences as rows of chunks: FASTA read by byte ranges, and windows cut without carrying contigs.

A contig is never one row. FASTA files are read in the byte ranges that Spark's text source makes; each range
tells how many records begin in it and how many bases it ends with, and a running sum over ranges (a few rows)
gives every range the record and the offset it starts in. Pieces are then cut at multiples of the chunk's width and
put together, with as many bases of the neighbours on either side (the halo) as windows may reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tables of byte ranges, contigs and so on up to this many rows are broadcast.
BROADCAST_ROWS = 100_000

PIECES = "file string, block long, record long, name string, at long, seq binary"


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sequence lines as one piece each, with the number of the record in its byte range (0 for the one
    that the range begins in the middle of) and the offset from the record's, or the range's, begin."""
    where, record, name, at = None, 0, None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        files, blocks = batch.column(0), batch.column(1)
        lines = pc.utf8_trim_whitespace(batch.column(2))
        head = pc.fill_null(pc.starts_with(lines, ">"), False).to_numpy(zero_copy_only=False)
        new = np.zeros(n, bool)
        new[0] = True
        new[1:] = (pc.not_equal(files.slice(1), files.slice(0, n - 1)).to_numpy(zero_copy_only=False)) | (pc.not_equal(blocks.slice(1), blocks.slice(0, n - 1)).to_numpy(zero_copy_only=False))
        text = lines.to_pylist()
        out = []
        edges = np.flatnonzero(new | head)
        for low, high in zip(edges, np.append(edges[1:], n), strict=True):
            here = files[low].as_py(), blocks[low].as_py()
            if here != where:
                where, record, name, at = here, 0, None, 0
            if head[low]:
                record, name, at, low = record + 1, (text[low][1:].split() or [""])[0], 0, low + 1
            seq = "".join(text[low:high]).upper().encode()
            out.append((*where, record, name, at, seq))
            at += len(seq)
        names = ["file", "block", "record", "name", "at", "seq"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def fasta_pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, record, contig, at, seq: runs of bases with the offset in their record, which is numbered in its
    file. Bases before a file's first record belong to none and are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    pieces = lines.mapInArrow(_pieces, PIECES)
    own = pieces.groupBy("file", "block", "record").agg(F.max("name").alias("name"), F.sum(F.octet_length("seq")).alias("n"))
    ranges = own.groupBy("file", "block").agg(F.sum("n").alias("total"), F.max("record").alias("records"), F.max_by("n", "record").alias("tail"), F.max_by("name", "record").alias("last"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row for each byte range of a file
    sums = ranges.select("*", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("records").over(before), F.lit(0)).alias("first"))
    begun = F.when(F.col("records") > 0, F.struct("last", (F.col("base") + F.col("total") - F.col("tail")).alias("at")))
    starts = sums.select("file", "block", "base", "first", F.last(begun, ignorenulls=True).over(before).alias("open"))
    placed = pieces.join(few(starts), ["file", "block"])
    inside = F.col("record") == 0
    out = placed.select(
        "file", (F.col("first") + F.col("record")).alias("record"), F.when(inside, F.col("open.last")).otherwise(F.col("name")).alias("contig"),
        F.when(inside, F.col("at") + F.col("base") - F.col("open.at")).otherwise(F.col("at")).alias("at"), "seq",
    )
    return out.where("contig IS NOT NULL")


def chunked(pieces: DataFrame, keys: list[str], width: int, halo: int = 0) -> DataFrame:
    """``keys``, chunk, start, seq: chunk c has the bases from c * ``width`` to before (c + 1) * ``width``, and up
    to ``halo`` more on either side; ``start`` is the 0-based place of the first one that it has. ``pieces`` have
    ``keys``, at (0-based) and seq, and don't overlap."""
    if width <= 0 or halo < 0:
        raise ValueError("a chunk needs a width above 0 and a halo of 0 or more")
    size = F.octet_length("seq")
    div = lambda a: F.call_function("div", a, F.lit(width))
    cells = F.sequence(div(F.greatest(F.col("at") - halo, F.lit(0))), div(F.col("at") + size - 1 + halo))
    met = pieces.where(size > 0).select(*keys, "at", F.col("seq").cast("binary").alias("seq"), F.explode(cells).alias("chunk"))
    low = F.greatest(F.col("chunk") * width - halo, F.col("at"))
    high = F.least((F.col("chunk") + 1) * width + halo, F.col("at") + F.octet_length("seq"))
    cut = met.select(*keys, "chunk", low.alias("low"), high.alias("high"), F.substring("seq", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).cast("string").alias("part")).where("high > low")
    parts = F.array_sort(F.collect_list(F.struct("low", "part")))
    whole = cut.groupBy(*keys, "chunk").agg(F.min("low").alias("start"), F.max("high").alias("end"), parts.alias("parts"))
    return whole.where(F.col("end") > F.col("chunk") * width).select(*keys, "chunk", "start", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("seq"))


def fasta(spark: SparkSession, path: str, wanted: list[str] | None = None, chunk: int = 1 << 20, halo: int = 0) -> DataFrame:
    """contig, chunk, seq: upper-case sequence in chunks of ``chunk`` bases (chunk from 0); with a halo, start too.

    A record is named by its first word. A file is read by as many tasks as it has byte ranges, wherever records
    begin; compressed files are one range each. Records of one name stay apart, each with chunks of its own.
    """
    pieces = fasta_pieces(spark, path)
    if wanted is not None:
        pieces = pieces.where(F.col("contig").isin(wanted))
    out = chunked(pieces, ["file", "record", "contig"], chunk, halo)
    return out.select("contig", "chunk", *(["start"] if halo else []), "seq")


def sequence_store(sequences: DataFrame, *, width: int = 1 << 16, halo: int = 1 << 10, chrom: str = "chrom", seq: str = "seq") -> DataFrame:
    """chrom, chunk, start, seq out of a table with a whole sequence in each row."""
    return chunked(sequences.where(F.col(seq).isNotNull()).select(F.col(chrom).alias("chrom"), F.lit(0).cast("long").alias("at"), F.col(seq).alias("seq")), ["chrom"], width, halo)


def lengths(store: DataFrame) -> DataFrame:
    """chrom, length: what the last chunk of each contig ends with."""
    return store.groupBy("chrom").agg(F.max(F.col("start") + F.octet_length("seq")).alias("length"))


def beside(variants: DataFrame, store: DataFrame, *, width: int = 1 << 16, pos: Column | None = None) -> DataFrame:
    """``variants`` with ``chunk_start`` and ``chunk_seq`` of the chunk that holds their position (1-based), null
    where no chunk does. With a halo of a window or more, windows around ``pos - chunk_start`` in ``chunk_seq`` are
    those in the contig: the chunk ends only where the contig does. Contig and chunk are the key of the join, so a contig's variants are
    spread over its chunks."""
    at = F.col("pos").try_cast("long") if pos is None else pos
    right = store.select(F.col("chrom").alias("__chrom"), F.col("chunk").alias("__chunk"), F.col("start").alias("chunk_start"), F.col("seq").alias("chunk_seq"))
    cell = F.call_function("div", at - 1, F.lit(width))
    met = (F.col("chrom") == F.col("__chrom")) & (F.when(at >= 1, cell) == F.col("__chunk"))
    return variants.join(right, met, "left").drop("__chrom", "__chunk")
