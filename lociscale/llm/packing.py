"""Best-fit packing of documents into bins of fixed capacity, with conflicts.

Documents are dealt by hash into blocks of about ``block_items``; each block is packed largest first. Open
bins are kept in order of the room they have left. A document goes to the first bin from the tightest that
holds it on (its successors are searched until one is compatible): the bin must hold no document of the same
duplicate cluster, and fewer than ``max_per_source`` of the same source. A bin carries both as bitmaps; the
one for sources has a plane for each allowed repeat.

Then blocks exchange their open bins: all that are less than ``full`` filled are dealt anew, together with
those of other blocks, and packed once more as items that carry the sources and clusters of all they hold. So
a block's leftovers don't stay half empty, however many blocks there are.

A document longer than a bin is split into full pieces, each a bin of its own, and a rest that is packed.
Defined cases: null, empty or blank texts have no words and get bin null; a null source is a source; copies
and repeated rows never share a bin (their cluster is the same); very long texts are split whole; an empty
table gives no rows; a group that fills a third of all rows spreads over the blocks by doc_id; rows that share
a doc_id as well are packed in parts of bounded size. Only key, text and source are read, whatever other
columns are called.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociscale.llm.common import cut, hash60, streamed_groups, words

#: Moved bins up to which their new places are broadcast (48 bytes each).
BROADCAST_BINS = 200_000
SCHEMA = "doc_id long, piece int, n_words long, source string, cluster long, block long, bin long, bin_offset long, bin_words long"


Item = tuple[int, dict[int | str | None, int], frozenset]


def best_fit(items: list[Item], capacity: int, max_per_source: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Bin and offset for each item (size, how many documents of which source, clusters), and the words in each
    bin.

    Items are placed in the order given; every size is between 1 and ``capacity``.
    """
    shared = Counter(c for _, _, own in items for c in own)
    repeated = {c: 1 << i for i, c in enumerate(c for c, n in shared.items() if n > 1)}
    sources = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for _, own, _ in items for s in own))}
    ordered: list[tuple[int, int]] = []  # (room left, bin)
    planes: list[list[int]] = []  # of each bin: in plane p the sources of which it has more than p
    clusters: list[int] = []
    room: list[int] = []
    placed = []
    for size, own, copies in items:
        wanted = [(n, sum(sources[s] for s, k in own.items() if k == n)) for n in set(own.values())]
        copy = sum(repeated.get(c, 0) for c in copies)
        at = bisect_left(ordered, (size, -1))
        while at < len(ordered) and (clusters[ordered[at][1]] & copy or any(planes[ordered[at][1]][max_per_source - n] & bits for n, bits in wanted)):
            at += 1
        if at < len(ordered):
            _, b = ordered.pop(at)
        else:
            b = len(room)
            planes.append([0] * max_per_source)
            clusters.append(0)
            room.append(capacity)
        placed.append((b, capacity - room[b]))
        room[b] -= size
        clusters[b] |= copy
        for n, bits in wanted:
            for _ in range(n):  # each time, every source goes to its lowest plane that lacks it
                left = bits
                for p in range(max_per_source):
                    planes[b][p], left = planes[b][p] | left, left & planes[b][p]
        if room[b]:
            insort(ordered, (room[b], b))
    return placed, [capacity - x for x in room]


def exchanged(packed: DataFrame, *, capacity: int, max_per_source: int, block_items: int, full: float) -> DataFrame:
    """``packed`` after bins that are less than ``full`` filled were packed with those of other blocks. What moves
    goes behind the words of a bin that stays, whose block and number it takes."""
    bins = packed.where(F.col("bin").isNotNull() & (F.col("bin_words") < int(capacity * full)))
    bins = bins.groupBy("block", "bin").agg(F.first("bin_words").alias("size"), F.collect_list("source").alias("sources"), F.count("*").alias("n"), F.collect_list("cluster").alias("clusters"))  # at most ``capacity`` rows a bin
    bins = cut(bins)
    groups = max(1, -(-bins.count() // block_items))
    dealt = bins.withColumn("part", F.pmod(hash60(F.concat_ws("|", "block", "bin")), F.lit(groups))).repartition("part").sortWithinPartitions("part", F.desc("size"), "block", "bin")
    schema = "block long, bin long, new_block long, new_bin long, shift long, new_words long"

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in streamed_groups(batches, ["part"], 4 * block_items):
            own = rows.to_pylist()
            items: list[Item] = []
            for r in own:
                count = Counter(r["sources"])
                if missing := r["n"] - len(r["sources"]):  # lists leave nulls out
                    count[None] = missing
                items.append((r["size"], dict(count), frozenset(r["clusters"])))
            placed, filled = best_fit(items, capacity, max_per_source)
            first: dict[int, dict] = {}
            out = []
            for r, (b, at) in zip(own, placed, strict=True):
                stays = first.setdefault(b, r)
                if stays is not r or filled[b] != r["size"]:
                    out.append((r["block"], r["bin"], stays["block"], stays["bin"], at, filled[b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    moves = cut(dealt.mapInArrow(merged, schema))
    side = F.broadcast(moves) if moves.count() <= BROADCAST_BINS else moves
    both = packed.join(side, ["block", "bin"], "left")
    return both.select(
        "doc_id", "piece", "n_words", "source", "cluster", F.coalesce("new_block", "block").alias("block"), F.coalesce("new_bin", "bin").alias("bin"),
        (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("bin_offset"), F.coalesce("new_words", "bin_words").alias("bin_words"),
    )


def pack(docs: DataFrame, *, capacity: int = 4096, max_per_source: int = 4, block_items: int = 4096, full: float = 0.95, cluster: Column | None = None, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """One row for each piece of each document: its bin (unique within its block), where it starts in
    it, and how many words the bin holds. ``cluster`` is a long; by default equal texts share one."""
    blocks = max(1, -(-docs.count() // block_items))
    body = F.coalesce(hash60(F.col(text)), F.lit(-1)).cast("long")
    place = hash60(F.concat_ws("|", F.col(key).cast("string"), body.cast("string")))
    items = docs.select(
        F.col(key).cast("long").alias("doc_id"), words(F.col(text)).alias("n_words"), F.col(source).cast("string").alias("source"),
        (cluster if cluster is not None else body).alias("cluster"), F.pmod(place, F.lit(blocks)).alias("block"),
    )
    dealt = items.repartition("block").sortWithinPartitions("block", F.desc("n_words"), "doc_id", "cluster", "source")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = 0, None
        for (block,), rows in streamed_groups(batches, ["block"], 4 * block_items):
            part, last = (part + 1 if block == last else 0), block
            out, items = [], []
            for doc, n, src, group in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "n_words", "source", "cluster")), strict=True):
                if not n:
                    out.append((doc, 0, 0, src, group, None, None, None))
                    continue
                full, rest = divmod(n, capacity)
                for i in range(full):
                    items.append((doc, i, capacity, src, group))
                if rest:
                    items.append((doc, full, rest, src, group))
            placed, filled = best_fit([(x[2], {x[3]: 1}, frozenset((x[4],))) for x in items], capacity, max_per_source)
            out += [(*x, b + (part << 32), at, filled[b]) for x, (b, at) in zip(items, placed, strict=True)]
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays.insert(5, pa.array([block] * len(out), pa.int64()))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    if blocks == 1:  # no two of its bins fit together: the first document of the later one didn't fit into the earlier
        return dealt.mapInArrow(packed, SCHEMA)
    first = cut(dealt.mapInArrow(packed, SCHEMA))
    return exchanged(first, capacity=capacity, max_per_source=max_per_source, block_items=block_items, full=full)
