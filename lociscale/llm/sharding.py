"""Sharding by histogram sort, in DataFrame functions alone.

Rows are ordered by (60 bits of the text's MD5, 60 bits of the key's MD5, row ordinal), and the order is cut
into shards of near equal bytes. The cuts are found without sorting: each pass counts the exact bytes below
candidate boundaries in all partitions at once (a partial aggregation of at most ``probes`` buckets a cut),
keeps the bucket that a cut falls into, and puts the next probes inside it, until every cut is within
``tolerance`` of its target or its bucket holds a single row (then the nearer side of the row is taken; with
the default tolerance of 0 that is where all cuts end). Then the rows are exchanged once.

A text's copies are neighbours in the order; a group that is larger than a shard is cut inside, by the hash
of its keys. Slots number a shard's rows without gaps. They come from counts of ranges of the first level,
each cut by the second level into as many parts as its rows need, plus a rank inside each part, so no task
has to order a whole shard, however large a group of copies is.

Defined cases: a null text has no bytes (size 1) and checksum 0; null and empty texts have hashes of their own;
null keys hash as empty; very long texts go whole; rows that are equal in text and key are told apart by
their ordinal alone, which leaves the set of results the same on every run; an empty table gives no rows;
columns besides shard, slot and so on pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociscale.llm.common import aside, cut, hash60, stored

LEVELS = ("__h", "__t", "__m")
#: The keys of a level go from 0 to this.
HIGHEST = ((1 << 60) - 1, (1 << 60) - 1, (1 << 63) - 1)


@dataclass
class Splitter:
    """A cut being searched: the prefix of key levels that is settled, and the range of the next one."""

    target: int
    prefix: tuple[int, ...] = ()
    low: int = 0
    high: int = HIGHEST[0]
    below: int = 0  # bytes before the range
    inside: int | None = None  # bytes in the range
    done: bool = False

    def where(self) -> Column:
        level = F.col(LEVELS[len(self.prefix)])
        out = level.between(F.lit(self.low), F.lit(self.high))
        for name, value in zip(LEVELS, self.prefix, strict=False):
            out = (F.col(name) == F.lit(value)) & out
        return out

    def step(self, probes: int) -> int:
        """How many keys each of the buckets holds that the range is cut into."""
        return max(1, -(-(self.high - self.low + 1) // probes))

    def key(self) -> tuple[int, ...]:
        """Rows that sort below this belong to the shards before the cut."""
        return (*self.prefix, self.low)


def bucket_of(level: Column, low: int, step: int) -> Column:
    """Which bucket of ``step`` keys from ``low`` on a key is in."""
    return F.call_function("div", level - F.lit(low), F.lit(step))


def find_splitters(rows: DataFrame, shards: int, tolerance: float, probes: int) -> list[tuple[int, ...]]:
    """Lexicographic lower bounds of shards 1 to ``shards`` - 1 over the key levels of ``rows``."""
    total = rows.agg(F.sum("__size")).first()[0] or 0
    slack = tolerance * total / shards
    cuts = [Splitter(target=total * i // shards) for i in range(1, shards)]
    while open_ := [c for c in cuts if not c.done]:
        ranges = {(c.prefix, c.low, c.high): c for c in open_}
        branch, place = F, F
        for i, (k, c) in enumerate(ranges.items()):
            level = F.col(LEVELS[len(c.prefix)])
            branch = branch.when(c.where(), F.lit(i))
            place = place.when(c.where(), F.struct(bucket_of(level, c.low, c.step(probes)).alias("at"), level.alias("key")))
        found = rows.select(branch.alias("range"), place.alias("p"), "__size").where("range IS NOT NULL")
        counts = found.groupBy("range", "p.at").agg(F.sum("__size").alias("size"), F.count("*").alias("n"), F.min("p.key").alias("low"), F.max("p.key").alias("high"))
        by_range: list[list] = [[] for _ in ranges]
        for r in counts.collect():  # at most probes rows for each cut
            by_range[r["range"]].append(r)
        for i, k in enumerate(ranges):
            buckets = sorted(by_range[i], key=lambda r: r["at"])
            for c in [c for c in open_ if (c.prefix, c.low, c.high) == k]:
                below = c.below
                for r in buckets:
                    if below + r["size"] > c.target:
                        break
                    below += r["size"]
                else:  # the target is the end of the range
                    c.low, c.done = c.high, True
                    if buckets:
                        c.low = buckets[-1]["high"] + 1
                    continue
                if c.target - below <= slack or r["n"] == 1:
                    after = c.target - below > below + r["size"] - c.target  # a single row: the nearer side
                    c.low, c.done = (r["high"] + 1 if after and r["n"] == 1 else r["low"]), True
                elif r["low"] == r["high"]:
                    c.prefix, c.low, c.high, c.below = (*c.prefix, r["low"]), 0, HIGHEST[len(c.prefix) + 1], below
                else:
                    c.low, c.high, c.below = r["low"], r["high"], below
    return [c.key() for c in cuts]


def at_or_above(key: tuple[int, ...]) -> Column:
    """Whether a row's levels are not below ``key``, lexicographically."""
    out = F.lit(True)
    for name, value in reversed(list(zip(LEVELS, key, strict=False))):
        out = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def shard_documents(docs: DataFrame, *, shards: int = 8, tolerance: float = 0.0, probes: int = 256, rows_per_range: int = 50_000, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with size, text_crc32, law, shard, slot and grown_shard.

    Shards hold near equal bytes, to ``tolerance`` of a shard or to the nearest row.
    """
    names = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    docs, (text, key, *named), back = aside(docs, text, key, *(keep or []))
    keep = None if keep is None else named
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    body = F.col(text).cast("binary")
    levels = (F.coalesce(hash60(F.col(text)), F.lit(0)), hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.monotonically_increasing_id())
    slim = docs.select(
        *[F.col(f"`{c}`") for c in kept], (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("__size"),
        F.coalesce(F.crc32(body), F.lit(0)).alias("__crc"), *[v.alias(k) for v, k in zip(levels, LEVELS, strict=True)],
    )
    # the passes below read sizes and levels alone; whole documents are kept in columns for that
    rows = cut(slim) if {c.lower() for c in kept} <= {key.lower()} else stored(slim)
    splitters = find_splitters(rows, shards, tolerance, probes)
    shard = sum((F.when(at_or_above(k), 1).otherwise(0) for k in splitters), F.lit(0))
    n = rows.count()
    rows_per_range = max(rows_per_range, n // 1_000_000)
    fine = max(1, n // rows_per_range) * 16
    put = rows.select("*", shard.cast("int").alias("__shard"), bucket_of(F.col("__h"), 0, (1 << 60) // fine + 1).alias("__a"))
    # the copies of a text are in one range, which has parts enough for them
    sizes = put.groupBy("__shard", "__a").agg(F.count("*").alias("__n"))
    many = cut(sizes.where(F.col("__n") > rows_per_range).select("__shard", "__a", F.expr(f"__n div {rows_per_range} + 1").alias("__parts")))
    put = put.join(F.broadcast(many), ["__shard", "__a"], "left") if many.limit(1).count() else put.withColumn("__parts", F.lit(1).cast("long"))  # at most a million rows
    put = put.withColumn("__b", F.expr(f"__t div ({1 << 60} div coalesce(__parts, 1) + 1)"))
    own = ["__shard", "__a", "__b"]
    counts = put.groupBy(*own).agg(F.count("*").alias("__n"))
    upto = W.partitionBy("__shard").orderBy("__a", "__b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*own, F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))
    ranked = put.withColumn("__rank", F.row_number().over(W.partitionBy(*own).orderBy(*LEVELS)) - 1)
    placed = ranked.join(starts, own)
    return back(placed.select(
        *[F.col(f"`{c}`") for c in kept], F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"), (F.col("__start") + F.col("__rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    ))
