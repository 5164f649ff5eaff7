"""Mixing sources to target weights by capped water-filling.

Sources get shares of the whole by weight; one whose share exceeds ``max_epochs`` times its size is clamped
there, and the excess goes to the others by weight until no target is above its cap. A source's target is
then taken as whole repetitions of all its documents plus, for the rest, its documents in the order of a
seeded hash until the target is met; the document at the cut gives the words that are still missing.

Nothing orders a whole source: sizes are summed by hash bucket, the bucket with the cut is found from at
most 4096 sums a source, and only that bucket's documents are ordered. What leaves this is one row a source.

Defined cases: a null or blank text has size 0 and gives 0 words, an empty one too; very long texts count
whole; a null source is a source, the last in order; documents with the same key and size at the cut share the missing words equally (rounded down);
repeated rows count as rows; no words at all, or no rows: all targets are 0. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociscale.llm.common import aside, cut, fresh, numbered, replaced, words

#: Beyond so many sources, joins with the table of sources no longer broadcast it.
BROADCAST_SOURCES = 50_000


def by_code_point(sources: DataFrame, pattern: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sources`` with weights that repeat over them in code point order, null last."""
    placed = numbered(sources, "__at", F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, pattern)), (F.col("__at") % len(pattern) + 1).cast("int"))
    return placed.withColumn("weight", weight).drop("__at")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``sources`` (source, source_size, weight) with target.

    Each round is one aggregate over the sources that returns three numbers.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while total:
        full = cap < F.lit(level) * F.col("weight")
        n, held, rest = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == clamped or not rest:
            break
        level, clamped = (total - held) / rest, n
    return sources.withColumn("target", F.when(cap < F.lit(level) * F.col("weight"), cap.cast("double")).otherwise(F.lit(level) * F.col("weight")))


def _order_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))


def plan_mix(docs: DataFrame, *, weights: Column | None = None, max_epochs: int = 3, seed: int = 7, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """One row a source: source, source_size, target, whole, and where the last repetition is cut."""
    rows = cut(docs.select(F.col(source).alias("source"), words(F.col(text)).alias("size"), _order_key(key, seed).alias("u")))
    sums = cut(rows.groupBy("source", F.substring("u", 1, 3).alias("bucket")).agg(F.sum("size").alias("size")))
    sized = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = cut(by_code_point(sized) if weights is None else sized.withColumn("weight", weights))
    filled = water_fill(sources, max_epochs).withColumn("goal", F.floor(F.col("target") + 0.5))
    parts = [F.expr(f"goal {op} greatest(source_size, 1)").alias(name) for op, name in (("div", "whole"), ("%", "extra"))]
    sources = cut(filled.select("source", "source_size", "target", *parts))
    running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    before = sums.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    at = before.alias("a").join(sources.where("extra > 0").alias("b"), same & (F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("size")))
    at = cut(at.select("a.source", "bucket", "before", "extra"))
    near = rows.alias("a").join(at.alias("b"), same & (F.substring("a.u", 1, 3) == F.col("b.bucket")))
    tied = near.groupBy("a.source", "u", "a.size", "before", "extra").agg(F.count("*").alias("n"))
    order = W.partitionBy("source").orderBy("u", "size")
    tied = tied.withColumn("upto", F.col("before") + F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    mine = F.col("size") * F.col("n")
    last = tied.where((F.col("upto") - mine < F.col("extra")) & (F.col("extra") <= F.col("upto")))
    last = last.select("source", F.col("u").alias("cut_u"), F.col("size").alias("cut_size"), F.floor((F.col("extra") - F.col("upto") + mine) / F.col("n")).cast("long").alias("cut_words"))
    return cut(sources.alias("a").join(last.alias("b"), same, "left").select("a.source", "source_size", "target", "whole", "cut_u", "cut_size", "cut_words"))


def mix_sources(docs: DataFrame, *, weights: Column | None = None, max_epochs: int = 3, seed: int = 7, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with size, source_size, target, whole (repetitions), extra_words and taken (words)."""
    docs, (text, source, key), back = aside(docs, text, source, key)
    plan = plan_mix(docs, weights=weights, max_epochs=max_epochs, seed=seed, text=text, source=source, key=key)
    side = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    if side.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    sized = docs.select("*", words(F.col(text)).alias("__size"), _order_key(key, seed).alias("__u"))
    joined = sized.join(side, F.col(f"`{source}`").eqNullSafe(F.col("__source")), "left")
    here = (F.col("__u") == F.col("__cut_u")) & (F.col("__size") == F.col("__cut_size"))
    before = (F.col("__u") < F.col("__cut_u")) | ((F.col("__u") == F.col("__cut_u")) & (F.col("__size") < F.col("__cut_size")))
    extra = F.when(here, F.col("__cut_words")).when(before, F.col("__size")).otherwise(0)
    out = replaced(joined, size=F.col("__size"), source_size=F.col("__source_size"), target=F.col("__target"), whole=F.col("__whole"), extra_words=extra, taken=F.col("__size") * F.col("__whole") + extra)
    return back(out.drop(*[c for c in joined.columns if c.startswith("__")]))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: whole repetitions, and one more where at
    least half of a document's words are left to take. Documents without words stay once."""
    mixed = mix_sources(docs, **options)
    (time,) = fresh(mixed, "time")
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("whole") + F.when(F.col("extra_words") * 2 >= F.col("size"), 1).otherwise(0))
    names = [f"`{c}`" for c in docs.columns]
    repeated = mixed.select("*", F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array())).alias(time))
    return repeated.select(*names)
