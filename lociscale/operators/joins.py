"""Joins: keyed one to one, membership, point in interval, feature overlap and band self-joins.

Spark plans a pure range condition as a Cartesian product, so ranges are cut into bins that join on
equality; the range itself is then a filter on the joined rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociscale.operators.contracts import ContractError, duplicate_keys


def one_to_one(left: DataFrame, right: DataFrame, key: list[str], *, table: str = "right", complete: bool = True) -> DataFrame:
    """Left join with a ``matched`` flag; duplicate keys, and unmatched rows if ``complete``, raise."""
    for name, df in (("left", left), (table, right)):
        if n := duplicate_keys(df, key).count():
            raise ContractError(name, {"duplicate keys": n})
    out = left.join(right.withColumn("matched", F.lit(True)), key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    if complete and (n := out.where("NOT matched").count()):
        raise ContractError(table, {"unmatched rows": n})
    return out


def key_differences(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """status, keys: how many distinct keys are in both or in one only."""
    return membership(left, right, key).groupBy("status").agg(F.count("*").alias("keys"))


def membership(left: DataFrame, right: DataFrame, key: list[str], names: tuple[str, str, str, str] = ("matched", "left_only", "right_only", "duplicate")) -> DataFrame:
    """Each key with left_rows, right_rows and a status out of ``names``.

    Both sides are counted in one aggregation over their union, so a hot key is summed before it moves.
    """
    both = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = both.groupBy(*key).agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))
    status = F.when((F.col("left_rows") > 1) | (F.col("right_rows") > 1), names[3]).when(F.col("right_rows") == 0, names[1]).when(F.col("left_rows") == 0, names[2]).otherwise(names[0])
    return counts.withColumn("status", status)


def lookup(left: DataFrame, right: DataFrame, key: list[str], value: str, default: Column | None = None) -> DataFrame:
    """``left`` with ``value`` of the row of its key in ``right``, or ``default`` (NaN) where there is none; a key
    that ``right`` has twice raises."""
    if n := duplicate_keys(right, key).count():
        raise ContractError("lookup", {"duplicate keys": n})
    found = left.join(right.select(*key, F.col(value).alias("__v"), F.lit(True).alias("__found")), key, "left")
    return found.withColumn(value, F.when(F.col("__found"), F.col("__v")).otherwise(F.lit(float("nan")) if default is None else default)).drop("__v", "__found")


def inner_chain(first: DataFrame, *others: DataFrame, key: list[str]) -> DataFrame:
    """Tables joined on one key, one after the other; they share the first one's partitioning."""
    out = first
    for other in others:
        out = out.join(other, key)
    return out


def interval_lookup(points: DataFrame, intervals: DataFrame, *, group: str = "chrom", pos: str = "pos", start: str = "start", end: str = "end", value: str = "score") -> DataFrame:
    """``points`` with ``value`` and status of the half-open interval (0-based) that holds the base at
    ``pos`` (1-based); the intervals of a group don't overlap.

    Planned as an as-of join: one sort of the union by position, and the last interval seen. A group is
    ordered in bins of 2**20 positions, into each of which the intervals that reach it are copied, so
    a contig isn't one task.
    """
    width = 1 << 20
    cells = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width)))
    side = intervals.select(F.col(group).alias("__g"), cells.alias("__bin"), F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(value).alias("v")).alias("__i"))
    rows = points.select(F.struct(*points.columns).alias("__p"), F.col(group).alias("__g"), F.floor((F.col(pos) - 1) / width).alias("__bin"), (F.col(pos) - 1).alias("__at"), F.lit(1).alias("__kind"))
    both = rows.unionByName(side, allowMissingColumns=True)
    seen = F.last("__i", ignorenulls=True).over(W.partitionBy("__g", "__bin").orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0))
    held = both.withColumn("__seen", seen).where("__kind = 1").withColumn("__in", F.coalesce(F.col("__at") < F.col("__seen.e"), F.lit(False)))
    return held.select("__p.*", F.when(F.col("__in"), F.col("__seen.v")).alias(value), F.when(F.col("__in"), "covered").otherwise("missing_coverage").alias("status"))


def overlaps(points: DataFrame, features: DataFrame, *, group: str = "chrom", pos: str = "pos", start: str = "start", end: str = "end", flank: int = 0, width: int = 1 << 14) -> DataFrame:
    """Pairs of a point and a feature (1-based, inclusive, overlapping at will) that holds it, with
    ``flank`` added on either side: an equality join on bins, then the exact condition."""
    low, high = F.col(start) - flank, F.col(end) + flank
    cells = F.explode(F.sequence(F.floor(low / width), F.floor(F.greatest(high, low) / width)))
    side = features.select("*", cells.alias("__bin"))
    rows = points.withColumn("__bin", F.floor(F.col(pos) / width))
    return rows.join(side, [group, "__bin"]).where(F.col(pos).between(low, high)).drop("__bin")


def annotate(points: DataFrame, features: DataFrame, *, key: list[str], kind: str = "kind", name: str = "name", **where) -> DataFrame:
    """``key`` of each point with the flags in_cds, in_exon, in_gene and the sorted names of its genes."""
    hits = overlaps(points, features, **where)
    own = hits.groupBy(*key).agg(
        F.bool_or(F.col(kind) == "CDS").alias("in_cds"), F.bool_or(F.col(kind) == "exon").alias("in_exon"), F.bool_or(F.col(kind) == "gene").alias("in_gene"),
        F.array_sort(F.collect_set(F.when(F.col(kind) == "gene", F.col(name)))).alias("genes"),
    )
    no = F.lit(False)
    out = points.join(own, key, "left")
    return out.withColumns({c: F.coalesce(c, no) for c in ("in_cds", "in_exon", "in_gene")} | {"genes": F.coalesce("genes", F.array().cast("array<string>"))})


def in_blocks(left: DataFrame, right: DataFrame, keys: list[str], name: str, most: int = 1024) -> DataFrame:
    """``left`` joined to ``right`` on ``keys``. The right rows of a key are dealt by ``name`` into blocks of about ``most``, and
    each left row goes to all of them: a crowded key is the work of many tasks, and the exchange that parts it keeps a small
    table of few files, whose rows have many partners, from being joined where it is read."""
    sizes = right.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("__blocks"))
    ours = left.join(sizes, keys).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
    theirs = right.join(sizes, keys).withColumn("__block", F.pmod(F.xxhash64(name), F.col("__blocks")).cast("int")).drop("__blocks")
    return ours.join(theirs.hint("shuffle_merge"), [*keys, "__block"]).drop("__block")


def band_pairs(points: DataFrame, *, group: str, pos: str, key: str, reach: int, most: int = 1 << 13, longest: int = 128) -> DataFrame:
    """left, right, distance: pairs of a group with 0 < or = distance within ``reach``, each once (by
    position, then key). Bins are as wide as the band, so a point meets its own bin and the next.

    The keys of a position go together, in lists of up to ``longest``. Lists are what is exchanged, and a right one is opened last:
    pairs stand in runs of one position and one key, which files by columns hold in little. The lists of a bin are dealt to
    blocks of about ``most`` keys, and two blocks are a task's unit: a point is sent four times until a bin holds more.
    """
    own = points.select(F.col(group).alias("g"), F.floor(F.col(pos) / reach).alias("bin"), F.col(pos).alias("pos"), F.col(key).alias("key"))
    blocks = own.groupBy("g", "bin").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    # a crowded position is gathered in shares of some eight blocks; in structs, since a bare list leaves out keys that are null
    shared = own.join(blocks, ["g", "bin"]).withColumn("share", F.pmod(F.xxhash64("key"), F.ceil(F.col("blocks") / 8)))
    whole = shared.groupBy("g", "bin", "blocks", "pos", "share").agg(F.collect_list(F.struct("key")).getField("key").alias("keys"))
    lists = whole.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("keys"), F.lit(longest)))).withColumn("keys", F.slice("keys", F.col("at"), F.lit(longest)))
    lists = lists.withColumn("block", F.pmod(F.xxhash64("pos", "share", "at"), F.col("blocks")).cast("int"))
    met = ["g", "left_bin", "__block_left", "right_bin", "__block_right"]
    # tasks by number, not by size: few bytes make many pairs
    session = points.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 8 * session.sparkContext.defaultParallelism)

    def side(me: str, other: str, step: int) -> DataFrame:
        mine = lists.select("g", F.col("bin").alias(f"{me}_bin"), F.col("block").alias(f"__block_{me}"), F.col("pos").alias(f"{me}_pos"), F.col("keys").alias(f"{me}_keys"), F.explode(F.array(F.col("bin"), F.col("bin") + step)).alias(f"{other}_bin"))
        theirs = blocks.select("g", F.col("bin").alias(f"{other}_bin"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(f"__block_{other}"))
        return mine.join(theirs, ["g", f"{other}_bin"]).repartition(parts, *met)

    left, right = side("left", "right", 1).withColumn("left_key", F.explode("left_keys")).drop("left_keys"), side("right", "left", -1)
    near = (F.col("right_pos") >= F.col("left_pos")) & (F.col("right_pos") - F.col("left_pos") <= reach)
    pairs = right.join(left.hint("shuffle_merge"), met).where(near).withColumn("right_key", F.explode("right_keys"))
    once = (F.col("right_pos") > F.col("left_pos")) | (F.col("right_key") > F.col("left_key"))
    return pairs.where(once).select(F.col("g").alias(group), "left_key", "right_key", "left_pos", "right_pos", (F.col("right_pos") - F.col("left_pos")).alias("distance"))


def _compared(ours: DataFrame, theirs: DataFrame, key: list[str], columns: list[str], atol: float, rtol: float) -> DataFrame:
    """key, column, d, why: every key of either table, column by column; ``why`` is null where both agree.

    Keys meet null-safely. A key that is on one side only, a value that is missing (null or NaN) on one side
    only, and one that is further away than ``atol + rtol * abs(theirs)`` don't agree. Values that are missing on both
    sides, or equal infinities, do. Of a key that stands several times each row meets each.
    """
    a = ours.select(*[F.col(k).alias(f"a{i}") for i, k in enumerate(key)], F.struct(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).alias("a"))
    b = theirs.select(*[F.col(k).alias(f"b{i}") for i, k in enumerate(key)], F.struct(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).alias("b"))
    met = F.lit(True)
    for i in range(len(key)):
        met = F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) & met
    items = []
    for i, c in enumerate(columns):
        x, y = (F.nanvl(F.col(f"{t}.v{i}"), F.lit(None).cast("double")) for t in "ab")
        d = F.when(x == y, 0.0).otherwise(F.abs(x - y))
        why = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing_key").when(x.isNull() & y.isNull(), None).when(d.isNull(), "missing_value").when(d > atol + rtol * F.when(F.abs(y) < float("inf"), F.abs(y)).otherwise(0.0), "difference")
        items.append(F.struct(F.lit(c).alias("column"), d.alias("d"), why.alias("why")))
    keys = [F.when(F.col("a").isNull(), F.col(f"b{i}")).otherwise(F.col(f"a{i}")).alias(k) for i, k in enumerate(key)]
    return a.join(b, met, "full").select(*keys, F.explode(F.array(*items)).alias("x")).select(*key, "x.*")


def compare_tables(ours: DataFrame, theirs: DataFrame, key: list[str], columns: list[str], *, atol: float = 1e-6, rtol: float = 1e-6) -> DataFrame:
    """column, rows, unmatched, missing, max_difference, failing: two tables of one key, column by column. ``failing``
    counts unmatched keys, values that are missing on one side, and differences beyond the tolerance."""
    long = _compared(ours, theirs, key, columns, atol, rtol)
    count = lambda why: F.count_if(F.col("why") == why)
    return long.groupBy("column").agg(F.count("*").alias("rows"), count("missing_key").alias("unmatched"), count("missing_value").alias("missing"), F.max("d").alias("max_difference"), F.count("why").alias("failing"))


def failing_rows(ours: DataFrame, theirs: DataFrame, key: list[str], columns: list[str], *, atol: float = 1e-6, rtol: float = 1e-6) -> DataFrame:
    """key, column, difference, why: the rows that ``compare_tables`` counts as failing, with difference,
    missing_value or missing_key."""
    return _compared(ours, theirs, key, columns, atol, rtol).where("why IS NOT NULL").withColumnRenamed("d", "difference")


def spaced_exclusion(sites: DataFrame, *, group: str, pos: str, order: str, apart: int) -> DataFrame:
    """``sites`` with ``kept``: in the order given, a site is kept if none kept before it in its group is
    within ``apart``. Of copies of a site (equal in order and position) all have what the first has."""
    from lociscale.operators.ld import exclusion

    own = sites.select(F.col(group).alias("g"), F.col(pos).alias("p"), F.col(order).alias("o")).distinct()
    told = exclusion(own, group="g", pos="p", order="o", apart=apart)
    a, b = sites.alias("a"), told.alias("b")
    met = F.col(f"a.{group}").eqNullSafe(F.col("b.g")) & F.col(f"a.{pos}").eqNullSafe(F.col("b.p")) & F.col(f"a.{order}").eqNullSafe(F.col("b.o"))
    return a.join(b, met).select("a.*", "b.kept")
