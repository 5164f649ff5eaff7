"""Linkage: squared correlation of pairs, and thinning by it."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociscale.operators.joins import in_blocks
from lociscale.plans.lineage import cut, numbered

#: Places or positions that one task goes through at most where a stretch is decided in rounds.
WIDEST = 1 << 17

_R2 = T.StructType([T.StructField("n_complete", T.IntegerType()), T.StructField("r2", T.DoubleType()), T.StructField("status", T.StringType())])


def r2_batch(a: np.ndarray, b: np.ndarray, least: int, lowest: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_complete, r2 and status of each row of two matrices, over complete pairs (NaN and what is below
    ``lowest`` are missing, so 0 for dosages coded -1 where they are missing); undefined results are NaN and
    named, not raised."""
    ok = np.isfinite(a) & np.isfinite(b) & (a >= lowest) & (b >= lowest)
    n = ok.sum(axis=1)
    sums, still = [], []
    for m in (a, b):
        low, high = np.where(ok, m, np.inf).min(axis=1, initial=np.inf), np.where(ok, m, -np.inf).max(axis=1, initial=-np.inf)
        still.append(~(low < high))
        mean = np.where(ok, m, 0.0).sum(axis=1) / np.maximum(n, 1)
        sums.append(np.where(ok, m - mean[:, None], 0.0))
    x, y = sums
    vx, vy, xy = (np.einsum("ij,ij->i", p, q) for p, q in ((x, x), (y, y), (x, y)))
    flat = still[0] | still[1] | (vx <= 0) | (vy <= 0)
    status = np.where(n < least, "insufficient_complete_samples", np.where(flat, "pairwise_nonvariable", "ok")).astype(object)
    fine = status == "ok"
    r2 = np.full(len(n), np.nan)
    r2[fine] = xy[fine] ** 2 / (vx[fine] * vy[fine])
    if (r2[fine] > 1 + 1e-9).any():
        raise ValueError(f"r2 out of range: {np.nanmax(r2)}")
    return n, np.minimum(r2, 1.0), status


def r2_of(a: np.ndarray, b: np.ndarray, least: int, lowest: float = -np.inf) -> tuple[int, float | None, str]:
    """The same for one pair, with None where r2 is undefined."""
    n, r2, status = r2_batch(a[None], b[None], least, lowest)
    return int(n[0]), float(r2[0]) if status[0] == "ok" else None, str(status[0])


def r2_column(left: Column, right: Column, least: int = 200, lowest: float = float("-inf")) -> Column:
    """Struct of n_complete, r2, status for two array columns: rows of one length are stacked and come out of a
    few matrix operations."""

    @F.pandas_udf(_R2)
    def kernel(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        sizes = a.map(len).to_numpy()
        n, r2, status = np.zeros(len(a), dtype=int), np.full(len(a), np.nan), np.empty(len(a), dtype=object)
        for size in np.unique(sizes):
            for at in np.array_split(own := np.flatnonzero(sizes == size), max(1, len(own) * int(size) // (1 << 20))):
                n[at], r2[at], status[at] = r2_batch(*(np.stack(c.iloc[at].to_numpy()).astype(float) for c in (a, b)), least, lowest)
        return pd.DataFrame({"n_complete": n, "r2": pd.Series(r2).astype(object).where(~np.isnan(r2), None), "status": status})

    return kernel(left.cast("array<double>"), right.cast("array<double>"))


def pairwise_r2(pairs: DataFrame, vectors: DataFrame, *, key: str, vector: str, least: int = 200, lowest: float = float("-inf")) -> DataFrame:
    """``pairs`` (left_key, right_key, ...) with n_complete, r2, status."""
    a = vectors.select(F.col(key).alias("left_key"), F.col(vector).alias("__a"))
    b = vectors.select(F.col(key).alias("right_key"), F.col(vector).alias("__b"))
    out = pairs.join(a, "left_key").join(b, "right_key").withColumn("__r", r2_column(F.col("__a"), F.col("__b"), least, lowest))
    return out.select(*[F.col(c) for c in pairs.columns], "__r.*")


def planes(dosages: Column) -> Column:
    """Dosages as three bit planes of 64 samples a word: called, one copy, two copies. Anything but 0, 1 and 2 is missing."""
    words = F.sequence(F.lit(0), F.call_function("div", F.size(dosages) - 1, F.lit(64)).cast("int"))
    bits = lambda ok: F.transform(words, lambda w: F.aggregate(F.transform(F.slice(dosages, w * 64 + 1, F.lit(64)), lambda x, i: F.when(ok(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))
    return F.when(F.size(dosages) > 0, F.struct(bits(lambda x: x.isin(0, 1, 2)).alias("called"), bits(lambda x: x == 1).alias("one"), bits(lambda x: x == 2).alias("two")))


def plane_sums(a: Column, b: Column) -> Column:
    """Struct of n, and of the sums of x, y, xx, yy and xy, over the samples that are called in both, from ``planes``."""
    both = F.arrays_zip(a["called"].alias("ca"), a["one"].alias("a1"), a["two"].alias("a2"), b["called"].alias("cb"), b["one"].alias("b1"), b["two"].alias("b2"))
    count = lambda *x: F.bit_count(x[0].bitwiseAND(x[1])).cast("long")
    names = ("n", "x", "y", "xx", "yy", "xy")

    def add(acc: Column, w: Column) -> Column:
        # an allele is called where it is, so its plane need only meet the other's calls
        x1, x2, y1, y2 = count(w["a1"], w["cb"]), count(w["a2"], w["cb"]), count(w["b1"], w["ca"]), count(w["b2"], w["ca"])
        xy = count(w["a1"], w["b1"]) + 2 * (count(w["a1"], w["b2"]) + count(w["a2"], w["b1"])) + 4 * count(w["a2"], w["b2"])
        more = (count(w["ca"], w["cb"]), x1 + 2 * x2, y1 + 2 * y2, x1 + 4 * x2, y1 + 4 * y2, xy)
        return F.struct(*[(acc[k] + v).alias(k) for k, v in zip(names, more, strict=True)])

    return F.aggregate(both, F.struct(*[F.lit(0).cast("long").alias(k) for k in names]), add)


def dosage_r2(loci: DataFrame, *, group: str, pos: str, key: str, vector: str, reach: int, least: int = 200) -> DataFrame:
    """group, left_key, right_key, left_pos, right_pos, distance, n_complete, r2, status: of all pairs of a group within
    ``reach``, each once (by position, then key), from dosages 0, 1, 2 of vectors of one length.

    A locus goes to the bin of its position and to the next as three bits a sample, and pairs are made where the
    bits are: pairs are never exchanged, and nothing leaves the JVM. Sums are whole numbers, so r2 is exact to one rounding.
    """
    own = loci.select(F.col(group).alias("g"), F.col(pos).cast("long").alias("pos"), F.col(key).alias("key"), planes(F.col(vector)).alias("v"), F.floor(F.col(pos) / reach).alias("bin"))
    left = own.select("g", F.col("pos").alias("left_pos"), F.col("key").alias("left_key"), F.col("v").alias("a"), F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"))
    right = own.select("g", F.col("pos").alias("right_pos"), F.col("key").alias("right_key"), F.col("v").alias("b"), "bin")
    after = (F.col("right_pos") > F.col("left_pos")) | ((F.col("right_pos") == F.col("left_pos")) & (F.col("right_key") > F.col("left_key")))
    met = in_blocks(left, right, ["g", "bin"], "right_key").where(after & (F.col("right_pos") - F.col("left_pos") <= reach))
    sums = met.withColumn("s", plane_sums(F.col("a"), F.col("b")))
    n, x, y = F.coalesce("s.n", F.lit(0)), F.col("s.x"), F.col("s.y")
    vx, vy, xy = n * F.col("s.xx") - x * x, n * F.col("s.yy") - y * y, n * F.col("s.xy") - x * y
    status = F.when(n < least, "insufficient_complete_samples").when((vx == 0) | (vy == 0), "pairwise_nonvariable").otherwise("ok")
    r2 = F.when(status == "ok", (xy.cast("double") / vx) * (xy.cast("double") / vy))
    return sums.select(F.col("g").alias(group), "left_key", "right_key", "left_pos", "right_pos", (F.col("right_pos") - F.col("left_pos")).alias("distance"), n.cast("int").alias("n_complete"), r2.alias("r2"), status.alias("status"))


def lead_r2(vectors: DataFrame, leads: DataFrame, *, by: str, key: str, vector: str) -> DataFrame:
    """by, key, r2 of each row's vector with that of its group's lead (by, lead vector in ``lead``)."""
    out = vectors.join(leads.select(by, F.col("lead").alias("__lead")), by)
    return out.withColumn("__r", r2_column(F.col(vector), F.col("__lead"), 3)).select(by, key, F.col("__r.r2").alias("r2"))


def segments(nodes: DataFrame, edges: DataFrame, width: int = 1 << 16) -> DataFrame:
    """``nodes`` (i, from 0 without gaps, ...) with ``segment``: the first node of the stretch that it is in. No edge (l < r)
    leads from one stretch into another. A stretch begins at a node that no edge from before reaches; how far edges
    reach is a running maximum, taken in bins of ``width`` nodes and carried over from bin to bin."""
    reach = edges.groupBy(F.col("l").alias("i")).agg(F.max("r").alias("reach"))
    rows = cut(nodes.join(reach, "i", "left").withColumn("bin", F.call_function("div", F.col("i"), F.lit(width))))
    before = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # a row for each bin
    far = rows.groupBy("bin").agg(F.max("reach").alias("far")).select("bin", F.max("far").over(before).alias("far"))
    inside = W.partitionBy("bin").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    reached = F.greatest(F.col("far"), F.max("reach").over(inside))
    starts = rows.join(far, "bin").withColumn("start", F.when(reached.isNull() | (reached < F.col("i")), F.col("i")))
    last = starts.groupBy("bin").agg(F.max("start").alias("last")).select("bin", F.max("last").over(before).alias("last"))
    upto = W.partitionBy("bin").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return starts.join(last, "bin").withColumn("segment", F.coalesce(F.max("start").over(upto), "last")).drop("reach", "far", "start", "last")


def _thinned(nodes: pa.Table, edges: pa.Table) -> pa.Table:
    """Nodes (i, hit, open) of some segments or of a part of one, decided one after the other: removed by a kept one on
    their left, or by one outside (``hit``). What hangs on a node that is still open stays open (null)."""
    own = nodes.sort_by("i")
    i, hit, unsure = (own.column(c).to_numpy() for c in ("i", "hit", "open"))
    first, second = (np.searchsorted(i, edges.column(c).to_numpy()) for c in ("l", "r"))
    order = np.argsort(second, kind="stable")
    first, ends = first[order], np.searchsorted(second[order], np.arange(len(i) + 1))
    state = np.ones(len(i), np.int8)  # 0 removed, 1 kept, 2 open
    for at in np.flatnonzero((np.diff(ends) > 0) | hit | unsure):
        before = state[first[ends[at] : ends[at + 1]]]
        state[at] = 0 if hit[at] or (before == 1).any() else 2 if unsure[at] or (before == 2).any() else 1
    return pa.table({"i": i, "kept": pa.array(state == 1, mask=state == 2)})


def _by_segments(placed: DataFrame, edges: DataFrame, local: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``placed`` (i, ...) with ``kept``, in all segments of up to ``local`` nodes, and the rows and the edges of larger ones.
    Edges (l < r) join places; the left one decides on the right one."""
    cut_up = cut(segments(placed, edges))
    sizes = cut_up.groupBy("segment").agg(F.count("*").alias("n")).where("n > 1")
    sized = cut(cut_up.join(sizes, "segment", "left"))  # alone: no link, retained
    part = F.call_function("div", F.col("segment"), F.lit(max(1, local))).alias("part")  # neighbouring segments go together
    linked = edges.join(sized.select(F.col("i").alias("r"), "segment", "n"), "r")
    no = F.lit(False)
    small, own = sized.where(F.col("n") <= local).select(part, "i", no.alias("hit"), no.alias("open")), linked.where(F.col("n") <= local).select(part, "l", "r")
    decided = small.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(lambda a, b: _thinned(a, b), "i long, kept boolean")
    whole = sized.join(decided, "i", "left").where(F.col("n").isNull() | (F.col("n") <= local)).withColumn("kept", F.coalesce("kept", F.lit(True)))
    return whole.drop("segment", "n"), sized.where(F.col("n") > local).drop("segment", "n"), linked.where(F.col("n") > local).select("l", "r")


def _by_parts(nodes: DataFrame, edges: DataFrame, local: int, most: int) -> DataFrame:
    """``nodes`` (i) with ``kept``, of segments of any size: a task goes through ``local`` places, and leaves open what hangs
    on open nodes of the places before. Rounds are as many as the parts that a chain of decisions passes without a node
    that is decided by itself, not as its decisions; only parts with open nodes take another. After ``most`` rounds
    parts grow, up to ``WIDEST`` places."""
    width, rounds = max(1, local), 0
    links = cut(edges)
    state = nodes.select("i", F.lit(None).cast("boolean").alias("kept"))
    while True:
        part = lambda c: F.call_function("div", F.col(c), F.lit(width))  # noqa: E731, B023
        placed = state.withColumn("part", part("i"))
        live = placed if not rounds else placed.join(placed.where("kept IS NULL").select("part").distinct(), "part", "left_semi")
        ends = links.where(part("l") != part("r")).join(state.select(F.col("i").alias("l"), "kept"), "l")
        votes = ends.groupBy(F.col("r").alias("i")).agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.bool_or(F.col("kept").isNull()).alias("open"))
        told = live.select("part", "i").join(votes, "i", "left").select("part", "i", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("hit", "open")])
        inside = links.where(part("l") == part("r")).select(part("l").alias("part"), "l", "r")
        if rounds:
            inside = inside.join(told.select("part").distinct(), "part", "left_semi")
        now = told.groupBy("part").cogroup(inside.groupBy("part")).applyInArrow(lambda a, b: _thinned(a, b), "i long, kept boolean")
        state = cut(state.join(now.withColumnRenamed("kept", "now"), "i", "left").select("i", F.coalesce("kept", "now").alias("kept")))
        rounds += 1
        if not state.where("kept IS NULL").limit(1).count():
            return state
        width = min(2 * width, max(width, WIDEST)) if rounds >= most else width


def _spaced(rows: pa.Table, apart: int) -> pa.Table:
    """What a bin's own sites come to (null: it hangs on a site outside that is open). Sites (p, turn, kept, own), of each
    position one, are taken in turn."""
    rows = rows.sort_by("p")
    p, own, known = rows.column("p").to_numpy(), rows.column("own").to_numpy(), rows.column("kept").fill_null(False).to_numpy()
    low, high = np.searchsorted(p, p - apart, "right"), np.searchsorted(p, p + apart)
    out, unsure, state = np.zeros(len(p), bool), np.zeros(len(p), bool), np.full(len(p), 2, np.int8)
    for at in np.argsort(rows.column("turn").to_numpy()):
        if not known[at] and out[at]:
            state[at] = 0
        elif known[at] or own[at] and not unsure[at]:
            state[at] = 1
            out[low[at] : high[at]] = True
        else:
            unsure[low[at] : high[at]] = True
    told = rows.select(["g", "p", "turn"]).append_column("kept", pa.array(state == 1, mask=state == 2))
    return told.filter(pa.array(own & ~known))


def exclusion(sites: DataFrame, *, group: str, pos: str, order: str, apart: int, local: int = 50_000, most: int = 4) -> DataFrame:
    """``sites`` with ``kept``: in the order given (ties by position, then copies one after the other), a site is kept if
    none kept before it in its group is within ``apart``. A site without a position excludes none.

    Of the sites of one position only the first can be kept. These are decided in bins of ``local`` positions (or twice
    ``apart``), into which the sites within ``apart`` outside are copied: no pairs are made. What hangs on an open site of another
    bin waits for the next round, for which only bins with open sites are read; after ``most`` rounds bins grow.
    """
    names = sites.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    base = sites.select(row.alias("row"), F.col(group).alias("g"), F.col(pos).cast("long").alias("p"), F.col(order).alias("o"))
    if apart <= 0:
        return base.select("row.*", F.lit(True).alias("kept"))
    turns = numbered(base, "turn", "o", "p")  # copies get turns of their own
    left = cut(turns.where("p IS NOT NULL").groupBy("g", "p").agg(F.min("turn").alias("turn")).withColumn("kept", F.lit(None).cast("boolean")))
    kept, width, rounds = left.where("false"), max(local, 2 * apart), 0
    while True:
        at = lambda x: F.floor(x / F.lit(width))  # noqa: E731, B023
        own = at(F.col("p"))
        bins = F.explode(F.array_distinct(F.array(at(F.col("p") - (apart - 1)), own, at(F.col("p") + (apart - 1)))))
        dealt = left.unionByName(kept).select("*", bins.alias("bin")).withColumn("own", own == F.col("bin"))
        if rounds:
            live = left.select(F.col("g").alias("__g"), own.alias("__bin")).distinct()
            dealt = dealt.join(live, F.col("g").eqNullSafe(F.col("__g")) & (F.col("bin") == F.col("__bin")), "left_semi")
        told = cut(dealt.groupBy("g", "bin").applyInArrow(lambda rows: _spaced(rows, apart), left.schema))
        left, kept = told.where("kept IS NULL"), cut(kept.unionByName(told.where("kept")))
        rounds += 1
        if not left.limit(1).count():
            break
        width = min(2 * width, max(width, WIDEST)) if rounds >= most else width
    out = turns.join(kept.select("turn", "kept"), "turn", "left")
    return out.select("row.*", (F.col("kept").isNotNull() | F.col("p").isNull()).alias("kept"))


def greedy_thinning(nodes: DataFrame, links: DataFrame, *, key: str, by: list[str] | None = None, most: int = 4, local: int = 50_000) -> DataFrame:
    """``nodes`` with retained and removed_by: in the order of keys, a retained node removes those after
    it that it is linked to (``links``: left_key < right_key in that order, distance, r2).

    Nodes are cut into segments that no link crosses, and every segment is decided by itself, all at once: a
    task goes through some of them in the order of keys. Only segments of more than ``local`` nodes are cut into parts, which
    take rounds (``_by_parts``). Links whose ends aren't both nodes don't count.
    """
    by = by or []
    edges = cut(links.select(*by, "left_key", "right_key", "distance", "r2"))
    placed = cut(numbered(nodes.select(*by, F.col(key).alias("k")).distinct(), "i", *by, "k"))
    end = lambda name, out: placed.select(*by, F.col("k").alias(name), F.col("i").alias(out))
    indexed = cut(edges.join(end("left_key", "l"), [*by, "left_key"]).join(end("right_key", "r"), [*by, "right_key"]).select("l", "r"))
    whole, rest, links = _by_segments(placed, indexed, local)
    state = whole.select(*by, "k", "kept")
    if rest.limit(1).count():
        state = state.unionByName(rest.join(_by_parts(rest, links, local, most), "i").select(*by, "k", "kept"))
    state = cut(state)
    kept = state.where("kept").select(*by, F.col("k").alias("left_key"))
    remover = edges.join(kept, [*by, "left_key"]).groupBy(*by, F.col("right_key").alias("k")).agg(F.min(F.struct("left_key", "distance", "r2")).alias("m"))
    out = state.join(remover, [*by, "k"], "left")
    gone = ~F.col("kept")
    return out.select(*by, F.col("k").alias(key), F.col("kept").alias("retained"), *[F.when(gone, F.col(f"m.{c}")).alias(name) for c, name in (("left_key", "removed_by"), ("distance", "removal_distance"), ("r2", "removal_r2"))])


def thinning_profiles(nodes: DataFrame, links: DataFrame, profiles: dict[str, tuple[int, float]], *, key: str, by: list[str] | None = None) -> DataFrame:
    """``greedy_thinning`` under several profiles (name: window, least r2) at once: profile, window, threshold
    and its columns. Every profile is a group of its own in one thinning."""
    items = F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(w).alias("window"), F.lit(t).alias("threshold")) for n, (w, t) in profiles.items()])
    each = lambda df: df.withColumn("__p", F.explode(items)).select("*", "__p.*").drop("__p")
    own = each(links).where((F.col("distance") <= F.col("window")) & (F.col("r2") >= F.col("threshold")))
    groups = ["profile", "window", "threshold", *(by or [])]
    return greedy_thinning(each(nodes), own, key=key, by=groups)


def threshold_counts(pairs: DataFrame, windows: list[int], thresholds: list[float]) -> DataFrame:
    """window, pairs, valid and a count for each r2 threshold."""
    items = F.filter(F.array(*[F.when(F.col("distance") <= w, F.lit(w)) for w in windows]), lambda x: x.isNotNull())
    rows = pairs.select("r2", F.explode(items).alias("window"))
    counts = [F.count_if(F.col("r2") >= t).alias(f"r2_ge_{int(t * 100):03d}") for t in thresholds]
    return rows.groupBy("window").agg(F.count("*").alias("pairs"), F.count("r2").alias("valid"), *counts)
