"""Approximate nearest neighbours by cosine, through shifted space-filling curves.

Unit vectors are projected to ``DIMS`` coordinates, a random rotation for each curve, shifted at random and
put in Hilbert order. Each curve's order is cut into ranges of near equal rows at keys from a bounded sample;
a query visits the ranges around its own on every curve. The windows of all curves are merged before anything
is scored: a pair is scored only on the first curve on which it meets, once, in double precision.

How many curves there are and how far their windows reach is fitted: on the sample the nearest neighbours are
known exactly; for 2, 4, 8 and 16 curves the windows are made as wide as they must be to hold ``recall`` of
them, and the number of curves with the least rows in its windows is taken (fewer, if equal). With data that have no
low-dimensional structure that is two curves whose windows hold most rows; with structure, more and narrower.

Rows with the same vector share their place in every order. At most the k + 1 of them with the least ids
can be in any result, so the others leave before the search (their queries don't); one search serves all
queries with the same vector. Queries that visit a range are met in parts of bounded size.

Defined cases: vectors that are null, zero, hold null or non-finite components or aren't of the commonest
length, and rows without an id, take no part; an empty table gives no rows. A query finds every row but
itself: rows of its own id with another vector are candidates, and so is a repeat of its own row (once);
repeated rows are one candidate for others. With fewer than k candidates all that were met are returned.
Ties go to the smaller id. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociscale.llm.common import cut, streamed_groups

DIMS, BITS = 8, 6
TIE_BITS = 14
#: The least rows of a range, and about the most queries that meet a range in one task.
LEAST_RANGE, PART_QUERIES = 512, 8_192
#: By how much scores that are computed in bulk may differ from those summed in order.
SLACK = 1e-11


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of cells (rows of coordinates under 2**bits), as int64.

    Axes to transposed index, highest bit first: undo the rotations of every level, then Gray-decode.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            on = (axes[i] & bit) != 0
            swap = np.where(on, 0, (axes[0] ^ axes[i]) & low)
            first = np.where(on, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap if i else first
            axes[0] = first
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] >> level) & 1, turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> level) & 1)
    return key


@dataclass
class CurveIndex:
    """Projections, scales and shifts of the curves; where their orders are cut; how far windows reach."""

    turns: np.ndarray  # curves, dimension, DIMS
    low: np.ndarray  # curves, DIMS
    span: np.ndarray
    shift: np.ndarray
    bounds: list[np.ndarray] | None = None
    reach: int = 0

    def first(self, curves: int, reach: int) -> "CurveIndex":
        return CurveIndex(self.turns[:curves], self.low[:curves], self.span[:curves], self.shift[:curves], self.bounds[:curves], reach)

    def keys(self, unit: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """A key for each vector on each curve; rows at one place on a curve are told apart by ``ties``."""
        out = np.empty((len(unit), len(self.turns)), dtype=np.int64)
        for c, turn in enumerate(self.turns):
            place = np.clip((unit @ turn - self.low[c]) / self.span[c], 0, 0.9999)
            cells = ((place + self.shift[c]) / 2 * (1 << BITS)).astype(np.int64)
            out[:, c] = (hilbert(cells, BITS) << TIE_BITS) | ties
        return out

    def ranges(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, keys[:, c], side="right") for c, b in enumerate(self.bounds)], axis=1)


def fit(sample: np.ndarray, ties: np.ndarray, rows: int, *, curves: int, recall: float, k: int, range_rows: int, seed: int) -> CurveIndex:
    """An index of ``rows`` rows from a sample of them (vectors, tie keys)."""
    rng = np.random.RandomState(seed)
    dim = sample.shape[1]
    d = min(DIMS, dim)
    turns = np.stack([np.linalg.qr(rng.randn(dim, dim))[0][:, :d] for _ in range(curves)])
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    low, high = np.stack([np.quantile(unit @ t, [0.002, 0.998], axis=0) for t in turns], axis=1)
    index = CurveIndex(turns, low, np.maximum(high - low, 1e-9), rng.rand(curves, d))
    keys = index.keys(unit, ties)
    n = len(unit)
    cuts = max(1, min(128, rows // LEAST_RANGE), rows // range_rows)
    index.bounds = [np.quantile(np.sort(keys[:, c]), np.arange(1, cuts) / cuts, method="lower") for c in range(curves)]
    place = np.empty_like(keys)
    for c in range(curves):
        place[np.argsort(keys[:, c], kind="stable"), c] = np.arange(n)
    gaps = []
    for i in range(0, n, max(1, n // 1000)):  # a thousand queries of the sample
        near = unit @ unit[i]
        near[i] = -2
        own = np.argpartition(-near, min(k, n - 1) - 1)[:k] if n > 1 else []
        gaps += [np.abs(place[j] - place[i]) / n for j in own if j != i]
    gaps = np.array(gaps).reshape(-1, curves)
    tried = []
    for c in sorted({min(x, curves) for x in (2, 4, 8, 16, curves)}):
        share = float(np.quantile(gaps[:, :c].min(axis=1), recall)) if len(gaps) else 1.0
        reach = int(np.ceil(share * cuts)) + (1 if cuts > 1 else 0)
        wide = min(1.0, (reach + 0.5) / cuts)
        tried.append((c * wide * (2 - wide), c, reach))  # the ends of an order cut windows short
    _, c, reach = min(tried)
    return index.first(c, reach)


def usable(vector: Column, dim: int) -> Column:
    fine = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0)


def _array(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _hash(low: np.ndarray) -> np.ndarray:
    x = low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - TIE_BITS)).astype(np.int64)


def _cosines(own: np.ndarray, norms: np.ndarray, one: np.ndarray, norm: float) -> np.ndarray:
    """Cosines whose sums are taken in order, so that equal vectors have equal ones wherever they are."""
    return np.cumsum(own * one, axis=1)[:, -1] / (norm * norms)


def _norms(vs: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(vs * vs, axis=1)[:, -1])


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, curves: int = 16, recall: float = 0.96, sample: int = 6_000, range_rows: int = 20_000, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` the nearest k found.

    sample bounds the rows that the index is fitted on; every row is indexed.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).where("vec_id IS NOT NULL")
    sizes = rows.where("v IS NOT NULL").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes["n"] if sizes and sizes["n"] else 1
    rows = rows.where(usable(F.col("v"), dim)).select("*", F.xxhash64(F.lit(1), "v").alias("v1"), F.xxhash64(F.lit(2), "v").alias("v2"))
    queries = cut(rows.where("q").select("vec_id", "v1", "v2"))
    first = F.row_number().over(W.partitionBy("v1", "v2").orderBy("vec_id"))
    kept = cut(rows.dropDuplicates(["vec_id", "v1", "v2"]).withColumn("copy", first).where(F.col("copy") <= k + 1).select("vec_id", "v", "v1", "v2", "copy"))
    n = kept.count()
    drawn = kept.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 40)) < int(min(1.0, sample / max(1, n)) * (1 << 40)))
    held = drawn.select("vec_id", "v").collect()  # about ``sample`` rows
    if not held:
        held = kept.select("vec_id", "v").limit(sample).collect()
    ids = np.array([r[0] for r in held], dtype=np.int64)
    index = fit(np.array([r[1] for r in held], dtype=np.float64).reshape(len(held), dim), _hash(ids), n, curves=curves, recall=recall, k=k, range_rows=range_rows, seed=seed) if held else None
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    asked = cut(queries.select("v1", "v2").distinct().withColumn("asked", F.lit(True)))
    marked = kept.join(asked, ["v1", "v2"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)) & (F.col("copy") == 1))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _array(batch.column(1), dim)
            at = own.ranges(own.keys(v / np.linalg.norm(v, axis=1, keepdims=True), _hash(batch.column(0).to_numpy())))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * at.shape[1]), pa.array(at.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "v", "v1", "v2", "asked", "at"])

    dealt = marked.select("vec_id", "v", "v1", "v2", "asked").mapInArrow(placed, "vec_id long, v array<double>, v1 long, v2 long, asked boolean, at array<int>")
    most, reach = (len(index.bounds[0]), index.reach) if index else (0, 0)
    parts = max(1, -(-int(asked.count() * min(1.0, (2 * reach + 1) / (most + 1))) // PART_QUERIES))
    base = ["vec_id", "v", "v1", "v2", "at"]
    stored = dealt.select(*base, F.lit(0).alias("kind"), F.posexplode("at").alias("curve", "range"))
    stored = stored.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asking = dealt.where("asked").select(*base, F.posexplode("at").alias("curve", "own"))
    window = F.sequence(F.greatest(F.lit(0), F.col("own") - reach), F.least(F.lit(most), F.col("own") + reach))
    asking = asking.select(*base, F.lit(1).alias("kind"), "curve", F.explode(window).alias("range"), F.pmod(F.xxhash64("v1"), F.lit(parts)).cast("int").alias("part"))
    order = ["curve", "range", "part"]
    met = stored.unionByName(asking).repartition(*order).sortWithinPartitions(*order, F.desc("kind"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, asks = None, []
        for at, rows in streamed_groups(batches, order, 4_000):
            if at != where:
                where, asks = at, []
            curve = at[0]
            vs = np.concatenate([_array(c, dim) for c in rows.column("v").chunks])
            ranges = np.concatenate([_array(c, shared.value.turns.shape[0]) for c in rows.column("at").chunks]).astype(np.int32)
            kinds, norms = rows.column("kind").to_numpy(), _norms(vs)
            one, two = rows.column("v1").to_numpy(), rows.column("v2").to_numpy()
            asks += [(one[i], two[i], vs[i], norms[i], ranges[i]) for i in np.flatnonzero(kinds == 1)]
            here = np.flatnonzero(kinds == 0)
            if not len(here) or not asks:
                continue
            ids, own, lengths, places, names = rows.column("vec_id").to_numpy()[here], vs[here], norms[here], ranges[here], one[here]
            out = []
            for a, b, v, norm, place in asks:
                near, own_at = own, None
                if curve:  # without those that the query meets on an earlier curve
                    own_at = np.flatnonzero((np.abs(places[:, :curve] - place[:curve]) > reach).all(axis=1))
                    near = own[own_at]
                scores = near @ v / (norm * lengths if own_at is None else norm * lengths[own_at])
                best = np.flatnonzero(scores >= np.partition(scores, -k - 1)[-k - 1] - SLACK) if len(scores) > k + 1 else np.arange(len(scores))
                best = best if own_at is None else own_at[best]
                exact = _cosines(own[best], lengths[best], v, norm)
                first = np.lexsort((ids[best], -exact))[: k + 1]
                out.append((a, b, ids[best][first], names[best][first], exact[first]))
            sizes = [len(x[2]) for x in out]
            yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat([x[i] for x in out], sizes)) for i in (0, 1)], *[pa.array(np.concatenate([x[i] for x in out])) for i in (2, 3, 4)]], names=["v1", "v2", "vec_id", "own", "score"])

    found = met.mapInArrow(ranked, "v1 long, v2 long, vec_id long, own long, score double")
    best = W.partitionBy("v1", "v2").orderBy(F.desc("score"), "vec_id")
    found = cut(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1))
    lists = found.groupBy("v1", "v2").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "own", "score"))).alias("near"))  # k + 1 at most
    mine = F.col("repeats") == 1  # the query's own row is no candidate
    others = F.when(mine, F.filter("near", lambda x: ~((x["vec_id"] == F.col("query_id")) & (x["own"] == F.col("v1"))))).otherwise(F.col("near"))
    out = queries.groupBy(F.col("vec_id").alias("query_id"), "v1", "v2").agg(F.count("*").alias("repeats")).join(lists, ["v1", "v2"]).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", "hit.score")
