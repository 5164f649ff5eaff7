"""Permutation tests and bootstraps whose draws are hashes of counters.

A draw depends on seed, label, replicate and counter alone, so results don't change with partitioning and
can be had in SQL. What is resampled is reduced to sufficient statistics of clusters before replicates
multiply it; the row count is replicates times clusters, not replicates times rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociscale.functions.columns import hash_draw
from lociscale.operators.ranks import rank_pairs, value_cells
from lociscale.operators.stats import complete, moment_corr, safe_corr
from lociscale.plans.lineage import cut, numbered


def derived_seed(base: int, label: str) -> int:
    """A 32-bit seed from a base seed and a label."""
    return int.from_bytes(hashlib.sha256(f"{base}|{label}".encode()).digest()[:8], "big") % (1 << 32)


def interval(estimates: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """replicates, mean, se and the 2.5 and 97.5 percentiles of ``value``."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return estimates.groupBy(*(by or [])).agg(F.count(value).alias("replicates"), F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.stddev_samp(value)).alias("se"), F.get(q, F.lit(0)).alias("low"), F.get(q, F.lit(1)).alias("high"))


def cluster_bootstrap(df: DataFrame, x: str, y: str, *, stratum: str, cluster: str, replicates: int, seed: str, ranked: bool = True) -> DataFrame:
    """replicate, estimate: whole clusters are drawn anew within each stratum, as many as it has.

    Ranks are taken once, over all rows, before resampling; six sums a cluster are all that is kept.
    """
    rows = complete(df, x, y).select(F.col(stratum).alias("s"), F.col(cluster).alias("c"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if ranked:
        rows = rank_pairs(rows, "x", "y").select("s", "c", F.col("rx").alias("x"), F.col("ry").alias("y"))
    sums = rows.groupBy("s", "c").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    own = W.partitionBy("s")
    indexed = sums.withColumn("i", F.row_number().over(own.orderBy("c")) - 1).withColumn("m", F.count("*").over(own))
    draws = indexed.select("s", "m", F.col("i").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = draws.select("s", "replicate", hash_draw(seed, F.col("m"), F.col("s"), F.col("replicate"), F.col("d")).cast("int").alias("i"))
    total = drawn.join(indexed.drop("m", "c"), ["s", "i"]).groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return total.select("replicate", moment_corr(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).alias("estimate"))


def paired_recovery(outcomes: DataFrame, *, replicates: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """loci, blocks, baseline, model_recovery, delta, low, high, status: whole blocks are drawn anew."""
    by = by or []
    diff = F.col("model_hit").cast("double") - F.col("baseline_hit").cast("double")
    blocks = outcomes.groupBy(*by, "block").agg(F.sum(diff).alias("d"), F.count("*").alias("n"), F.sum(F.col("model_hit").cast("int")).alias("hits"), F.sum(F.col("baseline_hit").cast("int")).alias("base"))
    own = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # a row for each block
    indexed = blocks.withColumn("i", F.row_number().over(own.orderBy("block")) - 1).withColumn("m", F.count("*").over(own))
    draws = indexed.select(*by, "m", F.col("i").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = draws.select(*by, "replicate", hash_draw(seed, F.col("m"), *[F.col(c) for c in by], F.col("replicate"), F.col("at")).cast("int").alias("i"))
    estimates = drawn.join(indexed.select(*by, "i", "d", "n"), [*by, "i"]).groupBy(*by, "replicate").agg(F.try_divide(F.sum("d"), F.sum("n")).alias("estimate"))
    spread = interval(estimates, "estimate", by).select(*by, "low", "high")
    total = indexed.groupBy(*by).agg(F.sum("n").alias("loci"), F.count("*").alias("blocks"), F.try_divide(F.sum("base"), F.sum("n")).alias("baseline"), F.try_divide(F.sum("hits"), F.sum("n")).alias("model_recovery"), F.try_divide(F.sum("d"), F.sum("n")).alias("delta"))
    out = total.join(spread, by, "left") if by else total.crossJoin(spread)  # one row each
    return out.withColumn("status", F.when(F.coalesce(F.col("loci"), F.lit(0)) == 0, "not_estimable").otherwise("descriptive_block_bootstrap"))


#: Rounds of the network that permutes places.
ROUNDS = 6
#: Values of all strata up to which one side of a permutation test is sent to the tasks (8 bytes each).
GATHERED = 2_000_000


def permuted(i: np.ndarray, n: int, seed: str, replicate: int, stratum: str) -> np.ndarray:
    """Where each of the places ``i`` of 0 to n - 1 goes: a balanced network of two halves of bits, whose rounds add
    a keyed multiply-shift hash of one half to the other. It permutes the least power of four that holds n; a place
    that it sends to n or beyond is sent on until it is below, so that it permutes 0 to n - 1 too."""
    half = 1
    while 1 << (2 * half) < n:
        half += 1
    low = np.int64((1 << half) - 1)
    keys = [hashlib.sha256(f"{seed}|{replicate}|{stratum}|{k}".encode()).hexdigest() for k in range(ROUNDS)]
    keys = [(np.int64(int(k[:8], 16) % (1 << 30) * 2 + 1), np.int64(int(k[8:16], 16) % (1 << 31))) for k in keys]
    out, todo = i.astype(np.int64), np.arange(len(i))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for a, b in keys:
            left, right = right, left ^ (((right * a + b) & 0x7FFFFFFF) >> (31 - half))
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out


def _strata(ranked: DataFrame) -> DataFrame:
    """Rows (s, k, rx, ry) with their place in the order of k in their stratum (i, from 0) and its size (n)."""
    placed = numbered(ranked, "p", "s", "k")
    starts = placed.groupBy("s").agg(F.min("p").alias("first"), F.count("*").alias("n"))
    return placed.join(starts, "s").select("s", (F.col("p") - F.col("first")).alias("i"), "n", "rx", "ry")


def stratified_permutation(df: DataFrame, x: str, y: str, *, stratum: str, key: str, replicates: int, seed: str) -> DataFrame:
    """observed, replicates, extreme, p: Spearman against permutations of y's ranks inside strata.

    A replicate's partner of a row comes by arithmetic (``permuted``) from its place in the order of ``key``, so nothing is
    sorted or dealt for a replicate: tasks look the partners up and pass on one sum of products a replicate, since
    the other moments stay what they are. Beyond ``GATHERED`` values the partners are joined by their places
    instead, with the same result. p = (extreme + 1) / (replicates + 1), two-sided; values that are equal to 12 digits
    count as extreme.
    """
    rows = complete(df, x, y)
    ranked = rank_pairs(rows, x, y).select(F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("s"), F.col(key).alias("k"), "rx", "ry")
    placed = cut(_strata(ranked))
    whole = placed.agg(F.count("*").alias("m"), F.sum("rx").alias("sx"), F.sum("ry").alias("sy"), F.sum(F.col("rx") * F.col("rx")).alias("sxx"), F.sum(F.col("ry") * F.col("ry")).alias("syy"), F.sum(F.col("rx") * F.col("ry")).alias("observed"))
    left = placed.select("s", "i", "n", "rx")
    if (placed.count()) <= GATHERED:
        table = placed.select("s", "i", "ry").toArrow()  # the size was checked
        strata = table.column("s").combine_chunks().dictionary_encode()
        code, place, value = strata.indices.to_numpy(), table.column("i").to_numpy(), table.column("ry").to_numpy()
        values = {}
        for c, name in enumerate(strata.dictionary.to_pylist()):
            own = code == c
            values[name] = np.empty(own.sum())
            values[name][place[own]] = value[own]

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(replicates)
            for s, i, n, rx in _by_stratum(batches):
                for r in range(replicates):
                    sums[r] += rx @ values[s][permuted(i, n, seed, r, s)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(sums)], names=["replicate", "sxy"])

        each = left.mapInArrow(summed, "replicate int, sxy double").groupBy("replicate").agg(F.sum("sxy").alias("sxy"))
    else:

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, i, n, rx in _by_stratum(batches):
                for r in range(replicates):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), r, np.int32)), pa.array([s] * len(i)), pa.array(permuted(i, n, seed, r, s)), pa.array(rx)], names=["replicate", "s", "i", "rx"])

        each = left.mapInArrow(sent, "replicate int, s string, i long, rx double").join(placed.select("s", "i", "ry"), ["s", "i"]).groupBy("replicate").agg(F.sum(F.col("rx") * F.col("ry")).alias("sxy"))
    rho = lambda sxy: moment_corr(F.col("m"), F.col("sx"), F.col("sy"), F.col("sxx"), F.col("syy"), F.col(sxy))
    both = each.crossJoin(F.broadcast(whole)).select(rho("sxy").alias("rho"), rho("observed").alias("observed"))  # one row
    extreme = F.count_if(F.round(F.abs("rho"), 12) >= F.round(F.abs("observed"), 12))
    return both.groupBy("observed").agg(F.count("*").alias("replicates"), extreme.alias("extreme")).withColumn("p", (F.col("extreme") + 1) / (F.col("replicates") + 1))


def _by_stratum(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, int, np.ndarray]]:
    """stratum, places, size of the stratum, ranks of the rows of a batch that are in it."""
    for batch in batches:
        strata = batch.column(0).dictionary_encode()
        code = strata.indices.to_numpy()
        for c, name in enumerate(strata.dictionary.to_pylist()):
            own = np.flatnonzero(code == c)
            yield name, batch.column(1).to_numpy()[own], int(batch.column(2)[int(own[0])].as_py()), batch.column(3).to_numpy()[own]


#: Counts that a task holds at once: rows of a part times replicates.
HELD = 1 << 22
#: Cells of values, read side by side.
VALUE_CELLS = 256


def _changes(v: np.ndarray) -> np.ndarray:
    """Where the values of a sorted array begin (NaN is one value)."""
    return np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))])) if len(v) else np.zeros(0, int)


def _drawn(indexed: DataFrame, groups: list[tuple[int, list[Column]]], *, replicates: int, seed: str) -> DataFrame:
    """cell, g, v, counts: how often each replicate draws a value, a byte a replicate (what is above 255 is in further rows).

    ``indexed`` has g (a place in ``groups``, each of which has a size and what names its draws), i and v. Draws don't need
    the rows: they are made from counters, sorted in batches, and go as packed numbers to the part of the rows that they
    hit; a part has ``HELD`` counts. Rows are sorted by cell, a range of values, and value.
    """
    spark, width = indexed.sparkSession, max(1, HELD // replicates)
    span = width * replicates

    def packed(g: int):
        def dealt(keys: np.ndarray) -> pa.RecordBatch:
            keys.sort()
            parts, first = np.unique(keys // span, return_index=True)
            own = [(k - p * span).astype(np.uint32).tobytes() for p, k in zip(parts, np.split(keys, first[1:]), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([g] * len(parts), pa.int32()), pa.array(parts, pa.int64()), pa.array(own, pa.binary())], names=["g", "part", "draws"])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                held.append(batch.column(1).to_numpy() * replicates + batch.column(0).to_numpy())
                n += batch.num_rows
                if n >= HELD:
                    yield dealt(np.concatenate(held))
                    held, n = [], 0
            if n:
                yield dealt(np.concatenate(held))

        return deal

    dealt = None
    for g, (size, name) in enumerate(groups):
        slices = max(spark.sparkContext.defaultParallelism, -(-size * replicates // (2 * HELD)))
        draws = spark.range(0, size, 1, slices).select("id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
        own = draws.select("replicate", hash_draw(seed, F.lit(size), *name, F.col("replicate"), F.col("id")).alias("i")).mapInArrow(packed(g), "g int, part long, draws binary")
        dealt = own if dealt is None else dealt.unionByName(own)

    cuts = [c / VALUE_CELLS for c in range(1, VALUE_CELLS)]
    ends = np.unique(np.array(indexed.where(~F.isnan("v")).agg(F.percentile_approx("v", cuts, F.lit(10_000))).first()[0] or [], float))

    def counted(own: pa.Table, draws: pa.Table) -> pa.Table:
        counts = np.zeros(span, np.int64)
        for chunk in draws.column("draws").chunks:
            for packed in chunk:
                keys, n = np.unique(np.frombuffer(packed.as_buffer(), np.uint32), return_counts=True)
                counts[keys] += n
        v, g = own.column("v").to_numpy(), own.column("g")[0].as_py()
        order = np.argsort(v, kind="stable")
        v, counts = v[order], counts.reshape(width, replicates)[own.column("i").to_numpy()[order] % width]
        first = _changes(v)
        v, counts = v[first], np.add.reduceat(counts, first, axis=0)
        out = []
        while len(v := v[some := counts.any(axis=1)]):
            counts = counts[some]
            low = np.minimum(counts, 255)
            at = np.arange(len(v) + 1, dtype=np.int32) * replicates
            rows = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(at), pa.py_buffer(low.astype(np.uint8))])
            out.append(pa.RecordBatch.from_arrays([pa.array(np.searchsorted(ends, v, side="right"), pa.int32()), pa.array([g] * len(v), pa.int32()), pa.array(v, pa.float64()), rows], names=["cell", "g", "v", "counts"]))
            counts = counts - low
        return pa.Table.from_batches(out, schema=pa.schema([("cell", pa.int32()), ("g", pa.int32()), ("v", pa.float64()), ("counts", pa.binary())]))

    rows = indexed.withColumn("part", F.floor(F.col("i") / width))
    counts = rows.groupBy("g", "part").cogroup(dealt.groupBy("g", "part")).applyInArrow(counted, "cell int, g int, v double, counts binary")
    return cut(counts.repartition("cell").sortWithinPartitions("cell", "v"))


def _by_value(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """cell, values, counts (values by groups by replicates) of rows that are sorted by cell and value; each value comes once."""
    step, held = max(1, HELD // (4 * replicates)), None
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            cell, g, v = (part.column(i).to_numpy() for i in range(3))
            counts = np.zeros((len(v), 2, replicates), np.int64)
            counts[np.arange(len(v)), g] = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(v), replicates)
            if held:
                cell, v, counts = (np.concatenate(x) for x in zip(held, (cell, v, counts), strict=True))
            first = _changes(v)
            cell, v, counts = cell[first], v[first], np.add.reduceat(counts, first, axis=0)
            held = cell[-1:], v[-1:], counts[-1:]  # may go on in the next batch
            for name in np.unique(cell[:-1]):
                own = np.flatnonzero(cell[:-1] == name)
                yield int(name), v[own], counts[own]
    if held:
        yield int(held[0][0]), held[1], held[2]


def _estimates(drawn: DataFrame, sizes: list[int], replicates: int) -> tuple[DataFrame, DataFrame]:
    """replicate, u (of pairs of the first and the second group, twice those where the first is greater and once the equal
    ones), and replicate, g, median: cells are summed, then only those are read again in which a middle lies."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([cell] * replicates, pa.int32()), pa.array(range(replicates), pa.int32()), pa.array(total[0]), pa.array(total[1]), pa.array(u)], names=["cell", "replicate", "n0", "n1", "u"])

        cell, total, u = None, None, None
        for name, _, counts in _by_value(batches, replicates):
            if name != cell:
                if cell is not None:
                    yield told()
                cell, total, u = name, np.zeros((2, replicates), np.int64), np.zeros(replicates, np.int64)
            upto = total[1] + np.cumsum(counts[:, 1], axis=0)
            u += (counts[:, 0] * (2 * upto - counts[:, 1])).sum(axis=0)
            total += counts.sum(axis=0)
        if cell is not None:
            yield told()

    below = W.partitionBy("replicate").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cut(drawn.mapInArrow(summed, "cell int, replicate int, n0 long, n1 long, u long").withColumns({f"b{g}": F.coalesce(F.sum(f"n{g}").over(below), F.lit(0)) for g in (0, 1)}))
    middles = [F.struct(F.lit(g).alias("g"), (F.lit(place) - F.col(f"b{g}")).alias("place"), F.col(f"n{g}").alias("n")) for g, size in enumerate(sizes) if size for place in ((size - 1) // 2, size // 2)]
    wanted: dict[int, list[tuple[int, int, int]]] = {}
    for r in cells.select("cell", "replicate", F.inline(F.array(*middles))).where("place >= 0 AND place < n").collect():  # four a replicate
        wanted.setdefault(r["cell"], []).append((r["replicate"], r["g"], r["place"]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, total = None, None
        for name, v, counts in _by_value(batches, replicates):
            if name != cell:
                cell, total = name, np.zeros((2, replicates), np.int64)
            upto = total + np.cumsum(counts, axis=0)
            hit = [(r, g, float(v[np.searchsorted(upto[:, g, r], place, side="right")])) for r, g, place in wanted[name] if total[g, r] <= place < upto[-1, g, r]]
            total = upto[-1]
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hit, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["replicate", "g", "v"])

    medians = drawn.where(F.col("cell").isin(list(wanted))).mapInArrow(found, "replicate int, g int, v double").groupBy("replicate", "g").agg(F.sum(F.col("v") * 0.5).alias("median"))
    return cells.groupBy("replicate").agg(F.sum(F.col("n0") * 2 * F.col("b1") + F.col("u")).alias("u")), medians


def median_bootstrap(df: DataFrame, value: str, key: str, *, replicates: int, seed: str) -> DataFrame:
    """replicate, estimate: medians of as many values as there are, drawn with replacement. Replicates times rows are drawn,
    but no task holds a replicate."""
    rows = df.where(F.col(value).isNotNull()).select(F.lit(0).alias("g"), F.col(value).cast("double").alias("v"), F.col(key).alias("k"))
    indexed = numbered(rows, "i", "k").drop("k")
    if not (size := indexed.count()):
        return df.sparkSession.createDataFrame([], "replicate int, estimate double")
    _, medians = _estimates(_drawn(indexed, [(size, [])], replicates=replicates, seed=seed), [size], replicates)
    return medians.select("replicate", F.col("median").alias("estimate"))


def _split(draws: int, left: int, whole: int, *node: object) -> int:
    """How many of ``draws`` that fall into a node of ``whole`` rows fall into its left part of ``left``: a binomial
    draw that depends on the node's name alone."""
    if draws == 0 or left == 0:
        return 0
    if left == whole:
        return draws
    name = hashlib.sha256("|".join(map(str, node)).encode()).digest()
    return int(np.random.Generator(np.random.Philox(key=int.from_bytes(name[:16], "big"))).binomial(draws, left / whole))


def _descend(upto: np.ndarray, draws: int, place: int, *tree: object) -> tuple[int, int, int]:
    """The leaf that holds the draw at ``place`` (from 0, in order) of ``draws`` over leaves with cumulative counts
    ``upto``, with how many draws it has and the place among them."""
    low, high = 0, len(upto)
    while high - low > 1:
        middle = (low + high) // 2
        before = int(upto[low - 1]) if low else 0
        left = _split(draws, int(upto[middle - 1]) - before, int(upto[high - 1]) - before, *tree, low, high)
        if place < left:
            high, draws = middle, left
        else:
            low, draws, place = middle, draws - left, place - left
    return low, draws, place


def order_bootstrap(df: DataFrame, value: str, *, replicates: int, seed: str) -> DataFrame:
    """replicate, estimate: medians of as many values as there are, drawn with replacement, without drawing them.

    How many of the draws fall below a value is binomial, and so on inside either part; so a replicate goes down a tree of
    the counts of distinct values, one binomial draw a level, to where the middle of its draws lies. The upper levels
    are the sums of cells of values, a fixed number; a cell's values are one group of which each has about
    equally many. The work is replicates times levels, beside one count of the rows. Draws are named by seed, replicate
    and node, so results are the same on every run.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    cells = cut(value_cells(counts, "v", []))
    sums = cells.groupBy("__cell").agg(F.sum("n").alias("n")).orderBy("__cell").collect()  # at most CELLS squared
    if not sums:
        return df.sparkSession.createDataFrame([], "replicate int, estimate double")
    names, upto = [r["__cell"] for r in sums], np.cumsum([r["n"] for r in sums])
    m = int(upto[-1])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, names[leaf], draws, place) for r in batch.column(0).to_pylist() for at in ((m - 1) // 2, m // 2) for leaf, draws, place in [_descend(upto, m, at, seed, r)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["replicate", "__cell", "draws", "place"])

    def inside(cell: pa.Table, wanted: pa.Table) -> pa.Table:
        own = cell.sort_by("v")
        v, upto = own.column("v").to_numpy(), np.cumsum(own.column("n").to_numpy())
        rows = [(r, float(v[_descend(upto, draws, place, seed, r, c)[0]])) for r, c, draws, place in zip(*[wanted.column(i).to_pylist() for i in range(4)], strict=True)]
        return pa.table([pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.float64())], names=["replicate", "v"])

    wanted = df.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate")).mapInArrow(placed, "replicate int, __cell int, draws long, place long")
    ends = cells.groupBy("__cell").cogroup(wanted.groupBy("__cell")).applyInArrow(inside, "replicate int, v double")
    return ends.groupBy("replicate").agg(F.avg("v").alias("estimate"))


def pairwise_bootstrap(df: DataFrame, value: str, label: str, a: object, b: object, *, key: str, replicates: int, seed: str) -> DataFrame:
    """replicate, median_difference, rank_biserial: two groups drawn independently, each as often as it has rows.

    Draws are hashes of counters over the rows in order of ``key``, which has to tell rows apart. Replicates times
    rows are drawn and spread over the tasks as packed numbers; no task holds a replicate.
    """
    rows = df.where(F.col(label).isin(a, b) & F.col(value).isNotNull()).select(F.when(F.col(label) == a, 0).otherwise(1).alias("g"), F.col(value).cast("double").alias("v"), F.col(key).alias("k"))
    placed = numbered(rows, "p", "g", "k")
    known = {r["g"]: r["n"] for r in placed.groupBy("g").agg(F.count("*").alias("n")).collect()}  # two rows
    sizes = [known.get(g, 0) for g in (0, 1)]
    if not known:
        return df.sparkSession.createDataFrame([], "replicate int, median_difference double, rank_biserial double")
    indexed = placed.select("g", "v", (F.col("p") - F.col("g") * sizes[0]).alias("i"))
    drawn = _drawn(indexed, [(sizes[0], [F.lit("true")]), (sizes[1], [F.lit("false")])], replicates=replicates, seed=seed)
    sums, medians = _estimates(drawn, sizes, replicates)
    m = medians.groupBy("replicate").agg(*[F.max(F.when(F.col("g") == g, F.col("median"))).alias(f"m{g}") for g in (0, 1)])
    return sums.join(m, "replicate").select("replicate", (F.col("m0") - F.col("m1")).alias("median_difference"), (F.try_divide("u", F.lit(sizes[0] * sizes[1]).cast("long")) - 1).alias("rank_biserial"))
