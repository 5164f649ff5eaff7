"""Matrix operators: imputation, kinship, mixed-model scans, components and neighbours.

The numerics that SciPy would give (normal quantiles, Student's tail, a bounded minimiser) are here.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociscale.plans.lineage import cut

#: Rows that stand for cells of a neighbour search.
MOST_PIVOTS = 2_048
#: Into how many parts the blocks of a neighbour search are put, each of which a block is sent to once, and the most rows of one.
HOLDERS, HOLDER_ROWS = 64, 1 << 18
#: Bytes of fitted phenotypes up to which these are broadcast to where the variants are.
BROADCAST_BYTES = 64 << 20


def imputed(df: DataFrame, vector: str, out: str = "standardized") -> DataFrame:
    """``df`` with each row's vector mean-imputed and standardised (divisor n); rows whose called values
    are constant or missing get null, for a contract to report."""
    called = F.filter(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  evaluates ``value`` once a row

    def scaled(mean):
        sd = F.sqrt(F.try_divide(add(F.transform(called, lambda x: (x - mean) * (x - mean))), F.size(vector)))
        values = lambda sd: F.transform(vector, lambda x: F.when(x.isNull() | F.isnan(x.cast("double")), 0.0).otherwise((x - mean) / sd))
        return once(sd, lambda sd: F.when(sd > 0, values(sd)))

    return df.withColumn(out, once(F.try_divide(add(called), F.size(called)), scaled))


def kinship(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """by, i, j, k: X'X / rows of the row vectors in each group (null vectors left out).

    Each task adds its rows to one matrix a group, so what is exchanged doesn't grow with the rows.
    """
    by = by or []
    rows = df.where(F.col(vector).isNotNull()).select(*by, F.col(vector).cast("array<double>").alias("v"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema] + ["i int, j int, s double, m long"])

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for key, part in batch.groupby(by, sort=False) if by else [((), batch)]:
                x = np.stack(part["v"].to_numpy()) if len(part) else np.zeros((0, 0))
                if len(x):
                    s, m = held.get(key, (0, 0))
                    held[key] = (s + x.T @ x, m + len(x))
        for key, (s, m) in held.items():
            i, j = np.indices(s.shape)
            yield pd.DataFrame({**{c: [v] * s.size for c, v in zip(by, key, strict=True)}, "i": i.ravel(), "j": j.ravel(), "s": s.ravel(), "m": m})

    sums = rows.mapInPandas(gram, schema).groupBy(*by, "i", "j").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    return sums.select(*by, "i", "j", (F.col("s") / F.col("m")).alias("k"), F.col("s"), F.col("m"))


def leave_one_group_out(grams: DataFrame, by: str) -> DataFrame:
    """by, i, j, k: the kinship of all groups but one, as the total less its own sums."""
    total = grams.groupBy("i", "j").agg(F.sum("s").alias("ts"), F.sum("m").alias("tm"))
    return grams.join(total, ["i", "j"]).select(by, "i", "j", F.try_divide(F.col("ts") - F.col("s"), F.col("tm") - F.col("m")).alias("k"))


def normal_scores(y: np.ndarray) -> np.ndarray:
    ranks = pd.Series(y).rank(method="average").to_numpy()
    inverse = NormalDist().inv_cdf
    return np.array([inverse((r - 0.5) / len(y)) for r in ranks])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction for the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def student_tail(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else math.nan
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def minimize_bounded(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-6) -> float:
    """A grid to find the valley, then golden sections in it."""
    grid = np.linspace(low, high, 65)
    at = int(np.argmin([f(x) for x in grid]))
    a, b = grid[max(0, at - 1)], grid[min(64, at + 1)]
    g = (math.sqrt(5) - 1) / 2
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = f(x), f(y)
    while b - a > tolerance:
        if fx < fy:
            b, y, fy = y, x, fx
            x = b - g * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + g * (b - a)
            fy = f(y)
    return (a + b) / 2


#: Fixed value: between which logarithms the ratio of residual to genetic variance is sought.
LOG_RATIO = (-8.0, 8.0)


class NullModel:
    """A mixed model without genotypes: contrasts that the covariates can't reach, turned so that they are
    independent under it.

    The contrasts are a basis of what is orthogonal to the intercept and the covariates. In that basis fixed
    effects have gone, so the likelihood of the contrasts is the restricted likelihood of the data, and a
    genotype's effect is a weighted regression through the origin. All loci share the basis.
    """

    def __init__(self, kin: np.ndarray, covariates: np.ndarray | None = None):
        """covariates: samples by covariates; columns that others explain don't count."""
        n = len(kin)
        fixed = np.ones((n, 1)) if covariates is None else np.column_stack([np.ones(n), covariates])
        basis, sizes, _ = np.linalg.svd(fixed, full_matrices=True)
        contrasts = basis[:, int((sizes > sizes[0] * 1e-10).sum()) :]
        spectrum, axes = np.linalg.eigh(contrasts.T @ kin @ contrasts)
        self.onto, self.spectrum = contrasts @ axes, np.maximum(spectrum, 0)

    def ratio(self, z: np.ndarray) -> float:
        """Of residual to genetic variance, of the greatest likelihood for contrasts ``z``."""
        def deviance(log_ratio: float) -> float:
            variance = self.spectrum + math.exp(log_ratio)
            return float(np.log(variance).sum() + len(z) * math.log((z * z / variance).sum()))

        return math.exp(minimize_bounded(deviance, *LOG_RATIO))

    def fit(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Contrasts of the normal scores of y, and their ratio, found once for all genotypes."""
        z = self.onto.T @ normal_scores(y)
        return z, self.ratio(z)

    def effects(self, z: np.ndarray, ratio: float, genotypes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """beta, se, p for each row of genotypes; missing ones are their row's mean. A row of one value has no
        estimate."""
        weight, free = 1 / (self.spectrum + ratio), len(z) - 1
        called = np.isfinite(genotypes)
        n = called.sum(axis=1, keepdims=True)
        mean = np.where(called, genotypes, 0).sum(axis=1, keepdims=True) / np.maximum(n, 1)
        moved = np.where(called, genotypes - mean, 0) @ self.onto
        own, shared, total = (moved * moved) @ weight, (moved * z) @ weight, (z * z) @ weight
        varies = np.where(called, genotypes, -np.inf).max(axis=1) > np.where(called, genotypes, np.inf).min(axis=1)
        varies &= own > 1e-9 * weight.max()
        out = np.full((3, len(genotypes)), np.nan)
        beta = shared[varies] / own[varies]
        se = np.sqrt(np.maximum(total - beta * shared[varies], 0) / (free * own[varies]))
        with np.errstate(divide="ignore"):
            out[:, varies] = beta, se, [student_tail(t, free) for t in np.abs(beta / se)]
        return out[0], out[1], out[2]

    def scan(self, y: np.ndarray, genotypes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """beta, se, p for each row of genotypes, and the ratio."""
        z, ratio = self.fit(y)
        return *self.effects(z, ratio, genotypes), ratio


def mixed_model(y: np.ndarray, genotypes: np.ndarray, kin: np.ndarray, covariates: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """beta, se and p for each row of genotypes, and the variance ratio."""
    return NullModel(kin, covariates).scan(y, genotypes)


def association_scan(genotypes: DataFrame, phenotypes: DataFrame, kin: DataFrame, *, covariates: np.ndarray | None = None, locus: str = "gene", variant: str = "variant_id", vector: str = "dosages", samples_most: int = 3_000) -> DataFrame:
    """locus, variant, beta, se, p, delta: a scan of each locus's variants against its phenotype vector
    (``phenotypes``: locus, values), given kinship entries (i, j, k) over the same samples and, if any,
    covariates (samples by covariates) that are regressed out of both sides.

    The basis of the null model goes to every task: it is samples by samples, and more than ``samples_most``
    raise. It is found once, on the driver.
    """
    n = kin.agg(F.max("i")).first()[0]
    if n is None or n >= samples_most:
        raise ValueError(f"kinship of {n} samples; the kernel holds {samples_most}")
    matrix = np.zeros((n + 1, n + 1))
    entries = kin.select("i", "j", "k").toPandas()
    matrix[entries["i"], entries["j"]] = entries["k"]
    shared = genotypes.sparkSession.sparkContext.broadcast(NullModel(matrix, covariates))

    kinds = dict(genotypes.dtypes)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            fits = [shared.value.fit(np.asarray(y, float)) for y in own["values"]]
            yield pd.DataFrame({locus: own[locus], "z": [z.tolist() for z, _ in fits], "delta": [d for _, d in fits]})

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for _, g in rows.groupby(locus, sort=False, dropna=False):
                ratio = float(g["delta"].iloc[0])
                beta, se, p = shared.value.effects(np.asarray(g["z"].iloc[0], float), ratio, np.stack(g[vector].to_numpy()).astype(float))
                yield pd.DataFrame({locus: g[locus], variant: g[variant], "beta": beta, "se": se, "p": p, "delta": ratio})

    # a locus's phenotype is fitted once, and its variants are scanned wherever they are
    models = cut(phenotypes.select(locus, "values").mapInPandas(fitted, f"{locus} {kinds[locus]}, z array<double>, delta double"))
    side = F.broadcast(models) if models.count() * n * 8 <= BROADCAST_BYTES else models
    rows = genotypes.select(locus, variant, vector).join(side, locus)
    return rows.mapInPandas(scanned, f"{locus} {kinds[locus]}, {variant} {kinds[variant]}, beta double, se double, p double, delta double")


def principal_components(df: DataFrame, vector: str, key: str, k: int) -> DataFrame:
    """key, component from 1, value: of the centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(rows).transform(rows)
    out = PCA(k=k, inputCol="c", outputCol="p").fit(centred).transform(centred)
    return out.select(key, F.posexplode(vector_to_array("p")).alias("component", "value")).withColumn("component", F.col("component") + 1)


def _qr(blocks: list[np.ndarray], width: int) -> np.ndarray:
    """The upper factor of the stacked blocks, ``width`` square."""
    out = np.zeros((width, width))
    r = np.linalg.qr(np.vstack(blocks), mode="r") if blocks else out
    out[: len(r)] = r
    return out


def _factor(rows: DataFrame, product: Callable[[np.ndarray], np.ndarray], width: int, fan: int = 16) -> np.ndarray:
    """The upper factor of a tall matrix of ``width`` columns whose rows are spread over tasks: a tree of small
    ones, ``fan`` to a task and level."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for x in _vectors(batches):
            r = _qr([*([] if r is None else [r]), product(x)], width)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["r"])

    def joint(own: pa.Table) -> pa.Table:
        r = _qr([np.array(x).reshape(width, width) for x in own.column("r").to_pylist()], width)
        return pa.table({"r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    level = cut(rows.mapInArrow(leaf, "r array<double>"))
    while (n := level.count()) > fan:
        level = cut(level.repartition(-(-n // fan)).groupBy(F.spark_partition_id()).applyInArrow(joint, "r array<double>"))
    return _qr([np.array(r[0]).reshape(width, width) for r in level.collect()], width)  # at most ``fan`` small factors


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The last column's arrays of a batch as a matrix."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of a matrix of ``shape`` over the rows: one a task, then by rows of the matrix."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in _vectors(batches):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    each = rows.mapInArrow(partial, "i long, v array<double>")
    width = shape[1]
    found = each.groupBy("i").agg(F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(width)]).alias("v")).toArrow()
    out = np.zeros(shape)
    out[found.column("i").to_numpy()] = np.array(found.column("v").to_pylist()).reshape(-1, width)
    return out


def randomised_components(df: DataFrame, vector: str, key: str, k: int = 50, *, more: int = 10, passes: int = 2, seed: int = 0) -> DataFrame:
    """key, component from 1, value: of the centred vectors, from a random range instead of a covariance matrix.

    ``k`` + ``more`` random directions are sent through the rows and back ``passes`` times, which turns them towards
    the leading components; a tree of QR factors keeps them apart in between. What the driver holds is as wide as
    the directions: their factors, and the directions themselves (vector length times ``k`` + ``more``). A component's
    greatest weight is positive. Rows with a missing vector are left out; vectors have one length.
    """
    rows = cut(df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v")))
    size = rows.select(F.size("v")).first()
    if size is None:
        return df.sparkSession.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, component int, value double")
    d, width = size[0], min(size[0], k + more)
    only = rows.select("v")
    mean = _summed(only, lambda x: x.sum(0, keepdims=True), (1, d)) / rows.count()
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    for _ in range(passes):
        r = _factor(only, lambda x, w=w: (x - mean) @ w, width)
        inverse = np.linalg.pinv(r)
        w = np.linalg.qr(_summed(only, lambda x, w=w, i=inverse: (x - mean).T @ ((x - mean) @ w @ i), (d, width)))[0]
    _, _, turn = np.linalg.svd(_factor(only, lambda x, w=w: (x - mean) @ w, width))
    axes = (w @ turn.T)[:, :k]
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list((x - mean) @ axes), pa.list_(pa.float64()))], names=[key, "values"])

    out = rows.mapInArrow(scored, f"{key} {dict(df.dtypes)[key]}, values array<double>")
    return out.select(key, F.posexplode("values").alias("component", "value")).withColumn("component", F.col("component") + 1)


def near_blocks(df: DataFrame, vector: str, key: str, k: int, block: int) -> DataFrame:
    """block, key, x, targets, holders: rows in blocks of about ``block``, keys and vectors side by side, the blocks that may
    have one of their nearest ``k`` in it, and the holder of each of these: blocks of near names, up to ``HOLDER_ROWS`` rows.

    Rows go to the nearest of up to ``MOST_PIVOTS`` rows, drawn by hash; large cells are cut by hash. A block finds its
    rows' nearest in itself first: the farthest of these bounds how far away anything of use to it can be. By the
    triangle inequality a block whose pivot is further off than this and both radii holds nothing.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    pack = lambda own: own.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("key", "v"))).alias("r")).select("block", "r.key", F.flatten("r.v").alias("x"))
    if n <= block:  # one block, which meets itself
        return pack(rows.withColumn("block", F.lit(0).cast("long"))).withColumns({"targets": F.array("block"), "holders": F.array("block")})
    rows = cut(rows)
    cells = min(MOST_PIVOTS, max(1, -(-n // block)))
    drawn = rows.orderBy(F.xxhash64("key"), "key", "v").limit(cells).select("v").toArrow()  # at most MOST_PIVOTS rows
    pivots = np.array(drawn.column("v").to_pylist(), float).reshape(drawn.num_rows, -1)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cell = ((pivots * pivots).sum(1) - 2 * (x @ pivots.T)).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=["key", "v", "cell"])

    placed = cut(rows.mapInArrow(assigned, "key long, v array<double>, cell long"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    own = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("key"), F.col("parts")))  # at most MOST_PIVOTS rows
    packed = cut(pack(own))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                keys, x = _block(batch, i)
                near = _Nearest(keys, x, k)
                near.meet(keys, x)
                radius = np.sqrt(((x - pivots[name >> 32]) ** 2).sum(1).max())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([float(radius)]), pa.array([float(np.sqrt(near.near[:, -1].max()))])], names=["block", "radius", "reach"])

    known = packed.mapInArrow(bounds, "block long, radius double, reach double").toArrow()  # a row for each block
    names, radius, reach = (known.sort_by("block").column(c).to_numpy() for c in ("block", "radius", "reach"))
    holder = np.arange(len(names)) // max(1, min(-(-len(names) // HOLDERS), HOLDER_ROWS // block))

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets, holders = [], []
            for name in batch.column(0).to_pylist():
                away = np.sqrt(((pivots[names >> 32] - pivots[name >> 32]) ** 2).sum(1))
                slack = 1e-9 * (1 + away + radius)  # of the roundings of all these distances
                met = (away - radius - radius[names == name] <= reach + slack) | (names == name)
                targets.append(names[met])
                holders.append(holder[met])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.list_(pa.int64())) for c in (targets, holders)]], names=["block", "key", "x", "targets", "holders"])

    return packed.mapInArrow(aimed, "block long, key array<long>, x array<double>, targets array<long>, holders array<long>")


def _block(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a packed block."""
    keys = batch.column(1)[i].values.to_numpy(zero_copy_only=False)
    return keys, batch.column(2)[i].values.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(keys), -1)


def neighbour_sets(df: DataFrame, vector: str, key: str, k: int = 15, block: int = 2048) -> DataFrame:
    """key, neighbours: the k nearest other rows by Euclidean distance, ties to the smaller key.

    Blocks of ``near_blocks`` are put into up to ``HOLDERS`` holders, each held by one task, which meet, one by one, the
    blocks that may matter to them; no task or driver holds all vectors. So a block is sent ``HOLDERS`` times at most, as long
    as a holder has no more than ``HOLDER_ROWS`` rows. Where the rows have clusters most blocks are ruled out before they are
    sent; where they have none, all meet all, and the comparisons grow with the square of the rows. Matrix products only rule
    pairs out (with a margin for their rounding); the order is that of the plain sums of squares. Rows without a vector
    take no part.
    """
    packed = dealt_blocks(near_blocks(df, vector, key, k, block))
    if isinstance(df.schema[vector].dataType.elementType, T.FloatType):
        packed = packed.withColumn("x", F.col("x").cast("array<float>"))
    dealt = packed.repartition("holder").sortWithinPartitions("holder", "other", "block").select("holder", "key", "x", "other", "block", "targets")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holder, held, own = None, {}, []

        def among() -> None:
            for x, targets in own:
                for target in targets:
                    held[target].meet(held[x].keys, held[x].x)
            own.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                keys, x = _block(batch, i)
                at, other, name, targets = (batch.column(c)[i].as_py() for c in (0, 3, 4, 5))
                if at != holder:
                    among()
                    for h in held.values():
                        yield h.result()
                    holder, held = at, {}
                if other:  # a holder's own blocks come first
                    among()
                    for target in targets:
                        held[target].meet(keys, x)
                else:
                    held[name] = _Nearest(keys, x, k)
                    own.append((name, targets))
        among()
        for h in held.values():
            yield h.result()

    return dealt.mapInArrow(nearest, "key long, neighbours array<long>")


def dealt_blocks(packed: DataFrame) -> DataFrame:
    """Blocks by holder: those of a holder's own and all others that may matter to some of them, with these as targets."""
    each = packed.withColumn("holder", F.explode(F.array_distinct("holders")))
    met = F.filter(F.arrays_zip("targets", "holders"), lambda p: p["holders"] == F.col("holder"))["targets"]
    return each.withColumns({"other": ~F.array_contains(met, F.col("block")), "targets": met}).drop("holders")


class _Nearest:
    """The nearest rows to those of one block, among the blocks it has met."""

    def __init__(self, keys: np.ndarray, x: np.ndarray, k: int) -> None:
        self.keys, self.x, self.k = keys.copy(), x.copy(), k
        self.sizes = (x * x).sum(axis=1)
        self.near = np.full((len(keys), k), np.inf)
        self.who = np.full((len(keys), k), np.iinfo(np.int64).max)

    def meet(self, keys: np.ndarray, x: np.ndarray, step: int = 64, most: int = 200_000) -> None:
        sizes = (x * x).sum(axis=1)
        left = np.column_stack([-2 * self.x, self.sizes, np.ones(len(self.x))])
        right = np.ascontiguousarray(np.column_stack([x, np.ones(len(x)), sizes]).T)  # one product gives the squared distances
        margin = (1e-12 + 1e-15 * x.shape[1]) * (self.sizes + sizes[np.isfinite(sizes)].max(initial=0))[:, None]
        found, n = [], 0
        for at in range(0, len(self.keys), step):
            own, limit = self.keys[at : at + step], self.near[at : at + step, -1:]
            about = left[at : at + step] @ right
            if len(keys) > self.k and np.isinf(limit).any():
                about[own[:, None] == keys] = np.inf
                limit = np.minimum(limit, np.partition(about, self.k - 1, axis=1)[:, self.k - 1 : self.k])
            i, j = divmod(hit := np.flatnonzero(about <= limit + 2 * margin[at : at + step]), len(keys))
            real = np.isfinite(about.ravel()[hit]) & (own[i] != keys[j])
            found.append((i[real] + at, j[real]))
            n += len(i)
            if n > most or at + step >= len(self.keys):
                i, j = (np.concatenate(c) for c in zip(*found, strict=True))
                for part in range(0, len(i), most):
                    self._add(i[part : part + most], keys, x, j[part : part + most])
                found, n = [], 0

    def _add(self, i: np.ndarray, keys: np.ndarray, x: np.ndarray, j: np.ndarray) -> None:
        touched, row = np.unique(i, return_inverse=True)
        d = ((self.x[i] - x[j]) ** 2).sum(axis=1)
        rows = np.concatenate([np.repeat(np.arange(len(touched)), self.k), row])
        near = np.concatenate([self.near[touched].ravel(), d])
        who = np.concatenate([self.who[touched].ravel(), keys[j]])
        order = np.lexsort((who, near, rows))
        first = np.searchsorted(rows[order], np.arange(len(touched)))
        best = order[first[:, None] + np.arange(self.k)]
        self.near[touched], self.who[touched] = near[best], who[best]

    def result(self) -> pa.RecordBatch:
        out = [w[~np.isinf(d)] for w, d in zip(self.who, self.near, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(self.keys), pa.array(out, pa.list_(pa.int64()))], names=["key", "neighbours"])


def neighbour_agreement(df: DataFrame, one: str, two: str, key: str, k: int = 15) -> DataFrame:
    """key, jaccard of its neighbour sets under two vector columns."""
    a = neighbour_sets(df, one, key, k)
    b = neighbour_sets(df, two, key, k).withColumnRenamed("neighbours", "others")
    return a.join(b, "key").select("key", (F.size(F.array_intersect("neighbours", "others")) / F.size(F.array_union("neighbours", "others"))).alias("jaccard"))


def procrustes(a: np.ndarray, b: np.ndarray) -> float:
    """Disparity of two configurations after translation, scaling and rotation."""
    x, y = (m - m.mean(axis=0) for m in (a, b))
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    return float(1 - np.linalg.svd(y.T @ x, compute_uv=False).sum() ** 2)


def procrustes_table(df: DataFrame, one: str, two: str, k: int) -> float:
    """The same for two configurations that stand row by row in two array columns of ``k`` coordinates: one
    aggregation gives the moments, whose size doesn't depend on the rows."""
    x, y = ([F.get(F.col(c).cast("array<double>"), F.lit(i)) for i in range(k)] for c in (one, two))
    n, *sums = df.agg(F.count("*"), *map(F.sum, x), *map(F.sum, y)).first()
    if not n:
        return math.nan
    centre = [v / n for v in sums]
    x, y = ([c - F.lit(m) for c, m in zip(cs, ms, strict=True)] for cs, ms in ((x, centre[:k]), (y, centre[k:])))
    moments = df.agg(*[F.sum(a * a) for a in x], *[F.sum(b * b) for b in y], *[F.sum(b * a) for b in y for a in x]).first()
    cross = np.array(moments[2 * k :], float).reshape(k, k) / math.sqrt(sum(moments[:k]) * sum(moments[k : 2 * k]))
    return float(1 - np.linalg.svd(cross, compute_uv=False).sum() ** 2)


def sample_quality(df: DataFrame, vector: str) -> DataFrame:
    """sample_index, call_rate, primary_include (>= 0.8), strict_include (>= 0.9) over variant rows."""
    long = df.select(F.posexplode(vector).alias("sample_index", "g"))
    rates = long.groupBy("sample_index").agg(F.avg((F.col("g").isNotNull() & (F.col("g") >= 0)).cast("double")).alias("call_rate"))
    return rates.withColumns({"primary_include": F.col("call_rate") >= 0.8, "strict_include": F.col("call_rate") >= 0.9})


def score_sequences(df: DataFrame, scorer: Callable[[list[str]], list[float]], *, column: str = "sequence", out: str = "score") -> DataFrame:
    """``df`` with what ``scorer`` gives for each batch of sequences; the model is the caller's."""
    plain = df.withColumn(out, F.lit(None).cast("double"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = scorer(batch.column(batch.schema.get_field_index(column)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.float64())], names=batch.schema.names)

    return plain.mapInArrow(scored, plain.schema)
