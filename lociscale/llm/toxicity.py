"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector for all grades, and thresholds in order.
Features are whether a text has a word, or a word with a given beginning of 3 to 6 letters (which holds
inflected forms together). All that tell grades apart by a chi-square test are kept, whichever way they
speak. Weights and thresholds maximise the penalised likelihood, found by L-BFGS over sparse rows.
Predictions are over whole texts and give the chance of each grade and the expected severity.

Defined cases: a null or empty text has no features and gets the grade chances of the thresholds alone; texts
without labels, labels without a text, null grades and null doc_ids aren't learned from; a document with
several different grades is learned once for each, with repeated equal ones once; of several texts under one
doc_id the least is learned from; nothing to learn from, or an empty table: severity 0 for all; of equally
likely grades the least is given. Very long texts are read whole. Repeated rows stay; extra columns pass, but
for those with the names of the results, which these replace.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociscale.llm.common import cut, replaced, small_batches, spread, uniform

TOKEN = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)


class OrdinalModel:
    """Features, their shared weights, and the thresholds between ``len(thresholds) + 1`` grades."""

    def __init__(self, features: dict[str, float], thresholds: list[float]):
        self.words = {k: v for k, v in features.items() if not k.endswith("*")}
        self.heads = {n: {k[:-1]: v for k, v in features.items() if k.endswith("*") and len(k) == n + 1} for n in BEGINNINGS}
        self.thresholds = thresholds

    def score(self, text: str | None) -> float:
        own = set(TOKEN.findall(text.lower())) if text else set()
        total = sum(self.words[x] for x in self.words.keys() & own)
        for n, known in self.heads.items():
            if known:
                total += sum(known[x] for x in known.keys() & {w[:n] for w in own if len(w) >= n})
        return total

    def at_least(self, text: str | None) -> list[float]:
        """P(grade >= k) for k from 1."""
        x = self.score(text)
        return [float(1 / (1 + np.exp(np.clip(t - x, -50, 50)))) for t in self.thresholds]


def features_of(text: str | None) -> set[str]:
    own = set(TOKEN.findall(text.lower())) if text else set()
    return own | {f"{w[:n]}*" for w in own for n in BEGINNINGS if len(w) >= n}


def chi_square(up: float, seen: float, m: float, n: float) -> float:
    """Of a feature that ``seen`` of n samples have, ``up`` of them among the m graded above 0."""
    num = up * (n - m - seen + up) - (m - up) * (seen - up)
    return float(n * num * num / max(seen * (n - seen) * m * (n - m), 1e-9))


def fit(texts: list[set[str]], grades: list[int], *, chi: float = 12.0, support: int = 3) -> OrdinalModel:
    """A model of texts by their feature sets."""
    seen, up = Counter(), Counter()
    for own, g in zip(texts, grades, strict=True):
        seen.update(own)
        if g:
            up.update(own)
    m, n = sum(g > 0 for g in grades), len(grades)
    kept = sorted(f for f, k in seen.items() if k >= support and chi_square(up[f], k, m, n) >= chi)
    at = {f: i for i, f in enumerate(kept)}
    return fit_weights(kept, [[at[f] for f in own & at.keys()] for own in texts], grades)


class Likelihood:
    """The penalised negative log likelihood of sparse samples, and its gradient.

    Parameters are the weights, the first threshold, and the logarithms of the steps to the next ones.
    """

    def __init__(self, rows: list[list[int]], grades: np.ndarray, features: int, levels: int, ridge: float):
        self.sample = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.at = np.array([i for r in rows for i in r], dtype=np.int64)
        self.y, self.features, self.levels, self.ridge = grades, features, levels, ridge

    def thresholds(self, params: np.ndarray) -> np.ndarray:
        first, steps = params[self.features], params[self.features + 1 :]
        return first + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(steps, -30, 30)))])

    def __call__(self, params: np.ndarray) -> tuple[float, np.ndarray]:
        n, y, w, theta = len(self.y), self.y, params[: self.features], self.thresholds(params)
        z = np.bincount(self.sample, weights=w[self.at], minlength=n)
        cdf = np.ones((n, self.levels + 2))
        cdf[:, 0] = 0
        cdf[:, 1:-1] = 1 / (1 + np.exp(-np.clip(theta[None] - z[:, None], -50, 50)))
        slope, each = cdf * (1 - cdf), np.arange(n)
        p = np.maximum(cdf[each, y + 1] - cdf[each, y], 1e-12)
        by_z = (slope[each, y + 1] - slope[each, y]) / p
        by_theta = np.array([(slope[y == k + 1, k + 1] / p[y == k + 1]).sum() - (slope[y == k, k + 1] / p[y == k]).sum() for k in range(self.levels)])
        by_w = np.bincount(self.at, weights=by_z[self.sample], minlength=self.features) + self.ridge * w
        after = by_theta[::-1].cumsum()[::-1]  # a step moves all thresholds behind it
        by_steps = after[1:] * np.exp(np.clip(params[self.features + 1 :], -30, 30))
        return float(-np.log(p).sum() + self.ridge / 2 * (w @ w)), np.concatenate([by_w, after[:1], by_steps])


def minimised(f, x: np.ndarray, *, rounds: int = 300, memory: int = 10, tolerance: float = 1e-4) -> np.ndarray:
    """L-BFGS with backtracking, until no part of the gradient exceeds ``tolerance``."""
    value, grad = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(grad).max() <= tolerance:
            break
        way, held = -grad, []
        for s, g in reversed(moves):
            held.append((s @ way) / (s @ g))
            way = way - held[-1] * g
        if moves:
            s, g = moves[-1]
            way = way * (s @ g) / (g @ g)
        else:
            way = way / max(1.0, np.linalg.norm(way))
        for (s, g), a in zip(moves, reversed(held), strict=True):
            way = way + (a - (g @ way) / (s @ g)) * s
        slope, step = grad @ way, 1.0
        if slope >= 0:
            way, slope, moves = -grad, -(grad @ grad), []
        while step > 1e-12:
            new, after = f(x + step * way)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, g = step * way, after - grad
        if s @ g > 1e-12:
            moves = [*moves[-memory + 1 :], (s, g)]
        x, value, grad = x + s, new, after
    return x


def fit_weights(kept: list[str], rows: list[list[int]], grades: list[int], *, ridge: float = 0.1) -> OrdinalModel:
    """Weights by maximum penalised likelihood; ``rows`` holds each sample's features by their place in
    ``kept``."""
    y = np.asarray(grades, dtype=int)
    levels = int(y.max()) if len(y) else 0
    if levels == 0:
        return OrdinalModel({}, [50.0])
    f = Likelihood(rows, y, len(kept), levels, ridge)
    share = np.array([(y >= k).mean() for k in range(1, levels + 1)]).clip(1e-4, 1 - 1e-4)
    first = -np.log(share / (1 - share))
    start = np.concatenate([np.zeros(len(kept)), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    found = minimised(f, start)
    return OrdinalModel(dict(zip(kept, map(float, found), strict=False)), [float(t) for t in f.thresholds(found)])


def train(docs: DataFrame, graded: DataFrame, *, sample: int = 5_000, chi: float = 12.0, support: int = 3, text: str = "text", key: str = "doc_id") -> OrdinalModel:
    """Fit on rows of ``graded`` (doc_id, grade) joined to their texts; ``sample`` bounds how many different
    ones are drawn, by a hash of the key, and so the features, of which all that pass the test are kept."""
    small_batches(docs.sparkSession)
    rows = graded.select("doc_id", F.col("grade").cast("int").alias("grade")).where("grade IS NOT NULL AND doc_id IS NOT NULL").distinct()
    n = rows.count()
    drawn = rows.where(uniform(F.col("doc_id"), seed=6) < int(min(1.0, sample / max(1, n)) * (1 << 40)))
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    sampled = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # about ``sample`` rows

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(features_of(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.string()))], names=["doc_id", "grade", "features"])

    got = cut(sampled.select("doc_id", "grade", "text").mapInArrow(found, "doc_id long, grade int, features array<string>"))  # bounded by the sample
    m, n = got.agg(F.count_if(F.col("grade") > 0), F.count("*")).first()
    counts = got.select(F.explode("features").alias("f"), (F.col("grade") > 0).alias("up")).groupBy("f").agg(F.count("*").alias("seen"), F.count_if("up").alias("up"))
    num = F.col("up") * (n - m - F.col("seen") + F.col("up")) - (m - F.col("up")) * (F.col("seen") - F.col("up"))
    test = F.lit(float(n)) * num * num / F.greatest(F.col("seen") * (n - F.col("seen")) * F.lit(float(m * (n - m))), F.lit(1e-9))
    kept = sorted(r["f"] for r in counts.where((F.col("seen") >= support) & (test >= chi)).select("f").collect())  # of the sample's vocabulary

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(kept)}
        for batch in batches:
            own = [[at[f] for f in x if f in at] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["grade", "at"])

    small = got.orderBy("doc_id", "grade").select("grade", "features").mapInArrow(numbered, "grade int, at array<int>").collect()
    return fit_weights(kept, [r["at"] for r in small], [r["grade"] for r in small])


def score_toxicity(docs: DataFrame, model: OrdinalModel, *, cutoff: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with at_least (chance of each grade or above), severity (expected grade), grade (the
    likeliest) and toxic (the chance of a grade above 0 is at least ``cutoff``)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary of the sample
    added = {"at_least": "array<double>", "severity": "double", "grade": "int", "toxic": "boolean"}
    plain = replaced(spread(docs), **{k: F.lit(None).cast(v) for k, v in added.items()})
    source = next(c for c in docs.columns if c.lower() == text.lower())
    kinds = [pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.bool_()]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            chances = [own.at_least(x) for x in batch.column(batch.schema.get_field_index(source)).to_pylist()]
            edges = [np.array([1.0, *c, 0.0]) for c in chances]
            values = [chances, [float(sum(c)) for c in chances], [int(np.argmax(e[:-1] - e[1:])) for e in edges], [c[0] >= cutoff for c in chances]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: -len(kinds)], *[pa.array(v, k) for v, k in zip(values, kinds, strict=True)]], names=batch.schema.names)

    return plain.mapInArrow(scored, plain.schema)


def severity(toxic: Column, quality: Column) -> Column:
    """Grades from two binary labels: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return F.when(toxic == 0, 0).when(toxic == 1, F.when(quality == 0, 2).otherwise(1)).cast("int")
