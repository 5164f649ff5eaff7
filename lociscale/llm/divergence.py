"""Audit of how far the sources of a language diverge, by sorted runs of terms.

Tasks count the terms of their documents in spans; (lang, term, source, span) is what is repartitioned and
sorted, with term and lang in one binary key, so that the sort's prefix tells terms apart, and a number for each (lang,
source). A scan of runs then adds up document frequencies and counts: a run of (lang, term, source) becomes one
row, and a term's runs are let through once its language has it in ``min_docs`` documents. Nothing else is sorted
or counted again: the runs give the totals of groups, partial sums for pairs of sources, and the terms.

Terms are runs of letters: of A to Z and of anything beyond ASCII, of which A to Z alone are lower-cased. Among the
kept terms of a language a group (lang, source) gives a term p = 1 + floor(10**9 (count + 1) / (N + V)), N the group's
count of kept terms and V their number. From q to p a term adds floor((p - q)**2 / q). All of it is exact in 64 bits
up to N + V of 9 * 10**15.

Pairs: for a term, only groups that have it move away from the value that they share for terms they lack; so
sums are kept as differences from that value, and the work of a term is its groups times the groups of its language.
Languages of very many sources are cut into blocks of about ``block`` sources; a row goes to each pair of blocks
that it is in, and by its term to one of several parts, so neither a language nor a source is one task.

Defined cases: null text, lang and source are ''; a row is a document, repeated rows too; a group without terms is
compared like any other; V = 0 gives 0 for each pair and no terms; a lang of one source has no pairs; very long texts
are counted whole; an empty table gives no rows; columns besides the three are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociscale.llm.common import cut

ONE = 1_000_000_000
#: What a term is made of stays, A to Z become small letters, and all other bytes part terms.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Different (source, term) pairs that a task holds before it passes a span of documents on.
HELD = 600_000
#: Tables of groups up to this many rows are broadcast (some 60 bytes each).
BROADCAST_GROUPS = 100_000
#: Rows of runs in one part of a pair of blocks.
PART_ROWS = 200_000
#: Shares that are held at once while pairs are added up.
CELLS = 2_000_000

SPANS = "run binary, g long, span long, docs long, count long"
RUNS = "term binary, g long, docs long, count long, lang_docs long, lang_count long, first boolean"
PAIRS = "g long, other long, value long, terms long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequency and count of each term of each group, in spans of documents."""
    counts: dict[tuple[bytes, int], Counter] = {}
    again: dict[tuple[bytes, int], dict] = {}  # how many of a term's occurrences aren't its document's first
    held, span = 0, None

    def out() -> Iterator[pa.RecordBatch]:
        for key, own in counts.items():
            tail, more, n = b"\0" + key[0], again[key].get, len(own)
            count = np.fromiter(own.values(), np.int64, n)
            docs = count - np.fromiter((more(t, 0) for t in own), np.int64, n)
            columns = [pa.array([t + tail for t in own], pa.binary()), pa.array(np.full(n, key[1])), pa.array(np.full(n, span)), pa.array(docs), pa.array(count)]
            yield pa.RecordBatch.from_arrays(columns, names=["run", "g", "span", "docs", "count"])

    for batch in batches:
        langs, texts = (batch.column(i).cast(pa.binary()).to_pylist() for i in (0, 2))
        for lang, g, text, row in zip(langs, batch.column(1).to_pylist(), texts, batch.column(3).to_pylist(), strict=True):
            terms = text.translate(LETTERS).split()
            if not terms:
                continue
            span = row if span is None else span
            key = lang, g
            own, more = counts.setdefault(key, Counter()), again.setdefault(key, {})
            before = len(own)
            own.update(terms)
            for term, n in Counter(terms).items():
                if n > 1:
                    more[term] = more.get(term, 0) + n - 1
            held += len(own) - before
            if held >= HELD:
                yield from out()
                counts, again, held, span = {}, {}, 0, None
    yield from out()


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where in sorted rows a value of ``names`` other than the row's before begins."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for name in names:
        col = table.column(name).combine_chunks()
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _summed(table: pa.Table) -> pa.Table:
    """Sorted rows, one for each run of (lang, term, source)."""
    at = _starts(table, ["run", "g"])
    kept = table.select(["run", "g"]).take(pa.array(at))
    for name in ("docs", "count"):
        kept = kept.append_column(name, pa.array(np.add.reduceat(table.column(name).to_numpy(), at)))
    return kept


def _scanned(min_docs: int):
    """Runs of sorted spans, with what their term's run of runs adds up to; those of rare terms go."""

    def whole(runs: pa.Table) -> pa.Table:
        at = _starts(runs, ["run"])
        long = np.diff(np.append(at, runs.num_rows))
        first = np.zeros(runs.num_rows, bool)
        first[at] = True
        for name in ("docs", "count"):
            runs = runs.append_column(f"lang_{name}", pa.array(np.repeat(np.add.reduceat(runs.column(name).to_numpy(), at), long)))
        runs = runs.append_column("first", pa.array(first))
        runs = runs.filter(pc.greater_equal(runs.column("lang_docs"), min_docs))
        term = pa.array([r.partition(b"\0")[0] for r in runs.column("run").to_pylist()], pa.binary())  # a term has no byte 0
        return runs.drop_columns(["run"]).add_column(0, "term", term)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None  # the runs of the last term, a row for each source
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            runs = _summed(rows if open_ is None else pa.concat_tables([open_, rows]).combine_chunks())
            last = int(_starts(runs, ["run"])[-1])
            open_ = runs.slice(last)
            if last:
                yield from whole(runs.slice(0, last)).to_batches()
        if open_ is not None:
            yield from whole(open_).to_batches()

    return scan


def share(count: np.ndarray | int, n: np.ndarray, v: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 (count + 1) / (n + v)) by long division, three digits at a time."""
    of = np.maximum(n + v, 1)
    whole, rest = np.divmod(count + 1, of)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + more
    return 1 + whole


def share_column(count: Column, n: Column, v: Column) -> Column:
    """The same in the plan."""
    of = F.greatest(n + v, F.lit(1))
    div = lambda a: F.call_function("div", a, of)
    whole, rest = div(count + 1), (count + 1) % of
    for _ in range(3):
        whole, rest = whole * 1000 + div(rest * 1000), (rest * 1000) % of
    return whole + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _partial_pairs(key: tuple, runs: pa.Table, groups: pa.Table) -> pa.Table:
    """Of one part of a pair of blocks: each pair of groups with its terms' gains, less what they would be
    if neither group had these terms, and the number of these terms."""
    left_block, right_block = key[1].as_py(), key[2].as_py()
    groups = groups.sort_by("g")
    g = groups.column("g").to_numpy()
    n, v = groups.column("n").to_numpy(), groups.column("v").to_numpy()
    block = groups.column("block").to_numpy()
    empty = share(0, n, v)
    rows = np.flatnonzero(block == left_block)
    cols = np.flatnonzero(block == right_block)
    value, terms = np.zeros((len(rows), len(cols)), np.int64), np.zeros((len(rows), len(cols)), np.int64)
    if runs.num_rows:
        coded = runs.column("term").combine_chunks().dictionary_encode()
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        term = coded.indices.to_numpy()[order]
        who = np.searchsorted(g, runs.column("g").to_numpy())[order]
        p = share(runs.column("count").to_numpy()[order], n[who], v[who])
        step = max(1, CELLS // len(g))
        for low in range(0, len(coded.dictionary), step):  # so many terms at a time, each with all sources
            of = slice(*np.searchsorted(term, [low, low + step]))
            shares = np.tile(empty, (min(step, len(coded.dictionary) - low), 1))
            has = np.zeros(shares.shape, bool)
            shares[term[of] - low, who[of]], has[term[of] - low, who[of]] = p[of], True
            _add(value, terms, shares, has, rows, cols, empty)
    i, j = (x.ravel() for x in np.meshgrid(rows, cols, indexing="ij"))
    other = i != j
    return pa.table({"g": g[i[other]], "other": g[j[other]], "value": value.ravel()[other], "terms": terms.ravel()[other]})


def _add(value: np.ndarray, terms: np.ndarray, shares: np.ndarray, has: np.ndarray, rows: np.ndarray, cols: np.ndarray, empty: np.ndarray) -> None:
    """Add the gains of some terms (rows of ``shares``): first of the terms that a left group has, against every
    right one; then of those that a right group has and left ones lack."""
    right = shares[:, cols]
    for k, g in enumerate(rows):
        own = np.flatnonzero(has[:, g])
        value[k] += gain(shares[own, g][:, None], right[own]).sum(0)
        terms[k] += len(own)
    lacks = ~has[:, rows]
    for k, h in enumerate(cols):
        own = np.flatnonzero(has[:, h])
        without = lacks[own]
        value[:, k] += np.where(without, gain(empty[rows][None, :], shares[own, h][:, None]), 0).sum(0)
        terms[:, k] += without.sum(0)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def named_groups(docs: DataFrame, lang: str, source: str) -> tuple[DataFrame, int]:
    """lang, source, g: every group of ``docs`` with a 64-bit hash as its number, and the seed by which no two
    groups have one."""
    names = cut(docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"))]).distinct())
    n, seed = names.count(), 0
    while names.select(_number(seed)).distinct().count() < n:
        seed += 1
    return names.select("lang", "source", _number(seed).alias("g")), seed


def _number(seed: int, lang: str = "lang", source: str = "source") -> Column:
    return F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source)])


def runs_of_terms(docs: DataFrame, seed: int, *, min_docs: int = 3, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """term, g, docs, count, lang_docs, lang_count, first: a row for each kept term of a language and group, sorted in
    partitions by (term, lang, group); ``first`` marks the first row of a term."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = docs.select(whole(lang), _number(seed, lang, source), whole(text), F.monotonically_increasing_id()).toDF("lang", "g", "text", "row")
    spans = slim.mapInArrow(_counted, SPANS)
    return spans.repartition("run").sortWithinPartitions("run", "g", "span").drop("span").mapInArrow(_scanned(min_docs), RUNS)


def audit(docs: DataFrame, *, min_docs: int = 3, top: int = 200, block: int = 1_024, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: for each group its divergence from every other source of its
    language (part ``pair``) and the ``top`` terms by which it exceeds its language (part ``term``)."""
    names, seed = named_groups(docs, lang, source)
    runs = cut(runs_of_terms(docs, seed, min_docs=min_docs, text=text, lang=lang, source=source))
    sums = runs.groupBy("g").agg(F.sum("count").alias("n"), F.count_if("first").alias("firsts"), F.count("*").alias("runs"))
    groups = cut(names.join(sums, "g", "left").select("lang", "source", "g", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "firsts", "runs")]))
    langs = groups.groupBy(F.col("lang").alias("of")).agg(
        F.sum("firsts").alias("v"), F.sum("n").alias("lang_n"),
        F.ceil(F.count("*") / block).cast("long").alias("blocks"), (F.call_function("div", F.sum("runs"), F.lit(PART_ROWS)) + 1).alias("parts"),
    )
    groups = cut(groups.join(langs, F.col("lang") == F.col("of")).select("lang", "source", "g", "n", "v", "lang_n", "blocks", "parts", F.pmod("g", F.col("blocks")).alias("block")))

    own = few(groups, BROADCAST_GROUPS)
    joined = runs.join(own, "g")
    # a group of a block stands on the left of each pair of blocks that has it on the left, and so on the right
    at, keys = F.explode(_met()).alias("at"), ["lang", F.col("at.a").alias("a"), F.col("at.b").alias("b"), "part"]
    sent = joined.select("lang", "g", "term", "count", F.pmod(F.xxhash64("term"), F.col("parts")).alias("part"), at).select(*keys, "g", "term", "count")
    heads = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("*", at).select(*keys, "g", "n", "v", "block").withColumnRenamed("lang", "of")
    partial = sent.groupBy("lang", "a", "b", "part").cogroup(heads.groupBy("of", "a", "b", "part")).applyInArrow(_partial_pairs, PAIRS)
    summed = partial.groupBy("g", "other").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    others = few(groups.select(F.col("g").alias("other"), F.col("source").alias("item"), F.col("n").alias("other_n")), BROADCAST_GROUPS)
    met = summed.join(own, "g").join(others, "other")
    p, q = share_column(F.lit(0), F.col("n"), F.col("v")), share_column(F.lit(0), F.col("other_n"), F.col("v"))
    rest = (F.col("v") - F.col("terms")) * F.call_function("div", (p - q) * (p - q), q)
    pairs = met.select("lang", "source", "g", F.lit("pair").alias("part"), "item", F.when(F.col("v") > 0, F.col("value") + rest).otherwise(0).alias("value"))

    p, q = share_column(F.col("count"), F.col("n"), F.col("v")), share_column(F.col("lang_count"), F.col("lang_n"), F.col("v"))
    gained = joined.select("g", "term", p.alias("p"), q.alias("q")).where("p > q").select("g", "term", F.expr("(p - q) * (p - q) div q").alias("value"))
    best = F.row_number().over(W.partitionBy("g").orderBy(F.desc("value"), "term"))
    terms = gained.withColumn("rank", best).where(F.col("rank") <= top).join(own, "g").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    order = F.row_number().over(W.partitionBy("g").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", order).drop("g").unionByName(terms)


def _met() -> Column:
    """The pairs of blocks that a row of ``block`` belongs to, each once."""
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pair = lambda a, b: F.named_struct(F.lit("a"), a, F.lit("b"), b)
    return F.array_distinct(F.concat(F.transform(others, lambda m: pair(F.col("block"), m)), F.transform(others, lambda m: pair(m, F.col("block")))))
