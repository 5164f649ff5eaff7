"""Fail-loud table contracts: all rules of a table are counted in one aggregation.

A contract is an action on purpose: an assertion that sits in an unused column would be pruned.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociscale.functions.columns import finite, orient
from lociscale.plans.lineage import numbered

BASE = "^[ACGT]$"
VARIANT = ["chrom", "pos", "ref", "alt"]


def genome_keys() -> list[Column]:
    """What tables are sorted by: numbered contigs by number, then the others by name; position and alleles."""
    return [F.col("chrom").try_cast("int").asc_nulls_last(), F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")]


class ContractError(ValueError):
    """What a table violates, with the number of rows for each rule."""

    def __init__(self, table: str, violations: Mapping[str, int]):
        self.violations = dict(violations)
        super().__init__(f"{table}: " + ", ".join(f"{k} ({n} rows)" for k, n in violations.items()))


def require_columns(df: DataFrame, names: Iterable[str], table: str) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ContractError(table, {f"missing column {x}": 0 for x in missing})
    return df


def require_header(df: DataFrame, names: list[str], table: str) -> DataFrame:
    if df.columns != names:
        raise ContractError(table, {f"header is {df.columns}, not {names}": 0})
    return df


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, rows: how many rows break each rule (a rule that is null counts as broken)."""
    counts = [F.struct(F.lit(name).alias("rule"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("rows")) for name, ok in rules.items()]
    return df.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def enforce(df: DataFrame, rules: Mapping[str, Column], table: str, *, unique: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """``df`` itself, or ContractError with all counts. Keys are dealt to ``parts`` tasks, or to as many as the session says."""
    if unique:  # keys and whether any rule is broken in one pass; only a broken table's rows are counted
        broken = F.lit(False)
        for ok in rules.values():
            broken = broken | ~F.coalesce(ok, F.lit(False))
        dealt = df.select(*unique, broken.alias("__broken"))
        dealt = dealt.repartition(parts, *unique) if parts else dealt
        keyed = dealt.groupBy(*unique).agg(F.count("*").alias("rows"), F.max("__broken").alias("__broken"))
        doubled, faulty = keyed.agg(F.count_if(F.col("rows") > 1), F.max("__broken")).first()
        found = {r["rule"]: r["rows"] for r in violations(df, rules).collect() if r["rows"]} if faulty else {}
        if doubled:
            found[f"duplicate {','.join(c.lstrip('_') for c in unique)}"] = doubled
    else:
        found = {r["rule"]: r["rows"] for r in violations(df, rules).collect() if r["rows"]}
    if found:
        raise ContractError(table, found)
    return df


def variant_rules(score: str = "score") -> dict[str, Column]:
    pos = F.col("pos").try_cast("double")
    return {
        "chrom is missing": F.col("chrom").isNotNull() & (F.trim(F.col("chrom").cast("string")) != ""),
        "pos is not a positive integer": (pos > 0) & (pos == F.floor(pos)),
        "ref is not one canonical base": F.col("ref").rlike(BASE),
        "alt is not one canonical base": F.col("alt").rlike(BASE),
        "ref equals alt": F.col("ref") != F.col("alt"),
        "score is not finite": finite(F.col(score)).isNotNull(),
    }


def score_table(df: DataFrame, table: str = "score table", *, parts: int | None = None) -> DataFrame:
    """A typed copy of chrom, pos, ref, alt, score and whatever else is there, if all rules hold."""
    require_columns(df, [*VARIANT, "score"], table)
    enforce(df, variant_rules(), table, unique=VARIANT, parts=parts)
    return df.withColumns({"chrom": F.col("chrom").cast("string"), "pos": F.col("pos").cast("long"), "score": finite(F.col("score"))})


def eligibility(ladder: list[tuple[Column, str]]) -> Column:
    """The first reason that holds, or eligible."""
    out = F
    for condition, reason in ladder:
        out = out.when(F.coalesce(condition, F.lit(True)), reason)
    return out.otherwise("eligible")


def site_ladder(lengths: Column, window: int = 512) -> list[tuple[Column, str]]:
    """Why a site can't be scored; ``lengths`` is the length of its contig, null off the nuclear genome."""
    pos = F.col("pos").try_cast("long")
    half = window // 2
    return [
        (F.col("ref").isNull() | F.col("alt").isNull() | pos.isNull(), "malformed"),
        (lengths.isNull(), "non_nuclear"),
        (~(F.upper("ref").rlike(BASE) & F.upper("alt").rlike(BASE)), "noncanonical"),
        ((pos < 1) | (pos > lengths), "invalid_position"),
        ((pos <= half) | (pos > lengths - (window - half - 1)), "edge"),
    ]


def population_ladder(least_call_rate: float) -> list[tuple[Column, str]]:
    return [((F.col("ac_alt") == 0) | (F.col("ac_ref") == 0), "nonpolymorphic"), (F.col("allele_call_rate") < least_call_rate, "low_call_rate")]


def genotype_qc(call_rate: Column, af: Column, *, calls: float = 0.9, low: float = 0.05) -> Column:
    return (call_rate >= calls) & af.between(low, 1 - low)


def arithmetic_rules() -> dict[str, Column]:
    """What the counts and frequencies of a population table must satisfy among themselves."""
    close = lambda a, b: F.abs(a - b) <= 1e-9
    return {
        "an = ac_ref + ac_alt": F.col("an") == F.col("ac_ref") + F.col("ac_alt"),
        "an = 2 (n - missing)": F.col("an") == 2 * (F.col("n_genotypes") - F.col("n_missing")),
        "mac = least count": F.col("mac") == F.least("ac_ref", "ac_alt"),
        "af = ac_alt / an": close(F.col("af_alt"), F.try_divide("ac_alt", "an")),
        "maf = mac / an": close(F.col("maf"), F.try_divide("mac", "an")),
        "call rate": close(F.col("allele_call_rate"), F.try_divide(F.col("an"), 2 * F.col("n_genotypes"))),
    }


def coverage_rules(status: str = "status", value: str = "phylop") -> dict[str, Column]:
    """Covered rows have a finite value, the others none."""
    has = finite(F.col(value)).isNotNull()
    return {"covered without a value": (F.col(status) != "covered") | has, "a value without cover": (F.col(status) == "covered") | F.col(value).isNull()}


def track_violations(intervals: DataFrame, lengths: DataFrame, *, line: str | None = None, width: int = 1 << 20) -> DataFrame:
    """rule, rows for a track of half-open intervals (chrom, start, end, score): known contigs, bounds, finite
    scores, and no overlap with one before it on its contig; with ``line`` (a column that ascends in the order of
    the file) also that each starts no earlier than the one before it in the file.

    A contig is ordered in bins of ``width`` positions, with the greatest end of the bins before.
    """
    bins = intervals.withColumn("__bin", F.floor(F.col("start") / width))
    ends = bins.groupBy("chrom", "__bin").agg(F.max("end").alias("__end"))
    earlier = W.partitionBy("chrom").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)  # one row a bin
    reach = ends.select("chrom", "__bin", F.max("__end").over(earlier).alias("__reach"))
    inside = W.partitionBy("chrom", "__bin").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    rows = bins.join(reach, ["chrom", "__bin"]).withColumn("before", F.greatest(F.max("end").over(inside), F.col("__reach")))
    rows = rows.join(F.broadcast(lengths), "chrom", "left")  # a row for each contig
    rules = {
        "unknown contig": F.col("length").isNotNull(),
        "bad bounds": (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.coalesce("length", F.col("end"))),
        "score is not finite": finite(F.col("score")).isNotNull(),
        "overlap": F.col("before").isNull() | (F.col("before") <= F.col("start")),
    }
    out = violations(rows, rules)
    if line is None:
        return out
    return out.unionByName(disordered(intervals, line).select(F.lit("file order").alias("rule"), "rows"))


def disordered(intervals: DataFrame, line: str, width: int = 1 << 20) -> DataFrame:
    """rows: how many intervals start before one that comes earlier in the file on the same contig. Lines are
    taken in bins of ``width``, with the greatest start of the bins before."""
    bins = intervals.withColumn("__bin", F.floor(F.col(line) / width))
    tops = bins.groupBy("chrom", "__bin").agg(F.max("start").alias("__top"))
    earlier = W.partitionBy("chrom").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)  # one row a bin
    reach = tops.select("chrom", "__bin", F.max("__top").over(earlier).alias("__reach"))
    inside = W.partitionBy("chrom", "__bin").orderBy(line).rowsBetween(W.unboundedPreceding, -1)
    rows = bins.join(reach, ["chrom", "__bin"]).withColumn("before", F.greatest(F.max("start").over(inside), F.col("__reach")))
    return rows.agg(F.count_if(F.col("before") > F.col("start")).alias("rows"))


def score_validation(variants: DataFrame, scores: DataFrame, *, key: str = "variant_id", unchanged: list[str], llr: str = "llr", tolerance: float = 1e-5) -> DataFrame:
    """rule, rows of a scoring run against the variants it was given: complete and single ids, metadata as it
    was, the orientation that the frequencies give, and scores that are the ratio of their log probabilities.

    ``variants`` has key, ref, alt, af_alt and ``unchanged``; ``scores`` the same columns and ``llr``, log_p_ref,
    log_p_alt, orientation and score_minor_vs_major. All rules are one join and one aggregation.
    """
    given = variants.select(F.col(key).alias("__k"), F.struct(*unchanged).alias("__given"), "ref", "alt", "af_alt")
    told = scores.select(F.col(key).alias("__j"), F.struct(*unchanged).alias("__told"), llr, "log_p_ref", "log_p_alt", "orientation", "score_minor_vs_major")
    both = given.join(told, F.col("__k") == F.col("__j"), "full")
    o = orient(F.col("ref"), F.col("alt"), F.col("af_alt"), F.col(llr))
    there = F.col("__k").isNotNull() & F.col("__j").isNotNull()
    unless = lambda ok: ~there | F.coalesce(ok, F.lit(False))
    same = F.col("score_minor_vs_major").eqNullSafe(o["minor_vs_major"]) | (F.abs(F.col("score_minor_vs_major") - o["minor_vs_major"]) <= tolerance)
    rules = violations(both.withColumn("__o", o), {
        "variant without a score": F.col("__j").isNotNull(),
        "score without a variant": F.col("__k").isNotNull(),
        "metadata changed": unless(F.col("__given").eqNullSafe(F.col("__told"))),
        "score is not finite": unless(finite(F.col(llr)).isNotNull()),
        "orientation disagrees": unless(F.col("orientation").eqNullSafe(o["orientation"])),
        "oriented score disagrees": unless(same),
        "score is not the log ratio": unless(F.abs(F.col(llr) - (F.col("log_p_alt") - F.col("log_p_ref"))) <= tolerance),
    })
    twice = duplicate_keys(scores, [key]).agg(F.count("*").alias("rows")).select(F.lit("id scored twice").alias("rule"), "rows")
    return rules.unionByName(twice)


def load_variants(df: DataFrame, contigs: Mapping[str, str], lengths: DataFrame, *, key: str = "variant_id", table: str = "variants") -> DataFrame:
    """A variant table as a run needs it, or ContractError with all counts: known contigs, positions inside them,
    canonical alleles that differ, frequencies in [0, 1] of which maf is the lesser, single ids. Adds fasta_chrom
    and ``ordinal``, the place in genome order.

    contigs maps chrom to the names in ``lengths`` (contig, length: a row for each contig).
    """
    names = F.element_at(F.create_map(*[F.lit(x) for kv in contigs.items() for x in kv]), F.col("chrom").cast("string"))
    sized = df.withColumn("fasta_chrom", names).join(F.broadcast(lengths.select(F.col("contig").alias("fasta_chrom"), F.col("length").alias("__length"))), "fasta_chrom", "left")
    pos, af = F.col("pos").try_cast("long"), finite(F.col("af_alt"))
    enforce(sized, {
        "contig is not mapped": F.col("fasta_chrom").isNotNull() & F.col("__length").isNotNull(),
        "position is outside its contig": F.coalesce((pos >= 1) & (pos <= F.col("__length")), F.col("__length").isNull()),
        "ref is not one canonical base": F.col("ref").rlike(BASE), "alt is not one canonical base": F.col("alt").rlike(BASE), "ref equals alt": F.col("ref") != F.col("alt"),
        "af_alt is not in [0, 1]": af.between(0, 1), "maf is not the lesser frequency": F.abs(finite(F.col("maf")) - F.least(af, 1 - af)) <= 1e-9,
    }, table, unique=[key])
    return numbered(sized.drop("__length").withColumn("pos", pos), "ordinal", *genome_keys())


def comparison_ids(tables: Mapping[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    """table, rows, missing, not_finite: of the ids of all tables how many each lacks, and how many of its rows
    hold a value that isn't finite in one of ``columns``. Comparable tables have 0 and 0."""
    both = None
    for name, df in tables.items():
        fine = F.lit(True)
        for c in columns:
            fine = fine & finite(F.col(c)).isNotNull()
        own = df.select(F.col(key).alias("k"), F.lit(name).alias("table"), fine.alias("fine"))
        both = own if both is None else both.unionByName(own)
    ids = both.select("k").distinct().agg(F.count("*").alias("ids"))  # one row
    own = both.groupBy("table").agg(F.count("*").alias("rows"), F.count_if(~F.col("fine")).alias("not_finite"))
    distinct = both.select("table", "k").distinct().groupBy("table").agg(F.count("*").alias("own"))
    return own.join(distinct, "table").crossJoin(F.broadcast(ids)).select("table", "rows", (F.col("ids") - F.col("own")).alias("missing"), "not_finite")


def frozen_counts(df: DataFrame, by: str, expected: Mapping[str, int]) -> DataFrame:
    """by, expected, found, ok: the rows of each group against counts that were frozen; groups that one side
    lacks have 0 there."""
    frozen = df.sparkSession.createDataFrame(list(expected.items()), f"`{by}` string, expected long")
    found = df.groupBy(F.col(by).cast("string").alias(by)).agg(F.count("*").alias("found"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return frozen.join(found, by, "full").select(by, zero("expected"), zero("found"), F.col("expected").eqNullSafe(F.col("found")).alias("ok"))


def pinned(found: Mapping[str, str], pins: Mapping[str, str], *, allow_unpinned: bool = False) -> None:
    """Inputs by name with their digests, against pinned ones: a digest that differs, or a pin without an input,
    always raises; an input without a pin does unless ``allow_unpinned``."""
    bad = {f"{n} is not what was pinned": 1 for n in sorted(pins) if n in found and found[n] != pins[n]}
    bad |= {f"{n} is pinned and missing": 1 for n in sorted(pins) if n not in found}
    if not allow_unpinned:
        bad |= {f"{n} is not pinned": 1 for n in sorted(found) if n not in pins}
    if bad:
        raise ContractError("inputs", bad)


def preflight(inputs: Mapping[str, tuple[DataFrame, Mapping[str, Column], list[str] | None]]) -> DataFrame:
    """table, rule, rows of everything that is wrong with the inputs of a run, without running it: each has its
    rules and, if any, its key. An empty input is a fault; no rows mean that the run may start."""
    out = None
    for name, (df, rules, key) in inputs.items():
        faults = violations(df, rules)
        empty = df.limit(1).agg(F.count("*").alias("n")).select(F.lit("no rows").alias("rule"), (1 - F.col("n")).alias("rows"))
        faults = faults.unionByName(empty)
        if key:
            faults = faults.unionByName(duplicate_keys(df, key).agg(F.count("*").alias("rows")).select(F.lit(f"duplicate {','.join(key)}").alias("rule"), "rows"))
        own = faults.where("rows > 0").select(F.lit(name).alias("table"), "rule", "rows")
        out = own if out is None else out.unionByName(own)
    return out


def universe_audit(ranks: DataFrame) -> DataFrame:
    """scope, gene, methods, candidates, same: whether all methods of a scope ranked the same candidates. Sets are
    compared by the sums and the exclusive ors of two hashes of their ids."""
    one, two = F.xxhash64("variant_id"), F.xxhash64(F.lit(1), "variant_id")
    own = ranks.groupBy("scope", "gene", "method").agg(F.count("*").alias("n"), F.struct(F.count("*"), F.bit_xor(one), F.sum(F.pmod(two, F.lit(1 << 40)))).alias("s"))
    return own.groupBy("scope", "gene").agg(F.count("*").alias("methods"), F.max("n").alias("candidates"), (F.min("s") == F.max("s")).alias("same"))


def variable_rows(dosages: DataFrame, value: str = "dosages") -> DataFrame:
    """``dosages`` with whether at least two calls are there and they differ."""
    called = F.filter(value, lambda x: x.isNotNull() & (x >= 0))
    return dosages.withColumn("variable", (F.size(called) >= 2) & (F.array_min(called) < F.array_max(called)))


def reference_report(variants: DataFrame, sequences: DataFrame, *, width: int = 1 << 16) -> DataFrame:
    """outcome, rows, examples: reference alleles against contig sequences (``chrom``, ``seq``), or against a store of
    chunks of ``width`` (``chrom``, ``chunk``, ``start``, ``seq``). Rows meet the chunk of their position alone."""
    from lociscale.sources.sequences import beside, few, lengths, sequence_store

    store = sequences if "chunk" in sequences.columns else sequence_store(sequences, width=width, halo=0)
    at = F.col("pos").try_cast("long")
    met = beside(variants.select("chrom", "pos", "ref"), store, width=width).join(few(lengths(store)), "chrom", "left")
    seen = F.upper(F.substring("chunk_seq", (at - F.col("chunk_start")).cast("int"), F.lit(1)))
    outcome = F.when(F.col("length").isNull(), "mapping").when(at.isNull() | ~at.between(1, F.col("length")), "out_of_bounds").when(seen == F.upper("ref"), "match").otherwise("mismatch")
    rows = met.select(outcome.alias("outcome"), F.concat_ws(":", "chrom", "pos", "ref").alias("site"))
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("outcome").orderBy("site"))).where("n <= 20").groupBy("outcome").agg(F.array_sort(F.collect_list("site")).alias("examples"))
    return rows.groupBy("outcome").agg(F.count("*").alias("rows")).join(first, "outcome")


def single(df: DataFrame, condition: Column):
    """The only row that meets ``condition``."""
    found = df.where(condition).limit(2).collect()
    if len(found) != 1:
        raise ContractError("lookup", {"not exactly one record": len(found)})
    return found[0]


def rank_audit(ranks: DataFrame) -> DataFrame:
    """method, gene, and whether its ranks are 1 to n, its ids distinct and its target single."""
    own = ranks.groupBy("scope", "method", "gene").agg(
        F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("rank").alias("ranks"), F.countDistinct("variant_id").alias("ids"), F.count_if("target").alias("targets")
    )
    return own.select("scope", "method", "gene", "n", ((F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("ranks") == F.col("n"))).alias("ranks_ok"), (F.col("ids") == F.col("n")).alias("ids_ok"), (F.col("targets") == 1).alias("target_ok"))
