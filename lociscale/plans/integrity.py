"""Queries on what keeps runs honest: contracts, columns that decide, and sources and sinks, each of which is
written from a whole table and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociscale.functions import columns as C
from lociscale.operators import contracts, joins, ld, prioritize, ranks, reports, stats
from lociscale.plans.lineage import numbered, shared_folder
from lociscale.plans.registry import query, rounded
from lociscale.plans.standins import CANDIDATES_SQL, COMPARED_SQL, VARIANTS_SQL, candidates, compared, table, variants
from lociscale.sources import readers, writers
from lociscale.streaming import scores

V = f"variants AS ({VARIANTS_SQL})"
K = f"candidates AS ({CANDIDATES_SQL})"


#: Rows of which one task holds the keys.
TASK_ROWS = 2_000_000


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/lociscale-{uuid.uuid4().hex}"


# --- contracts -----------------------------------------------------------------------------------


def _scored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as variants, and a scoring run that went wrong here and there."""
    k = F.col("s_suppkey")
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    given = table(spark, sf, "supplier").select(k.alias("variant_id"), "s_nationkey", F.get(bases, (k % 4).cast("int")).alias("ref"), F.get(bases, ((k + 1) % 4).cast("int")).alias("alt"), ((k % 11) / 10).alias("af_alt"))
    told = given.where(k % 17 != 3).withColumns({"log_p_ref": -(F.col("variant_id") % 7) / 8, "log_p_alt": -(F.col("variant_id") % 5) / 4})
    told = told.withColumn("llr", F.col("log_p_alt") - F.col("log_p_ref") + F.when(F.col("variant_id") % 13 == 0, 0.5).otherwise(0.0))
    o = C.orient(F.col("ref"), F.col("alt"), F.col("af_alt"), F.col("llr"))
    told = told.withColumn("s_nationkey", F.when(F.col("variant_id") % 19 == 0, -1).otherwise(F.col("s_nationkey"))).withColumn("orientation", F.when(F.col("variant_id") % 23 == 0, "alt_minor").otherwise(o["orientation"]))
    told = told.withColumn("score_minor_vs_major", F.when(F.col("variant_id") % 29 == 0, 9.0).otherwise(o["minor_vs_major"])).drop("ref", "alt", "af_alt")
    return given, told.unionByName(told.where("variant_id % 31 = 1")).unionByName(told.where("variant_id % 37 = 2").withColumn("variant_id", -F.col("variant_id")))


@query("score_validation", """
    WITH t AS (SELECT s_suppkey AS k, s_suppkey % 11 AS f, s_suppkey % 17 <> 3 AS told, -(s_suppkey % 5) / 4.0::DOUBLE + (s_suppkey % 7) / 8.0::DOUBLE + CASE WHEN s_suppkey % 13 = 0 THEN 0.5 ELSE 0 END AS llr FROM supplier),
    m AS (SELECT * FROM t WHERE told UNION ALL SELECT * FROM t WHERE told AND k % 31 = 1)
    SELECT 'variant without a score' AS rule, CAST(count(*) FILTER (WHERE NOT told) AS BIGINT) AS rows FROM t
    UNION ALL SELECT 'score without a variant', CAST(count(*) FILTER (WHERE told AND k % 37 = 2) AS BIGINT) FROM t
    UNION ALL SELECT 'metadata changed', CAST(count(*) FILTER (WHERE k % 19 = 0) AS BIGINT) FROM m
    UNION ALL SELECT 'score is not finite', CAST(0 AS BIGINT)
    UNION ALL SELECT 'orientation disagrees', CAST(count(*) FILTER (WHERE k % 23 = 0 AND NOT f < 5) AS BIGINT) FROM m
    UNION ALL SELECT 'oriented score disagrees', CAST(count(*) FILTER (WHERE k % 29 = 0) AS BIGINT) FROM m
    UNION ALL SELECT 'score is not the log ratio', CAST(count(*) FILTER (WHERE k % 13 = 0) AS BIGINT) FROM m
    UNION ALL SELECT 'id scored twice', CAST(count(*) FILTER (WHERE told AND k % 31 = 1) AS BIGINT) FROM t""")
def score_validation(spark: SparkSession, sf: str) -> DataFrame:
    given, told = _scored(spark, sf)
    return contracts.score_validation(given, told, unchanged=["s_nationkey"])


@query("load_variants", """
    WITH v AS (SELECT s_suppkey AS variant_id, CAST(s_nationkey % 12 + 1 AS VARCHAR) AS chrom, s_suppkey * 7 % 9001 + 1 AS pos FROM supplier)
    SELECT variant_id, chrom, 'contig' || chrom AS fasta_chrom, pos, CAST(row_number() OVER (ORDER BY CAST(chrom AS INTEGER), pos, substr('ACGT', CAST(variant_id % 4 + 1 AS INTEGER), 1), substr('ACGT', CAST((variant_id + 1) % 4 + 1 AS INTEGER), 1), variant_id) - 1 AS BIGINT) AS ordinal FROM v""")
def load_variants(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    v = table(spark, sf, "supplier").select(k.alias("variant_id"), (F.col("s_nationkey") % 12 + 1).cast("string").alias("chrom"), (k * 7 % 9001 + 1).alias("pos"), F.get(bases, (k % 4).cast("int")).alias("ref"), F.get(bases, ((k + 1) % 4).cast("int")).alias("alt"), ((k % 10) / 10).alias("af_alt"))
    v = v.withColumn("maf", F.least(F.col("af_alt"), 1 - F.col("af_alt")))
    lengths = spark.createDataFrame([(f"contig{i}", 10_000) for i in range(1, 13)], "contig string, length long")
    return contracts.load_variants(v, {str(i): f"contig{i}" for i in range(1, 13)}, lengths).select("variant_id", "chrom", "fasta_chrom", "pos", "ordinal")


@query("comparison_ids", """
    WITH a AS (SELECT c_custkey AS k, c_acctbal AS x, 'customer' AS t FROM customer UNION ALL SELECT o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END, 'orders' FROM orders)
    SELECT t AS "table", CAST(count(*) AS BIGINT) AS rows, CAST((SELECT count(DISTINCT k) FROM a) - count(DISTINCT k) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE x IS NULL) AS BIGINT) AS not_finite FROM a GROUP BY t""")
def comparison_ids(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).otherwise(float("nan")).alias("x"))
    return contracts.comparison_ids({"customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x")), "orders": o}, "k", ["x"])


@query("frozen_counts", """
    WITH f AS (SELECT o_orderstatus AS o, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT * FROM (VALUES ('F', 10), ('O', 0), ('X', 3)) v(o, n))
    SELECT coalesce(f.o, e.o) AS o_orderstatus, CAST(coalesce(e.n, 0) AS BIGINT) AS expected, CAST(coalesce(f.n, 0) AS BIGINT) AS found, f.n IS NOT DISTINCT FROM e.n AS ok FROM f FULL JOIN e ON f.o = e.o""")
def frozen_counts(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.frozen_counts(table(spark, sf, "orders"), "o_orderstatus", {"F": 10, "O": 0, "X": 3})


@query("preflight", """
    SELECT 'customer' AS "table", 'balance is negative' AS rule, CAST(count(*) AS BIGINT) AS rows FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0
    UNION ALL SELECT 'lineitem', 'duplicate l_orderkey,l_linenumber', CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) HAVING count(*) > 0
    UNION ALL SELECT 'nothing', 'no rows', CAST(1 AS BIGINT)""")
def preflight(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.preflight({
        "customer": (table(spark, sf, "customer"), {"balance is negative": F.col("c_acctbal") >= 0, "name is missing": F.col("c_name").isNotNull()}, ["c_custkey"]),
        "lineitem": (table(spark, sf, "lineitem"), {"quantity is not positive": F.col("l_quantity") > 0}, ["l_orderkey", "l_linenumber"]),
        "nothing": (table(spark, sf, "region").where("false"), {"key is missing": F.col("r_regionkey").isNotNull()}, None),
    })


@query("universe_audit", f"""
    WITH {K}, m AS (SELECT gene, variant_id, 'A' AS method FROM candidates WHERE model_a IS NOT NULL UNION ALL SELECT gene, variant_id, 'B' FROM candidates WHERE model_b IS NOT NULL),
    s AS (SELECT gene, method, count(*) AS n, string_agg(variant_id, ',' ORDER BY variant_id) AS ids FROM m GROUP BY 1, 2)
    SELECT 'all' AS scope, gene, CAST(count(*) AS BIGINT) AS methods, CAST(max(n) AS BIGINT) AS candidates, count(DISTINCT ids) = 1 AS same FROM s GROUP BY gene""")
def universe_audit(spark: SparkSession, sf: str) -> DataFrame:
    k = candidates(spark, sf)
    own = lambda m, c: k.where(F.col(c).isNotNull()).select(F.lit("all").alias("scope"), "gene", F.lit(m).alias("method"), "variant_id")
    return contracts.universe_audit(own("A", "model_a").unionByName(own("B", "model_b")))


@query("population_checks", """
    WITH g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS missing, count(*) FILTER (WHERE l_returnflag = 'A') AS r FROM lineitem GROUP BY 1),
    t AS (SELECT l_suppkey, n, missing, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE r END AS ac_ref, n - missing - r AS ac_alt, (n - missing) / n::DOUBLE AS rate FROM g)
    SELECT l_suppkey, CASE WHEN ac_alt = 0 OR ac_ref = 0 THEN 'nonpolymorphic' WHEN rate < 0.5 THEN 'low_call_rate' ELSE 'eligible' END AS status,
        rate >= 0.48 AND (l_suppkey % 20) / 20.0 BETWEEN 0.05 AND 0.95 AS qc, rate / 100 <= 0.05 / (l_suppkey % 5 + 1) AS family FROM t""")
def population_checks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_suppkey")
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("missing"), F.count_if(F.col("l_returnflag") == "A").alias("r"))
    t = g.select("l_suppkey", F.when(k % 9 == 0, 0).otherwise(F.col("r")).alias("ac_ref"), (F.col("n") - F.col("missing") - F.col("r")).alias("ac_alt"), ((F.col("n") - F.col("missing")) / F.col("n")).alias("allele_call_rate"))
    rate = F.col("allele_call_rate")
    return t.select("l_suppkey", contracts.eligibility(contracts.population_ladder(0.5)).alias("status"), contracts.genotype_qc(rate, (k % 20) / 20, calls=0.48).alias("qc"), prioritize.family_threshold(rate / 100, k % 5 + 1, F.lit(1)).alias("family"))


@query("coverage_checks", """
    WITH r AS (SELECT p_partkey % 3 <> 0 AS c, p_partkey % 7 <> 0 AS has, p_partkey % 5 = 0 AS masked FROM part)
    SELECT 'covered without a value' AS rule, CAST(count(*) FILTER (WHERE c AND NOT masked AND NOT has) AS BIGINT) AS rows FROM r
    UNION ALL SELECT 'a value without cover', CAST(count(*) FILTER (WHERE NOT (c AND NOT masked) AND has) AS BIGINT) FROM r""")
def coverage_checks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(C.coverage_status(k % 3 != 0, k % 5 == 0).alias("status"), F.when(k % 7 != 0, F.col("p_retailprice")).alias("phylop"))
    return contracts.violations(p, contracts.coverage_rules())


@query("variable_variants", """
    SELECT vec_id, len(list_distinct(list_filter(list_transform(embedding, lambda x: CAST(round(x) AS INTEGER)), lambda x: x >= 0))) >= 2 AS variable FROM embeddings""")
def variable_variants(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x).cast("int")).alias("dosages"))
    return contracts.variable_rows(e).select("vec_id", "variable")


@query("single_record", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation)")
def single_record(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    top = n.agg(F.max("n_nationkey")).first()[0]
    row = contracts.single(n, F.col("n_nationkey") == top)
    return spark.createDataFrame([(row["n_nationkey"], row["n_name"])], n.select("n_nationkey", "n_name").schema)


@query("identity_faults", """
    WITH e AS (SELECT vec_id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE), CAST(embedding[4] AS DOUBLE)] AS x FROM embeddings)
    SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'probabilities do not add up to 1' WHEN vec_id % 7 = 0 THEN 'log ratio is not the difference of logits' END AS fault FROM e""")
def identity_faults(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("x"))
    p = C.log_softmax(F.col("x"))
    p = F.when(F.col("vec_id") % 5 == 0, F.transform(p, lambda v: v + 0.01)).otherwise(p)
    told = F.when(F.col("vec_id") % 7 == 0, F.transform("x", lambda v, i: v + i * 0.001)).otherwise(F.col("x"))
    return e.select("vec_id", C.distribution_faults(p, told, F.lit("A"), F.lit("G")).alias("fault"))


# --- columns that decide -------------------------------------------------------------------------


@query("variant_fields", """
    SELECT s_suppkey, 'chr' || (s_nationkey % 5 + 1) AS mapped, s_suppkey * 3 AS id_pos, 'C' AS id_alt, substr(s_name, 10) AS stripped, -s_acctbal AS harmonised,
        CASE WHEN s_suppkey % 4 = 0 THEN 'no_VCF_record_at_position' WHEN s_suppkey % 4 = 1 THEN 'reference_allele_mismatch' WHEN s_suppkey % 4 = 2 THEN 'ALT_or_biallelic_definition_mismatch' ELSE 'exact_biallelic_match' END AS match,
        abs(s_acctbal) >= 500 AND abs(s_acctbal - 4000) >= 500 AND sign(s_acctbal) = sign(s_acctbal - 4000) AS consistent,
        CASE WHEN s_acctbal < 0 THEN 'negative' WHEN s_nationkey > 12 THEN 'far' ELSE 'ok' END AS reason, CASE WHEN s_suppkey % 6 = 0 THEN 0.0 ELSE s_acctbal END AS filled,
        abs(s_acctbal - 4000) <= 100 + 0.1 * 4000 AS near, abs(s_acctbal - 4000) <= greatest(0.1 * greatest(abs(s_acctbal), 4000), 300) AS close,
        CAST(('0x' || substr(sha256('7|' || s_name), 9, 8)) AS BIGINT) AS seed FROM supplier""")
def variant_fields(spark: SparkSession, sf: str) -> DataFrame:
    s, k, bal = table(spark, sf, "supplier"), F.col("s_suppkey"), F.col("s_acctbal")
    v = C.split_variant_id(C.variant_id(F.lit("1"), k * 3, F.lit("A"), F.lit("C")))
    match = C.match_category(k % 4 != 0, F.lit("A"), F.lit("C"), F.when(k % 4 == 1, "G").otherwise("A"), F.when(k % 4 == 2, "T").otherwise("C"))
    return s.select(
        "s_suppkey", C.map_chromosome(F.col("s_nationkey") % 5 + 1, {str(i): f"chr{i}" for i in range(1, 6)}).alias("mapped"), v["pos"].alias("id_pos"), v["alt"].alias("id_alt"), C.strip_prefix(F.col("s_name"), "Supplier#").alias("stripped"),
        C.harmonised(bal).alias("harmonised"), match.alias("match"), C.consistent_pair(bal, bal - 4000, 500).alias("consistent"), C.first_reason((bal < 0, "negative"), (F.col("s_nationkey") > 12, "far")).alias("reason"),
        C.filled(F.when(k % 6 == 0, float("nan")).otherwise(bal)).alias("filled"), C.near(bal, F.lit(4000.0), atol=100, rtol=0.1).alias("near"), C.close(bal, F.lit(4000.0), rel=0.1, absolute=300).alias("close"), C.derived_seed(7, F.col("s_name")).alias("seed"),
    )


SEQ = "regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGTRYSWKMBDHVN]', 'N', 'g')"


@query("sequence_fields", f"""
    WITH s AS (SELECT item_id, {SEQ} AS seq FROM benchmark), p AS (SELECT *, substr(seq, 6, 12) AS oligo, translate(reverse(substr(seq, 6, 12)), 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN') AS back FROM s WHERE length(seq) >= 24),
    h AS (SELECT *, len(list_filter(range(1, length(seq) - 10), lambda i: substr(seq, i, 12) = oligo)) AS a, len(list_filter(range(1, length(seq) - 10), lambda i: substr(seq, i, 12) = back)) AS b FROM p)
    SELECT item_id, translate(reverse(seq), 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN') AS rc, substr(seq, 10 - 4, 12) AS inner_window, CASE WHEN (a = 1) <> (b = 1) THEN CASE WHEN a = 1 THEN '+' ELSE '-' END END AS strand, item_id % 3 <> 0 AS changed FROM h""")
def sequence_fields(spark: SparkSession, sf: str) -> DataFrame:
    text = F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACGTRYSWKMBDHVN]", "N")
    s = table(spark, sf, "benchmark").select("item_id", text.alias("seq")).where("length(seq) >= 24")
    hit = C.oligo_hit(F.col("seq"), F.substring("seq", 6, 12))
    own = C.tokens(F.col("seq"))
    masked = F.when(F.col("item_id") % 3 == 0, own).otherwise(C.tokens(F.col("seq"), F.lit(9)))
    return s.select("item_id", C.reverse_complement_iupac(F.col("seq")).alias("rc"), C.inner_context(F.col("seq"), F.lit(10), 12, 4).alias("inner_window"), hit["strand"].alias("strand"), reports.single_token_change(own, masked, F.lit(9)).alias("changed"))


@query("window_fields", """
    WITH p AS (SELECT p_partkey, p_partkey * 100 AS s, p_partkey * 100 + p_size * 50 AS e, p_size % 2 = 0 AS minus, CASE p_size % 4 WHEN 0 THEN 'CDS' WHEN 1 THEN 'exon_nonCDS' WHEN 2 THEN 'genic' ELSE 'intergenic' END AS context FROM part)
    SELECT p_partkey, context, CASE WHEN minus THEN e - 1199 ELSE s - 5000 END AS promoter_start, CASE WHEN minus THEN e + 5000 ELSE s + 1199 END AS promoter_end, CASE WHEN minus THEN s - 5000 ELSE e - 1199 END AS terminator_start, minus AS reversed FROM p""")
def window_fields(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    start, end = F.col("p_partkey") * 100, F.col("p_partkey") * 100 + size * 50
    w = C.regulatory_window(start, end, F.when(size % 2 == 0, "-").otherwise("+"))
    context = C.locus_context(size % 4 == 0, size % 4 <= 1, size % 4 <= 2)
    return table(spark, sf, "part").select("p_partkey", context.alias("context"), w["promoter"]["start"].alias("promoter_start"), w["promoter"]["end"].alias("promoter_end"), w["terminator"]["start"].alias("terminator_start"), w["reversed"].alias("reversed"))


# --- joins, summaries, rules ---------------------------------------------------------------------


@query("lookup_default", "SELECT c_custkey, coalesce(s_acctbal, -1.0::DOUBLE) AS s_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    return joins.lookup(table(spark, sf, "customer").select("c_custkey"), s, ["c_custkey"], "s_acctbal", F.lit(-1.0))


@query("flanked_overlap", """
    SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_suppkey * 37 + 5 BETWEEN p_partkey * 40 - 15 AND p_partkey * 40 + p_size * 2 + 15""")
def flanked_overlap(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "part").select(F.lit("1").alias("chrom"), "p_partkey", (F.col("p_partkey") * 40).alias("start"), (F.col("p_partkey") * 40 + F.col("p_size") * 2).alias("end"))
    p = table(spark, sf, "supplier").select(F.lit("1").alias("chrom"), "s_suppkey", (F.col("s_suppkey") * 37 + 5).alias("pos"))
    return joins.overlaps(p, f, flank=15).select("s_suppkey", "p_partkey")


@query("first_rows", "SELECT o_custkey, min_by(o_orderkey, ROW(o_orderdate, o_orderkey)) AS o_orderkey, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS day FROM orders GROUP BY 1")
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return reports.first_rows(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate"]).select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@query("category_order", """
    WITH c AS (SELECT * FROM (VALUES (0, 'rare'), (1, 'low'), (2, 'BUILDING'), (3, 'MACHINERY')) v(ordinal, c_mktsegment)), n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)
    SELECT CAST(ordinal AS INTEGER) AS ordinal, c.c_mktsegment, CAST(coalesce(n, 0) AS BIGINT) AS n FROM c LEFT JOIN n USING (c_mktsegment)""")
def category_order(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return reports.reindexed(n, "c_mktsegment", ["rare", "low", "BUILDING", "MACHINERY"], {"n": 0})


@query("ordered_join", "SELECT CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS BIGINT) AS ordinal, c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def ordered_join(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("n_nationkey"))
    return reports.ordered_join(c, table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], ["c_acctbal", "c_custkey"]).select("ordinal", "c_custkey", "n_name")


@query("canonical_columns", "SELECT s_name, s_suppkey, s_acctbal FROM supplier")
def canonical_columns(spark: SparkSession, sf: str) -> DataFrame:
    return reports.canonical(table(spark, sf, "supplier"), ["s_name", "s_suppkey", "s_acctbal"])


@query("describe_columns", """
    WITH x AS (SELECT l_returnflag, 'l_quantity' AS "column", l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END FROM lineitem)
    SELECT l_returnflag, "column", CAST(count(x) AS BIGINT) AS n, CAST(count(*) - count(x) AS BIGINT) AS missing, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, min(x) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max FROM x GROUP BY 1, 2""")
def describe_columns(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_tax")).alias("l_tax"))
    return rounded(reports.describe(li, ["l_quantity", "l_tax"], ["l_returnflag"]))


@query("failing_rows", f"WITH {COMPARED_SQL} SELECT k, \"column\", round(difference, 9) AS difference, why FROM judged WHERE why IS NOT NULL")
def failing_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(joins.failing_rows(*compared(spark, sf), ["k"], ["q", "t"], atol=0.2, rtol=1e-6), 9)


@query("score_summary", f"""
    WITH {V} SELECT chrom, CAST(count(score) AS BIGINT) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(avg(CASE WHEN score < 0 THEN 1.0 ELSE 0.0 END), 9) AS proportion_negative FROM variants GROUP BY 1""")
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.score_summary(variants(spark, sf), "score", ["chrom"])
    return out.select("chrom", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("proportion_negative", 9).alias("proportion_negative"))


@query("subset_medians", f"""
    WITH {V}, s AS (SELECT 'all' AS subset, quantity, price FROM variants UNION ALL SELECT 'early', quantity, price FROM variants WHERE line <= 2 UNION ALL SELECT 'dear', quantity, price FROM variants WHERE price > 50000)
    SELECT subset, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(quantity, 0.5), 6) AS median_x, round(quantile_cont(price, 0.5), 6) AS median_y FROM s GROUP BY 1""")
def subset_medians(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.subset_medians(variants(spark, sf), "quantity", "price", {"all": F.lit(True), "early": F.col("line") <= 2, "dear": F.col("price") > 50000}))


def _pct(x: str) -> str:
    return f"(rank() OVER (PARTITION BY gene ORDER BY {x}) + (count(*) OVER (PARTITION BY gene, {x}) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY gene)"


_BASE = f"0.8 * (0.9 * {_pct('discovery_neglogp')} + 0.1 * coalesce(ld_r2_lead, 0)) + 0.1 * exp(-abs(tss_distance) / 2000.0) + 0.05 * {_pct('coalesce(phylop, 0)')} + CASE WHEN context <> 'CDS' THEN 0.05 ELSE 0 END"
_FORMS = {"magnitude": "(abs(model_a) + abs(model_b)) / 2", "signed": "(model_a + model_b) / 2", "negative": "(-model_a + -model_b) / 2"}


@query("rule_family", f"WITH {K}, s AS (SELECT * FROM candidates WHERE model_a IS NOT NULL AND model_b IS NOT NULL), b AS (SELECT gene, variant_id, {_BASE} AS annotated, " + ", ".join(f"{_pct(x)} AS {form}" for form, x in _FORMS.items()) + " FROM s) " + " UNION ALL ".join(
    f"SELECT '{form}_{w:g}' AS rule, gene, variant_id, CAST(row_number() OVER (PARTITION BY gene ORDER BY round({1 - w} * annotated + {w} * {form}, 12) DESC, variant_id) AS INTEGER) AS rank FROM b" for form in _FORMS for w in prioritize.FAMILY_WEIGHTS))
def rule_family(spark: SparkSession, sf: str) -> DataFrame:
    """Every form at every weight, of the mean of two contexts."""
    k = candidates(spark, sf).where("model_a IS NOT NULL AND model_b IS NOT NULL")
    return prioritize.rank_family(k, ["model_a", "model_b"]).select("rule", "gene", "variant_id", "rank")


@query("strict_percentile", f"WITH {K} SELECT gene, variant_id, round({_pct('discovery_neglogp')}, 9) AS percentile FROM candidates")
def strict_percentile(spark: SparkSession, sf: str) -> DataFrame:
    k = candidates(spark, sf)
    return rounded(k.select("gene", "variant_id", ranks.percentile_rank(F.col("discovery_neglogp"), ["gene"], strict=True).alias("percentile")), 9)


@query("genome_order", """
    WITH v AS (SELECT c_custkey, CASE WHEN c_nationkey % 7 = 0 THEN 'Mt' ELSE CAST(c_nationkey % 12 AS VARCHAR) END AS chrom, c_custkey * 31 % 997 AS pos FROM customer)
    SELECT chrom, pos, c_custkey, CAST(row_number() OVER (ORDER BY TRY_CAST(chrom AS INTEGER) NULLS LAST, chrom, pos, c_custkey) - 1 AS BIGINT) AS ordinal FROM v""")
def genome_order(spark: SparkSession, sf: str) -> DataFrame:
    """Written in genome order and read again, with each row's place."""
    n = F.col("c_nationkey")
    v = table(spark, sf, "customer").select("c_custkey", F.when(n % 7 == 0, "Mt").otherwise((n % 12).cast("string")).alias("chrom"), (F.col("c_custkey") * 31 % 997).alias("pos"))
    keyed = ranks.genome_order(v.withColumns({"ref": F.lpad(F.col("c_custkey").cast("string"), 12, "0"), "alt": F.lit("C"), "number": F.coalesce(F.col("chrom").try_cast("int"), F.lit(1 << 30))}))
    return writers.write_checked(keyed, f"{folder(spark)}/t", ["number", "chrom", "pos", "ref"]).select("chrom", "pos", "c_custkey", "ordinal")


@query("thinning_profiles", """
    WITH RECURSIVE e AS (SELECT label, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
    pr AS (SELECT a.vec_id AS l, b.vec_id AS r, b.vec_id - a.vec_id AS d, unnest(a.v) AS x, unnest(b.v) AS y FROM e a JOIN e b ON a.label = b.label AND b.vec_id > a.vec_id AND b.vec_id - a.vec_id <= 60),
    r2 AS (SELECT l, r, d, corr(x, y) * corr(x, y) AS r2 FROM pr GROUP BY 1, 2, 3),
    f AS (SELECT * FROM (VALUES ('near', 20, 0.05), ('far', 60, 0.05), ('weak', 60, 0.02)) v(profile, w, t)),
    n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
    lo AS (SELECT profile, r AS vec_id, list(l ORDER BY l) AS ls FROM r2 JOIN f ON d <= w AND r2 >= t GROUP BY 1, 2),
    o AS (SELECT f.profile, n.i, n.vec_id, coalesce(ls, []) AS ls FROM f CROSS JOIN n LEFT JOIN lo ON lo.profile = f.profile AND lo.vec_id = n.vec_id),
    walk AS (SELECT profile, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept FROM f UNION ALL
        SELECT o.profile, o.i, CASE WHEN list_has_any(kept, o.ls) THEN kept ELSE list_append(kept, o.vec_id) END FROM walk JOIN o ON o.profile = walk.profile AND o.i = walk.i + 1),
    final AS (SELECT profile, max_by(kept, i) AS kept FROM walk GROUP BY 1)
    SELECT o.profile, o.vec_id, list_contains(kept, o.vec_id) AS retained FROM o JOIN final USING (profile)""")
def thinning_profiles(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    pairs = joins.band_pairs(e.select("label", "vec_id", F.col("vec_id").alias("pos")), group="label", pos="pos", key="vec_id", reach=60)
    links = ld.pairwise_r2(pairs, e, key="vec_id", vector="embedding", least=3).where("r2 IS NOT NULL")
    return ld.thinning_profiles(e, links, {"near": (20, 0.05), "far": (60, 0.05), "weak": (60, 0.02)}, key="vec_id").select("profile", "vec_id", "retained")


# --- sources and sinks ---------------------------------------------------------------------------


@query("tsv_round_trip", "SELECT s_suppkey, s_name, s_acctbal, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS note FROM supplier")
def tsv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{folder(spark)}/t"
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("note"))
    writers.write_table(s, out)
    return readers.tsv(spark, out, "s_suppkey long, s_name string, s_acctbal double, note string", required=["s_suppkey"], header=s.columns)


@query("text_table_scan", "SELECT 's' || s_suppkey AS s_suppkey, CAST(s_nationkey AS VARCHAR) AS s_nationkey, round(s_acctbal, 3) AS s_acctbal FROM supplier")
def text_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers written with few digits, read as text."""
    out = f"{folder(spark)}/t"
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("s_suppkey"), F.col("s_nationkey").cast("string").alias("s_nationkey"), "s_acctbal")
    writers.write_table(s, out, digits=12)
    return readers.tsv(spark, out, header=s.columns).withColumn("s_acctbal", F.round(F.col("s_acctbal").cast("double"), 3))


@query("track_scan", """
    SELECT p_brand AS chrom, CAST(count(*) AS BIGINT) AS intervals, CAST(sum(p_size) AS BIGINT) AS covered, round(sum(p_retailprice), 2) AS total FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1""")
def track_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{folder(spark)}/t"
    part = table(spark, sf, "part").select(F.col("p_brand").alias("c"), (F.col("p_partkey") * 100).alias("s"), F.col("p_size"), "p_retailprice")
    lines = part.select(F.concat_ws("\t", "c", "s", F.col("s") + F.col("p_size"), "p_retailprice").alias("value"))
    spark.createDataFrame([("track type=bedGraph",), ("",), ("# a remark",)], "value string").unionByName(lines).write.option("compression", "gzip").text(out)
    track = readers.bedgraph(spark, out, excluded=["Brand#11"])
    sums = track.groupBy("chrom").agg(F.round(F.sum("score"), 2).alias("total"))
    return readers.track_counts(track).join(sums, "chrom")


@query("annotation_scan", """
    SELECT 'AT1G' || lpad(CAST(p_partkey % 90000 AS VARCHAR), 5, '0') AS gene, p_partkey * 10 AS "start", CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_name AS note, 't' || p_partkey AS transcript, 'g' || p_partkey % 97 AS parent FROM part""")
def annotation_scan(spark: SparkSession, sf: str) -> DataFrame:
    out, k = f"{folder(spark)}/t", F.col("p_partkey")
    name = F.concat(F.lit("AT1G"), F.lpad((k % 90_000).cast("string"), 5, "0"))
    told = F.concat(F.lit("ID=t"), k, F.lit(";Parent=g"), k % 97, F.lit(";Name="), name, F.lit(";note="), F.replace("p_name", F.lit(" "), F.lit("%20")))
    lines = table(spark, sf, "part").select(F.concat_ws("\t", F.lit("c1"), F.lit("src"), F.lit("mRNA"), k * 10, k * 10 + 9, F.lit("."), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-"), F.lit("."), told).alias("value"))
    spark.createDataFrame([("##gff-version 3",), ("#!genome-build b1",)], "value string").unionByName(lines).write.option("compression", "gzip").text(out)
    g = readers.gff3(spark, out)
    raw = spark.read.text(out).where("NOT startswith(value, '#')").select(C.transcript_fields(F.get(F.split("value", "\t"), F.lit(8))).alias("t"))
    both = g.withColumn("id", F.element_at("attributes", "ID")).join(raw.select("t.id", "t.parent"), "id")
    return both.select("gene", "start", "strand", F.element_at("attributes", "note").alias("note"), F.col("id").alias("transcript"), "parent")


@query("sequence_scan", f"WITH s AS (SELECT 'item' || item_id AS contig, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark) SELECT contig, CAST(length(seq) AS BIGINT) AS length, md5(seq) AS digest FROM s WHERE seq <> ''")
def sequence_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{folder(spark)}/t"
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    records = table(spark, sf, "benchmark").select(F.concat(F.lit(">item"), F.col("item_id"), F.lit(" from the table\n"), F.regexp_replace(letters, "(.{60})", "$1\n")).alias("value"))
    records.where(F.length(F.element_at(F.split("value", "\n", 2), 2)) > 0).write.text(out)
    chunks = readers.fasta(spark, out, chunk=50)
    whole = chunks.groupBy("contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return readers.contig_lengths(chunks).join(whole, "contig").select("contig", "length", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query("variant_file", """
    WITH v AS (SELECT s_suppkey, CASE WHEN s_nationkey % 6 = 0 THEN 'Pt' ELSE CAST(s_nationkey % 12 AS VARCHAR) END AS chrom, s_suppkey * 7 % 501 + 1 AS pos, substr('ACGT', CAST(s_suppkey % 4 + 1 AS INTEGER), 1) AS ref, substr('ACGT', CAST((s_suppkey + 1) % 4 + 1 AS INTEGER), 1) AS alt FROM supplier WHERE s_suppkey % 8 <> 0),
    d AS (SELECT DISTINCT chrom, pos, ref, alt FROM v)
    SELECT chrom, pos, ref, alt, CAST(row_number() OVER (ORDER BY TRY_CAST(chrom AS INTEGER) NULLS LAST, chrom, pos, ref, alt) - 1 AS BIGINT) AS place FROM d""")
def variant_file(spark: SparkSession, sf: str) -> DataFrame:
    """A VCF written in genome order; sites that don't pass are not read. The place is that in the file."""
    out, k = f"{folder(spark)}/t", F.col("s_suppkey")
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    v = table(spark, sf, "supplier").select(F.when(F.col("s_nationkey") % 6 == 0, "Pt").otherwise((F.col("s_nationkey") % 12).cast("string")).alias("chrom"), (k * 7 % 501 + 1).alias("pos"), F.get(bases, (k % 4).cast("int")).alias("ref"), F.get(bases, ((k + 1) % 4).cast("int")).alias("alt"), F.when(k % 8 != 0, "PASS").otherwise("low").alias("filter")).distinct()
    writers.write_vcf(v, out, ["##fileformat=VCFv4.2"])
    files = spark.read.text(out).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).where("NOT startswith(value, '#')")
    f = F.split("value", "\t")
    passing = files.where(F.get(f, F.lit(6)) == "PASS")  # a site may stand there twice, as passing and as not
    placed = passing.select("file", "at", F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("pos"), F.get(f, F.lit(3)).alias("ref"), F.get(f, F.lit(4)).alias("alt"))
    sites = readers.vcf_sites(spark, out).select("chrom", "pos", "ref", "alt")
    from lociscale.plans.lineage import numbered

    return numbered(placed.join(sites, ["chrom", "pos", "ref", "alt"], "left_semi"), "place", "file", "at").select("chrom", "pos", "ref", "alt", "place")


@query("genotype_file", """
    WITH g AS (SELECT DISTINCT s_suppkey AS pos FROM supplier WHERE s_suppkey % 5 = 0), t AS (SELECT * FROM (VALUES ('s1', '0|0'), ('s2', '0|1'), ('s3', '1|1')) v(sample, gt)) SELECT '1' AS chrom, pos, 'A' AS ref, 'C' AS alt, sample, gt FROM g CROSS JOIN t""")
def genotype_file(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of the variants in a list of keys, semi-joined before they are exploded."""
    out, k = f"{folder(spark)}/t", F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "s1", "s2", "s3"])
    lines = s.select(F.concat_ws("\t", F.lit("1"), k, F.lit("."), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.lit("0|0"), F.lit("0|1"), F.lit("1|1")).alias("value"))
    spark.createDataFrame([("##fileformat=VCFv4.2",), (head,)], "value string").unionByName(lines).write.text(out)
    keys = s.where(k % 5 == 0).select(F.lit("1").alias("chrom"), k.alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    return readers.vcf_genotypes(spark, out, keys)


@query("indexed_genotype_fetch", """
    WITH v AS (SELECT DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN '01' ELSE CAST(l_suppkey % 3 AS VARCHAR) END AS chrom, l_partkey * 100 + l_linenumber AS pos FROM lineitem),
    k AS (SELECT chrom, pos FROM v WHERE pos % 7 = 0 AND chrom <> '2'), t AS (SELECT * FROM (VALUES ('s1', '0|0'), ('s2', '0|1')) v(sample, gt))
    SELECT chrom, CAST(pos AS BIGINT) AS pos, 'A' AS ref, 'C' AS alt, sample, gt FROM k CROSS JOIN t""")
def indexed_genotype_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of a list of keys from the table of a VCF's sites; keys of another allele find nothing."""
    out = folder(spark)
    chrom = F.when(F.col("l_suppkey") % 3 == 0, "01").otherwise((F.col("l_suppkey") % 3).cast("string"))
    v = table(spark, sf, "lineitem").select(chrom.alias("chrom"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("pos")).distinct()
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "s1", "s2"])
    lines = v.select(F.concat_ws("\t", "chrom", "pos", F.lit("."), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.lit("0|0"), F.lit("0|1")).alias("value"))
    spark.createDataFrame([("##fileformat=VCFv4.2",), (head,)], "value string").unionByName(lines).write.text(f"{out}/vcf")
    writers.index_vcf(spark, f"{out}/vcf", f"{out}/index", width=1 << 14)
    keys = v.where("pos % 7 = 0 AND chrom <> '2'").select("chrom", "pos", F.lit("A").alias("ref"), F.explode(F.array(F.lit("C"), F.lit("G"))).alias("alt"))
    return readers.indexed_genotypes(spark, f"{out}/index", keys)


@query("dosage_file", "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN x < -1 THEN -1 WHEN x < 0 THEN 0 WHEN x < 1 THEN 1 ELSE 2 END)) AS BIGINT) AS total FROM embeddings")
def dosage_file(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{folder(spark)}/t"
    coded = F.transform("embedding", lambda x: F.when(x < -1, -1).when(x < 0, 0).when(x < 1, 1).otherwise(2))
    writers.write_checked(table(spark, sf, "embeddings").select("vec_id", coded.alias("dosages")), out)
    return readers.dosage_matrix(spark, out, 64).select("vec_id", F.aggregate("dosages", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("shard_scan", "SELECT o_orderstatus AS shard, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def shard_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with markers, written twice (the second time nothing is done) and read whole once all markers hold."""
    o = table(spark, sf, "orders")
    parts = writers.ResumableTable(spark, f"{folder(spark)}/t", {"table": "orders"})
    names = sorted(r[0] for r in o.select("o_orderstatus").distinct().collect())
    for name in [*names, *names]:
        parts.write(name, o.where(F.col("o_orderstatus") == name).select("o_orderkey", "o_totalprice"))
    return parts.whole(names).groupBy("shard").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("manifest_check", """
    SELECT CAST(r_regionkey AS BIGINT) AS region, CASE WHEN r_regionkey = (SELECT max(r_regionkey) FROM region) THEN 'missing file' ELSE 'checksum' END AS problem FROM region WHERE r_regionkey % 2 = 1 OR r_regionkey = (SELECT max(r_regionkey) FROM region)
    UNION ALL SELECT NULL, 'unsafe path'""")
def manifest_check(spark: SparkSession, sf: str) -> DataFrame:
    """Nations in a file a region, against the folder's manifest: the files of some regions were written again with
    other rows since, the last one's went, and an entry names a file outside."""
    out, n = folder(spark), table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    last = n.agg(F.max("n_regionkey")).first()[0]
    for key in range(last + 1):
        single_file(n.where(F.col("n_regionkey") == key).orderBy("n_nationkey"), f"{out}/data/region{key}.tsv")
    writers.write_manifest(spark, out)
    for key in range(1, last + 1, 2):
        single_file(n.where(F.col("n_regionkey") == key).orderBy(F.desc("n_nationkey")), f"{out}/data/region{key}.tsv")
    fs, p = writers._file_system(spark, f"{out}/data/region{last}.tsv")
    fs.delete(p, False)
    expected = readers.json_document(spark, f"{out}/{writers.MANIFEST}")
    expected["files"] |= {"../outside": {"sha256": "0"}}
    found = writers.manifest_differences(spark, out, expected)
    return found.select(F.regexp_extract("name", "region([0-9]+)", 1).try_cast("bigint").alias("region"), "problem")


def single_file(df: DataFrame, path: str, form: str = "csv") -> None:
    """A small table as one tab-separated file, or its lines as one text, in place of any that is there."""
    spark, part = df.sparkSession, f"{path}.part"
    df.coalesce(1).write.mode("overwrite").format(form).options(**({"sep": "\t", "header": True} if form == "csv" else {})).save(part)
    fs, target = writers._file_system(spark, path)
    (own,) = [f.getPath() for f in fs.globStatus(writers._file_system(spark, f"{part}/part-*")[1])]
    fs.delete(target, False)
    fs.rename(own, target)
    fs.delete(writers._file_system(spark, part)[1], True)


@query("sheet_scan", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS row_number, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS balance, CAST(s_suppkey AS VARCHAR) AS key FROM supplier")
def sheet_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A workbook of all suppliers: shared and inline strings, numbers, cells without a reference and missing ones."""
    out, ns = folder(spark), readers.SHEET_NS.strip("{}")
    s = ranks_of(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"))
    tag = lambda text, *x: F.format_string(text, *x)
    strings = s.select("n", tag("<si><r><t>%s</t></r><r><t>%s</t></r></si>", F.substring("s_name", 1, 4), F.expr("substring(s_name, 5)")).alias("value"))
    name = tag('<c r="A%d" t="s"><v>%d</v></c>', "n", F.col("n") - 1)
    balance = F.when(F.col("s_suppkey") % 4 != 0, tag("<c><v>%s</v></c>", F.col("s_acctbal").cast("string"))).otherwise("")
    key = tag('<c r="AB%d" t="inlineStr"><is><t>%d</t></is></c>', "n", "s_suppkey")
    rows = s.select("n", F.concat(tag('<row r="%d">', "n"), name, balance, key, F.lit("</row>")).alias("value"))
    for lines, part, outer in ((strings, "sharedStrings.xml", "<sst xmlns='{}'>|</sst>"), (rows, "worksheets/sheet1.xml", "<worksheet xmlns='{}'><sheetData>|</sheetData></worksheet>")):
        before, after = outer.format(ns).split("|")
        ends = spark.createDataFrame([(0, before), (1 << 40, after)], "n long, value string")
        single_file(ends.unionByName(lines).orderBy("n").select("value"), f"{out}/book/xl/{part}", "text")
    writers.write_zip(spark, f"{out}/book", f"{out}/book.xlsx")
    cell = lambda c: F.col("cells").getItem(c)
    return readers.xlsx(spark, f"{out}/book.xlsx", 1).select("row_number", cell("A").alias("name"), cell("B").cast("double").alias("balance"), cell("AB").alias("key"))


def ranks_of(s: DataFrame) -> DataFrame:
    """Suppliers with their place, from 1."""
    return numbered(s, "n", "s_suppkey").withColumn("n", F.col("n") + 1)


@query("verified_folder", "SELECT CAST(n_nationkey AS VARCHAR) AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def verified_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables of a folder whose manifest holds, by name."""
    out = folder(spark)
    for name in ("nation", "region"):
        single_file(table(spark, sf, name), f"{out}/data/{name}.tsv")
    writers.write_manifest(spark, out)
    tables = writers.load_verified(spark, out)
    return tables["nation"].join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("region"))


@query("pinned_inputs", """
    SELECT o_orderpriority || CASE WHEN o_orderpriority = (SELECT min(o_orderpriority) FROM orders) THEN ' is pinned and missing' ELSE ' is not what was pinned' END AS problem FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = (SELECT min(o_orderpriority) FROM orders) GROUP BY o_orderpriority
    UNION ALL SELECT 'late is not pinned'""")
def pinned_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by priority as inputs, pinned with all of their rows, then offered without those of one status, without
    one priority, and with an input more."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct("o_orderkey", "o_orderstatus")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    digests = lambda df: {r[0]: str(r[1]) for r in df.groupBy("o_orderpriority").agg(F.sum(h)).collect()}  # noqa: E731  one row a priority
    pins, found = digests(o), digests(o.where("o_orderstatus <> 'P'"))
    found.pop(min(pins))
    try:
        contracts.pinned(found | {"late": "0"}, pins)
        faults = []
    except contracts.ContractError as e:
        faults = sorted(e.violations)
    return spark.createDataFrame([(f,) for f in faults], "problem string")


@query("score_contract", """
    WITH s AS (
        SELECT CASE WHEN l_linenumber = 7 THEN ' ' WHEN l_orderkey % 11 <> 0 THEN l_returnflag END AS chrom, CASE l_linenumber WHEN 1 THEN '0' WHEN 2 THEN '2.5' WHEN 3 THEN 'x' ELSE CAST(l_orderkey AS VARCHAR) END AS pos,
            CASE WHEN l_partkey % 9 <> 0 THEN substr('ACGTNa', CAST(l_partkey % 6 + 1 AS INTEGER), 1) END AS ref, substr('ACGT', CAST(l_suppkey % 4 + 1 AS INTEGER), 1) AS alt, CASE WHEN l_quantity < 10 THEN 'NaN' WHEN l_quantity < 20 THEN NULL ELSE CAST(l_quantity AS VARCHAR) END AS score FROM lineitem
    ), broken AS (
        SELECT chrom IS NULL OR trim(chrom) = '' AS a, coalesce(try_cast(pos AS BIGINT), 0) <= 0 OR pos = '2.5' AS b, ref IS NULL OR ref NOT IN ('A', 'C', 'G', 'T') AS c, false AS d, ref IS NULL OR ref = alt AS e, score IS NULL OR score = 'NaN' AS f FROM s
    ), counts AS (SELECT unnest(['chrom is missing', 'pos is not a positive integer', 'ref is not one canonical base', 'alt is not one canonical base', 'ref equals alt', 'score is not finite', 'typed rows']) AS rule,
        unnest([count(*) FILTER (WHERE a), count(*) FILTER (WHERE b), count(*) FILTER (WHERE c), count(*) FILTER (WHERE d), count(*) FILTER (WHERE e), count(*) FILTER (WHERE f), (SELECT count(*) FROM (SELECT DISTINCT l_linenumber, l_orderkey FROM lineitem))]) AS rows FROM broken)
    SELECT rule, CAST(rows AS BIGINT) AS rows FROM counts""")
def score_contract(spark: SparkSession, sf: str) -> DataFrame:
    """The contract of score tables: its rules over a table with faults of every kind, and over one without any, as
    which the same rows come out typed."""
    k, q = F.col("l_orderkey"), F.col("l_quantity")
    li, pick = table(spark, sf, "lineitem"), lambda text, n: F.get(F.array(*map(F.lit, text)), n.cast("int"))
    faulty = li.select(
        F.when(F.col("l_linenumber") == 7, " ").when(k % 11 != 0, F.col("l_returnflag")).alias("chrom"), F.when(F.col("l_linenumber") == 1, "0").when(F.col("l_linenumber") == 2, "2.5").when(F.col("l_linenumber") == 3, "x").otherwise(k.cast("string")).alias("pos"),
        F.when(F.col("l_partkey") % 9 != 0, pick("ACGTNa", F.col("l_partkey") % 6)).alias("ref"), pick("ACGT", F.col("l_suppkey") % 4).alias("alt"), F.when(q < 10, "NaN").when(q >= 20, q.cast("string")).alias("score"),
    )
    parts = max(spark.sparkContext.defaultParallelism, -(-li.count() // TASK_ROWS))
    lines = li.select("l_linenumber", "l_orderkey").repartition(parts, "l_linenumber", "l_orderkey").distinct()
    sound = lines.select(F.col("l_linenumber").cast("string").alias("chrom"), (k + 1).cast("string").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), (k % 7 / 10).cast("string").alias("score"))
    typed = contracts.score_table(sound, parts=parts).agg(F.count(F.col("pos") + F.col("score")).alias("rows")).select(F.lit("typed rows").alias("rule"), "rows")
    return contracts.violations(faulty, contracts.variant_rules()).unionByName(typed)


@query("population_integration", """
    WITH p AS (
        SELECT CAST(p_partkey % 5 + 1 AS VARCHAR) AS chrom, p_partkey + 1 AS pos, substr('ACGT', CAST(p_size % 4 + 1 AS INTEGER), 1) AS ref, substr('ACGT', CAST((p_size + 1) % 4 + 1 AS INTEGER), 1) AS alt, (p_size % 11) / 10.0::DOUBLE AS af_alt, round(p_retailprice - 1400, 6) AS score_ref_alt FROM part
    )
    SELECT chrom, pos, ref, alt, af_alt, 'contig_' || chrom AS fasta_chrom, score_ref_alt, least(af_alt, 1 - af_alt) AS maf,
        CASE WHEN af_alt < 0.5 THEN alt WHEN af_alt > 0.5 THEN ref END AS minor_allele, CASE WHEN af_alt < 0.5 THEN ref WHEN af_alt > 0.5 THEN alt END AS major_allele,
        CASE WHEN af_alt < 0.5 THEN 'alt_minor' WHEN af_alt > 0.5 THEN 'ref_minor' ELSE 'frequency_tie' END AS orientation, af_alt > 0.5 AS flipped, CASE WHEN af_alt > 0.5 THEN -score_ref_alt ELSE score_ref_alt END AS score_paper_oriented,
        CASE WHEN af_alt < 0.5 THEN score_ref_alt WHEN af_alt > 0.5 THEN -score_ref_alt END AS score_minor_vs_major, pos <= 256 AS edge_padded FROM p""")
def population_integration(spark: SparkSession, sf: str) -> DataFrame:
    """A population table and a model's scores, whose contigs have names of their own."""
    from lociscale.operators.integrate import integrate_population_scores

    p, pick = table(spark, sf, "part"), lambda n: F.get(F.array(*map(F.lit, "ACGT")), (n % 4).cast("int"))
    key = [(F.col("p_partkey") + 1).alias("pos"), pick(F.col("p_size")).alias("ref"), pick(F.col("p_size") + 1).alias("alt")]
    chrom = (F.col("p_partkey") % 5 + 1).cast("string")
    population = p.select(chrom.alias("chrom"), *key, (F.col("p_size") % 11 / 10).alias("af_alt"))
    scores = p.select(F.concat(F.lit("contig_"), chrom).alias("chrom"), *key, F.round(F.col("p_retailprice") - 1400, 6).alias("score"))
    return integrate_population_scores(population, scores, {f"contig_{i}": str(i) for i in range(1, 6)})


@query("fallback_scan", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def fallback_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A store that can't be read, one that holds another table, then the one that can."""
    out = f"{folder(spark)}/t"
    writers.write_table(table(spark, sf, "supplier").select("s_suppkey", "s_name"), out)
    return readers.first_readable(lambda: readers.tsv(spark, f"{folder(spark)}/nowhere.tsv"), lambda: readers.tsv(spark, out, required=["s_phone_of_another_table"]), lambda: readers.tsv(spark, out, required=["s_name"]))


@query("stream_reason_totals", """
    SELECT CASE WHEN l_discount < 0.02 THEN 'no_frequency' WHEN l_quantity < 5 THEN 'few' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'open' ELSE 'eligible' END AS reason, CAST(count(*) AS BIGINT) AS rows FROM lineitem GROUP BY 1""")
def stream_reason_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons of every line as a stream has counted them, run twice over the same files (the second takes none)."""
    out, ladder = folder(spark), [(F.col("l_discount") < 0.02, "no_frequency"), (F.col("l_quantity") < 5, "few"), ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "open")]
    for _ in range(2):
        totals = scores.reason_totals(scores.table_files(spark, f"{sf}/lineitem.parquet"), ladder)
        scores.keep_totals(totals, f"{out}/totals", f"{out}/mark").awaitTermination()
    return spark.read.parquet(f"{out}/totals")


@query("withheld_columns", "SELECT n_nationkey, n_name, (SELECT CAST(count(*) AS BIGINT) FROM nation) AS held FROM nation")
def withheld_columns(spark: SparkSession, sf: str) -> DataFrame:
    kept, told = writers.withheld(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_regionkey"])
    return kept.withColumn("held", F.lit(told["rows"]).cast("long"))


@query("vcf_quota_scan", """
    WITH v AS (SELECT s_suppkey AS pos, row_number() OVER (ORDER BY s_suppkey) - 1 AS o, s_acctbal FROM supplier WHERE s_suppkey % 6 <> 0),
    a AS (SELECT pos, o FROM v WHERE s_acctbal < 1000 ORDER BY o LIMIT 7), b AS (SELECT pos, o FROM v WHERE pos NOT IN (SELECT pos FROM a) ORDER BY o LIMIT 9)
    SELECT pos, CAST(o AS BIGINT) AS ordinal, 'poor' AS selection_class FROM a UNION ALL SELECT pos, CAST(o AS BIGINT), 'any' FROM b""")
def vcf_quota_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Sites of two classes in the order of a sorted file, some of which don't pass."""
    out, k = f"{folder(spark)}/t", F.col("s_suppkey")
    v = table(spark, sf, "supplier").select(F.lit("1").alias("chrom"), k.alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.when(k % 6 == 0, "low").otherwise("PASS").alias("filter"), F.concat(F.lit("B="), F.col("s_acctbal")).alias("info"))
    writers.write_vcf(v, out, ["##fileformat=VCFv4.2"])
    balance = F.regexp_extract("info", "B=(.*)", 1).cast("double")
    return readers.vcf_quota(spark, out, [("poor", balance < 1000, 7), ("any", F.lit(True), 9)]).select("pos", "ordinal", "selection_class")


@query("indexed_fetch", """
    WITH s AS (SELECT 'c' || l_suppkey % 3 AS chrom, l_partkey * 500 + l_linenumber AS pos, l_orderkey FROM lineitem)
    SELECT chrom, pos, CAST(count(*) AS BIGINT) AS n FROM s WHERE (chrom = 'c1' AND (pos BETWEEN 1000 AND 40000 OR pos BETWEEN 30000 AND 70000)) OR (chrom = 'c2' AND pos BETWEEN 60000 AND 60600) GROUP BY 1, 2""")
def indexed_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, two of which overlap, from a table in folders by contig and bin."""
    out = f"{folder(spark)}/t"
    s = table(spark, sf, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey") % 3).alias("chrom"), (F.col("l_partkey") * 500 + F.col("l_linenumber")).alias("pos"), "l_orderkey")
    writers.write_indexed_sites(s, out, width=1 << 15)
    regions = spark.createDataFrame([("c1", 1000, 40_000), ("c1", 30_000, 70_000), ("c2", 60_000, 60_600)], "chrom string, start long, end long")
    return readers.indexed_sites(spark, out, regions, width=1 << 15).groupBy("chrom", "pos").agg(F.count("*").alias("n"))


@query("batch_scorer", "WITH s AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark) SELECT item_id, round(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq)::DOUBLE, 9) AS score FROM s WHERE seq <> ''")
def batch_scorer(spark: SparkSession, sf: str) -> DataFrame:
    """The protocol of a model that scores batches, with one that SQL knows too."""
    from lociscale.operators.assoc import score_sequences

    s = table(spark, sf, "benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence")).where("sequence <> ''")
    out = score_sequences(s, lambda batch: [(x.count("G") + x.count("C")) / len(x) for x in batch])
    return rounded(out.select("item_id", "score"), 9)


@query("procrustes", """
    WITH e AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings),
    m AS (SELECT covar_pop(a, c) AS ac, covar_pop(a, d) AS ad, covar_pop(b, c) AS bc, covar_pop(b, d) AS bd, (var_pop(a) + var_pop(b)) * (var_pop(c) + var_pop(d)) AS s FROM e)
    SELECT round(1 - (ac * ac + ad * ad + bc * bc + bd * bd + 2 * abs(ac * bd - ad * bc)) / s, 9) AS disparity FROM m""")
def procrustes(spark: SparkSession, sf: str) -> DataFrame:
    from lociscale.operators.assoc import procrustes_table

    e = table(spark, sf, "embeddings").select(F.slice("embedding", 1, 2).alias("a"), F.slice("embedding", 3, 2).alias("b"))
    return rounded(spark.createDataFrame([(procrustes_table(e, "a", "b", 2),)], "disparity double"), 9)


@query("metadata_scan", "SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS latitude FROM supplier")
def metadata_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Dashes and NA for what is missing."""
    out, k = f"{folder(spark)}/t", F.col("s_suppkey")
    text = table(spark, sf, "supplier").select(k.alias("id"), F.when(k % 4 == 0, "—").otherwise(F.col("s_name")).alias("name"), F.when(k % 5 == 0, "NA").otherwise(F.col("s_acctbal").cast("string")).alias("latitude"))
    text.write.options(header=True, encoding="UTF-8").csv(out)
    return readers.metadata_csv(spark, out, ["latitude"])


@query("archive_scan", """
    SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'even_nations' ELSE 'odd_nations' END AS member, n_nationkey || ' ' || n_name AS line FROM nation""")
def archive_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Two folders of text in one archive, read by the line."""
    out = folder(spark)
    n = table(spark, sf, "nation").select((F.col("n_nationkey") % 2).alias("odd"), F.concat_ws(" ", "n_nationkey", "n_name").alias("value"))
    for odd, name in enumerate(("even_nations", "odd_nations")):
        n.where(F.col("odd") == odd).select("value").write.text(f"{out}/files/{name}")
    writers.write_zip(spark, f"{out}/files", f"{out}/all.zip")
    lines = readers.zip_members(spark, f"{out}/all.zip", r"(even|odd)_nations/.*\.txt")
    return lines.select(F.substring_index("member", "/", 1).alias("member"), "line")


@query("report_table", """
    SELECT CAST(0 AS INTEGER) AS place, '| r_regionkey | r_name |' AS line UNION ALL SELECT 1, '| --- | --- |'
    UNION ALL SELECT CAST(1 + row_number() OVER (ORDER BY r_regionkey) AS INTEGER), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region""")
def report_table(spark: SparkSession, sf: str) -> DataFrame:
    text = writers.markdown(table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "place int, line string")
