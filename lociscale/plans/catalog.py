"""The query catalogue: each operator on the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociscale.functions import columns as C
from lociscale.operators import assoc, contracts, joins, ld, prioritize, ranks, reports, resample, stats
from lociscale.plans import integrity
from lociscale.plans.registry import QUERIES, SQL, query, rounded
from lociscale.plans.standins import CANDIDATES_SQL, COMPARED_SQL, VARIANTS_SQL, candidates, compared, table, variants
from lociscale.sources.sequences import beside, sequence_store

__all__ = ["QUERIES", "SQL", "integrity"]

V = f"variants AS ({VARIANTS_SQL})"
K = f"candidates AS ({CANDIDATES_SQL})"


# --- contracts -----------------------------------------------------------------------------------


@query("contract_report", f"""
    WITH {V}, rules AS (
        SELECT 'ref equals alt' AS rule, count(*) FILTER (WHERE ref = alt) AS rows FROM variants
        UNION ALL SELECT 'ref is not canonical', count(*) FILTER (WHERE NOT regexp_matches(ref, '^[ACGT]$')) FROM variants
        UNION ALL SELECT 'score is negative', count(*) FILTER (WHERE score < 0) FROM variants
        UNION ALL SELECT 'site is not positive', count(*) FILTER (WHERE site <= 0) FROM variants
        UNION ALL SELECT 'duplicate site,line', (SELECT count(*) FROM (SELECT 1 FROM variants GROUP BY site, line HAVING count(*) > 1))
    ) SELECT rule, CAST(rows AS BIGINT) AS rows FROM rules""")
def contract_report(spark: SparkSession, sf: str) -> DataFrame:
    v = variants(spark, sf)
    rules = {"ref equals alt": F.col("ref") != F.col("alt"), "ref is not canonical": F.col("ref").rlike(contracts.BASE), "score is negative": F.col("score") >= 0, "site is not positive": F.col("site") > 0}
    dup = contracts.duplicate_keys(v, ["site", "line"]).agg(F.count("*").alias("rows")).select(F.lit("duplicate site,line").alias("rule"), "rows")
    return contracts.violations(v, rules).unionByName(dup)


@query("eligibility_reasons", f"""
    WITH {V}, r AS (SELECT CASE WHEN ref = 'N' THEN 'noncanonical' WHEN line > 6 THEN 'non_nuclear' WHEN site < 1 OR site > 40000 THEN 'invalid_position'
        WHEN site <= 256 OR site > 40000 - 255 THEN 'edge' ELSE 'eligible' END AS reason FROM variants)
    SELECT reason, CAST(count(*) AS BIGINT) AS rows FROM r GROUP BY reason""")
def eligibility_reasons(spark: SparkSession, sf: str) -> DataFrame:
    v = variants(spark, sf).withColumn("pos", F.col("site"))
    length = F.when(F.col("line") <= 6, F.lit(40000))
    return v.select(contracts.eligibility(contracts.site_ladder(length)).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


@query("track_contract", """
    WITH i AS (SELECT p_brand AS chrom, p_partkey * 7 AS s, p_partkey * 7 + p_size * 40 AS e, p_retailprice AS score FROM part),
    w AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)
    SELECT 'unknown contig' AS rule, CAST(count(*) FILTER (WHERE chrom NOT LIKE 'Brand#1%') AS BIGINT) AS rows FROM w
    UNION ALL SELECT 'bad bounds', CAST(count(*) FILTER (WHERE NOT (s >= 0 AND s < e AND (chrom NOT LIKE 'Brand#1%' OR e <= 12000))) AS BIGINT) FROM w
    UNION ALL SELECT 'score is not finite', CAST(count(*) FILTER (WHERE score IS NULL) AS BIGINT) FROM w
    UNION ALL SELECT 'overlap', CAST(count(*) FILTER (WHERE before > s) AS BIGINT) FROM w""")
def track_contract(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    i = p.select(F.col("p_brand").alias("chrom"), (F.col("p_partkey") * 7).alias("start"), (F.col("p_partkey") * 7 + F.col("p_size") * 40).alias("end"), F.col("p_retailprice").alias("score"))
    lengths = p.where(F.col("p_brand").startswith("Brand#1")).select(F.col("p_brand").alias("chrom"), F.lit(12000).alias("length")).distinct()
    return contracts.track_violations(i, lengths)


@query("arithmetic_invariants", """
    WITH g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS missing FROM lineitem GROUP BY 1),
    t AS (SELECT n AS n_genotypes, missing AS n_missing, n - missing AS ac_ref, n - missing - l_suppkey % 2 AS ac_alt FROM g)
    SELECT 'an = 2 (n - missing)' AS rule, CAST(count(*) FILTER (WHERE ac_ref + ac_alt <> 2 * (n_genotypes - n_missing)) AS BIGINT) AS rows FROM t
    UNION ALL SELECT 'mac = least count', 0 UNION ALL SELECT 'an = ac_ref + ac_alt', 0 UNION ALL SELECT 'af = ac_alt / an', 0 UNION ALL SELECT 'maf = mac / an', 0
    UNION ALL SELECT 'call rate', CAST(count(*) FILTER (WHERE abs((n_genotypes - n_missing) / n_genotypes::DOUBLE - (ac_ref + ac_alt) / (2.0 * n_genotypes)) > 1e-9) AS BIGINT) FROM t""")
def arithmetic_invariants(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_genotypes"), F.count_if(F.col("l_returnflag") == "N").alias("n_missing"))
    t = g.withColumn("ac_ref", F.col("n_genotypes") - F.col("n_missing")).withColumn("ac_alt", F.col("ac_ref") - F.col("l_suppkey") % 2).withColumn("an", F.col("ac_ref") + F.col("ac_alt")).withColumn("mac", F.least("ac_ref", "ac_alt"))
    t = t.withColumns({"af_alt": F.try_divide("ac_alt", "an"), "maf": F.try_divide("mac", "an"), "allele_call_rate": F.try_divide(F.col("n_genotypes") - F.col("n_missing"), F.col("n_genotypes"))})
    return contracts.violations(t, contracts.arithmetic_rules())


# --- projections ---------------------------------------------------------------------------------


@query("orient_minor_major", f"""
    WITH {V} SELECT CASE WHEN af_alt < 0.5 THEN 'alt_minor' WHEN af_alt > 0.5 THEN 'ref_minor' ELSE 'frequency_tie' END AS orientation, chrom,
        CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN af_alt <> 0.5 THEN 1 END) AS BIGINT) AS oriented,
        round(sum(CASE WHEN af_alt < 0.5 THEN score WHEN af_alt > 0.5 THEN -score END), 2) AS minor_vs_major, round(sum(CASE WHEN af_alt > 0.5 THEN -score ELSE score END), 2) AS paper,
        round(avg(least(af_alt, 1 - af_alt)), 6) AS maf, CAST(count(CASE WHEN CASE WHEN af_alt < 0.5 THEN alt WHEN af_alt > 0.5 THEN ref END = 'A' THEN 1 END) AS BIGINT) AS minor_a
    FROM variants GROUP BY 1, 2""")
def orient_minor_major(spark: SparkSession, sf: str) -> DataFrame:
    v = variants(spark, sf).withColumn("o", C.orient(F.col("ref"), F.col("alt"), F.col("af_alt"), F.col("score")))
    return v.groupBy("o.orientation", "chrom").agg(F.count("*").alias("n"), F.count("o.minor_vs_major").alias("oriented"), F.round(F.sum("o.minor_vs_major"), 2).alias("minor_vs_major"), F.round(F.sum("o.paper_oriented"), 2).alias("paper"), F.round(F.avg("o.maf"), 6).alias("maf"), F.count_if(F.col("o.minor_allele") == "A").alias("minor_a"))


@query("frequency_class_summary", f"""
    WITH {V}, m AS (SELECT least(af_alt, 1 - af_alt) / 10 AS maf, score FROM variants)
    SELECT CASE WHEN maf < 0.01 THEN 'rare' WHEN maf < 0.05 THEN 'low_frequency' ELSE 'common' END AS frequency_class, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean,
        round(stddev_samp(score), 6) AS sd, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.75), 6) AS q75, min(score) AS min, max(score) AS max
    FROM m GROUP BY 1""")
def frequency_class_summary(spark: SparkSession, sf: str) -> DataFrame:
    maf = F.least(F.col("af_alt"), 1 - F.col("af_alt")) / 10
    v = variants(spark, sf).withColumn("frequency_class", C.frequency_class(maf))
    out = stats.group_summary(v, "score", ["frequency_class"])
    return out.select("frequency_class", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "median", "q25", "q75")], "min", "max")


@query("substitution_counts", f"""
    WITH {V} SELECT CASE WHEN ref IN ('A','G') THEN translate(ref, 'ACGT', 'TGCA') || '>' || translate(alt, 'ACGT', 'TGCA') ELSE ref || '>' || alt END AS substitution, CAST(count(*) AS BIGINT) AS n FROM variants GROUP BY 1""")
def substitution_counts(spark: SparkSession, sf: str) -> DataFrame:
    return variants(spark, sf).groupBy(C.substitution_class(F.col("ref"), F.col("alt")).alias("substitution")).agg(F.count("*").alias("n"))


SEQ = "regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGT]', 'N', 'g')"


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    text = F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACGT]", "N")
    return table(spark, sf, "benchmark").select("item_id", text.alias("seq")).where("seq <> ''")


@query("reverse_complement", f"""
    WITH s AS (SELECT item_id, {SEQ} AS seq FROM benchmark)
    SELECT item_id, translate(reverse(seq), 'ACGTN', 'TGCAN') AS rc, sha256(translate(reverse(seq), 'ACGTN', 'TGCAN') || '{{"model": "m"}}') AS cache_key FROM s WHERE seq <> ''""")
def reverse_complement(spark: SparkSession, sf: str) -> DataFrame:
    rc = C.reverse_complement(F.col("seq"))
    return sequences(spark, sf).select("item_id", rc.alias("rc"), C.cache_key(rc, {"model": "m"}).alias("cache_key"))


@query("context_windows", f"""
    WITH s AS (SELECT item_id, {SEQ} AS seq, item_id % 40 + 1 AS pos FROM benchmark), p AS (SELECT *, repeat('N', 16) || seq || repeat('N', 32) AS padded FROM s WHERE seq <> '')
    SELECT item_id, substr(padded, pos + 16 - 15, 32) AS padded, CASE WHEN pos - 15 >= 1 AND pos - 15 + 31 <= length(seq) THEN substr(seq, pos - 15, 32) END AS inner_window,
        pos <= 16 OR pos > length(seq) - 15 AS edge, pos <= length(seq) AND substr(seq, pos, 1) = 'A' AS ref_is_a,
        CASE WHEN pos <= length(seq) THEN substr(seq, 1, pos - 1) || 'T' || substr(seq, pos + 1) END AS substituted FROM p""")
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    s, pos = sequences(spark, sf).withColumn("pos", F.col("item_id") % 40 + 1), F.col("pos")
    return s.select("item_id", C.padded_context(F.col("seq"), pos, 32, 15).alias("padded"), C.inner_context(F.col("seq"), pos, 32).alias("inner_window"), C.edge_padded(pos, F.length("seq"), 32).alias("edge"), C.reference_matches(F.col("seq"), pos, F.lit("A")).alias("ref_is_a"), F.when(pos <= F.length("seq"), C.substituted(F.col("seq"), pos - 1, F.lit("T"))).alias("substituted"))


@query("token_encoding", f"""
    WITH s AS (SELECT item_id, {SEQ} AS seq FROM benchmark), c AS (SELECT item_id, i, substr(seq, i, 1) AS b FROM (SELECT item_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s))
    SELECT item_id, CAST(sum(CASE WHEN i = 6 THEN 1 WHEN b = 'A' THEN 3 WHEN b = 'C' THEN 4 WHEN b = 'G' THEN 5 WHEN b = 'T' THEN 6 ELSE 2 END * (i % 97)) AS BIGINT) AS token_sum,
        CAST(sum(CASE WHEN b <> 'N' THEN 1 ELSE 0 END) AS BIGINT) AS one_hot_sum FROM c GROUP BY item_id""")
def token_encoding(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences(spark, sf)
    weighted = F.aggregate(F.transform(C.tokens(F.col("seq"), F.lit(5)), lambda v, i: v * ((i + 1) % 97)), F.lit(0), lambda a, x: a + x)
    hot = F.aggregate(F.flatten(C.one_hot(F.col("seq"))), F.lit(0.0), lambda a, x: a + x)
    return s.select("item_id", weighted.cast("long").alias("token_sum"), hot.cast("long").alias("one_hot_sum"))


@query("single_difference", f"""
    WITH s AS (SELECT item_id, {SEQ} AS a FROM benchmark), t AS (SELECT item_id, a, CASE WHEN item_id % 3 = 0 THEN a ELSE substr(a, 1, 4) || 'T' || substr(a, 6) END AS b FROM s WHERE length(a) >= 8)
    SELECT item_id, CASE WHEN a <> b THEN 5 END AS differs_at, sha256(substr(a, 1, 2) || 'NNN' || substr(a, 6)) AS masked FROM t""")
def single_difference(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences(spark, sf).where("length(seq) >= 8").withColumn("b", F.when(F.col("item_id") % 3 == 0, F.col("seq")).otherwise(F.overlay("seq", F.lit("T"), F.lit(5), F.lit(1))))
    spans = F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("end")))
    return s.select("item_id", C.difference_position(F.col("seq"), F.col("b")).alias("differs_at"), F.sha2(C.masked(F.col("seq"), spans), 256).alias("masked"))


@query("log_softmax_llr", """
    WITH e AS (SELECT vec_id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE), CAST(embedding[4] AS DOUBLE)] AS x FROM embeddings),
    p AS (SELECT vec_id, x, ln(exp(x[1]) + exp(x[2]) + exp(x[3]) + exp(x[4])) AS z FROM e)
    SELECT vec_id, round(x[3] - x[1], 9) AS llr, round(x[1] - z, 9) AS log_p_a, round(((x[3] - x[1]) + (x[4] - x[2])) / 2, 9) AS strand_mean, round(abs((x[3] - x[1]) - (x[4] - x[2])), 9) AS strand_difference FROM p""")
def log_softmax_llr(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("x")).withColumn("p", C.log_softmax(F.col("x")))
    e = e.withColumn("llr", C.log_ratio(F.col("p"), F.lit("A"), F.lit("G"))).withColumn("rc", C.log_ratio(F.col("p"), F.lit("C"), F.lit("T")))
    s = C.strand_summary(F.col("llr"), F.col("rc"), F.lit(False))
    return e.select("vec_id", F.round("llr", 9).alias("llr"), F.round(F.get("p", F.lit(0)), 9).alias("log_p_a"), F.round(s["score"], 9).alias("strand_mean"), F.round(s["strand_difference"], 9).alias("strand_difference"))


@query("transfer_magnitude", """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))) AS x FROM embeddings)
    SELECT vec_id, round(list_sum(list_transform(range(1, 17), lambda i: abs(ln(1 + x[24 + i]) - ln(1 + x[i])))) / 16, 9) AS magnitude FROM e""")
def transfer_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), F.abs).alias("x"))
    return e.select("vec_id", F.round(C.transfer_magnitude(F.slice("x", 1, 16), C.central(F.col("x"), 16)), 9).alias("magnitude"))


@query("attribute_parse", """
    SELECT event_id, 'ID=e' || event_id || ';type=' || event_type AS attributes, event_type AS type_value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || '+=' || event_id AS note FROM events""")
def attribute_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    text = F.concat(F.lit("ID=e"), F.col("event_id"), F.lit(";type="), F.col("event_type"))
    m = C.attributes(F.concat(text, F.lit(";note="), F.col("event_type"), F.lit("%2B="), F.col("event_id")))
    return e.select("event_id", text.alias("attributes"), F.element_at(m, "type").alias("type_value"), F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.element_at(m, "note").alias("note"))


@query("physical_bins", """
    SELECT c_nationkey || ':' || CAST(((c_custkey * 13 + 1) - 1) // 500 + 1 AS VARCHAR) AS bin, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1""")
def physical_bins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(C.physical_bin(F.col("c_nationkey"), F.col("c_custkey") * 13 + 1, 500).alias("bin")).agg(F.count("*").alias("n"))


@query("scalar_transforms", """
    SELECT s_suppkey, round(exp(-abs(s_acctbal) / 2000.0), 9) AS decay, round(-log10((s_suppkey % 100 + 1) / 101.0::DOUBLE), 9) AS neg_log10, sign(s_acctbal) = sign(5000 - s_acctbal) AS same_sign,
        round(least(1, greatest(0, s_acctbal / 9000)), 9) AS clamped, s_suppkey % 2 = 0 AS flag, round(s_acctbal * 1.0498368135592189, 6) AS rescaled,
        CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS parsed, CASE WHEN s_suppkey % 7 < 4 THEN (s_suppkey % 5) * 1000 - (s_suppkey % 3) * 700 ELSE (s_suppkey % 11) * 50 - (s_suppkey % 5) * 1000 END AS signed_distance FROM supplier""")
def scalar_transforms(spark: SparkSession, sf: str) -> DataFrame:
    s, k, bal = table(spark, sf, "supplier"), F.col("s_suppkey"), F.col("s_acctbal")
    strand = F.when(k % 7 < 4, "+").otherwise("-")
    return s.select("s_suppkey", F.round(C.distance_decay(bal), 9).alias("decay"), F.round(C.neg_log10((k % 100 + 1) / 101), 9).alias("neg_log10"), C.same_sign(bal, 5000 - bal).alias("same_sign"), F.round(C.clamp_unit(bal / 9000), 9).alias("clamped"), C.parse_bool(F.when(k % 2 == 0, "Yes").otherwise("no")).alias("flag"), F.round(C.affine(bal, 1.0498368135592189), 6).alias("rescaled"), C.finite(F.when(k % 3 == 0, bal.cast("string")).when(k % 3 == 1, "NaN").otherwise("")).alias("parsed"), C.tss_distance((k % 5) * 1000, C.tss((k % 3) * 700, (k % 11) * 50, strand), strand).alias("signed_distance"))


# --- joins ---------------------------------------------------------------------------------------


@query("one_to_one_integrate", """
    SELECT s_suppkey, s_name, n_items, revenue, n_items IS NOT NULL AS matched FROM supplier LEFT JOIN
        (SELECT l_suppkey AS s_suppkey, CAST(count(*) AS BIGINT) AS n_items, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1) USING (s_suppkey)""")
def one_to_one_integrate(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_items"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return joins.one_to_one(table(spark, sf, "supplier").select("s_suppkey", "s_name"), own, ["s_suppkey"], complete=False)


MEMBERSHIP = """k AS (SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS l, coalesce(b.n, 0) AS r FROM (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1) a
    FULL JOIN (SELECT o_custkey + 100 AS k, count(*) AS n FROM orders GROUP BY 1) b ON a.k = b.k)"""


@query("crosswalk_status", f"""
    WITH {MEMBERSHIP} SELECT key, CASE WHEN l > 1 OR r > 1 THEN 'duplicate' WHEN r = 0 THEN 'left_only' WHEN l = 0 THEN 'right_only' ELSE 'matched' END AS status,
        CAST(l AS BIGINT) AS left_rows, CAST(r AS BIGINT) AS right_rows FROM k""")
def crosswalk_status(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return joins.membership(c, table(spark, sf, "orders").select((F.col("o_custkey") + 100).alias("key")), ["key"])


@query("key_set_difference", f"""
    WITH {MEMBERSHIP} SELECT CASE WHEN l > 1 OR r > 1 THEN 'duplicate' WHEN r = 0 THEN 'left_only' WHEN l = 0 THEN 'right_only' ELSE 'matched' END AS status, CAST(count(*) AS BIGINT) AS keys FROM k GROUP BY 1""")
def key_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return joins.key_differences(c, table(spark, sf, "orders").select((F.col("o_custkey") + 100).alias("key")), ["key"])


@query("keyed_chain_join", """
    SELECT n_nationkey, n_name, r_name, suppliers FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) USING (n_regionkey)
        JOIN (SELECT s_nationkey AS n_nationkey, CAST(count(*) AS BIGINT) AS suppliers FROM supplier GROUP BY 1) USING (n_nationkey) WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""")
def keyed_chain_join(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return joins.inner_chain(n, s, key=["n_nationkey"]).join(c, "n_nationkey", "left_semi").select("n_nationkey", "n_name", "r_name", "suppliers")


@query("interval_lookup", """
    WITH p AS (SELECT DISTINCT l_partkey * 7 + l_linenumber AS pos FROM lineitem), i AS (SELECT p_partkey * 7 AS s, p_partkey * 7 + 1 + p_size % 6 AS e, p_retailprice AS score FROM part)
    SELECT pos, score, CASE WHEN score IS NULL THEN 'missing_coverage' ELSE 'covered' END AS status FROM p LEFT JOIN i ON s <= pos - 1 AND pos - 1 < e""")
def interval_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select(F.lit("1").alias("chrom"), (F.col("l_partkey") * 7 + F.col("l_linenumber")).alias("pos")).distinct()
    i = table(spark, sf, "part").select(F.lit("1").alias("chrom"), (F.col("p_partkey") * 7).alias("start"), (F.col("p_partkey") * 7 + 1 + F.col("p_size") % 6).alias("end"), F.col("p_retailprice").alias("score"))
    return joins.interval_lookup(p, i).select("pos", "score", "status")


@query("feature_overlap", """
    WITH f AS (SELECT p_name AS name, CASE p_size % 3 WHEN 0 THEN 'CDS' WHEN 1 THEN 'exon' ELSE 'gene' END AS kind, p_partkey * 40 AS s, p_partkey * 40 + p_size * 2 AS e FROM part),
    p AS (SELECT s_suppkey, s_suppkey * 37 + 5 AS pos FROM supplier)
    SELECT s_suppkey, pos, coalesce(bool_or(kind = 'CDS'), false) AS in_cds, coalesce(bool_or(kind = 'exon'), false) AS in_exon, coalesce(bool_or(kind = 'gene'), false) AS in_gene,
        coalesce(string_agg(DISTINCT CASE WHEN kind = 'gene' THEN name END, '|' ORDER BY CASE WHEN kind = 'gene' THEN name END), '') AS genes,
        CASE WHEN bool_or(kind = 'CDS') THEN 'coding_cds' WHEN bool_or(kind = 'exon') THEN 'exonic_non_cds' WHEN bool_or(kind = 'gene') THEN 'other_genic' ELSE 'intergenic' END AS context
    FROM p LEFT JOIN f ON pos BETWEEN s AND e GROUP BY 1, 2""")
def feature_overlap(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    f = table(spark, sf, "part").select(F.lit("1").alias("chrom"), F.col("p_name").alias("name"), F.when(size % 3 == 0, "CDS").when(size % 3 == 1, "exon").otherwise("gene").alias("kind"), (F.col("p_partkey") * 40).alias("start"), (F.col("p_partkey") * 40 + size * 2).alias("end"))
    p = table(spark, sf, "supplier").select(F.lit("1").alias("chrom"), "s_suppkey", (F.col("s_suppkey") * 37 + 5).alias("pos"))
    out = joins.annotate(p, f, key=["s_suppkey"])
    return out.select("s_suppkey", "pos", "in_cds", "in_exon", "in_gene", F.array_join("genes", "|").alias("genes"), C.gene_context(F.col("in_cds"), F.col("in_exon"), F.col("in_gene")).alias("context"))


BAND = """p AS (SELECT c_nationkey AS g, c_custkey AS k, c_custkey * 3 % 4001 AS pos FROM customer),
    pairs AS (SELECT a.g, a.k AS left_key, b.k AS right_key, a.pos AS left_pos, b.pos AS right_pos, b.pos - a.pos AS distance FROM p a JOIN p b ON a.g = b.g AND (b.pos > a.pos OR (b.pos = a.pos AND b.k > a.k)) AND b.pos - a.pos <= 250)"""


@query("band_pairs", f"WITH {BAND} SELECT g AS c_nationkey, left_key, right_key, left_pos, right_pos, distance FROM pairs")
def band_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") * 3 % 4001).alias("pos"))
    return joins.band_pairs(p, group="c_nationkey", pos="pos", key="c_custkey", reach=250)


@query("table_comparison", f"""
    WITH {COMPARED_SQL} SELECT "column", CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE why = 'missing_key') AS BIGINT) AS unmatched, CAST(count(*) FILTER (WHERE why = 'missing_value') AS BIGINT) AS missing,
        round(max(difference), 9) AS max_difference, CAST(count(why) AS BIGINT) AS failing FROM judged GROUP BY 1""")
def table_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(joins.compare_tables(*compared(spark, sf), ["k"], ["q", "t"], atol=0.2, rtol=1e-6), 9)


# --- samples -------------------------------------------------------------------------------------


@query("sha256_bottom_k", """
    SELECT o_orderkey, o_totalprice, h AS selection_hash, CAST(row_number() OVER (ORDER BY h) AS INTEGER) AS selection_rank FROM
        (SELECT o_orderkey, o_totalprice, sha256('sample|' || o_orderkey) AS h FROM orders ORDER BY h LIMIT 100)""")
def sha256_bottom_k(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.bottom_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, "sample", "o_orderkey")


@query("bottom_k_eligible", """
    WITH c AS (SELECT o_orderkey, o_orderstatus, sha256('pool|' || o_orderkey) AS h FROM orders ORDER BY h LIMIT 400), t AS (SELECT * FROM c WHERE o_orderstatus <> 'P' ORDER BY h LIMIT 120)
    SELECT o_orderkey, o_orderstatus, h AS selection_hash, CAST(row_number() OVER (ORDER BY h) AS INTEGER) AS selection_rank FROM t""")
def bottom_k_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.bottom_k_eligible(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), 400, 120, F.col("o_orderstatus") != "P", "pool", "o_orderkey")


@query("quota_fill", """
    WITH p AS (
        SELECT nullif(p_brand, 'Brand#13') AS brand, CASE WHEN p_size % 3 <> 0 THEN p_size END AS size, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS price, unnest([1, 2]) AS time, p_partkey FROM part
    ), a AS (SELECT *, 'rare' AS c FROM p WHERE size < 5 ORDER BY p_partkey, time LIMIT 25),
    b AS (SELECT *, 'alt_major' AS c FROM p WHERE price > 950 AND (p_partkey, time) NOT IN (SELECT (p_partkey, time) FROM a) ORDER BY p_partkey, time LIMIT 25),
    d AS (SELECT *, 'common' AS c FROM p WHERE (p_partkey, time) NOT IN (SELECT (p_partkey, time) FROM a UNION ALL SELECT (p_partkey, time) FROM b) ORDER BY p_partkey, time LIMIT 25)
    SELECT brand, size, price, p_partkey, c AS selection_class FROM a UNION ALL SELECT brand, size, price, p_partkey, c FROM b UNION ALL SELECT brand, size, price, p_partkey, c FROM d""")
def quota_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with missing values, each row twice."""
    n = F.col("p_size")
    p = table(spark, sf, "part").select(F.nullif("p_brand", F.lit("Brand#13")).alias("brand"), F.when(n % 3 != 0, n).alias("size"), F.when(n % 4 != 0, F.col("p_retailprice")).alias("price"), "p_partkey")
    twice = p.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("time")).drop("time")
    return ranks.quota_fill(twice, [("rare", F.col("size") < 5, 25), ("alt_major", F.col("price") > 950, 25), ("common", F.lit(True), 25)], ["p_partkey"])


@query("per_group_bottom_k", """
    WITH h AS (SELECT c_nationkey, c_custkey, sha256('grp|' || c_custkey) AS h, c_custkey % 50 = 0 AS first FROM customer)
    SELECT c_nationkey, c_custkey, h AS selection_hash, CAST(n AS INTEGER) AS group_rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY first DESC, h) AS n FROM h) WHERE n <= 5""")
def per_group_bottom_k(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey")
    return ranks.per_group_bottom_k(c, 5, ["c_nationkey"], "grp", "c_custkey", first=F.col("c_custkey") % 50 == 0)


@query("hash_holdout", """
    SELECT CASE WHEN CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 7 THEN 'discovery' ELSE 'heldout' END AS side, CAST(count(*) AS BIGINT) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1""")
def hash_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(C.discovery_side(F.col("c_custkey")).alias("side")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("hash_subset", "SELECT n_name, sha256('alpha:' || n_name) AS subset_hash FROM nation ORDER BY 2 LIMIT 5")
def hash_subset(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.hash_subset(table(spark, sf, "nation").select("n_name"), "n_name")


# --- statistics ----------------------------------------------------------------------------------


@query("genotype_summary", """
    WITH c AS (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN '0' WHEN 'R' THEN '1' ELSE '.' END AS a, CASE l_linestatus WHEN 'F' THEN '0' ELSE '1' END AS b FROM lineitem),
    s AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE a = '.' AND b = '.') AS m, count(*) FILTER (WHERE a <> b AND a <> '.') AS h, sum((a = '0')::INT + (b = '0')::INT) AS r, sum((a = '1')::INT + (b = '1')::INT) AS x FROM c GROUP BY 1)
    SELECT l_suppkey, CAST(n AS BIGINT) AS n_genotypes, CAST(m AS BIGINT) AS n_missing, CAST(h AS BIGINT) AS n_heterozygous, CAST(r AS BIGINT) AS ac_ref, CAST(x AS BIGINT) AS ac_alt, CAST(0 AS BIGINT) AS invalid,
        CAST(r + x AS BIGINT) AS an, CAST(least(r, x) AS BIGINT) AS mac, round(x / (r + x)::DOUBLE, 9) AS af_alt, round(least(r, x) / (r + x)::DOUBLE, 9) AS maf, round((r + x) / (2.0 * n)::DOUBLE, 9) AS allele_call_rate FROM s""")
def genotype_summary(spark: SparkSession, sf: str) -> DataFrame:
    one = F.when(F.col("l_returnflag") == "A", "0").when(F.col("l_returnflag") == "R", "1").otherwise(".")
    calls = table(spark, sf, "lineitem").select("l_suppkey", F.concat(one, F.lit("|"), F.when(F.col("l_linestatus") == "F", "0").otherwise("1"), F.lit(":99")).alias("gt"))
    return rounded(stats.genotype_summary(calls, ["l_suppkey"]), 9)


@query("dosage_extraction", """
    SELECT l_suppkey, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS missing, CAST(sum(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 END + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) AS BIGINT) AS alt_copies FROM lineitem GROUP BY 1""")
def dosage_extraction(spark: SparkSession, sf: str) -> DataFrame:
    one = F.when(F.col("l_returnflag") == "A", "0").when(F.col("l_returnflag") == "R", "1").otherwise(".")
    d = table(spark, sf, "lineitem").select("l_suppkey", C.dosage(F.concat(one, F.lit("/"), F.when(F.col("l_linestatus") == "F", "0").otherwise("1"))).alias("d"))
    return d.groupBy("l_suppkey").agg(F.count_if(F.col("d").isNull()).alias("missing"), F.sum("d").cast("long").alias("alt_copies"))


def _corr_sql(source: str, by: str, x: str, y: str) -> str:
    """Pearson and spearman by group; ``source`` names a relation."""
    cols = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    avg = lambda c: f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {cols}{c}) - 1) / 2.0::DOUBLE"
    guard = lambda a, b: f"CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN round(corr({a}, {b}), 6) + 0.0::DOUBLE END"
    return f"""r AS (SELECT {cols}{x} AS x, {y} AS y, {avg(x)} AS rx, {avg(y)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
        c AS (SELECT {cols}CAST(count(*) AS BIGINT) AS n, {guard('x', 'y')} AS pearson, {guard('rx', 'ry')} AS spearman FROM r {group})
        SELECT {cols}n, 'pearson' AS method, pearson AS estimate FROM c UNION ALL SELECT {cols}n, 'spearman', spearman FROM c"""


@query("correlation_overall", f"WITH {V}, {_corr_sql('variants', '', 'quantity', 'score')}")
def correlation_overall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.correlations(variants(spark, sf), "quantity", "score"))


@query("correlation_stratified", f"WITH {V}, s AS (SELECT chrom, status, CASE WHEN chrom = 'N' THEN 1.0::DOUBLE ELSE quantity END AS quantity, price FROM variants), {_corr_sql('s', 'chrom, status', 'quantity', 'price')}")
def correlation_stratified(spark: SparkSession, sf: str) -> DataFrame:
    v = variants(spark, sf).withColumn("quantity", F.when(F.col("chrom") == "N", 1.0).otherwise(F.col("quantity")))
    return rounded(stats.correlations(v, "quantity", "price", ["chrom", "status"]))


@query("comparison_grid", f"""WITH {V}, s AS (SELECT 'quantity__price' AS comparison, chrom, quantity AS x, price AS y FROM variants UNION ALL SELECT 'quantity__tax', chrom, quantity, tax FROM variants UNION ALL SELECT 'price__tax', chrom, price, tax FROM variants), {_corr_sql('s', 'comparison, chrom', 'x', 'y')}""")
def comparison_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.comparison_grid(variants(spark, sf), [("quantity", "price"), ("quantity", "tax"), ("price", "tax")], ["chrom"]))


@query("correlation_leave_one_out", f"""WITH {V}, g AS (SELECT unnest(['A','N','R']) AS "group"), s AS (SELECT CASE WHEN chrom = "group" THEN 'only' ELSE 'without' END AS analysis, "group", tax, price FROM variants, g), {_corr_sql('s', 'analysis, "group"', 'tax', 'price')}""")
def correlation_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.leave_one_out(variants(spark, sf), "tax", "price", "chrom", ["A", "N", "R"]))


@query("correlation_sensitivity", f"""WITH {V}, s AS (SELECT 'all' AS subset, tax, price FROM variants UNION ALL SELECT 'large', tax, price FROM variants WHERE quantity >= 25 UNION ALL SELECT 'large_taxed', tax, price FROM variants WHERE quantity >= 25 AND tax > 0.02), {_corr_sql('s', 'subset', 'tax', 'price')}""")
def correlation_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    large = F.col("quantity") >= 25
    return rounded(stats.sensitivity(variants(spark, sf), "tax", "price", {"all": F.lit(True), "large": large, "large_taxed": large & (F.col("tax") > 0.02)}))


@query("rank_biserial", """
    WITH r AS (SELECT o_orderstatus = 'F' AS a, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS r FROM orders WHERE o_orderstatus IN ('F', 'O')),
    s AS (SELECT count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE NOT a) AS nb, sum(r) FILTER (WHERE a) AS ra FROM r)
    SELECT CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, round(2 * (ra - na * (na + 1) / 2) / (na * nb) - 1, 9) AS rank_biserial FROM s""")
def rank_biserial(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.rank_biserial(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F", "O"), 9)


@query("average_ranks", "SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS rank FROM part")
def average_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.average_ranks(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"]).drop("p_size")


@query("log_histogram", """
    SELECT CAST(least(43, floor(ln(o_totalprice / 1000.0) / ln(500.0) * 44)) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS rows FROM orders WHERE o_totalprice BETWEEN 1000 AND 500000 GROUP BY 1""")
def log_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.log_histogram(table(spark, sf, "orders"), "o_totalprice", 1000.0, 500000.0, 44)


@query("density_grid", "SELECT CAST(floor(l_quantity / 5.0) AS BIGINT) AS x_bin, CAST(floor(l_extendedprice / 10000.0) AS BIGINT) AS y_bin, CAST(count(*) AS BIGINT) AS rows FROM lineitem GROUP BY 1, 2")
def density_grid(spark: SparkSession, sf: str) -> DataFrame:
    return stats.density_grid(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 5.0, 10000.0)


@query("attrition_funnel", """
    SELECT 1 AS step, 'all' AS name, CAST(count(*) AS BIGINT) AS rows FROM orders UNION ALL SELECT 2, 'open', CAST(count(*) AS BIGINT) FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 3, 'large', CAST(count(*) AS BIGINT) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 UNION ALL SELECT 4, 'urgent', CAST(count(*) AS BIGINT) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_orderpriority = '1-URGENT'""")
def attrition_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return stats.funnel(table(spark, sf, "orders"), {"all": F.lit(True), "open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 100000, "urgent": F.col("o_orderpriority") == "1-URGENT"})


@query("reason_codes", """
    WITH c AS (SELECT c_acctbal < 0 AS a, c_mktsegment = 'MACHINERY' AS b, c_nationkey % 2 = 1 AS d FROM customer)
    SELECT 'negative' AS reason, CAST(count(*) FILTER (WHERE a) AS BIGINT) AS rows FROM c HAVING count(*) FILTER (WHERE a) > 0 UNION ALL SELECT 'machinery', CAST(count(*) FILTER (WHERE b) AS BIGINT) FROM c
    UNION ALL SELECT 'odd_nation', CAST(count(*) FILTER (WHERE d) AS BIGINT) FROM c""")
def reason_codes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(C.reasons((F.col("c_acctbal") < 0, "negative"), (F.col("c_mktsegment") == "MACHINERY", "machinery"), (F.col("c_nationkey") % 2 == 1, "odd_nation")).alias("r"))
    return stats.reason_counts(c, "r")


@query("coverage_matrix", f"""
    WITH {K}, l AS (SELECT gene, 'model_a' AS model, model_a IS NOT NULL AS has FROM candidates UNION ALL SELECT gene, 'model_b', model_b IS NOT NULL FROM candidates UNION ALL SELECT gene, 'phylop', phylop IS NOT NULL FROM candidates),
    g AS (SELECT gene, model, count(*) FILTER (WHERE has) AS h, count(*) AS n FROM l GROUP BY 1, 2)
    SELECT model, CAST(sum(h) AS BIGINT) AS covered, CAST(sum(n) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE h = n) AS BIGINT) AS complete_groups FROM g GROUP BY 1""")
def coverage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.coverage_table(candidates(spark, sf), ["model_a", "model_b", "phylop"], "gene")


# --- resampling ----------------------------------------------------------------------------------

DRAW = "CAST(('0x' || substr(sha256({}), 1, 8)) AS BIGINT)"


@query("cluster_bootstrap", f"""
    WITH {V}, r AS (SELECT chrom AS s, CAST(line AS VARCHAR) || status AS c, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS y FROM variants),
    q AS (SELECT s, c, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM r GROUP BY 1, 2),
    i AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY s) AS m FROM q),
    d AS (SELECT s, rep, {DRAW.format("'cb|' || s || '|' || rep || '|' || i")} % m AS i FROM i, range(0, 20) t(rep)),
    t AS (SELECT rep, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy FROM d JOIN i USING (s, i) GROUP BY 1)
    SELECT CAST(rep AS INTEGER) AS replicate, round((sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)), 6) AS estimate FROM t""")
def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    v = variants(spark, sf).withColumn("c", F.concat(F.col("line").cast("string"), F.col("status")))
    return rounded(resample.cluster_bootstrap(v, "quantity", "price", stratum="chrom", cluster="c", replicates=20, seed="cb"))


@query("stratified_permutation", f"""
    WITH RECURSIVE o AS (SELECT CAST(s_nationkey % 4 AS VARCHAR) AS s, s_suppkey AS k, s_suppkey % 17 AS a, s_acctbal AS b FROM supplier),
    r AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY s) AS n, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS ry FROM o),
    obs AS (SELECT corr(rx, ry) AS observed FROM r),
    halves AS (SELECT s, n, (SELECT min(h) FROM range(1, 32) t(h) WHERE (1::BIGINT << (2 * h)) >= n) AS half FROM r GROUP BY 1, 2),
    keys AS (SELECT s, rep, {", ".join(f"CAST('0x' || substr(sha256('perm|' || rep || '|' || s || '|{k}'), 1, 8) AS BIGINT) % 1073741824 * 2 + 1 AS a{k}, CAST('0x' || substr(sha256('perm|' || rep || '|' || s || '|{k}'), 9, 8) AS BIGINT) % 2147483648 AS b{k}" for k in range(6))} FROM halves, range(0, 40) t(rep)),
    walk AS (
        SELECT rep, s, i, n, half, 0 AS k, i >> half AS l, i & ((1::BIGINT << half) - 1) AS r FROM r JOIN halves USING (s, n), range(0, 40) t(rep)
        UNION ALL
        SELECT rep, s, i, n, half, k % 6 + 1, r, xor(l, ((r * CASE k % 6 {" ".join(f"WHEN {k} THEN a{k}" for k in range(6))} END + CASE k % 6 {" ".join(f"WHEN {k} THEN b{k}" for k in range(6))} END) & 2147483647) >> (31 - half))
        FROM walk JOIN keys USING (s, rep) WHERE k < 6 OR (l << half) + r >= n
    ),
    b AS (SELECT rep, s, i, (l << half) + r AS j FROM walk WHERE k = 6 AND (l << half) + r < n),
    e AS (SELECT rep, corr(x.rx, y.ry) AS rho FROM b JOIN r x ON x.s = b.s AND x.i = b.i JOIN r y ON y.s = b.s AND y.i = b.j GROUP BY 1)
    SELECT round(observed, 6) AS observed, CAST(count(*) AS BIGINT) AS replicates, CAST(count(*) FILTER (WHERE round(abs(rho), 12) >= round(abs(observed), 12)) AS BIGINT) AS extreme, round((count(*) FILTER (WHERE round(abs(rho), 12) >= round(abs(observed), 12)) + 1) / 41.0::DOUBLE, 6) AS p FROM e, obs GROUP BY observed""")
def stratified_permutation(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select((F.col("s_nationkey") % 4).alias("s"), "s_suppkey", (F.col("s_suppkey") % 17).alias("a"), F.col("s_acctbal").alias("b"))
    return rounded(resample.stratified_permutation(s, "a", "b", stratum="s", key="s_suppkey", replicates=40, seed="perm"))


@query("median_bootstrap", f"""
    WITH v AS (SELECT s_acctbal AS v, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS m FROM supplier), d AS (SELECT rep, {DRAW.format("'med|' || rep || '|' || i")} % m AS i FROM v, range(0, 30) t(rep)),
    e AS (SELECT rep, quantile_cont(v, 0.5) AS estimate FROM d JOIN v USING (i) GROUP BY 1)
    SELECT CAST(count(*) AS BIGINT) AS replicates, round(avg(estimate), 6) AS mean, round(stddev_samp(estimate), 6) AS se, round(quantile_cont(estimate, 0.025), 6) AS low, round(quantile_cont(estimate, 0.975), 6) AS high FROM e""")
def median_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.interval(resample.median_bootstrap(table(spark, sf, "supplier"), "s_acctbal", "s_suppkey", replicates=30, seed="med"), "estimate"))


@query("order_bootstrap")
def order_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Medians of every line's price, by draws down a tree of counts (which SQL doesn't have; held against direct draws in tests)."""
    return rounded(resample.interval(resample.order_bootstrap(table(spark, sf, "lineitem"), "l_extendedprice", replicates=200, seed="tree"), "estimate"))


@query("pairwise_bootstrap", f"""
    WITH r AS (SELECT o_orderstatus = 'F' AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS m FROM orders WHERE o_orderstatus IN ('F', 'O')),
    d AS (SELECT g, rep, {DRAW.format("'pb|' || CASE WHEN g THEN 'true' ELSE 'false' END || '|' || rep || '|' || i")} % m AS i FROM r, range(0, 50) t(rep)),
    s AS (SELECT rep, g, v FROM d JOIN r USING (g, i)),
    m AS (SELECT rep, quantile_cont(v, 0.5) FILTER (WHERE g) - quantile_cont(v, 0.5) FILTER (WHERE NOT g) AS md FROM s GROUP BY 1),
    c AS (SELECT rep, v, count(*) FILTER (WHERE g) AS na, count(*) FILTER (WHERE NOT g) AS nb FROM s GROUP BY 1, 2),
    b AS (SELECT rep, na, nb, coalesce(sum(nb) OVER (PARTITION BY rep ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
    u AS (SELECT rep, sum(na * (2 * below + nb)) / (sum(na) * sum(nb))::DOUBLE - 1 AS rb FROM b GROUP BY 1)
    SELECT CAST(rep AS INTEGER) AS replicate, round(md, 6) AS median_difference, round(rb, 9) AS rank_biserial FROM m JOIN u USING (rep)""")
def pairwise_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    out = resample.pairwise_bootstrap(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F", "O", key="o_orderkey", replicates=50, seed="pb")
    return out.select("replicate", F.round("median_difference", 6).alias("median_difference"), F.round("rank_biserial", 9).alias("rank_biserial"))


# --- linkage and matrices ------------------------------------------------------------------------

R2 = """e AS (SELECT label, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
    pr AS (SELECT a.label, a.vec_id AS left_key, b.vec_id AS right_key, b.vec_id - a.vec_id AS distance, unnest(a.v) AS x, unnest(b.v) AS y FROM e a JOIN e b ON a.label = b.label AND b.vec_id > a.vec_id AND b.vec_id - a.vec_id <= {}),
    r2 AS (SELECT label, left_key, right_key, distance, CAST(count(*) AS INTEGER) AS n_complete, corr(x, y) * corr(x, y) AS r2 FROM pr GROUP BY 1, 2, 3, 4)"""


def _pairs(spark: SparkSession, sf: str, reach: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    p = joins.band_pairs(e.select("label", "vec_id", F.col("vec_id").alias("pos")), group="label", pos="pos", key="vec_id", reach=reach)
    return ld.pairwise_r2(p.select("label", "left_key", "right_key", "distance"), e, key="vec_id", vector="embedding", least=10)


@query("pairwise_r2", f"WITH {R2.format(60)} SELECT label, left_key, right_key, distance, n_complete, round(r2, 6) AS r2, 'ok' AS status FROM r2")
def pairwise_r2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_pairs(spark, sf, 60))


@query("dosage_r2", """
    WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CASE WHEN x < -1 THEN NULL WHEN x < -0.2 THEN 0 WHEN x < 0.8 THEN 1 ELSE 2 END) AS v FROM embeddings),
    pr AS (SELECT a.label, a.vec_id AS left_key, b.vec_id AS right_key, b.vec_id - a.vec_id AS distance, unnest(a.v) AS x, unnest(b.v) AS y FROM e a JOIN e b ON a.label = b.label AND b.vec_id > a.vec_id AND b.vec_id - a.vec_id <= 60),
    s AS (SELECT label, left_key, right_key, distance, CAST(count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS INTEGER) AS n_complete, corr(x, y) AS r, covar_pop(x, y) AS c FROM pr GROUP BY 1, 2, 3, 4)
    SELECT label, left_key, right_key, distance, n_complete, CASE WHEN n_complete >= 40 AND c IS NOT NULL AND NOT isnan(r) THEN round(r * r, 9) END AS r2, CASE WHEN n_complete < 40 THEN 'insufficient_complete_samples' WHEN r IS NULL OR isnan(r) THEN 'pairwise_nonvariable' ELSE 'ok' END AS status FROM s""")
def dosage_r2(spark: SparkSession, sf: str) -> DataFrame:
    """Linkage of dosages on bit planes; components below -1 stand for calls that are missing."""
    coded = F.transform("embedding", lambda x: F.when(x < -1, -1).when(x < -0.2, 0).when(x < 0.8, 1).otherwise(2))
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("vec_id").alias("pos"), coded.alias("dosages"))
    out = ld.dosage_r2(e, group="label", pos="pos", key="vec_id", vector="dosages", reach=60, least=40)
    return rounded(out.drop("left_pos", "right_pos"), 9)


@query("r2_threshold_counts", f"""WITH {R2.format(60)}, w AS (SELECT unnest([20, 40, 60]) AS "window") SELECT "window", CAST(count(*) AS BIGINT) AS pairs, CAST(count(r2) AS BIGINT) AS valid, CAST(count(*) FILTER (WHERE r2 >= 0.02) AS BIGINT) AS r2_ge_002, CAST(count(*) FILTER (WHERE r2 >= 0.05) AS BIGINT) AS r2_ge_005 FROM r2, w WHERE distance <= "window" GROUP BY 1""")
def r2_threshold_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ld.threshold_counts(_pairs(spark, sf, 60), [20, 40, 60], [0.02, 0.05])


@query("greedy_thinning", f"""
    WITH RECURSIVE {R2.format(60)}, l AS (SELECT label, left_key, right_key, distance FROM r2 WHERE r2 >= 0.05),
    n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
    left_of AS (SELECT right_key AS vec_id, list(left_key ORDER BY left_key) AS ls FROM l GROUP BY 1),
    o AS (SELECT n.i, n.vec_id, coalesce(ls, []) AS ls FROM n LEFT JOIN left_of USING (vec_id)),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL
        SELECT o.i, CASE WHEN list_has_any(kept, o.ls) THEN kept ELSE list_append(kept, o.vec_id) END FROM walk JOIN o ON o.i = walk.i + 1),
    final AS (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)
    SELECT o.vec_id, list_contains(kept, o.vec_id) AS retained, CASE WHEN NOT list_contains(kept, o.vec_id) THEN list_min(list_filter(o.ls, lambda v: list_contains(kept, v))) END AS removed_by FROM o, final""")
def greedy_thinning(spark: SparkSession, sf: str) -> DataFrame:
    links = _pairs(spark, sf, 60).where("r2 >= 0.05")
    return ld.greedy_thinning(table(spark, sf, "embeddings"), links, key="vec_id").select("vec_id", "retained", "removed_by")


@query("spacing_thinning", """
    WITH RECURSIVE p AS (SELECT DISTINCT c_nationkey AS g, c_custkey * 17 % 5003 AS pos FROM customer), o AS (SELECT g, pos, row_number() OVER (PARTITION BY g ORDER BY pos) AS i FROM p),
    w AS (SELECT g, i, pos AS last, true AS kept FROM o WHERE i = 1 UNION ALL SELECT o.g, o.i, CASE WHEN o.pos - w.last >= 400 THEN o.pos ELSE w.last END, o.pos - w.last >= 400 FROM w JOIN o ON o.g = w.g AND o.i = w.i + 1)
    SELECT g AS c_nationkey, last AS pos FROM w WHERE kept""")
def spacing_thinning(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "customer").select("c_nationkey", (F.col("c_custkey") * 17 % 5003).alias("pos"))
    return ranks.spaced(p, group="c_nationkey", pos="pos", apart=400)


@query("kinship", """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), m AS (SELECT vec_id, v, list_avg(v) AS mu FROM e), s AS (SELECT vec_id, v, mu, sqrt(list_avg(list_transform(v, lambda x: (x - mu) * (x - mu)))) AS sd FROM m),
    z AS (SELECT vec_id, unnest(range(0, len(v))) AS i, unnest(list_transform(v, lambda x: (x - mu) / sd)) AS x FROM s)
    SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(avg(a.x * b.x), 6) AS k FROM z a JOIN z b USING (vec_id) GROUP BY 1, 2""")
def kinship(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(assoc.kinship(assoc.imputed(e, "v"), "standardized").select("i", "j", "k"))


@query("kinship_leave_one_out", """
    WITH z AS (SELECT label, vec_id, unnest(range(0, len(embedding))) AS i, unnest(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS x FROM embeddings), g AS (SELECT DISTINCT label FROM embeddings)
    SELECT g.label, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(avg(a.x * b.x), 6) + 0.0 AS k FROM z a JOIN z b USING (vec_id) JOIN g ON g.label <> a.label GROUP BY 1, 2, 3""")
def kinship_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(assoc.leave_one_group_out(assoc.kinship(e, "v", ["label"]), "label"))


@query("neighbour_jaccard", """
    WITH e AS (SELECT vec_id, list_transform(embedding[1:32], lambda v: CAST(v AS DOUBLE)) AS a, list_transform(embedding[33:64], lambda v: CAST(v AS DOUBLE)) AS b FROM embeddings),
    d AS (SELECT x.vec_id AS key, y.vec_id AS o, list_sum(list_transform(range(1, 33), lambda i: (x.a[i] - y.a[i]) * (x.a[i] - y.a[i]))) AS da, list_sum(list_transform(range(1, 33), lambda i: (x.b[i] - y.b[i]) * (x.b[i] - y.b[i]))) AS db FROM e x JOIN e y ON x.vec_id <> y.vec_id),
    r AS (SELECT key, o, row_number() OVER (PARTITION BY key ORDER BY da, o) <= 15 AS na, row_number() OVER (PARTITION BY key ORDER BY db, o) <= 15 AS nb FROM d)
    SELECT key, round(count(*) FILTER (WHERE na AND nb) / count(*) FILTER (WHERE na OR nb)::DOUBLE, 9) AS jaccard FROM r GROUP BY key""")
def neighbour_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return rounded(assoc.neighbour_agreement(e, "a", "b", "vec_id"), 9)


@query("sample_quality", """
    WITH s AS (SELECT unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings), r AS (SELECT i, avg(CASE WHEN v >= 0 THEN 1.0 ELSE 0.0 END) AS c FROM s GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS sample_index, round(c, 9) AS call_rate, c >= 0.8 AS primary_include, c >= 0.9 AS strict_include FROM r""")
def sample_quality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(assoc.sample_quality(table(spark, sf, "embeddings"), "embedding"), 9)


@query("principal_components")
def principal_components(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.principal_components(table(spark, sf, "embeddings"), "embedding", "vec_id", 8)


@query("component_norms", """
    WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT vec_id, x - avg(x) OVER (PARTITION BY i) AS x FROM e)
    SELECT vec_id, round(sum(x * x), 6) AS norm FROM c GROUP BY 1""")
def component_norms(spark: SparkSession, sf: str) -> DataFrame:
    """Over all its components a row has the length that it has from the mean."""
    p = assoc.principal_components(table(spark, sf, "embeddings"), "embedding", "vec_id", 64)
    return p.groupBy("vec_id").agg(F.round(F.sum(F.col("value") * F.col("value")), 6).alias("norm"))


@query("randomised_component_norms", """
    WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT vec_id, x - avg(x) OVER (PARTITION BY i) AS x FROM e)
    SELECT vec_id, round(sum(x * x), 6) AS norm FROM c GROUP BY 1""")
def randomised_component_norms(spark: SparkSession, sf: str) -> DataFrame:
    """The same lengths from a random range, which as wide as the vectors loses nothing."""
    p = assoc.randomised_components(table(spark, sf, "embeddings"), "embedding", "vec_id", 64, more=0)
    return p.groupBy("vec_id").agg(F.round(F.sum(F.col("value") * F.col("value")), 6).alias("norm"))


@query("association_scan")
def association_scan(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("L"), F.col("label")).alias("gene"), F.col("vec_id").alias("variant_id"), F.col("embedding").cast("array<double>").alias("dosages"))
    own = assoc.kinship(assoc.imputed(e, "dosages"), "standardized").select("i", "j", "k")
    y = e.groupBy("gene").agg(F.min_by("dosages", "variant_id").alias("values"))
    return assoc.association_scan(e, y, own)


# --- ranking -------------------------------------------------------------------------------------

RANKED = """SELECT *, rank() OVER (PARTITION BY gene ORDER BY {x}) + (count(*) OVER (PARTITION BY gene, {x}) - 1) / 2.0::DOUBLE - 0.5"""


def _pct(x: str) -> str:
    return f"(rank() OVER (PARTITION BY gene ORDER BY {x}) + (count(*) OVER (PARTITION BY gene, {x}) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY gene)"


def _rank_sql(source: str, out: str, score: str | None) -> str:
    annotated = f"0.8 * (0.9 * {_pct('discovery_neglogp')} + 0.1 * coalesce(ld_r2_lead, 0)) + 0.1 * exp(-abs(tss_distance) / 2000.0) + 0.05 * {_pct('coalesce(phylop, 0)')} + CASE WHEN context <> 'CDS' THEN 0.05 ELSE 0 END"
    priority = annotated if score is None else f"0.8 * ({annotated}) + 0.2 * {_pct(f'abs({score})')}"
    return f"{out}_p AS (SELECT *, {priority} AS priority FROM {source}), {out} AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY round(priority, 12) DESC, variant_id) AS rank FROM {out}_p)"


@query("rank_candidates", f"WITH {K}, s AS (SELECT * FROM candidates WHERE model_a IS NOT NULL), {_rank_sql('s', 'r', 'model_a')} SELECT gene, variant_id, round(priority, 9) AS priority, CAST(rank AS INTEGER) AS rank FROM r")
def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prioritize.rank_candidates(candidates(spark, sf).where("model_a IS NOT NULL"), "model_a").select("gene", "variant_id", "priority", "rank"), 9)


@query("held_out_targets", f"""
    WITH {K}, m AS (SELECT gene, min(ROW(heldout_p, variant_id)) AS m, count(*) AS n FROM candidates GROUP BY 1)
    SELECT gene, (m)[2] AS target, (m)[1] AS target_p, CAST(n AS BIGINT) AS full_candidates, (m)[1] < 0.05 / n AS replicated FROM m""")
def held_out_targets(spark: SparkSession, sf: str) -> DataFrame:
    return prioritize.held_out_targets(candidates(spark, sf))


def _scopes(spark: SparkSession, sf: str) -> DataFrame:
    return prioritize.scoped_rankings(candidates(spark, sf), {"A": "model_a", "B": "model_b"}, {"own_a": ["model_a"], "matched": ["model_a", "model_b"]})


_PARTS = [("own_a", "A", "model_a", "model_a IS NOT NULL"), ("matched", "A", "model_a", "model_a IS NOT NULL AND model_b IS NOT NULL"), ("matched", "B", "model_b", "model_a IS NOT NULL AND model_b IS NOT NULL")]
OUTCOMES = f"{K}, target AS (SELECT gene, min_by(variant_id, ROW(heldout_p, variant_id)) AS target FROM candidates GROUP BY 1), " + ", ".join(
    f"s{i} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY gene) AS cnt FROM candidates WHERE {where}) WHERE cnt >= 6), {_rank_sql(f's{i}', f'm{i}', col)}, {_rank_sql(f's{i}', f'b{i}', None)}" for i, (_, _, col, where) in enumerate(_PARTS)
) + ", rankings AS (" + " UNION ALL ".join(
    f"SELECT '{scope}' AS scope, '{method}' AS method, m.gene, m.block, m.variant_id, CAST(m.rank AS INTEGER) AS rank, CAST(b.rank AS INTEGER) AS baseline_rank, m.cnt AS candidates FROM m{i} m JOIN b{i} b USING (gene, variant_id)" for i, (scope, method, _, _) in enumerate(_PARTS)
) + "), outcomes AS (SELECT r.*, r.rank <= 5 AS model_hit, r.baseline_rank <= 5 AS baseline_hit FROM rankings r JOIN target t ON r.gene = t.gene AND r.variant_id = t.target)"


@query("scoped_rankings", f"""WITH {OUTCOMES} SELECT scope, method, gene, variant_id, rank, baseline_rank, CASE WHEN rank <= 5 AND baseline_rank <= 5 THEN 'retained' WHEN rank <= 5 THEN 'entered' WHEN baseline_rank <= 5 THEN 'left' ELSE 'outside' END AS change FROM rankings""")
def scoped_rankings(spark: SparkSession, sf: str) -> DataFrame:
    return _scopes(spark, sf).select("scope", "method", "gene", "variant_id", "rank", "baseline_rank", C.shortlist_change(F.col("baseline_rank"), F.col("rank")).alias("change"))


@query("paired_outcomes", f"WITH {OUTCOMES} SELECT scope, method, gene, block, variant_id, rank AS target_rank, baseline_rank AS target_baseline_rank, model_hit, baseline_hit, CAST(candidates AS BIGINT) AS candidates FROM outcomes")
def paired_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return prioritize.paired_outcomes(_scopes(spark, sf))


@query("outcome_summary", f"""WITH {OUTCOMES} SELECT scope, method, CAST(count(*) AS BIGINT) AS loci, CAST(count(*) FILTER (WHERE model_hit) AS BIGINT) AS model_hits, CAST(count(*) FILTER (WHERE baseline_hit) AS BIGINT) AS baseline_hits,
    CAST(count(*) FILTER (WHERE model_hit AND NOT baseline_hit) AS BIGINT) AS into_top, CAST(count(*) FILTER (WHERE NOT model_hit AND baseline_hit) AS BIGINT) AS out_of_top, CAST(count(*) FILTER (WHERE model_hit AND baseline_hit) AS BIGINT) AS stayed_in, CAST(count(*) FILTER (WHERE NOT model_hit AND NOT baseline_hit) AS BIGINT) AS stayed_out FROM outcomes GROUP BY 1, 2""")
def outcome_summary(spark: SparkSession, sf: str) -> DataFrame:
    return prioritize.outcome_summary(prioritize.paired_outcomes(_scopes(spark, sf)))


@query("recovery_curve", f"WITH {OUTCOMES} SELECT scope, method, CAST(k AS INTEGER) AS k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 9) AS recovery, round(avg(CASE WHEN baseline_rank <= k THEN 1.0 ELSE 0.0 END), 9) AS baseline FROM outcomes, range(1, 21) t(k) GROUP BY 1, 2, 3")
def recovery_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prioritize.recovery_curve(prioritize.paired_outcomes(_scopes(spark, sf))), 9)


@query("method_pairs", f"""WITH {OUTCOMES} SELECT a.scope, a.method AS one, b.method AS two, CAST(count(*) AS BIGINT) AS loci, CAST(count(*) FILTER (WHERE a.candidates = b.candidates) AS BIGINT) AS same_candidates,
    CAST(count(*) FILTER (WHERE a.model_hit AND NOT b.model_hit) AS BIGINT) AS only_one, CAST(count(*) FILTER (WHERE NOT a.model_hit AND b.model_hit) AS BIGINT) AS only_two FROM outcomes a JOIN outcomes b ON a.scope = b.scope AND a.gene = b.gene AND a.method < b.method GROUP BY 1, 2, 3""")
def method_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return prioritize.method_pairs(prioritize.paired_outcomes(_scopes(spark, sf)))


@query("paired_recovery", f"""
    WITH {OUTCOMES}, b AS (SELECT scope, method, block, sum(model_hit::INT - baseline_hit::INT) AS d, count(*) AS n, sum(model_hit::INT) AS h, sum(baseline_hit::INT) AS base FROM outcomes GROUP BY 1, 2, 3),
    i AS (SELECT *, row_number() OVER (PARTITION BY scope, method ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY scope, method) AS m FROM b),
    d AS (SELECT scope, method, rep, {DRAW.format("'pr|' || scope || '|' || method || '|' || rep || '|' || i")} % m AS i FROM i, range(0, 50) t(rep)),
    e AS (SELECT scope, method, rep, sum(d) / sum(n)::DOUBLE AS est FROM d JOIN i USING (scope, method, i) GROUP BY 1, 2, 3), q AS (SELECT scope, method, quantile_cont(est, 0.025) AS low, quantile_cont(est, 0.975) AS high FROM e GROUP BY 1, 2),
    t AS (SELECT scope, method, CAST(sum(n) AS BIGINT) AS loci, CAST(count(*) AS BIGINT) AS blocks, sum(base) / sum(n)::DOUBLE AS baseline, sum(h) / sum(n)::DOUBLE AS model_recovery, sum(d) / sum(n)::DOUBLE AS delta FROM i GROUP BY 1, 2)
    SELECT scope, method, loci, blocks, round(baseline, 9) AS baseline, round(model_recovery, 9) AS model_recovery, round(delta, 9) AS delta, round(low, 9) AS low, round(high, 9) AS high, 'descriptive_block_bootstrap' AS status FROM t JOIN q USING (scope, method)""")
def paired_recovery(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.paired_recovery(prioritize.paired_outcomes(_scopes(spark, sf)), replicates=50, seed="pr", by=["scope", "method"]), 9)


@query("rank_audit", f"""WITH {OUTCOMES} SELECT r.scope, r.method, r.gene, CAST(count(*) AS BIGINT) AS n, min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*) AS ranks_ok, count(DISTINCT variant_id) = count(*) AS ids_ok, count(*) FILTER (WHERE variant_id = target) = 1 AS target_ok FROM rankings r JOIN target USING (gene) GROUP BY 1, 2, 3""")
def rank_audit(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.rank_audit(_scopes(spark, sf))


# --- reports -------------------------------------------------------------------------------------


@query("lead_variant", f"WITH {K} SELECT gene, min_by(variant_id, ROW(heldout_p, variant_id)) AS lead, min(heldout_p) AS p FROM candidates GROUP BY 1")
def lead_variant(spark: SparkSession, sf: str) -> DataFrame:
    return reports.lead_variant(candidates(spark, sf), ["gene"], "heldout_p", "variant_id")


@query("longest_pick", "SELECT p_brand, min_by(p_partkey, ROW(-length(p_name), p_partkey)) AS pick, CAST(max(length(p_name)) AS INTEGER) AS length FROM part GROUP BY 1")
def longest_pick(spark: SparkSession, sf: str) -> DataFrame:
    return reports.longest(table(spark, sf, "part"), ["p_brand"], F.length("p_name"), "p_partkey")


@query("carrier_eligibility", """
    WITH c AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS r, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS a FROM lineitem GROUP BY 1)
    SELECT l_suppkey, CAST(r AS BIGINT) AS ref_carriers, CAST(a AS BIGINT) AS alt_carriers, r >= 100 AND a >= 100 AS eligible FROM c""")
def carrier_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    one = F.when(F.col("l_returnflag") == "A", "0").when(F.col("l_returnflag") == "R", "1").otherwise(".")
    d = table(spark, sf, "lineitem").select("l_suppkey", C.dosage(F.concat(one, F.lit("|"), F.when(F.col("l_linestatus") == "F", "0").otherwise("1"))).alias("d"))
    return reports.carriers(d, ["l_suppkey"], F.col("d"), 100)


@query("member_counts", "SELECT word AS member, CAST(count(*) AS BIGINT) AS rows FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS word FROM part) GROUP BY 1")
def member_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.member_counts(table(spark, sf, "part").select(F.split("p_name", " ").alias("m")), "m")


@query("score_concordance", f"""WITH {K}, f AS (SELECT gene, 'raw' AS form, model_a AS x, model_b AS y FROM candidates UNION ALL SELECT gene, 'absolute', abs(model_a), abs(model_b) FROM candidates),
    s AS (SELECT gene AS scope, form, x, y FROM f UNION ALL SELECT 'all', form, x, y FROM f), {_corr_sql('s', 'scope, form', 'x', 'y')}""")
def score_concordance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.concordance(candidates(spark, sf), "model_a", "model_b", "gene"))


@query("key_sets", """
    WITH u AS (SELECT c_custkey AS k, 'customer' AS t FROM customer UNION ALL SELECT o_custkey, 'orders' FROM orders UNION ALL SELECT user_id, 'events' FROM events),
    g AS (SELECT k, string_agg(DISTINCT t, ',' ORDER BY t) AS present FROM u GROUP BY 1) SELECT present, CAST(count(*) AS BIGINT) AS keys FROM g GROUP BY 1""")
def key_sets(spark: SparkSession, sf: str) -> DataFrame:
    k = lambda name, column: table(spark, sf, name).select(F.col(column).alias("k"))
    return reports.key_sets({"customer": k("customer", "c_custkey"), "orders": k("orders", "o_custkey"), "events": k("events", "user_id")}, ["k"])


@query("genotype_groups", """
    WITH d AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 END + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS dosage, l_extendedprice AS v FROM lineitem)
    SELECT CAST(dosage AS INTEGER) AS dosage, CAST(count(v) AS BIGINT) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75 FROM d WHERE dosage IS NOT NULL GROUP BY 1""")
def genotype_groups(spark: SparkSession, sf: str) -> DataFrame:
    one = F.when(F.col("l_returnflag") == "A", "0").when(F.col("l_returnflag") == "R", "1").otherwise(".")
    d = table(spark, sf, "lineitem").select(C.dosage(F.concat(one, F.lit("|"), F.when(F.col("l_linestatus") == "F", "0").otherwise("1"))).alias("dosage"), "l_extendedprice")
    return rounded(reports.genotype_groups(d, "dosage", "l_extendedprice"))


@query("panel_table", """
    SELECT 'A' AS panel, o_orderstatus, NULL AS o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 2
    UNION ALL SELECT 'B', NULL, o_orderpriority, CAST(count(*) AS BIGINT), NULL FROM orders WHERE o_orderstatus = 'F' GROUP BY 3""")
def panel_table(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    a = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean"))
    return reports.panels({"A": a, "B": o.where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))})


@query("capped_selection", """
    WITH RECURSIVE o AS (SELECT c_nationkey AS g, c_custkey * 17 % 5003 AS pos, sha256('sel|' || c_custkey) AS h, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('sel|' || c_custkey)) AS i FROM customer),
    w AS (SELECT g, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, '' AS h, CAST(NULL AS BIGINT) AS pos, '' AS status FROM (SELECT DISTINCT g FROM o) UNION ALL
        SELECT o.g, o.i, CASE WHEN len(kept) < 8 AND len(list_filter(kept, lambda v: abs(v - o.pos) < 400)) = 0 THEN list_append(kept, o.pos) ELSE kept END, o.h, o.pos,
            CASE WHEN len(kept) >= 8 THEN 'block_full' WHEN len(list_filter(kept, lambda v: abs(v - o.pos) < 400)) > 0 THEN 'overlapping_window' ELSE 'selected' END FROM w JOIN o ON o.g = w.g AND o.i = w.i + 1)
    SELECT g AS c_nationkey, h, pos, status FROM w WHERE i > 0""")
def capped_selection(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_nationkey", C.hash_rank("sel", F.col("c_custkey")).alias("h"), (F.col("c_custkey") * 17 % 5003).alias("pos"))
    return reports.capped_selection(c, group="c_nationkey", pos="pos", order="h", apart=400, cap=8)


@query("direction_agreement", f"WITH {K} SELECT CAST(count(*) FILTER (WHERE sign(model_a) <> 0 AND sign(model_b) <> 0) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE sign(model_a) = sign(model_b) AND sign(model_a) <> 0) AS BIGINT) AS agreeing FROM candidates")
def direction_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return prioritize.direction_agreement(candidates(spark, sf), "model_a", "model_b")


@query("reference_report", f"""
    WITH s AS (SELECT CAST(item_id AS VARCHAR) AS chrom, {SEQ} AS seq FROM benchmark), v AS (SELECT CAST(l_suppkey % 60 AS VARCHAR) AS chrom, l_linenumber * 40 - 40 AS pos, substr('ACGT', CAST(l_partkey % 4 AS INTEGER) + 1, 1) AS ref FROM lineitem),
    o AS (SELECT v.chrom || ':' || pos || ':' || ref AS site, CASE WHEN seq IS NULL THEN 'mapping' WHEN pos < 1 OR pos > length(seq) THEN 'out_of_bounds' WHEN substr(seq, pos, 1) = ref THEN 'match' ELSE 'mismatch' END AS outcome FROM v LEFT JOIN s USING (chrom))
    SELECT outcome, CAST(count(*) AS BIGINT) AS rows, array_to_string(list_sort(list(site))[1:20], ';') AS examples FROM o GROUP BY 1""")
def reference_report(spark: SparkSession, sf: str) -> DataFrame:
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    text = F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACGT]", "N")
    s = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("chrom"), text.alias("seq"))
    v = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 60).cast("string").alias("chrom"), (F.col("l_linenumber") * 40 - 40).alias("pos"), F.get(bases, (F.col("l_partkey") % 4).cast("int")).alias("ref"))
    return contracts.reference_report(v, s).withColumn("examples", F.array_join("examples", ";"))


@query("chunked_context", f"""
    WITH s AS (SELECT CAST(item_id AS VARCHAR) AS chrom, {SEQ} AS seq FROM benchmark), p AS (SELECT chrom, seq, repeat('N', 16) || seq || repeat('N', 32) AS padded FROM s WHERE seq <> ''),
    v AS (SELECT CAST(l_suppkey % 60 AS VARCHAR) AS chrom, CAST(l_orderkey % 600 + 1 AS BIGINT) AS pos, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT chrom, pos, CAST(n AS BIGINT) AS n, CASE WHEN pos <= length(seq) THEN substr(padded, pos, 33) END AS padded, CASE WHEN pos > 16 AND pos + 16 <= length(seq) THEN substr(seq, pos - 16, 33) END AS inner_window,
        CASE WHEN pos <= length(seq) THEN substr(substr(padded, pos, 33), 1, 16) || 'T' || substr(substr(padded, pos, 33), 18) END AS alternative
    FROM v LEFT JOIN p USING (chrom)""")
def chunked_context(spark: SparkSession, sf: str) -> DataFrame:
    """Windows cut from a store of chunks that are little wider than the windows."""
    text = F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACGT]", "N")
    store = sequence_store(table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("chrom"), text.alias("seq")), width=40, halo=33)
    v = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 60).cast("string").alias("chrom"), (F.col("l_orderkey") % 600 + 1).alias("pos")).agg(F.count("*").alias("n"))
    seq, at = F.col("chunk_seq"), (F.col("pos") - F.col("chunk_start")).cast("int")
    inside = at <= F.length(seq)
    padded = F.when(inside, C.padded_context(seq, at, 33, 16))
    return beside(v, store, width=40).select("chrom", "pos", "n", padded.alias("padded"), F.when(inside, C.inner_context(seq, at, 33, 16)).alias("inner_window"), C.substituted(padded, F.lit(16), F.lit("T")).alias("alternative"))


@query("locus_screen", """
    WITH n AS (SELECT c_nationkey AS k, count(*) AS c, min(c_acctbal) AS lo, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS m FROM customer GROUP BY 1)
    SELECT k, CASE WHEN k % 7 = 0 THEN 'overlapping_window' WHEN c % 12 < 6 THEN 'too_few_common_snps' WHEN k % 5 = 1 THEN 'expression_nonfinite' WHEN lo IS NULL THEN 'invalid_association' WHEN m % 3 = 0 THEN 'no_discovery_cis_signal' WHEN m < 6 THEN 'fewer_than_six_linked' ELSE 'selected' END AS status FROM n""")
def locus_screen(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("c"), F.min("c_acctbal").alias("lo"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("m"))
    k = F.col("k")
    flags = n.withColumns({"overlapping": k % 7 == 0, "common_snps": F.col("c") % 12, "expression_finite": k % 5 != 1, "association_valid": F.col("lo").isNotNull(), "cis_signal": F.col("m") % 3 != 0, "linked_snps": F.col("m")})
    return flags.select("k", prioritize.locus_screen(flags).alias("status"))


@query("lead_r2", """
    WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), l AS (SELECT label, min_by(v, vec_id) AS lead FROM e GROUP BY 1),
    p AS (SELECT label, vec_id, unnest(v) AS x, unnest(lead) AS y FROM e JOIN l USING (label)) SELECT label, vec_id, round(corr(x, y) * corr(x, y), 6) AS r2 FROM p GROUP BY 1, 2""")
def lead_r2(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(ld.lead_r2(e, e.groupBy("label").agg(F.min_by("v", "vec_id").alias("lead")), by="label", key="vec_id", vector="v"))


@query("worked_locus", f"WITH {K}, s AS (SELECT * FROM candidates WHERE model_b IS NOT NULL), {_rank_sql('s', 'r', 'model_b')} SELECT gene, variant_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5 AND gene = (SELECT min(gene) FROM r)")
def worked_locus(spark: SparkSession, sf: str) -> DataFrame:
    return reports.worked_locus(prioritize.rank_candidates(candidates(spark, sf).where("model_b IS NOT NULL"), "model_b")).select("gene", "variant_id", "rank")


def _horner(part: str, r: str) -> str:
    def poly(c: tuple[float, ...]) -> str:
        out = f"{c[0]!r}::DOUBLE"
        for x in c[1:]:
            out = f"({out} * {r} + {x!r}::DOUBLE)"
        return out

    return "({} / {})".format(*map(poly, C.NORMAL_QUANTILE[part]))


def _quantile_sql(p: str) -> str:
    """The normal quantile of a column in SQL."""
    far = f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {_horner('middle', f'(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))')} ELSE sign({p} - 0.5) * CASE WHEN {far} <= 5 THEN {_horner('shoulder', f'({far} - 1.6::DOUBLE)')} ELSE {_horner('tail', f'({far} - 5)')} END END"


@query("normal_scores", f"""
    WITH r AS (SELECT s_suppkey, s_nationkey, s_acctbal, (rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY s_nationkey) AS p FROM supplier)
    SELECT s_suppkey, s_nationkey, s_acctbal, round({_quantile_sql('p')}, 9) AS normal_score FROM r""")
def normal_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.normal_scores(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_acctbal", ["s_nationkey"])
    return out.withColumn("normal_score", F.round("normal_score", 9))


@query("association_unrelated", f"""
    WITH e AS (SELECT 'L' || label AS gene, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
    y AS (SELECT gene, unnest(range(0, 64)) AS i, unnest(min_by(v, vec_id)) AS y FROM e GROUP BY gene),
    r AS (SELECT gene, i, (rank() OVER (PARTITION BY gene ORDER BY y) + (count(*) OVER (PARTITION BY gene, y) - 1) / 2.0::DOUBLE - 0.5) / 64 AS p FROM y),
    q AS (SELECT gene, i, {_quantile_sql('p')} AS y FROM r),
    g AS (SELECT gene, vec_id, unnest(range(0, 64)) AS i, unnest(v) AS x FROM e),
    s AS (SELECT gene, vec_id, covar_pop(x, y) * 64 AS xy, var_pop(x) * 64 AS xx, var_pop(y) * 64 AS yy FROM g JOIN q USING (gene, i) GROUP BY 1, 2)
    SELECT gene, vec_id AS variant_id, round(xy / xx, 6) AS beta, round(sqrt((yy - xy * xy / xx) / 62 / xx), 6) AS se FROM s""")
def association_unrelated(spark: SparkSession, sf: str) -> DataFrame:
    """Samples without kinship: the mixed model is a plain regression then, which SQL has."""
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("L"), F.col("label")).alias("gene"), F.col("vec_id").alias("variant_id"), F.col("embedding").cast("array<double>").alias("dosages"))
    i = F.sequence(F.lit(0), F.lit(63))
    own = spark.range(1).select(F.explode(i).alias("i"), F.lit(1.0).alias("k")).withColumn("j", F.col("i"))
    y = e.groupBy("gene").agg(F.min_by("dosages", "variant_id").alias("values"))
    return rounded(assoc.association_scan(e, y, own).select("gene", "variant_id", "beta", "se"))


@query("association_covariates", f"""
    WITH e AS (SELECT 'L' || label AS gene, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
    y AS (SELECT gene, unnest(range(0, 64)) AS i, unnest(min_by(v, vec_id)) AS y FROM e GROUP BY gene),
    r AS (SELECT gene, i, (rank() OVER (PARTITION BY gene ORDER BY y) + (count(*) OVER (PARTITION BY gene, y) - 1) / 2.0::DOUBLE - 0.5) / 64 AS p FROM y),
    q AS (SELECT gene, i, {_quantile_sql('p')} AS y, CAST(i * 37 % 64 AS DOUBLE) AS c FROM r),
    g AS (SELECT gene, vec_id, unnest(range(0, 64)) AS i, unnest(v) AS x FROM e),
    s AS (
        SELECT gene, vec_id, covar_pop(x, y) * 64 AS xy, covar_pop(x, c) * 64 AS xc, covar_pop(y, c) * 64 AS yc, var_pop(x) * 64 AS xx, var_pop(y) * 64 AS yy, var_pop(c) * 64 AS cc FROM g JOIN q USING (gene, i) GROUP BY 1, 2
    ), f AS (SELECT gene, vec_id, xy - xc * yc / cc AS xy, xx - xc * xc / cc AS xx, yy - yc * yc / cc AS yy FROM s)
    SELECT gene, vec_id AS variant_id, round(xy / xx, 6) AS beta, round(sqrt((yy - xy * xy / xx) / 61 / xx), 6) AS se FROM f""")
def association_covariates(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a covariate, which is regressed out of both sides (one of two, which tells nothing new, doesn't count)."""
    import numpy as np

    e = table(spark, sf, "embeddings").select(F.concat(F.lit("L"), F.col("label")).alias("gene"), F.col("vec_id").alias("variant_id"), F.col("embedding").cast("array<double>").alias("dosages"))
    own = spark.range(64).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(1.0).alias("k"))
    c = np.arange(64) * 37 % 64
    y = e.groupBy("gene").agg(F.min_by("dosages", "variant_id").alias("values"))
    return rounded(assoc.association_scan(e, y, own, covariates=np.column_stack([c, 2.0 * c + 1])).select("gene", "variant_id", "beta", "se"))
