"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions alone.

A line counts as boilerplate when it stands on at least ``min_sites`` distinct sites, in more than one
distinct text (the lines of a document that is merely copied are none). One aggregation by line hash merges a
HyperLogLog sketch of the sites a line; where the estimate is near the threshold, an exact distinct count
decides, so the outcome is that of exact counting.

Lines are compared without spaces at their ends, by a 64-bit hash; lines under ``min_chars`` characters
are never boilerplate. Defined cases: a null text stays null with 0 lines; an empty text has one empty
line; a null site is no site; a document whose lines are all boilerplate stays whole (it is a copy, which
document-level removal is for). All other boilerplate lines go, in every document. Very long texts are split
whole, line by line; an empty table gives no rows. Repeated rows are kept as rows; columns besides the text
pass through, but for those with the names of the results, which these replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociscale.llm.common import aside, cut

#: log2 of a sketch's slots; the relative standard error is 1.04 / sqrt(2**8), 6.5 %.
LOG_SLOTS = 8
#: Estimates within this share of the threshold are counted exactly: four standard errors.
NEAR = 0.26
#: Lines near the threshold up to which these are broadcast (8 bytes each).
BROADCAST_LINES = 500_000
#: Into how many parts the documents of one text are dealt where many hashes are joined.
SALTS = 32


def line_keys(text: Column, min_chars: int) -> Column:
    """A hash for each line in order; null for lines that are too short."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(F.length(F.trim(x)) >= min_chars, F.xxhash64(F.trim(x))))


def boilerplate(docs: DataFrame, *, min_sites: int = 8, min_chars: int = 16, text: str = "text", site: str = "source") -> DataFrame:
    """The hashes (``line``) of all boilerplate lines, materialised."""
    seen = docs.select(
        F.xxhash64(F.col(site).cast("string")).alias("hash"),
        F.col(site).isNotNull().alias("has"),
        F.xxhash64(F.col(text)).alias("body"),
        F.explode(F.array_distinct(line_keys(F.col(text), min_chars))).alias("line"),
    ).where("line IS NOT NULL")
    seen = seen.select("line", "body", F.when(F.col("has"), F.col("hash")).alias("site"))
    several = F.min("body") != F.max("body")
    estimates = seen.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_SLOTS)).alias("sites"), several.alias("several"))
    spread = F.col("sites")
    candidates = cut(estimates.where(F.col("several") & (spread >= min_sites * (1 - NEAR))).select("line", (spread > min_sites * (1 + NEAR)).alias("sure")))
    unsure = candidates.where("NOT sure").select("line")
    # few lines are sent to where the others are; many meet them once each line and site is one row
    near = seen.join(F.broadcast(unsure), "line", "left_semi") if unsure.count() <= BROADCAST_LINES else seen.select("line", "site").distinct().join(unsure, "line", "left_semi")
    exact = near.groupBy("line").agg(F.countDistinct("site").alias("sites"))
    return cut(candidates.where("sure").select("line").unionByName(exact.where(F.col("sites") >= min_sites).select("line")))


def remove_boilerplate(docs: DataFrame, *, min_sites: int = 8, min_chars: int = 16, inline: int = 5_000, text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` without boilerplate lines, with n_lines (before) and n_removed at the end.

    Up to ``inline`` boilerplate hashes travel inside the plan as one hash set. With more, the
    hashes are joined to the documents' lines and come back as one array for each distinct text; the
    documents of a text, and those without one, are dealt to that join in parts. The results are the same.
    """
    docs, (text, site), back = aside(docs, text, site)
    found = boilerplate(docs, min_sites=min_sites, min_chars=min_chars, text=text, site=site)
    body = F.col(f"`{text}`")
    lines = F.split(body, "\n", -1)
    rows = [r[0] for r in found.limit(inline + 1).collect()]
    if len(rows) <= inline:
        marked = docs.select("*", lines.alias("__lines"))
        if rows:
            marked = marked.withColumn("__kept", F.filter("__lines", lambda x: ~((F.length(F.trim(x)) >= min_chars) & F.xxhash64(F.trim(x)).isin(rows))))
        else:
            marked = marked.withColumn("__kept", F.col("__lines"))
    else:
        own = docs.select(F.xxhash64(body).alias("__body"), F.explode(F.array_distinct(line_keys(body, min_chars))).alias("line"))
        gone = own.join(found, "line").groupBy("__body").agg(F.collect_set("line").alias("__gone"))
        part = F.monotonically_increasing_id()
        salted = gone.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        dealt = docs.withColumns({"__body": F.when(body.isNull(), -part).otherwise(F.xxhash64(body)), "__salt": F.when(body.isNull(), F.lit(-1)).otherwise(F.pmod(part, F.lit(SALTS)))})
        marked = dealt.join(salted, ["__body", "__salt"], "left").select(*[f"`{c}`" for c in docs.columns], lines.alias("__lines"), "__gone")
        hit = lambda x: F.coalesce((F.length(F.trim(x)) >= min_chars) & F.array_contains("__gone", F.xxhash64(F.trim(x))), F.lit(False))
        marked = marked.withColumn("__kept", F.filter("__lines", lambda x: ~hit(x)))
    whole = ~F.exists("__kept", lambda x: F.length(F.trim(x)) > 0) | (F.size("__kept") == F.size("__lines"))
    marked = marked.withColumn("__out", F.when(whole, F.col("__lines")).otherwise(F.col("__kept")))
    n = F.coalesce(F.size("__lines"), F.lit(0))
    columns = [F.when(F.size("__out") == F.size("__lines"), body).otherwise(F.array_join("__out", "\n")).alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return back(marked.select(*columns, F.when(body.isNull(), 0).otherwise(n).alias("n_lines"), F.when(body.isNull(), 0).otherwise(n - F.size("__out")).alias("n_removed")))
