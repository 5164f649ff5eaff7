"""Column builders over variants, sequences, scores and arrays. All stay inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The labels that results carry, and the limits of frequency classes.
ORIENTATIONS = ("alt_minor", "ref_minor", "frequency_tie")
FREQUENCY_CLASSES = ("rare", "low_frequency", "common")
FREQUENCY_LIMITS = (0.01, 0.05)
GENE_CONTEXTS = ("coding_cds", "exonic_non_cds", "other_genic", "intergenic")
LOCUS_CONTEXTS = ("CDS", "exon_nonCDS", "genic", "intergenic")
MATCHES = ("exact_biallelic_match", "no_VCF_record_at_position", "reference_allele_mismatch", "ALT_or_biallelic_definition_mismatch")
SHORTLIST = ("entered", "left", "retained", "outside")
COVERAGE = ("covered", "CDS_masked", "outside_windows")
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes"), ("false", "0", "no")
BASES, COMPLEMENTS = "ACGTN", "TGCAN"
IUPAC, IUPAC_COMPLEMENTS = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"

# --- numbers -------------------------------------------------------------------------------------


def finite(text: Column) -> Column:
    """A finite double parsed from a string or number, else null (text, NaN and infinities too)."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def filled(x: Column) -> Column:
    """Null and NaN as 0."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(None)), F.lit(0.0))


def clamp_unit(x: Column) -> Column:
    """Into [0, 1]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def near(observed: Column, expected: Column, *, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    """|observed - expected| <= atol + rtol |expected|; not symmetric."""
    return F.abs(observed - expected) <= F.lit(atol) + F.lit(rtol) * F.abs(expected)


def close(a: Column, b: Column, *, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    """Symmetric: within rel of the larger magnitude, or within absolute."""
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def neg_log10(p: Column) -> Column:
    return F.when(p > 0, -F.log10(p))


#: Wichura's rational approximations of the normal quantile (AS 241, 1988): for the middle, the
#: shoulders and the tails, numerator and denominator from the highest power down.
NORMAL_QUANTILE = {
    "middle": (
        (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
        (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0),
    ),
    "shoulder": (
        (7.7454501427834140764e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
        (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
    ),
    "tail": (
        (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720),
        (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
    ),
}


def normal_quantile(p: Column) -> Column:
    """The quantile of the standard normal distribution, to 16 digits; null outside (0, 1)."""
    def ratio(part: str, r: Column) -> Column:
        ends = []
        for powers in NORMAL_QUANTILE[part]:
            total = F.lit(powers[0])
            for c in powers[1:]:
                total = total * r + F.lit(c)
            ends.append(total)
        return ends[0] / ends[1]

    q = p - 0.5
    far = F.sqrt(-F.ln(F.least(p, 1 - p)))
    outer = F.signum(q) * F.when(far <= 5, ratio("shoulder", far - 1.6)).otherwise(ratio("tail", far - 5))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * ratio("middle", 0.180625 - q * q)).otherwise(outer))


def distance_decay(distance: Column, scale: float = 2000.0) -> Column:
    return F.exp(-F.abs(distance) / F.lit(scale))


def same_sign(a: Column, b: Column) -> Column:
    return F.signum(a) == F.signum(b)


def consistent_pair(a: Column, b: Column, least: float = 0.5) -> Column:
    """Two assay differences of at least ``least`` in magnitude and of one sign."""
    return (F.abs(a) >= least) & (F.abs(b) >= least) & same_sign(a, b)


def affine(x: Column, slope: float, offset: float = 0.0) -> Column:
    return x * F.lit(slope) + F.lit(offset)


def parse_bool(text: Column, *, strict: bool = False) -> Column:
    """true/1/yes and false/0/no (strict: true and false alone); anything else is null."""
    x = F.lower(F.trim(text.cast("string")))
    yes, no = (TRUE_WORDS[:1], FALSE_WORDS[:1]) if strict else (TRUE_WORDS, FALSE_WORDS)
    return F.when(x.isin(*yes), True).when(x.isin(*no), False)


# --- variants ------------------------------------------------------------------------------------


def variant_id(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def split_variant_id(variant: Column) -> Column:
    """Struct of chrom, pos, ref, alt."""
    x = F.split(variant, ":")
    return F.struct(F.get(x, F.lit(0)).alias("chrom"), F.get(x, F.lit(1)).try_cast("long").alias("pos"), F.get(x, F.lit(2)).alias("ref"), F.get(x, F.lit(3)).alias("alt"))


def strip_prefix(name: Column, prefix: str = "X") -> Column:
    return F.regexp_replace(name, f"^{prefix}", "")


def map_chromosome(chrom: Column, names: Mapping[str, str]) -> Column:
    """The mapped name; null where it is unknown, which contracts report."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), chrom.cast("string"))


def orient(ref: Column, alt: Column, af_alt: Column, score: Column) -> Column:
    """Struct: minor_allele, major_allele, maf, orientation, flipped, paper_oriented, minor_vs_major.

    The score is of alt against ref. Where alt is the minor allele it stays; where ref is, it changes
    sign; at a frequency of exactly one half there is no minor allele, and only the score that the
    original convention takes as it is remains.
    """
    minor, major = af_alt < 0.5, af_alt > 0.5
    return F.struct(
        F.when(minor, alt).when(major, ref).alias("minor_allele"),
        F.when(minor, ref).when(major, alt).alias("major_allele"),
        F.least(af_alt, 1 - af_alt).alias("maf"),
        F.when(minor, ORIENTATIONS[0]).when(major, ORIENTATIONS[1]).when(af_alt.isNotNull(), ORIENTATIONS[2]).alias("orientation"),
        major.alias("flipped"),
        F.when(major, -score).otherwise(score).alias("paper_oriented"),
        F.when(minor, score).when(major, -score).alias("minor_vs_major"),
    )


def frequency_class(maf: Column) -> Column:
    return F.when(maf < FREQUENCY_LIMITS[0], FREQUENCY_CLASSES[0]).when(maf < FREQUENCY_LIMITS[1], FREQUENCY_CLASSES[1]).when(maf.isNotNull(), FREQUENCY_CLASSES[2])


def substitution_class(ref: Column, alt: Column) -> Column:
    """``C>A`` and so on, with purine references on the other strand."""
    purine = ref.isin("A", "G")
    other = lambda x: F.translate(x, "ACGT", "TGCA")
    return F.concat(F.when(purine, other(ref)).otherwise(ref), F.lit(">"), F.when(purine, other(alt)).otherwise(alt))


def physical_bin(chrom: Column, pos: Column, width: int) -> Column:
    return F.concat(chrom.cast("string"), F.lit(":"), (F.floor((pos - 1) / F.lit(width)) + 1).cast("string"))


def tss(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "-", end).otherwise(start)


def tss_distance(pos: Column, site: Column, strand: Column) -> Column:
    """Signed along the strand: negative upstream."""
    return (pos - site) * F.when(strand == "-", -1).otherwise(1)


def gene_context(cds: Column, exon: Column, gene: Column) -> Column:
    return F.when(cds, GENE_CONTEXTS[0]).when(exon, GENE_CONTEXTS[1]).when(gene, GENE_CONTEXTS[2]).otherwise(GENE_CONTEXTS[3])


def locus_context(cds: Column, exon: Column, gene: Column) -> Column:
    """The second vocabulary, in which exons outside the coding sequence are named for that."""
    return F.when(cds, LOCUS_CONTEXTS[0]).when(exon, LOCUS_CONTEXTS[1]).when(gene, LOCUS_CONTEXTS[2]).otherwise(LOCUS_CONTEXTS[3])


def edge_padded(pos: Column, length: Column, window: int) -> Column:
    """Whether a window around ``pos`` (1-based) reaches beyond either end of the contig."""
    half = window // 2
    return (pos <= half) | (pos > length - (window - half - 1))


def left_edge_padded(pos: Column, window: int = 512) -> Column:
    """The same for the left end alone, where the length of the contig isn't known."""
    return pos <= window // 2


def dosage(genotype: Column) -> Column:
    """ALT copies of a diploid call; null if any allele is missing or not 0 or 1."""
    a = F.split(F.get(F.split(genotype, ":"), F.lit(0)), r"[|/]")
    whole = (F.size(a) == 2) & F.forall(a, lambda x: x.isin("0", "1"))
    return F.when(whole, F.get(a, F.lit(0)).try_cast("int") + F.get(a, F.lit(1)).try_cast("int"))


def match_category(found: Column, ref: Column, alt: Column, seen_ref: Column, seen_alt: Column) -> Column:
    return F.when(~F.coalesce(found, F.lit(False)), MATCHES[1]).when(ref != seen_ref, MATCHES[2]).when(alt != seen_alt, MATCHES[3]).otherwise(MATCHES[0])


def shortlist_change(baseline_rank: Column, rank: Column, k: int = 5) -> Column:
    return F.when((rank <= k) & (baseline_rank <= k), SHORTLIST[2]).when(rank <= k, SHORTLIST[0]).when(baseline_rank <= k, SHORTLIST[1]).otherwise(SHORTLIST[3])


def coverage_status(covered: Column, masked: Column) -> Column:
    return F.when(covered & ~masked, COVERAGE[0]).when(covered, COVERAGE[1]).otherwise(COVERAGE[2])


def regulatory_window(start: Column, end: Column, strand: Column, *, out: int = 5000, into: int = 1200) -> Column:
    """Struct of promoter and terminator windows (1-based, inclusive), swapped on the minus strand."""
    left = F.struct((start - out).alias("start"), (start + into - 1).alias("end"))
    right = F.struct((end - into + 1).alias("start"), (end + out).alias("end"))
    minus = strand == "-"
    return F.struct(F.when(minus, right).otherwise(left).alias("promoter"), F.when(minus, left).otherwise(right).alias("terminator"), minus.alias("reversed"))


# --- hashes --------------------------------------------------------------------------------------


def hash_rank(namespace: str, *key: Column) -> Column:
    """64 hex digits whose order is the order of the hash as a number."""
    return F.sha2(F.concat_ws("|", F.lit(namespace), *[k.cast("string") for k in key]), 256)


def hash_fraction(text: Column, parts: int = 10) -> Column:
    """The first 32 bits of a SHA-256, modulo ``parts``."""
    return F.conv(F.substring(F.sha2(text.cast("string"), 256), 1, 8), 16, 10).cast("long") % parts


def discovery_side(text: Column, below: int = 7) -> Column:
    """A 70/30 split by hash: discovery or heldout."""
    return F.when(hash_fraction(text) < below, "discovery").otherwise("heldout")


def hash_draw(seed: str, bound: Column, *counters: Column) -> Column:
    """A draw from 0 to bound - 1 that depends on seed and counters alone, not on partitions."""
    text = F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in counters])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % bound


def derived_seed(base: int, label: Column) -> Column:
    """A 32-bit seed from a base seed and a label: the first 64 bits of a SHA-256, modulo 2**32."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(base)), label.cast("string")), 256), 9, 8), 16, 10).cast("long")


def cache_key(sequence: Column, spec: Mapping[str, object]) -> Column:
    return F.sha2(F.concat(sequence, F.lit(json.dumps(dict(spec), sort_keys=True))), 256)


# --- sequences -----------------------------------------------------------------------------------


def reverse_complement(seq: Column) -> Column:
    """Of A, C, G, T and N, in upper case."""
    return F.translate(F.reverse(F.upper(seq)), BASES, COMPLEMENTS)


def reverse_complement_iupac(seq: Column) -> Column:
    """Of upper-case IUPAC codes; characters beyond those stay."""
    return F.translate(F.reverse(seq), IUPAC, IUPAC_COMPLEMENTS)


def padded_context(seq: Column, pos: Column, window: int, target: int) -> Column:
    """``window`` bases with the base at ``pos`` (1-based) at index ``target``, N beyond the ends."""
    start = pos - target  # 1-based, may be below 1
    left = F.least(F.greatest(F.lit(0), 1 - start), F.lit(window)).cast("int")
    inside = F.substring(seq, F.greatest(F.lit(1), start).cast("int"), F.greatest(F.lit(0), window - left).cast("int"))
    return F.rpad(F.concat(F.repeat(F.lit("N"), left), inside), window, "N")


def inner_context(seq: Column, pos: Column, window: int, target: int | None = None) -> Column:
    """The same without padding: null if the window reaches beyond an end. The default target is the
    base before the middle."""
    at = window // 2 - 1 if target is None else target
    start = pos - at
    return F.when((start >= 1) & (start + window - 1 <= F.length(seq)), F.substring(seq, start.cast("int"), F.lit(window)))


def reference_matches(seq: Column, pos: Column, ref: Column) -> Column:
    inside = (pos >= 1) & (pos <= F.length(seq))
    return F.coalesce(inside & (F.upper(F.substring(seq, F.greatest(F.lit(1), pos).cast("int"), F.lit(1))) == F.upper(ref)), F.lit(False))


def substituted(seq: Column, index: Column, base: Column) -> Column:
    """``seq`` with the base at 0-based ``index`` replaced."""
    return F.overlay(seq, base, (index + 1).cast("int"), F.lit(1))


def difference_position(a: Column, b: Column) -> Column:
    """Where two strings of equal length differ (1-based), if in exactly one place; else null."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when((F.length(a) == F.length(b)) & (F.size(at) == 1), F.get(at, F.lit(0)))


def masked(seq: Column, intervals: Column) -> Column:
    """N over each of an array of intervals (start and end, 1-based, inclusive)."""
    return F.aggregate(
        intervals, seq,
        lambda s, x: F.overlay(s, F.repeat(F.lit("N"), (x["end"] - x["start"] + 1).cast("int")), x["start"].cast("int"), (x["end"] - x["start"] + 1).cast("int")),
    )


def oligo_hit(seq: Column, oligo: Column, *, strict: bool = False) -> Column:
    """Struct of strand and 1-based start of an oligo that one strand alone holds exactly once (strict:
    once in all); overlapping hits count. Null otherwise."""
    def hits(probe: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(seq) - F.length(probe) + 1))
        return F.filter(starts, lambda i: F.substring(seq, i, F.length(probe)) == probe)

    plus, minus = hits(oligo), hits(reverse_complement_iupac(oligo))
    one, other = F.size(plus) == 1, F.size(minus) == 1
    ok = F.size(plus) + F.size(minus) == 1 if strict else one != other
    return F.when(ok, F.struct(F.when(one, "+").otherwise("-").alias("strand"), F.when(one, F.get(plus, F.lit(0))).otherwise(F.get(minus, F.lit(0))).alias("start")))


#: Token numbers of bases, of padding, the mask and anything else.
TOKENS = {"A": 3, "C": 4, "G": 5, "T": 6}
PAD, MASK, UNKNOWN = 0, 1, 2


def tokens(seq: Column, target: Column | None = None) -> Column:
    """Token numbers of a sequence, with the one at 0-based ``target`` masked."""
    base = F.create_map(*[F.lit(x) for kv in TOKENS.items() for x in kv])
    plain = F.transform(F.split(F.upper(seq), ""), lambda c: F.coalesce(F.try_element_at(base, c), F.lit(UNKNOWN)))
    return plain if target is None else F.transform(plain, lambda v, i: F.when(i == target, MASK).otherwise(v))


def one_hot(seq: Column) -> Column:
    """An array of four 0/1 for each base; other letters are all zeros."""
    return F.transform(F.split(F.upper(seq), ""), lambda c: F.array(*[F.when(c == b, 1.0).otherwise(0.0) for b in "ACGT"]))


# --- model outputs -------------------------------------------------------------------------------


def log_softmax(logits: Column) -> Column:
    """Log probabilities of an array of logits."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.transform(logits, lambda x: x - top - F.ln(total))


def log_ratio(log_p: Column, ref: Column, alt: Column) -> Column:
    """log p(alt) - log p(ref) from an array in the order A, C, G, T."""
    at = lambda base: F.instr(F.lit("ACGT"), base) - 1
    return F.get(log_p, at(alt)) - F.get(log_p, at(ref))


def distribution_faults(log_p: Column, logits: Column, ref: Column, alt: Column) -> Column:
    """What is wrong with the log probabilities of a site, or null: they must add up to 1 to a millionth, and the
    log ratio of alt to ref must be the difference of their logits to a hundred-thousandth."""
    total = F.aggregate(F.transform(log_p, F.exp), F.lit(0.0), lambda a, x: a + x)
    gap = F.abs(log_ratio(log_p, ref, alt) - log_ratio(logits, ref, alt))
    return F.when(~F.coalesce(F.abs(total - 1) <= 1e-6, F.lit(False)), "probabilities do not add up to 1").when(~F.coalesce(gap < 1e-5, F.lit(False)), "log ratio is not the difference of logits")


def harmonised(score: Column) -> Column:
    """A score of ref against alt as one of alt against ref; null unless it is finite."""
    return -finite(score)


def strand_summary(forward: Column, reverse: Column, flipped: Column) -> Column:
    """Struct: mean of the strands, its magnitude, its value as minor against major, strand difference."""
    mean = (forward + reverse) / 2
    return F.struct(mean.alias("score"), F.abs(mean).alias("magnitude"), F.when(flipped, -mean).otherwise(mean).alias("minor_vs_major"), F.abs(forward - reverse).alias("strand_difference"))


def transfer_magnitude(ref: Column, alt: Column) -> Column:
    """Mean |log1p(alt) - log1p(ref)| over two arrays of bins."""
    total = F.aggregate(F.zip_with(ref, alt, lambda a, b: F.abs(F.log1p(b) - F.log1p(a))), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(ref))


def central(values: Column, n: int) -> Column:
    """The n middle entries of an array; null if there are fewer, if the rest can't be halved, or if any
    is negative or not finite."""
    rest = F.size(values) - n
    out = F.slice(values, (F.greatest(rest, F.lit(0)) / 2).cast("int") + 1, F.lit(n))
    fine = F.forall(out, lambda x: (x >= 0) & (x < float("inf")) & ~F.isnan(x))
    return F.when((rest >= 0) & (rest % 2 == 0) & fine, out)


# --- text ----------------------------------------------------------------------------------------


def attributes(text: Column) -> Column:
    """A map from ``k=v;k=v``, percent-decoded; a value may hold further equal signs."""
    items = F.filter(F.split(text, ";"), lambda x: x.contains("="))
    decode = lambda x: F.url_decode(F.regexp_replace(x, r"\+", "%2B"))
    pairs = F.transform(items, lambda x: F.struct(decode(F.trim(F.substring_index(x, "=", 1))).alias("k"), decode(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")))
    return F.map_from_entries(pairs)


def gene_name(text: Column) -> Column:
    """A locus name from an attribute column."""
    found = F.regexp_extract(text, r"(?:locus_tag|Name)=(AT[1-5]G\d{5})", 1)
    return F.when(found != "", found)


def transcript_fields(text: Column) -> Column:
    """Struct of a transcript's id and the gene it belongs to, from the attribute column of its row."""
    part = lambda key: F.nullif(F.regexp_extract(text, f"(?:^|;){key}=([^;]+)", 1), F.lit(""))
    return F.struct(part("ID").alias("id"), part("Parent").alias("parent"))


def reasons(*named: tuple[Column, str]) -> Column:
    """The names of all conditions that hold, joined by semicolons."""
    return F.concat_ws(";", *[F.when(c, name) for c, name in named])


def first_reason(*named: tuple[Column, str], otherwise: str = "ok") -> Column:
    out = F
    for c, name in named:
        out = out.when(c, name)
    return out.otherwise(otherwise)
