"""The four variant callers as aggregate plans.

All of them share one shape: reads laid out by neighbourhood, expanded in place, counted per
``(contig, locus, ..., allele)`` with map-side combining, then judged per locus over the few alleles
that are left. No group of reads is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.functions.genotypes import ALT, NO_CALL, OTHER_ALT, REF, call_array, classify_copies, classify_pair
from lociforge.functions.quality import LOG_UNIT, log_copies, log_hit, log_miss
from lociforge.operators.filters import LOCUS_KEYS, MIN_MAPQ, evidence, filter_pileups, min_base_quality, passing
from lociforge.operators.pileup import (
    base_allele_counts, base_reads, by_neighbourhood, elements, is_single_base, on_loci, reference_base,
    restrict,
)
from lociforge.sources.fasta import with_reference_base

# Option defaults of the callers and their sample names.
THRESHOLD = 8
THRESHOLD_NORMAL, THRESHOLD_TUMOR = 4, 10
MIN_BASE_QUALITY, MIN_COVERAGE, TOP_PERCENT = 20, 10, 90
SOMATIC_SAMPLE, SIMPLE_SAMPLE = "somatic", "sample"
TUMOR, NORMAL = 1, 2

_LOCUS = ["contig", "locus"]
_SAMPLE_LOCUS = ["contig", "locus", "sample"]


def _expanded(reads: DataFrame, cluster: bool, loci: DataFrame | None = None) -> DataFrame:
    chosen = restrict(reads, loci)
    return elements(by_neighbourhood(chosen) if cluster else chosen)


def _genotypes(rows: DataFrame, *extra: str) -> DataFrame:
    """Explode ``calls`` (array of alt, alleles, n, n_fwd) into genotype rows."""
    return rows.select(
        "contig", F.col("locus").alias("pos"), "ref", "sample", "depth", "depth_fwd", *extra,
        F.explode("calls").alias("c"),
    ).select(
        "contig", "pos", "ref", F.col("c.alt").alias("alt"), "sample", F.col("c.alleles").alias("alleles"),
        F.col("depth").cast("int").alias("read_depth"),
        F.col("c.n").cast("int").alias("alt_read_depth"),
        F.col("depth_fwd").cast("int").alias("fwd_reads"),
        *extra,
    )


def _call(allele: Column, *names: str) -> Column:
    return F.struct(
        allele["allele"].alias("alt"), call_array(*names).alias("alleles"), allele["n"].alias("n")
    )


def _by_count(struct_fields: list[Column], keep: Column) -> Column:
    """Kept alleles, most frequent first, ties by base. Only single bases, so a short list."""
    return F.array_sort(F.collect_list(F.when(keep, F.struct(*struct_fields))))


def threshold_calls(
    reads: DataFrame,
    threshold: int = THRESHOLD,
    emit_ref: bool = False,
    emit_no_call: bool = False,
    loci: DataFrame | None = None,
    cluster: bool = True,
) -> DataFrame:
    """Call alleles whose integer percent of all elements is above ``threshold``, per sample.

    Reads without an MD tag are left out: MD supplies the reference base.
    """
    with_md = reads.filter(F.col("md").isNotNull())
    counts = on_loci(base_allele_counts(_expanded(with_md, cluster, loci)), loci)
    return threshold_calls_from(counts, threshold, emit_ref, emit_no_call)


def threshold_calls_from(
    counts: DataFrame, threshold: int = THRESHOLD, emit_ref: bool = False, emit_no_call: bool = False
) -> DataFrame:
    """As :func:`threshold_calls`, from single-base allele counts."""
    ranked = _by_count(
        [(-F.col("n")).alias("order"), F.col("allele"), F.col("n")], F.col("allele").isNotNull()
    )
    per_locus = counts.groupBy(*_SAMPLE_LOCUS).agg(
        F.sum("n").alias("depth"),
        F.sum("n_fwd").alias("depth_fwd"),
        F.max("ref_base").alias("ref"),
        ranked.alias("ranked"),
    )
    passing = per_locus.withColumn(
        "top", F.expr(f"slice(filter(ranked, a -> a.n * 100 div depth > {int(threshold)}), 1, 2)")
    ).withColumn("n_top", F.size("top"))
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    ref_row = F.struct(F.col("ref").alias("allele"), F.lit(None).cast("bigint").alias("n"))
    nothing = F.array().cast("array<struct<alt:string,alleles:array<string>,n:bigint>>")
    one_is_ref = (first["allele"] == F.col("ref")) | (second["allele"] == F.col("ref"))
    calls = (
        F.when(F.col("n_top") == 0, F.array(_call(ref_row, NO_CALL, NO_CALL)) if emit_no_call else nothing)
        .when(
            (F.col("n_top") == 1) & (first["allele"] == F.col("ref")),
            F.array(_call(first, REF, REF)) if emit_ref else nothing,
        )
        .when(F.col("n_top") == 1, F.array(_call(first, ALT, ALT)))
        .when(
            one_is_ref,
            F.array(_call(F.when(first["allele"] == F.col("ref"), second).otherwise(first), REF, ALT)),
        )
        .otherwise(F.array(_call(first, ALT, OTHER_ALT), _call(second, ALT, OTHER_ALT)))
    )
    return _genotypes(passing.withColumn("calls", calls))


def allele_percents(counts: DataFrame, keys: tuple[str, ...] = ("contig", "locus", "sample")) -> DataFrame:
    """Percent of all elements per single base, from :func:`base_allele_counts`."""
    return (
        counts.withColumn("depth", F.sum("n").over(Window.partitionBy(*keys)))
        .filter(F.col("allele").isNotNull())
        .withColumn("percent", F.col("n") * 100.0 / F.col("depth"))
    )


def somatic_threshold_calls(
    reads: DataFrame,
    threshold_tumor: int = THRESHOLD_TUMOR,
    threshold_normal: int = THRESHOLD_NORMAL,
    allow_ref: bool = False,
    loci: DataFrame | None = None,
    cluster: bool = True,
) -> DataFrame:
    """Two-threshold tumor/normal calls over one read set with tokens 1 (tumor) and 2 (normal)."""
    rows = _expanded(reads.filter(F.col("md").isNotNull()), cluster, loci)
    tumor, normal = F.col("token") == TUMOR, F.col("token") == NORMAL
    counts = rows.groupBy(*_LOCUS, F.when(is_single_base(), F.col("allele")).alias("allele")).agg(
        F.count_if(tumor).alias("n"),
        F.count_if(normal).alias("n_normal"),
        F.count_if(tumor & F.col("fwd")).alias("n_fwd"),
        reference_base().alias("ref_base"),
    )
    ranked = _by_count(
        [(-F.col("n")).alias("order"), F.col("allele"), F.col("n"), F.col("n_normal")],
        F.col("allele").isNotNull(),
    )
    not_ref = "true" if allow_ref else "a.allele <> ref"
    per_locus = (
        on_loci(counts, loci).groupBy(*_LOCUS)
        .agg(
            F.sum("n").alias("depth"),
            F.sum("n_normal").alias("depth_normal"),
            F.sum("n_fwd").alias("depth_fwd"),
            F.max("ref_base").alias("ref"),
            ranked.alias("ranked"),
        )
        .filter("depth > 0 AND depth_normal > 0")
        .withColumn(
            "top",
            F.expr(
                f"slice(filter(ranked, a -> a.n_normal * 100 < {threshold_normal} * depth_normal "
                f"AND a.n * 100 > {threshold_tumor} * depth AND {not_ref}), 1, 2)"
            ),
        )
        .filter(F.size("top") > 0)
        .withColumn("sample", F.lit(SOMATIC_SAMPLE))
    )
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    calls = F.when(F.size("top") == 1, F.array(_call(first, ALT, REF))).otherwise(
        F.array(_call(first, ALT, OTHER_ALT), _call(second, ALT, OTHER_ALT))
    )
    return _genotypes(per_locus.withColumn("calls", calls))


def _usable(rows: DataFrame, min_base_quality_: int, min_mapq: int | None) -> DataFrame:
    kept = min_base_quality(rows, min_base_quality_) if min_base_quality_ > 0 else rows
    return kept if min_mapq is None else kept.filter(F.col("mapq") > min_mapq)


def base_counts(
    rows: DataFrame, min_base_quality_: int = 0, min_mapq: int | None = None,
    keys: tuple[str, ...] = ("contig", "locus", "token"),
) -> DataFrame:
    """Counts per base, the deletion (null base) included."""
    return _usable(rows, min_base_quality_, min_mapq).groupBy(*keys, "base").agg(F.count(F.lit(1)).alias("n"))


def top_bases(counts: DataFrame, percent: int = TOP_PERCENT, keys: tuple[str, ...] = ("contig", "locus", "token")) -> DataFrame:
    """Most frequent bases of a pileup until their integer percent reaches ``percent``.

    Ties go by base, the deletion last. Works on base counts, so a window holds a few rows.
    """
    locus = Window.partitionBy(*keys)
    order = locus.orderBy(F.desc("n"), F.asc_nulls_last("base"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        counts.withColumn("_before", before)
        .withColumn("depth", F.sum("n").over(locus))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.expr(f"_before = 0 OR _before * 100 div depth < {int(percent)}"))
        .drop("_before")
    )


def somatic_calls(
    reads: DataFrame,
    reference: DataFrame,
    min_base_quality_: int = MIN_BASE_QUALITY,
    min_normal_coverage: int = MIN_COVERAGE,
    min_tumor_coverage: int = MIN_COVERAGE,
    top_percent: int = TOP_PERCENT,
    min_mapq: int | None = None,
    clip_mode: str = "aligned",
    cluster: bool = True,
) -> DataFrame:
    """Call the tumor's most frequent base where the normal's top bases do not include it.

    ``reads`` carry tokens 1 (tumor) and 2 (normal); ``reference`` is a fragment table. Both samples
    are counted in one aggregate, candidates are picked per locus and only those look up the
    reference base.
    """
    rows = base_reads(by_neighbourhood(reads) if cluster else reads, clip_mode)
    both = _usable(rows, min_base_quality_, min_mapq).groupBy(*_LOCUS, "base").agg(
        F.count_if(F.col("token") == TUMOR).alias("n_tumor"),
        F.count_if(F.col("token") == NORMAL).alias("n_normal"),
        F.count_if((F.col("token") == TUMOR) & F.col("fwd")).alias("n_fwd"),
    )
    # The null base sorts last on equal counts.
    no_base = F.col("base").isNull()
    per_locus = (
        both.groupBy(*_LOCUS)
        .agg(
            F.sum("n_tumor").alias("tumor_depth"),
            F.sum("n_normal").alias("normal_depth"),
            F.sum("n_fwd").alias("tumor_fwd"),
            F.min(
                F.struct((-F.col("n_tumor")).alias("order"), no_base.alias("gap"), "base")
            ).alias("best"),
            F.array_sort(
                F.collect_list(F.struct((-F.col("n_normal")).alias("order"), no_base.alias("gap"), "base"))
            ).alias("normal"),
        )
        .filter(
            (F.col("tumor_depth") >= min_tumor_coverage)
            & (F.col("normal_depth") >= min_normal_coverage)
            & ~F.col("best.gap")
        )
        .withColumn("alt", F.col("best.base"))
        # Normal reads ahead of the alternate in frequency order, and whether it occurs at all.
        .withColumn(
            "ahead",
            F.expr(
                "aggregate(slice(normal, 1, array_position(transform(normal, b -> b.base), alt) - 1), "
                "0L, (s, b) -> s - b.order)"
            ),
        )
        .withColumn(
            "n_alt_normal",
            F.expr("aggregate(filter(normal, b -> b.base = alt), 0L, (s, b) -> s - b.order)"),
        )
    )
    in_normal = F.expr(
        f"n_alt_normal > 0 AND (ahead = 0 OR ahead * 100 div nullif(normal_depth, 0) < {int(top_percent)})"
    )
    found = with_reference_base(per_locus.filter(~in_normal), reference)
    return found.filter(F.col("alt") != F.col("ref")).select(
        "contig", F.col("locus").alias("pos"), "ref", "alt", F.lit(SIMPLE_SAMPLE).alias("sample"),
        call_array(ALT, ALT).alias("alleles"),
        F.col("tumor_depth").cast("int").alias("read_depth"),
        (-F.col("best.order")).cast("int").alias("alt_read_depth"),
        F.col("tumor_fwd").cast("int").alias("fwd_reads"),
    )


def allele_evidence(rows: DataFrame, min_mapq: int = 0) -> DataFrame:
    """:func:`evidence` with the two log sums (1e-9 units), impossible hits, forward reads and reference base.

    ``hit`` sums ln(2(1-e)), ``miss`` sums ln(2e); ``zero`` counts elements whose quality 0 makes a
    hit impossible. With these a genotype's likelihood is plain arithmetic.
    """
    good = passing(min_mapq)
    return evidence(
        rows,
        F.coalesce(F.sum(F.when(good, log_hit("q"))), F.lit(0)).cast("bigint").alias("hit"),
        F.sum(F.when(good, log_miss("q"))).cast("bigint").alias("miss"),
        F.count_if(good & (F.col("q") <= 0)).alias("zero"),
        F.count_if(good & F.col("fwd")).alias("n_fwd"),
        reference_base(F.when(good, F.col("ref_base"))).alias("ref_base"),
        min_mapq=min_mapq,
    )


def _with_totals(alleles: DataFrame) -> DataFrame:
    locus = Window.partitionBy(*_SAMPLE_LOCUS)
    return (
        alleles.withColumn("depth", F.sum("n").over(locus))
        .withColumn("depth_fwd", F.sum("n_fwd").over(locus))
        .withColumn("ref", F.max("ref_base").over(locus))
        .withColumn("all_miss", F.sum("miss").over(locus))
    )


def genotype_likelihoods(alleles: DataFrame) -> DataFrame:
    """Every genotype of the alleles seen at a locus: ``a1 <= a2, log_likelihood, likelihood``.

    Both come from per-allele sums; pairs are over distinct alleles, never over reads.
    """
    full = _with_totals(alleles)
    right = full.select(
        *_SAMPLE_LOCUS, F.col("allele").alias("a2"), F.col("miss").alias("miss2"), F.col("n").alias("n2")
    )
    pairs = (
        full.withColumnRenamed("allele", "a1").withColumnRenamed("n", "n1")
        .join(right, _SAMPLE_LOCUS).filter("a1 <= a2")
    )
    same = F.col("a1") == F.col("a2")
    units = F.when(same, F.col("hit") + F.col("all_miss") - F.col("miss")).otherwise(
        F.col("all_miss") - F.col("miss") - F.col("miss2")
    )
    value = F.when(same & (F.col("zero") > 0), F.lit(float("-inf"))).otherwise(
        units / F.lit(float(LOG_UNIT)) - F.col("depth")
    )
    return pairs.select(
        *_SAMPLE_LOCUS, "a1", "a2", "n1", "n2", "depth", "depth_fwd", "ref", value.alias("log_likelihood")
    ).withColumn(
        "likelihood", F.exp(F.col("log_likelihood") + F.col("depth") - F.col("depth") * F.ln(F.lit(2.0)))
    )


def most_likely_genotypes(alleles: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Best genotype per locus and sample, ties to the smaller pair.

    Columns: ``a1, a2`` with their element counts ``n1, n2``, ``depth, depth_fwd, ref``. Without a
    prior no pairs are made: the best homozygote has the largest ``hit - miss``, the best
    heterozygote the two smallest ``miss``. A prior table ``a1, a2, log_prior`` lists pairs, all others
    count 0; a locus then looks at its homozygotes, its listed pairs and the best unlisted partner of
    each allele.
    """
    if prior is not None:
        return _most_likely_under(alleles, prior)
    order = F.row_number().over(Window.partitionBy(*_SAMPLE_LOCUS).orderBy("miss", "allele"))
    hom = F.when(F.col("zero") == 0, F.col("hit") - F.col("miss"))
    seen = F.struct("allele", "n")
    best = (
        alleles.withColumn("order", order)
        .groupBy(*_SAMPLE_LOCUS)
        .agg(
            F.sum("n").alias("depth"),
            F.sum("n_fwd").alias("depth_fwd"),
            F.max("ref_base").alias("ref"),
            F.min(F.when(hom.isNotNull(), F.struct((-hom).alias("o"), "allele", "n"))).alias("hom"),
            F.min(seen).alias("smallest"),
            F.max(F.when(F.col("order") == 1, seen)).alias("m1"),
            F.max(F.when(F.col("order") == 2, seen)).alias("m2"),
            F.sum(F.when(F.col("order") <= 2, F.col("miss"))).alias("miss2"),
        )
        .withColumn("het1", F.least("m1", "m2"))
        .withColumn("het2", F.when(F.col("m2").isNotNull(), F.greatest("m1", "m2")))
    )
    # Scores leave out the shared all_miss - depth: hom is hit - miss, het is -(miss + miss).
    gain, het_gain = -F.col("hom.o"), -F.col("miss2")
    first_by_name = (F.col("hom.allele") < F.col("het1.allele")) | (
        (F.col("hom.allele") == F.col("het1.allele")) & (F.col("hom.allele") <= F.col("het2.allele"))
    )
    use_hom = F.col("m2").isNull() | (
        F.col("hom").isNotNull() & ((gain > het_gain) | ((gain == het_gain) & first_by_name))
    )
    hom_allele = F.coalesce("hom.allele", "smallest.allele")
    hom_n = F.coalesce("hom.n", "smallest.n")
    return best.select(
        *_SAMPLE_LOCUS,
        F.when(use_hom, hom_allele).otherwise(F.col("het1.allele")).alias("a1"),
        F.when(use_hom, hom_allele).otherwise(F.col("het2.allele")).alias("a2"),
        F.when(use_hom, hom_n).otherwise(F.col("het1.n")).alias("n1"),
        F.when(use_hom, hom_n).otherwise(F.col("het2.n")).alias("n2"),
        "depth", "depth_fwd", "ref",
    )


def _listed_partners(prior: DataFrame) -> DataFrame:
    """``listed, partners``: for each allele of a prior the other alleles it is listed with, and the log prior."""
    both = prior.select("a1", "a2", "log_prior").unionByName(
        prior.select(F.col("a2").alias("a1"), F.col("a1").alias("a2"), "log_prior")
    )
    rows = both.groupBy("a1", "a2").agg(F.max("log_prior").alias("log_prior"))
    return rows.groupBy(F.col("a1").alias("listed")).agg(
        F.collect_list(F.struct("a2", "log_prior")).alias("partners")
    )


def _most_likely_under(alleles: DataFrame, prior: DataFrame) -> DataFrame:
    """Best genotype under a prior, in one aggregate per locus over its distinct alleles.

    An unlisted heterozygote is best with the partner of least ``miss``, so each allele adds one such
    pair; alleles that the prior does not list find it in first or second place.
    """
    known = alleles.join(_listed_partners(prior), F.col("allele") == F.col("listed"), "left")
    per_locus = known.groupBy(*_SAMPLE_LOCUS).agg(
        F.sum("n").alias("depth"),
        F.sum("n_fwd").alias("depth_fwd"),
        F.max("ref_base").alias("ref"),
        F.sum("miss").alias("all_miss"),
        F.sort_array(F.collect_list(F.struct("miss", "allele", "n", "hit", "zero", "partners"))).alias("seen"),
    )
    unit = f"{float(LOG_UNIT)}D"
    pair = (
        "named_struct('o', -(({units}) / " + unit + " - depth + {prior}), 'a1', least(x.allele, {y}.allele), "
        "'a2', greatest(x.allele, {y}.allele), 'n1', if(x.allele <= {y}.allele, x.n, {y}.n), "
        "'n2', if(x.allele <= {y}.allele, {y}.n, x.n))"
    )
    listed = "element_at(filter(x.partners, p -> p.a2 = {y}.allele), 1).log_prior"
    is_listed = "exists(x.partners, p -> p.a2 = {y}.allele)"
    het = "all_miss - x.miss - y.miss"
    hom = (
        "named_struct('o', if(x.zero > 0, double('inf'), -((x.hit + all_miss - x.miss) / " + unit + " - depth + "
        + "coalesce(try_element_at(filter(x.partners, p -> p.a2 = x.allele), 1).log_prior, 0D))), "
        "'a1', x.allele, 'a2', x.allele, 'n1', x.n, 'n2', x.n)"
    )
    with_listed = (
        "transform(filter(seen, y -> y.allele > x.allele AND " + is_listed.format(y="y") + "), y -> "
        + pair.format(units=het, prior=listed.format(y="y"), y="y") + ")"
    )
    unlisted = (
        "transform(slice(if(x.partners IS NULL, filter(slice(seen, 1, 2), y -> y.allele <> x.allele), "
        "filter(seen, y -> y.allele <> x.allele AND NOT " + is_listed.format(y="y") + ")), 1, 1), y -> "
        + pair.format(units=het, prior="0D", y="y") + ")"
    )
    best = F.expr(
        f"array_min(flatten(transform(seen, x -> concat(array({hom}), "
        f"if(x.partners IS NULL, slice(array({hom}), 1, 0), {with_listed}), {unlisted}))))"
    )
    return per_locus.withColumn("g", best).select(
        *_SAMPLE_LOCUS, "g.a1", "g.a2", "g.n1", "g.n2", "depth", "depth_fwd", "ref"
    )


def bayes_evidence(
    reads: DataFrame,
    min_mapq: int = MIN_MAPQ,
    max_complexity: int = 100,
    no_ambiguous: bool = False,
    max_ploidy: int | None = None,
    loci: DataFrame | None = None,
    cluster: bool = True,
) -> DataFrame:
    """Allele evidence after the pileup filters; only the mapping quality filter is on by default.

    Base rows are counted where they are expanded: the shuffle carries a row per locus, sample and allele.
    """
    rows = _expanded(reads, cluster, loci)
    if max_complexity >= 100 and not no_ambiguous and max_ploidy is None:
        # Nothing looks at the elements that are mapped worse, so they need not be counted.
        return on_loci(allele_evidence(rows.filter(passing(min_mapq))), loci)
    return filter_pileups(
        on_loci(allele_evidence(rows, min_mapq), loci), LOCUS_KEYS, max_complexity, no_ambiguous, max_ploidy
    )


def bayes_calls(
    reads: DataFrame,
    min_mapq: int = MIN_MAPQ,
    emit_ref: bool = False,
    prior: DataFrame | None = None,
    loci: DataFrame | None = None,
    cluster: bool = True,
    **pileup_filters,
) -> DataFrame:
    """Most likely diploid genotype per locus and sample, one row per distinct alternate allele."""
    alleles = bayes_evidence(reads, min_mapq, loci=loci, cluster=cluster, **pileup_filters)
    return bayes_calls_from(alleles, emit_ref, prior)


def bayes_calls_from(
    alleles: DataFrame, emit_ref: bool = False, prior: DataFrame | None = None
) -> DataFrame:
    best = most_likely_genotypes(alleles, prior)
    names = classify_pair(F.col("a1"), F.col("a2"), F.col("ref"))
    one = F.struct(F.col("a1").alias("alt"), F.col("n1").alias("n"))
    two = F.struct(F.col("a2").alias("alt"), F.col("n2").alias("n"))
    distinct = F.when(F.col("a1") == F.col("a2"), F.array(one)).otherwise(F.array(one, two))
    alts = F.filter(distinct, lambda a: a["alt"] != F.col("ref"))
    if emit_ref:
        alts = F.when(F.size(alts) == 0, F.array(one)).otherwise(alts)
    return best.select(
        *_SAMPLE_LOCUS, "ref", "depth", "depth_fwd", names.alias("alleles"), F.explode(alts).alias("c")
    ).select(
        "contig", F.col("locus").alias("pos"), "ref", F.col("c.alt").alias("alt"), "sample", "alleles",
        F.col("depth").cast("int").alias("read_depth"),
        F.col("c.n").cast("int").alias("alt_read_depth"),
        F.col("depth_fwd").cast("int").alias("fwd_reads"),
    )


def copy_evidence(rows: DataFrame, ploidy: int) -> DataFrame:
    """Per allele the counts and, for each number of its copies from 0 to ``ploidy``, the log sum of its elements.

    ``gains[k]`` sums ln(k (1 - e) + (ploidy - k) e) in 1e-9 units; ``zero`` counts elements of quality 0, which
    no genotype of ``ploidy`` copies of the allele can have.
    """
    sums = [F.coalesce(F.sum(log_copies("q", k, ploidy)), F.lit(0)).cast("bigint") for k in range(ploidy + 1)]
    return rows.groupBy(*_SAMPLE_LOCUS, "allele").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("fwd").alias("n_fwd"), F.count_if(F.col("q") <= 0).alias("zero"),
        reference_base().alias("ref_base"), F.array(*sums).alias("gains"),
    )


def most_likely_copies(alleles: DataFrame, ploidy: int) -> DataFrame:
    """Best genotype of any ploidy per locus and sample: ``genotype`` (its alleles in order), ``calls``, counts and log-likelihood.

    An allele with k copies adds ``gains[k]``, so the best genotype is a knapsack of ``ploidy`` copies over the alleles
    seen: a table of the best score of 0 to ``ploidy`` copies, allele after allele. No genotype is listed. Ties go to the
    genotype that comes first. Where quality 0 rules out all, the smallest allele is taken, at minus infinity.
    """
    none = F.lit(None).cast("struct<cost: bigint, genotype: array<string>>")
    empty = F.struct(F.lit(0).cast("bigint").alias("cost"), F.array().cast("array<string>").alias("genotype"))
    start = F.array(empty, *[none] * ploidy)

    def with_allele(table: Column, x: Column) -> Column:
        def best(total: int) -> Column:
            options = []
            for k in range(total + 1):
                rest = F.get(table, F.lit(total - k))
                made = F.struct(
                    (rest["cost"] - F.get(x["gains"], F.lit(k))).alias("cost"),
                    F.concat(F.array_repeat(x["allele"], k), rest["genotype"]).alias("genotype"),
                )
                allowed = rest.isNotNull() if k < ploidy else rest.isNotNull() & (x["zero"] == 0)
                options.append(F.when(allowed, made))
            return F.array_min(F.array(*options))

        return F.array(*[best(total) for total in range(ploidy + 1)])

    per_locus = alleles.groupBy(*_SAMPLE_LOCUS).agg(
        F.sum("n").cast("bigint").alias("depth"), F.sum("n_fwd").cast("bigint").alias("depth_fwd"), F.max("ref_base").alias("ref"),
        F.sort_array(F.collect_list(F.struct("allele", "gains", "zero")), asc=False).alias("seen"),
    )
    found = per_locus.withColumn("best", F.get(F.aggregate("seen", start, with_allele), F.lit(ploidy)))
    fallback = F.array_repeat(F.element_at("seen", -1)["allele"], ploidy)
    score = -F.col("best.cost") / F.lit(float(LOG_UNIT)) - F.col("depth") * F.ln(F.lit(float(ploidy)))
    found = found.withColumns({
        "genotype": F.coalesce("best.genotype", fallback), "log_likelihood": F.coalesce(score, F.lit(float("-inf"))),
    })
    return found.select(
        *_SAMPLE_LOCUS, "genotype", classify_copies(F.col("genotype"), F.col("ref")).alias("calls"), "depth", "depth_fwd", "ref", "log_likelihood"
    )
