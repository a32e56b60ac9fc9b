"""Pileup filters over base rows and filters over called genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.functions.bases import variant_type

LOCUS_KEYS = ("contig", "locus", "sample")

# Option defaults.
MIN_MAPQ, MAX_COMPLEXITY, MAX_PLOIDY = 30, 25, 2
MIN_READ_DEPTH, MIN_ALT_DEPTH, MAX_STRAND_BIAS_DEPTH = 0, 0, 10
LOW_STRAND_BIAS, HIGH_STRAND_BIAS = 0, 100


def min_base_quality(rows: DataFrame, minimum: int) -> DataFrame:
    """Drop bases below the quality; deletions have none and stay."""
    return rows.filter(F.coalesce("bq", F.lit(minimum)) >= minimum)


def min_mapping_quality(rows: DataFrame, minimum: int) -> DataFrame:
    """Keep elements mapped strictly better than ``minimum``."""
    return rows.filter(F.col("mapq") > minimum)


def min_depth(pileups: DataFrame, minimum: int, depth: str = "depth") -> DataFrame:
    return pileups.filter(F.col(depth) >= minimum)


def evidence(
    rows: DataFrame, *aggregates: Column, min_mapq: int = 0, keys: tuple[str, ...] = LOCUS_KEYS
) -> DataFrame:
    """Base rows reduced to one row per ``keys`` and allele, in one aggregate with map-side combining.

    ``n`` elements are mapped strictly better than ``min_mapq`` (all of them for 0) and ``kept_mapq`` is their least
    mapping quality; ``n_all``, ``n_low`` and ``low_mapq`` count every element. ``aggregates`` are taken
    over the better ones: build them with :func:`passing`. The locus filters below are arithmetic on the few
    allele rows of a locus, however deep it is.
    """
    good = passing(min_mapq)
    return rows.groupBy(*keys, "allele").agg(
        F.count_if(good).alias("n"),
        F.min(F.when(good, F.col("mapq"))).alias("kept_mapq"),
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(~good).alias("n_low"),
        F.min("mapq").alias("low_mapq"),
        *aggregates,
    )


def passing(min_mapq: int) -> Column:
    """Whether an element is mapped well enough to count."""
    return F.col("mapq") > min_mapq if min_mapq > 0 else F.lit(True)


def drop_ambiguous(alleles: DataFrame, keys: tuple[str, ...] = LOCUS_KEYS) -> DataFrame:
    """Drop a locus if any of its elements has mapping quality 0."""
    low = F.min("low_mapq").over(Window.partitionBy(*keys))
    return alleles.withColumn("_low", low).filter("_low > 0").drop("_low")


def drop_multi_allelic(
    alleles: DataFrame, max_ploidy: int = MAX_PLOIDY, keys: tuple[str, ...] = LOCUS_KEYS
) -> DataFrame:
    """Drop a locus with more distinct alleles than ``max_ploidy``."""
    number = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return alleles.withColumn("_alleles", number).filter(F.col("_alleles") <= max_ploidy).drop("_alleles")


def drop_complex_regions(
    alleles: DataFrame, max_complexity: int = MAX_COMPLEXITY, keys: tuple[str, ...] = LOCUS_KEYS
) -> DataFrame:
    """Drop a locus where more than ``max_complexity`` percent of the elements map at or below the
    minimum that the evidence was taken with."""
    locus = Window.partitionBy(*keys)
    share = F.sum("n_low").over(locus) * 100.0 / F.sum("n_all").over(locus)
    return alleles.withColumn("_share", share).filter(F.col("_share") <= max_complexity).drop("_share")


def filter_pileups(
    alleles: DataFrame,
    keys: tuple[str, ...] = LOCUS_KEYS,
    max_complexity: int = MAX_COMPLEXITY,
    no_ambiguous: bool = False,
    max_ploidy: int | None = None,
) -> DataFrame:
    """The whole chain on :func:`evidence` rows: ambiguous loci, multi-allelic loci, complex regions, then alleles
    without a well-mapped element. Locus filters drop whole loci, so their order does not matter, and
    their windows share one shuffle of allele rows."""
    if no_ambiguous:
        alleles = drop_ambiguous(alleles, keys)
    if max_ploidy is not None:
        alleles = drop_multi_allelic(alleles, max_ploidy, keys)
    if max_complexity < 100:
        alleles = drop_complex_regions(alleles, max_complexity, keys)
    return alleles.filter("n > 0")


def has_read_depth(minimum: int, include_null: bool = True) -> Column:
    return F.coalesce(F.col("read_depth") > minimum, F.lit(include_null))


def has_alt_depth(minimum: int, include_null: bool = True) -> Column:
    return F.coalesce(F.col("alt_read_depth") > minimum, F.lit(include_null))


def not_strand_biased(
    low: int = LOW_STRAND_BIAS, high: int = HIGH_STRAND_BIAS,
    max_depth: int = MAX_STRAND_BIAS_DEPTH, include_null: bool = True,
) -> Column:
    """Forward percent within ``[low, high]``; sites with ``max_depth`` alt reads or more are exempt."""
    percent = F.col("fwd_reads") * 100.0 / F.col("read_depth")
    return F.coalesce(
        percent.between(low, high) | (F.col("alt_read_depth") >= max_depth), F.lit(include_null)
    )


def filter_genotypes(
    genotypes: DataFrame,
    min_read_depth: int = MIN_READ_DEPTH,
    min_alt_depth: int = MIN_ALT_DEPTH,
    max_strand_bias_depth: int = MAX_STRAND_BIAS_DEPTH,
    low_strand_bias: int = LOW_STRAND_BIAS,
    high_strand_bias: int = HIGH_STRAND_BIAS,
    include_null: bool = True,
) -> DataFrame:
    """Read depth, alternate depth and strand bias filters, each applied to what the last one left."""
    kept = genotypes
    if min_read_depth > 0:
        kept = kept.filter(has_read_depth(min_read_depth, include_null))
    if min_alt_depth > 0:
        kept = kept.filter(has_alt_depth(min_alt_depth, include_null))
    if low_strand_bias > 0 or high_strand_bias < 100:
        kept = kept.filter(
            not_strand_biased(low_strand_bias, high_strand_bias, max_strand_bias_depth, include_null)
        )
    return kept


def select_variants(
    genotypes: DataFrame, exclude_snvs: bool = False, exclude_indels: bool = False, contig: str = "",
    others: bool = False,
) -> DataFrame:
    """Contig and variant-type selection; the empty contig name means every contig.

    Substitutions of several bases (type ``OTHER``) are neither SNVs nor indels and are left out
    unless ``others`` asks for them.
    """
    kind = variant_type("ref", "alt")
    out = {"SNV": exclude_snvs, "INS": exclude_indels, "DEL": exclude_indels, "OTHER": not others}
    wanted = [k for k, excluded in out.items() if not excluded]
    rows = genotypes.filter(kind.isin(*wanted) if wanted else F.lit(False))
    return rows.filter(F.col("contig") == contig) if contig else rows
