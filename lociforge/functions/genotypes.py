"""Two-allele genotypes as ``ARRAY<STRING>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Allele call names.
REF, ALT, OTHER_ALT, NO_CALL = "Ref", "Alt", "OtherAlt", "NoCall"


def call_array(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def ploidy(alleles: Column) -> Column:
    return F.size(alleles)


def unique_alleles(alleles: Column) -> Column:
    return F.size(F.array_distinct(alleles))


def non_reference_alleles(alleles: Column, ref: Column) -> Column:
    return F.filter(alleles, lambda a: a != ref)


def variant_count(alleles: Column, ref: Column) -> Column:
    return F.size(non_reference_alleles(alleles, ref))


def is_variant(alleles: Column, ref: Column) -> Column:
    return variant_count(alleles, ref) > 0


def classify_pair(a1: Column, a2: Column, ref: Column) -> Column:
    """Allele calls of a diploid genotype against the reference allele."""
    return (
        F.when((a1 == ref) & (a2 == ref), call_array(REF, REF))
        .when(a1 == a2, call_array(ALT, ALT))
        .when((a1 != ref) & (a2 != ref), call_array(ALT, OTHER_ALT))
        .otherwise(call_array(REF, ALT))
    )


def classify_copies(genotype: Column, ref: Column) -> Column:
    """Allele calls of a genotype of any ploidy: reference copies first, then those of its first other allele, then the rest.

    Without a known reference allele all copies count as other ones.
    """
    is_ref = lambda a: F.coalesce(a == ref, F.lit(False))
    others = F.filter(genotype, lambda a: ~is_ref(a))
    alts = F.filter(others, lambda a: a == F.get(others, F.lit(0)))
    named = lambda n, name: F.array_repeat(F.lit(name), n)
    return F.concat(
        named(F.size(genotype) - F.size(others), REF), named(F.size(alts), ALT), named(F.size(others) - F.size(alts), OTHER_ALT)
    )
