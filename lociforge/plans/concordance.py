"""Scoring called genotypes against a truth set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.functions.genotypes import NO_CALL, REF
from lociforge.operators.filters import select_variants
from lociforge.operators.variants import normalized

_VARIANT = ["contig", "pos", "ref", "alt"]


def _call_type(genotypes: DataFrame) -> DataFrame:
    """Distinct variants with one call type per key; hom-ref and no-call rows are not calls."""
    called = ~F.array_contains("alleles", NO_CALL) & ~F.forall("alleles", lambda a: a == REF)
    return genotypes.filter(called)


def _type_name() -> "F.Column":
    return F.when(F.array_contains("alleles", REF), "HET").otherwise("HOM_ALT")


def one_sample(genotypes: DataFrame, sample: str | None = None) -> DataFrame:
    """The rows of one sample; without a name, of the first by name, which a job looks up."""
    if sample is None:
        sample = genotypes.agg(F.min("sample")).first()[0]
    return genotypes.filter(F.col("sample") == sample)


def concordance_table(
    called: DataFrame,
    truth: DataFrame,
    exclude_snvs: bool = False,
    exclude_indels: bool = False,
    contig: str = "",
    match_sample: bool = False,
    sample: str | None = None,
    truth_sample: str | None = None,
    reference: DataFrame | None = None,
) -> DataFrame:
    """Number of variants per (called type, true type); a missing side is ``NO_CALL``.

    With ``reference`` fragments both sides are normalised first, so that equal variants meet however they are written.

    One sample of either side is scored, the first by name unless ``sample`` and ``truth_sample`` name
    others; with ``match_sample`` every sample is scored against its namesake instead. Variants are
    reduced to one row per key before the join, so each key meets once.
    """
    keys = [*_VARIANT, "sample"] if match_sample else _VARIANT

    def side(genotypes: DataFrame, name: str, chosen: str | None) -> DataFrame:
        rows = genotypes if match_sample else one_sample(genotypes, chosen)
        rows = rows if reference is None else normalized(rows, reference)
        rows = select_variants(_call_type(rows), exclude_snvs, exclude_indels, contig)
        return rows.groupBy(*keys).agg(F.max(_type_name()).alias(name))

    joined = side(called, "called", sample).join(side(truth, "truth", truth_sample), keys, "full_outer")
    return joined.groupBy(
        F.coalesce("called", F.lit("NO_CALL")).alias("called"),
        F.coalesce("truth", F.lit("NO_CALL")).alias("truth"),
        *(["sample"] if match_sample else []),
    ).agg(F.count(F.lit(1)).alias("variants"))


def precision_recall(table: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """True/false positives, false negatives, precision, recall and F1 of a concordance table."""
    called, true = F.col("called") != "NO_CALL", F.col("truth") != "NO_CALL"

    def total(which) -> "F.Column":
        return F.coalesce(F.sum(F.when(which, F.col("variants"))), F.lit(0)).cast("bigint")

    counts = table.groupBy(*keys).agg(
        total(called & true).alias("true_positives"),
        total(called & ~true).alias("false_positives"),
        total(~called & true).alias("false_negatives"),
    )
    tp = F.col("true_positives").cast("double")
    scored = counts.withColumn(
        "precision", F.try_divide(tp, tp + F.col("false_positives"))
    ).withColumn("recall", F.try_divide(tp, tp + F.col("false_negatives")))
    return scored.withColumn(
        "f1",
        F.try_divide(
            F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
        ),
    )


def evaluate(called: DataFrame, truth: DataFrame, **options) -> DataFrame:
    """One row of concordance scores (one per sample with ``match_sample=True``)."""
    keys = ("sample",) if options.get("match_sample") else ()
    return precision_recall(concordance_table(called, truth, **options), keys)
