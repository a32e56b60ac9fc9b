"""Bases, contig names and short strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four standard bases.
STANDARD_BASES = "ACGT"


def normalize_contig(contig: Column | str) -> Column:
    """Drop the ``chr`` prefix text and spell the mitochondrion ``M``."""
    col = F.col(contig) if isinstance(contig, str) else contig
    return F.replace(F.replace(col, F.lit("chr"), F.lit("")), F.lit("MT"), F.lit("M"))


def is_standard(bases: Column | str) -> Column:
    """True when the string is non-empty and holds standard bases only."""
    col = F.col(bases) if isinstance(bases, str) else bases
    return col.rlike(f"^[{STANDARD_BASES}]+$")


def to_bases(text: Column | str) -> Column:
    """Sequence text in the canonical form: upper case, unknown bases as ``N``."""
    return F.translate(F.upper(text), ".", "N")


def same_bases(left: Column | str, right: Column | str) -> Column:
    """Case-insensitive, null-safe equality of two base strings."""
    return to_bases(left).eqNullSafe(to_bases(right))


def variant_type(ref: Column | str, alt: Column | str) -> Column:
    """``SNV``, ``INS``, ``DEL`` or ``OTHER`` from the allele lengths."""
    ref_len, alt_len = F.length(ref), F.length(alt)
    return (
        F.when((ref_len == 1) & (alt_len == 1), "SNV")
        .when(alt_len > ref_len, "INS")
        .when(alt_len < ref_len, "DEL")
        .otherwise("OTHER")
    )
