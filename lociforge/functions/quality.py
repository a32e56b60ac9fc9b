"""Phred qualities and the log-likelihood terms built from them.

Sums of logarithms are kept as integers in units of 1e-9. Integer sums do not depend on the
order in which tasks deliver their parts, so a rerun after a lost executor gives the same calls.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text offset of phred scores and the unit of the integer log terms.
PHRED_OFFSET = 33
LOG_UNIT = 1_000_000_000


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def phred_array(qual: Column | str, seq: Column | str) -> Column:
    """Array of quality numbers; a read without qualities gets zeros."""
    decoded = F.transform(F.split(_col(qual), ""), lambda ch: F.ascii(ch) - F.lit(PHRED_OFFSET))
    zeros = F.array_repeat(F.lit(0), F.length(_col(seq)))
    return F.coalesce(decoded, zeros)


def phred_to_error(q: Column | str) -> Column:
    return F.pow(F.lit(10.0), -_col(q) / F.lit(10.0))


def log_term(probability: Column) -> Column:
    """ln(probability) as an integer; null when the probability is zero."""
    return F.floor(F.ln(probability) * F.lit(float(LOG_UNIT)) + F.lit(0.5)).cast("bigint")


def _by_quality(q: Column | str, probability: Callable[[float], float]) -> Column:
    """Integer log term looked up by quality; scores outside 0..255 are computed."""
    terms = []
    for score in range(256):
        p = probability(10.0 ** (-score / 10.0))
        terms.append(f"{math.floor(math.log(p) * LOG_UNIT + 0.5)}L" if p > 0 else "CAST(NULL AS BIGINT)")
    table = F.expr(f"array({', '.join(terms)})")
    formula = F.when(_col(q).between(0, 255), F.lit(None)).otherwise(
        log_term(probability(phred_to_error(q)))
    )
    return F.coalesce(F.get(table, _col(q)), formula)


def log_hit(q: Column | str) -> Column:
    """Both alleles of a genotype agree with the element: ln(2(1 - e))."""
    return _by_quality(q, lambda e: 2.0 * (1.0 - e))


def log_miss(q: Column | str) -> Column:
    """Neither allele of a genotype agrees with the element: ln(2e)."""
    return _by_quality(q, lambda e: 2.0 * e)


def log_copies(q: Column | str, copies: int, ploidy: int) -> Column:
    """``copies`` alleles of a genotype of ``ploidy`` agree with the element: ln(copies (1 - e) + (ploidy - copies) e)."""
    return _by_quality(q, lambda e: copies * (1.0 - e) + (ploidy - copies) * e)
