"""MD tags: the reference text under a read, without a reference genome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Match lengths are the tokens that sort before ':'; letters and '^' come after.
_TOKEN = "([0-9]+|\\\\^[A-Z]+|[A-Z])"


def md_tokens(md: str = "md") -> Column:
    """``ARRAY<STRING>`` of match lengths, mismatch letters and ``^`` deletions."""
    return F.expr(f"regexp_extract_all({md}, '{_TOKEN}', 1)")


def md_mismatches(md: str = "md") -> Column:
    """``ARRAY<STRUCT<off, base>>`` of the substituted reference bases.

    ``off`` counts reference positions from the alignment start (deleted bases included).
    """
    return F.expr(f"""
      aggregate(
        regexp_extract_all({md}, '{_TOKEN}', 1),
        named_struct('pos', 0, 'out', cast(array() AS ARRAY<STRUCT<off: INT, base: STRING>>)),
        (s, t) -> CASE
          WHEN t < ':' THEN named_struct('pos', s.pos + int(t), 'out', s.out)
          WHEN startswith(t, '^') THEN named_struct('pos', s.pos + length(t) - 1, 'out', s.out)
          ELSE named_struct('pos', s.pos + 1,
                            'out', concat(s.out, array(named_struct('off', s.pos, 'base', t))))
        END,
        s -> s.out)
    """)


def md_length(md: str = "md") -> Column:
    """Number of reference positions that the tag speaks of."""
    return F.expr(f"""
      CASE WHEN {md} RLIKE '^[0-9]{{1,9}}$' THEN int({md})
      ELSE aggregate(
        regexp_extract_all({md}, '{_TOKEN}', 1), 0,
        (n, t) -> n + CASE WHEN t < ':' THEN int(t) WHEN startswith(t, '^') THEN length(t) - 1 ELSE 1 END) END
    """)


def aligned_text(seq: str = "seq", blocks: str = "blocks") -> Column:
    """Read bases that sit on the reference, insertions and clips cut out."""
    return F.expr(f"""
      CASE WHEN size({blocks}) = 1 THEN {seq}
      ELSE array_join(
        transform(filter({blocks}, b -> b.op IN ('M', '=', 'X')),
                  b -> substring({seq}, b.read_off + 1, b.len)), '') END
    """)


def reference_text(md: str = "md", aligned: str = "aligned") -> Column:
    """Reference bases under the read, rebuilt from MD and the aligned read bases.

    The text covers what MD covers, so its offsets leave out N gaps unless the tag counts them.
    """
    return F.expr(f"""
      CASE WHEN {md} IS NULL THEN NULL
      WHEN {md} RLIKE '^[0-9]+$' THEN {aligned}
      ELSE aggregate(
        regexp_extract_all({md}, '{_TOKEN}', 1),
        named_struct('pos', 0, 'out', ''),
        (s, t) -> CASE
          WHEN t < ':' THEN named_struct(
            'pos', s.pos + int(t), 'out', concat(s.out, substring({aligned}, s.pos + 1, int(t))))
          WHEN startswith(t, '^') THEN named_struct(
            'pos', s.pos, 'out', concat(s.out, substring(t, 2, length(t) - 1)))
          ELSE named_struct('pos', s.pos + 1, 'out', concat(s.out, t))
        END,
        s -> s.out) END
    """)
