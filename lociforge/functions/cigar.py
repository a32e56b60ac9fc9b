"""CIGAR text as an array of aligned blocks, parsed once per read with native expressions.

A block is one CIGAR element; it also knows the length of the insertion that directly follows it
(several ones with padding in between count as one), because an insertion belongs to the base before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operators that consume read bases and reference bases.
READ_OPS = "MIS=X"
REFERENCE_OPS = "MDN=X"
BASE_OPS = "M=X"

_SIMPLE = "^[0-9]+[M=X]$"
_VALID = "^([0-9]+[MIDNSHP=X])+$"


def _quoted(ops: str) -> str:
    return ", ".join(f"'{o}'" for o in ops)


def is_valid_cigar(cigar: str) -> Column:
    return F.col(cigar).rlike(_VALID)


def cigar_elements(cigar: str = "cigar") -> Column:
    """``ARRAY<STRUCT<op, len>>`` of every element, as written."""
    return F.expr(
        f"transform(regexp_extract_all({cigar}, '[0-9]+[MIDNSHP=X]', 0), "
        "t -> named_struct('op', right(t, 1), 'len', int(left(t, length(t) - 1))))"
    )


def cigar_blocks(cigar: str = "cigar") -> Column:
    """``ARRAY<STRUCT<op, len, ref_off, read_off, aln_off, idx, ins_len>>``.

    ``ref_off`` and ``read_off`` count from the alignment start and the first stored base,
    ``aln_off`` is the reference offset without skipped (N) regions, ``idx`` is the position of
    the element in the CIGAR and ``ins_len`` the length of the attached insertion.
    A plain single-element CIGAR takes a shortcut around the fold.
    """
    block = (
        "named_struct('op', {op}, 'len', {len}, 'ref_off', {ref}, 'read_off', {read}, "
        "'aln_off', {aln}, 'idx', {idx}, 'ins_len', {ins})"
    )
    single = block.format(
        op=f"right({cigar}, 1)",
        len=f"coalesce(try_cast(left({cigar}, length({cigar}) - 1) AS INT), 0)",
        ref="0", read="0", aln="0", idx="0", ins="0",
    )
    # One text split per read gives operators and lengths; the bound struct z keeps the lambdas from
    # splitting again. All insertions up to the next base belong to the base before, whatever padding
    # stands between them.
    attached = (
        "CASE WHEN NOT z.inserts THEN 0 WHEN get(z.ops, i + 1) = 'I' AND coalesce(get(z.ops, i + 2) NOT IN ('I', 'P'), true) "
        "THEN int(get(z.lens, i + 1)) WHEN get(z.ops, i + 1) IN ('I', 'P') THEN "
        "aggregate(sequence(i + 1, size(z.ops)), named_struct('open', true, 'n', 0), (s, k) -> "
        "if(s.open AND coalesce(get(z.ops, k) IN ('I', 'P'), false), "
        "named_struct('open', true, 'n', s.n + if(get(z.ops, k) = 'I', int(get(z.lens, k)), 0)), "
        "named_struct('open', false, 'n', s.n)), s -> s.n) ELSE 0 END"
    )
    fold = f"""
      element_at(transform(
        array(named_struct(
          'ops', split(regexp_replace({cigar}, '[0-9]+', ''), ''),
          'lens', split({cigar}, '[MIDNSHP=X]'),
          'inserts', contains({cigar}, 'I'))),
        z -> aggregate(
          transform(z.ops, (op, i) -> named_struct(
            'op', op, 'len', int(get(z.lens, i)), 'idx', i, 'ins', {attached})),
          named_struct('ref', 0, 'read', 0, 'aln', 0,
                       'out', cast(array() AS ARRAY<STRUCT<op: STRING, len: INT, ref_off: INT,
                                   read_off: INT, aln_off: INT, idx: INT, ins_len: INT>>)),
          (s, x) -> named_struct(
            'ref', s.ref + if(x.op IN ({_quoted(REFERENCE_OPS)}), x.len, 0),
            'read', s.read + if(x.op IN ({_quoted(READ_OPS)}), x.len, 0),
            'aln', s.aln + if(x.op IN ('M', 'D', '=', 'X'), x.len, 0),
            'out', concat(s.out, array({block.format(
                op="x.op", len="x.len", ref="s.ref", read="s.read",
                aln="s.aln", idx="x.idx", ins="x.ins")}))),
          s -> s.out)), 1)
    """
    return F.expr(f"CASE WHEN {cigar} RLIKE '{_SIMPLE}' THEN array({single}) WHEN {cigar} RLIKE '{_VALID}' THEN {fold} END")


def _total(cigar: str, ops: str) -> Column:
    return F.expr(
        f"aggregate(regexp_extract_all({cigar}, '([0-9]+)[{ops}]', 1), 0L, (n, t) -> n + bigint(t))"
    )


def read_length(cigar: str = "cigar") -> Column:
    """Number of stored read bases the CIGAR consumes."""
    return _total(cigar, READ_OPS)


def reference_length(cigar: str = "cigar") -> Column:
    """Number of reference bases the CIGAR spans."""
    return _total(cigar, REFERENCE_OPS)


def leading_clip(cigar: str = "cigar") -> Column:
    """Soft plus hard clipped bases before the alignment."""
    return F.expr(
        f"aggregate(regexp_extract_all(regexp_extract({cigar}, '^(?:[0-9]+[SH])+', 0), "
        "'([0-9]+)', 1), 0L, (n, t) -> n + bigint(t))"
    )


def trailing_clip(cigar: str = "cigar") -> Column:
    """Soft plus hard clipped bases after the alignment."""
    return F.expr(
        f"aggregate(regexp_extract_all(regexp_extract({cigar}, '(?:[0-9]+[SH])+$', 0), "
        "'([0-9]+)', 1), 0L, (n, t) -> n + bigint(t))"
    )


def alignment_end(start: str = "start", cigar: str = "cigar") -> Column:
    return F.col(start) + reference_length(cigar)


def unclipped_start(start: str = "start", cigar: str = "cigar") -> Column:
    return F.col(start) - leading_clip(cigar)


def unclipped_end(start: str = "start", cigar: str = "cigar") -> Column:
    return alignment_end(start, cigar) + trailing_clip(cigar)
