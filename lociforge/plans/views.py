"""Genomic views over the benchmark tables: reads, intervals, targets, truth and reference.

Everything follows from the table rows by integer arithmetic, so the same data can be described in
plain SQL. ``lineitem`` rows become stored reads (CIGAR, MD, sequence and quality text), which the
library then treats like any other reads.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.operators.pileup import by_neighbourhood
from lociforge.sources.fasta import fragment_number

# Fixed values of the derived genome.
CONTIGS = 4
CONTIG_LENGTH = 2052
READ_START_SPAN = 2000
FRAGMENT = 500
STRETCH = 64
WIDE_SPAN = 200_000_000
# Mapped: the 1-based start, clipped bases included, is not negative.
MAPPED = "NOT (shape = 7 AND start < 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _x(p: str, c: str = "c") -> str:
    return f"({p} * {p} * 3 + {p} * 5 + ({p} * {p} * {p}) % 11 + {c})"


def _letter(p: str, shift: int, c: str = "c") -> str:
    return f"substr('ACGT', int(1 + ({_x(p, c)} + {shift}) % 4), 1)"


def _base(p: int, shift: int, c: int) -> str:
    """As :func:`_letter`, in Python."""
    return "ACGT"[(p * p * 3 + p * 5 + p * p * p % 11 + c + shift) % 4]


@cache
def _haplotype_rows() -> list[tuple[int, int, int, str, str]]:
    rows = []
    for c in range(1, CONTIGS + 1):
        plain = "".join(_base(p, 0, c) for p in range(CONTIG_LENGTH + 9))
        for het in (0, 1):
            for som in (0, 1):
                text = "".join(
                    _base(p, 1, c) if p % 89 == 5 or (het and p % 97 == 13) or (som and p % 101 == 7) else plain[p]
                    for p in range(CONTIG_LENGTH + 9)
                )
                rows.append((c, het, som, text, plain))
    return rows


def _haplotypes(spark: SparkSession) -> DataFrame:
    """The contig texts a read can come from: 4 contigs x heterozygous flag x somatic flag."""
    rows = spark.createDataFrame(_haplotype_rows(), "c long, het long, som long, hap_text string, contig_text string")
    # Binary, where a slice does not walk the text before it.
    return rows.withColumns({t: F.col(t).cast("binary") for t in ("hap_text", "contig_text")})


def read_layout(lineitem: DataFrame) -> DataFrame:
    """Position, shape and flags of every read; one row per ``lineitem`` row."""
    return lineitem.selectExpr(
        "l_orderkey AS ok",
        "1 + l_suppkey % 4 AS c",
        "concat('chr', cast(1 + l_suppkey % 4 AS STRING)) AS contig",
        f"(l_partkey * 37 + l_linenumber * 11) % {READ_START_SPAN} AS start",
        "cast(floor(l_quantity) AS BIGINT) AS len",
        "CASE WHEN floor(l_quantity) < 6 THEN 1 ELSE l_linenumber END AS shape",
        "CASE WHEN l_linestatus = 'F' THEN 'tumor' ELSE 'normal' END AS sample",
        "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS token",
        "int(20 + l_orderkey % 41) AS mapq",
        "l_orderkey % 17 = 0 AS is_dup",
        "l_orderkey % 23 = 0 AS fail_qc",
        "l_returnflag <> 'R' AS fwd",
    ).selectExpr(
        "*", "len div 2 AS h",
        "CASE shape WHEN 5 THEN len + 2 WHEN 6 THEN len - 1 WHEN 7 THEN len - 2 ELSE len END AS span",
    )


def all_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reads with CIGAR, MD, sequence and qualities; duplicates and failed reads included.

    The narrow layout rows are moved to their neighbourhood first, so text is built in parallel and
    where the pileup needs it. The 16 contig texts are a fixed-size lookup table.
    """
    layout = read_layout(table(spark, sf_dir, "lineitem")).selectExpr(
        "*",
        "if(ok % 2 = 0, 1L, 0L) AS het",
        "if(sample = 'tumor' AND ok % 3 = 0, 1L, 0L) AS som",
    )
    placed = by_neighbourhood(layout, STRETCH)
    joined = placed.join(F.broadcast(_haplotypes(spark)), ["c", "het", "som"])
    gap = "(shape = 5 AND {o} >= h AND {o} < h + 2)"
    offsets = {
        "noise": "pmod(pmod(-455 * ok, 211) - start, 211)",
        "hom": "pmod(5 - start, 89)",
        "hetero": "if(het = 1, pmod(13 - start, 97), 1000)",
        "soma": "if(som = 1, pmod(7 - start, 101), 1000)",
    }
    cycles = ", ".join(
        "'" + "".join(chr(33 + 2 + v) for v in range(r, 40, 5)).replace("\\", "\\\\").replace("'", "\\'") + "'"
        for r in range(5)
    )
    texts = joined.selectExpr(
        "*",
        *[f"{e} AS {n}_at" for n, e in offsets.items()],
        "cast(substring(contig_text, int(start) + 1, int(span)) AS STRING) AS ref_span",
        "cast(substring(hap_text, int(start) + 1, int(span)) AS STRING) AS hap_span",
        f"substring(repeat(element_at(array({cycles}), int((ok * 3) % 40 % 5) + 1), 9), "
        "int((ok * 3) % 40 div 5) + 1, int(span)) AS q_span",
    ).drop("hap_text", "contig_text")
    noisy = _letter("(start + noise_at)", 2)
    # Every event of the MD tag is a number: twice its offset, and one more for the deletion. No two events have one
    # offset, so sorted numbers are sorted events, and most reads have one or none.
    seen = [f"if({o} < span AND NOT {gap.format(o=o)}, 2 * {o}, -1L)" for o in (f"{n}_at" for n in offsets)]
    texts = texts.selectExpr(
        "*",
        f"if(noise_at < span, overlay(hap_span PLACING {noisy} FROM int(noise_at) + 1 FOR 1), hap_span) AS text",
        f"sort_array(array_remove(array_distinct(array({', '.join(seen)}, if(shape = 5, 2 * h + 1, -1L))), -1L)) AS events",
    )
    behind = "(get(events, {k}) div 2 + 1 + get(events, {k}) % 2)"
    written = (
        f"transform(events, (e, i) -> concat(cast(e div 2 - if(i = 0, 0, {behind.format(k='i - 1')}) AS STRING), "
        "if(e % 2 = 1, '^', ''), substring(ref_span, int(e div 2) + 1, int(1 + e % 2))))"
    )
    md = (
        f"if(size(events) = 0, cast(span AS STRING), if(ref_span IS NULL, NULL, concat(array_join({written}, ''), "
        f"cast(span - {behind.format(k='size(events) - 1')} AS STRING))))"
    )

    def shaped(text: str, inserted: str, clipped: str) -> str:
        return (
            f"CASE shape WHEN 5 THEN concat(substring({text}, 1, int(h)), substring({text}, int(h) + 3)) "
            f"WHEN 6 THEN concat(substring({text}, 1, int(h)), {inserted}, substring({text}, int(h) + 1)) "
            f"WHEN 7 THEN concat({clipped}, {text}) ELSE {text} END"
        )

    return texts.selectExpr(
        "contig", "start", "start + span AS end",
        "CASE shape WHEN 5 THEN concat(h, 'M2D', len - h, 'M') WHEN 6 THEN concat(h, 'M1I', len - h - 1, 'M') "
        "WHEN 7 THEN concat('2S', len - 2, 'M') ELSE concat(len, 'M') END AS cigar",
        f"coalesce({md}, '') AS md",
        f"{shaped('text', quote('T'), quote('TT'))} AS seq",
        f"{shaped('q_span', 'char(35 + ok % 40)', quote('##'))} AS qual",
        "mapq", "sample", "token", "is_dup", "fail_qc", "fwd", f"{MAPPED} AS is_mapped", "som = 1 AS clone",
    )


def quote(text: str) -> str:
    return f"'{text}'"


def clone_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reads with the planted clone as the tumor sample and everything else as normal."""
    return reads(spark, sf_dir).withColumn("token", F.expr("if(clone, 1, 2)"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped, non-duplicate reads."""
    return all_reads(spark, sf_dir).filter("is_mapped AND NOT is_dup")


def read_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-duplicate reads without their texts: ``contig, start, end, sample, token, mapq, fwd``."""
    return read_layout(table(spark, sf_dir, "lineitem")).filter(f"NOT is_dup AND {MAPPED}").selectExpr(
        "contig", "start", "start + span AS end", "sample", "token", "mapq", "fwd"
    )


def sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored reads as SAM text lines (``value``)."""
    flag = "if(fwd, 0, 16) + if(is_dup, 1024, 0) + if(fail_qc, 512, 0)"
    # One generated row per read keeps the line text from being rebuilt for every parsed field.
    return all_reads(spark, sf_dir).selectExpr(
        "explode(array(concat_ws('\\t', 'r', cast("
        f"{flag} AS STRING), contig, cast(start + 1 AS STRING), cast(mapq AS STRING), cigar, '*', '0', "
        "'0', seq, qual, concat('RG:Z:', sample), concat('MD:Z:', md)))) AS value"
    )


#: Reads of every kind, as flag, MAPQ (0 for the row's own), CIGAR, SEQ, QUAL and MD. Row
#: ``i`` of ``lineitem`` is of kind ``(l_orderkey + l_linenumber) % 18``.
ODD_READS = [
    (0, 0, "4M", "ACGT", "IIII", "4"),
    (0, 0, "3M", "ACG", "III", ""),
    (0, 0, "3M", "ACG", "*", "3"),
    (0, 0, "3M", "ANG", "III", "1C1"),
    (0, 0, "2=1X1=", "ACGT", "IIII", ""),
    (0, 0, "2H1S3M1S", "TACGT", "IIIII", "3"),
    (0, 0, "2M3N2M", "ACGT", "IIII", "4"),
    (0, 0, "2M1P1I1P1I2M", "ACTTGT", "IIIIII", "4"),
    (0, 0, "4M", "ac.t", "IIII", "4"),
    (0, 0, "4M", "*", "*", "4"),
    (0, 0, "4M", "ACGT", "IIII", "2"),
    (0, 255, "4M", "ACGT", "IIII", "4"),
    (4, 0, "*", "ACGT", "IIII", ""),
    (0, 0, "5M", "ACGT", "IIII", "5"),
    (1024, 0, "4M", "TTTT", "IIII", "4"),
    (512, 0, "4M", "GGGG", "IIII", "4"),
    (16, 0, "2M2D2M", "ACGT", "IIII", "2^GG2"),
    (0, 0, "1M", "C", "I", "1"),
]


def odd_sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAM text lines of the kinds in ``ODD_READS``; the last kind lies before the first position, and every third
    order has no read group."""
    pick = lambda i: f"element_at(array({', '.join(repr(str(r[i])) for r in ODD_READS)}), kind + 1)"
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS ok", "concat('chr', cast(1 + l_suppkey % 4 AS STRING)) AS contig",
        f"10 + (l_partkey * 37 + l_linenumber * 11) % {READ_START_SPAN} AS start",
        f"int((l_orderkey + l_linenumber) % {len(ODD_READS)}) AS kind",
    )
    return rows.selectExpr(
        "concat_ws('\\t', 'r', " + pick(0) + ", if(kind = 12, '*', contig), "
        f"if(kind = {len(ODD_READS) - 1}, '0', cast(start + 1 AS STRING)), "
        f"if({pick(1)} = '0', cast(20 + ok % 41 AS STRING), {pick(1)}), {pick(2)}, '*', '0', '0', {pick(3)}, {pick(4)}, "
        "if(ok % 3 = 0, NULL, if(ok % 2 = 0, 'RG:Z:tumor', 'RG:Z:normal')), "
        f"if({pick(5)} = '', NULL, concat('MD:Z:', {pick(5)}))) AS value"
    )


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAM header lines: a contig per region, its length from the number of its nations' customers."""
    counts = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 4).alias("n")).agg(F.count("*").alias("size"))
    return counts.selectExpr(
        "explode(array(concat('@SQ\tSN:chr', cast(n + 1 AS STRING), '\tLN:', cast(1000 + size AS STRING)), "
        "'@CO\tSN:none\tLN:1')) AS value"
    )


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals with a value, one per ``orders`` row, over contigs of 200,000 loci."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('chr', cast(1 + o_custkey % 4 AS STRING)) AS contig",
        "(o_orderkey * 7919 + o_custkey * 31) % 200000 AS start",
        "(o_orderkey * 7919 + o_custkey * 31) % 200000 + 1 + o_custkey % 40 AS end",
        "o_orderstatus AS value",
    )


def wide_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of 1 to 100,000,000 loci with a value; rows of the orders table."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('chr', cast(1 + o_custkey % 4 AS STRING)) AS contig",
        f"(o_orderkey * 7919 + o_custkey * 31) % {WIDE_SPAN} AS start",
        f"(o_orderkey * 7919 + o_custkey * 31) % {WIDE_SPAN} + CASE WHEN o_orderkey % 200 = 0 "
        "THEN 1000000 * (1 + (o_orderkey div 200) % 100) "
        "ELSE (1 + o_custkey % 40) * CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 1000 END END AS end",
        "o_orderstatus AS value",
    )


def written_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deletion of 1 to 3 bases for each row of ``lineitem``, written with up to two bases around it."""
    letters = [_letter(f"(at + {k})", 0) for k in range(6)]
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "1 + l_suppkey % 4 AS c", "(l_partkey * 37 + l_linenumber * 11) % 1900 + 20 AS p", "1 + l_linenumber % 3 AS m", "l_orderkey % 3 AS left",
        "l_orderkey % 2 AS right",
    ).selectExpr("c", "m", "left", "right", "p - left AS at").selectExpr("*", f"concat({', '.join(letters)}) AS text")
    return rows.selectExpr(
        "concat('chr', cast(c AS STRING)) AS contig", "at AS pos", "substring(text, 1, int(left + m + right)) AS ref",
        "concat(substring(text, 1, int(left)), substring(text, int(left + m) + 1, int(right))) AS alt",
    )


def wide_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A locus for each row of ``lineitem``, over the stretch of :func:`wide_ranges`."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('chr', cast(1 + l_suppkey % 4 AS STRING)) AS contig",
        f"(l_orderkey * 104729 + l_partkey * 37 + l_linenumber) % {WIDE_SPAN} AS locus",
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short target intervals in read coordinates, one per ``supplier`` row."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('chr', cast(1 + s_suppkey % 4 AS STRING)) AS contig",
        f"(s_suppkey * 37) % {READ_START_SPAN} AS start",
        f"(s_suppkey * 37) % {READ_START_SPAN} + 1 + s_suppkey % 7 AS end",
        "s_nationkey % 5 AS value",
    )


def contig_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``[0, largest read end)`` of every contig, from the reads."""
    return read_spans(spark, sf_dir).groupBy("contig").agg(
        F.lit(0).cast("bigint").alias("start"), F.max("end").alias("end")
    )


def reference(spark: SparkSession, sf_dir: str, length: int = FRAGMENT) -> DataFrame:
    """Reference fragments over the loci the reads span."""
    extent = contig_loci(spark, sf_dir)
    frags = extent.selectExpr(
        "contig", "cast(substring(contig, 4) AS BIGINT) AS c", "end",
        f"explode(sequence(0L, (end - 1) div {length})) AS frag",
    )
    text = (
        f"array_join(transform(sequence(frag * {length}, least((frag + 1) * {length}, end) - 1), "
        f"p -> {_letter('p', 0)}), '')"
    )
    return frags.select(
        "contig", fragment_number(length), F.expr(f"frag * {length}").alias("frag_start"),
        F.expr(f"cast({text} AS BINARY)").alias("bases"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted genotypes at the loci the reads span; sample ``truth``."""
    hom, het, som = "locus % 89 = 5", "locus % 97 = 13", "locus % 101 = 7"
    return (
        contig_loci(spark, sf_dir)
        .selectExpr(
            "contig", "cast(substring(contig, 4) AS BIGINT) AS c",
            "explode(sequence(start, end - 1)) AS locus",
        )
        .filter(f"{hom} OR {het} OR {som}")
        .selectExpr(
            "contig", "locus AS pos", f"{_letter('locus', 0)} AS ref", f"{_letter('locus', 1)} AS alt",
            "'truth' AS sample",
            f"if({hom}, array('Alt', 'Alt'), array('Ref', 'Alt')) AS alleles",
        )
    )
