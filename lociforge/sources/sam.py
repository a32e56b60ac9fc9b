"""SAM text (or Parquet reads) as the ``reads`` DataFrame.

The header is a handful of ``@`` lines; the alignment lines are split-parallel text. Binary files
are read by :mod:`lociforge.sources.bam`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.functions.bases import normalize_contig, to_bases
from lociforge.functions.cigar import is_valid_cigar, read_length, reference_length, unclipped_start
from lociforge.sources.genotypes import is_parquet

# SAM flag bits, the "unknown mapping quality" number and the default sample name.
FLAG_UNMAPPED, FLAG_REVERSE, FLAG_FAIL, FLAG_DUPLICATE = 4, 16, 512, 1024
UNKNOWN_MAPQ = 255
DEFAULT_SAMPLE = "default"

READ_COLUMNS = [
    "contig", "start", "end", "cigar", "md", "seq", "qual", "mapq", "sample", "token",
    "is_dup", "fail_qc", "fwd", "is_mapped",
]


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


def contig_dictionary(lines: DataFrame) -> DataFrame:
    """Contig names and lengths of the ``@SQ`` header lines."""
    return lines.filter(F.col("value").startswith("@SQ\t")).select(
        F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"),
        F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("bigint").alias("length"),
    )


def read_groups(lines: DataFrame) -> DataFrame:
    """Read group ids and their sample (null when the header names none)."""
    sample = F.regexp_extract("value", r"\tSM:([^\t]+)", 1)
    return lines.filter(F.col("value").startswith("@RG\t")).select(
        F.regexp_extract("value", r"\tID:([^\t]+)", 1).alias("rg"),
        F.when(sample != "", sample).alias("rg_sample"),
    )


def _tag(name: str) -> Column:
    value = F.regexp_extract("value", rf"\t{name}:Z:([^\t]*)", 1)
    return F.when(value != "", value)


def parse_alignments(
    lines: DataFrame, token: int = 0, groups: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Alignment lines as typed reads; positions become 0-based, bases upper case.

    A sequence or quality text of ``*`` is null. ``groups`` maps read group ids to samples; the header bounds
    it to one row per read group. ``strict`` is the mapped test of the slim reads.
    """
    # Null-safe access and casts: the optimizer may evaluate these on header lines as well.
    fields = F.split("value", "\t", 12)
    field = lambda i: F.get(fields, F.lit(i))
    reads = lines.filter(~F.col("value").startswith("@") & (F.length("value") > 0)).select(
        field(2).alias("contig"),
        (field(3).try_cast("bigint") - 1).alias("start"),
        field(4).try_cast("int").alias("mapq"),
        field(5).alias("cigar"),
        F.when(field(9) != "*", to_bases(field(9))).alias("seq"),
        F.when(field(10) != "*", field(10)).alias("qual"),
        _tag("MD").alias("md"),
        _tag("RG").alias("rg"),
        field(1).try_cast("int").alias("flag"),
        F.lit(token).alias("token"),
    )
    return typed_reads(reads, groups, strict)


def typed_reads(reads: DataFrame, groups: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Reads of ``READ_COLUMNS`` from their raw fields, with ``flag`` and read group ``rg``; for any scan."""
    if groups is None:
        reads = reads.withColumn("sample", F.lit(DEFAULT_SAMPLE))
    else:
        reads = reads.join(groups, "rg", "left").withColumn(
            "sample", F.coalesce("rg_sample", F.lit(DEFAULT_SAMPLE))
        )
    bit = lambda mask: F.col("flag").bitwiseAND(mask) != 0
    return (
        reads.withColumn("is_dup", bit(FLAG_DUPLICATE))
        .withColumn("fail_qc", bit(FLAG_FAIL))
        .withColumn("fwd", ~bit(FLAG_REVERSE))
        .withColumn("is_mapped", F.coalesce(is_mapped(strict), F.lit(False)))
        .withColumn(
            "end", F.when(F.col("is_mapped"), F.col("start") + reference_length("cigar"))
        )
        .select(*READ_COLUMNS)
    )


def is_mapped(strict: bool = False) -> Column:
    """Mapped test on flag, contig, mapping quality, start and unclipped start.

    Starts are tested in 1-based terms: not negative, or with ``strict`` (the slim-read variant) positive.
    """
    lowest = 1 if strict else 0
    return (
        (F.col("flag").bitwiseAND(FLAG_UNMAPPED) == 0)
        & (F.col("mapq") != UNKNOWN_MAPQ)
        & (F.col("contig") != "*")
        & is_valid_cigar("cigar")
        & (F.col("start") + 1 >= lowest)
        & (unclipped_start("start", "cigar") + 1 >= lowest)
    )


def select_reads(
    reads: DataFrame,
    mapped: bool = True,
    non_duplicate: bool = True,
    passed_quality_checks: bool = True,
    md_present: bool = False,
    consistent: bool = True,
) -> DataFrame:
    """The usual scan filters, each optional. ``consistent`` drops reads that are not :func:`well_formed`."""
    if mapped:
        reads = reads.filter("is_mapped")
    if non_duplicate:
        reads = reads.filter(~F.col("is_dup"))
    if passed_quality_checks:
        reads = reads.filter(~F.col("fail_qc"))
    if md_present:
        reads = reads.filter(F.col("md").isNotNull())
    if consistent:
        reads = reads.filter(well_formed())
    return reads


def well_formed() -> Column:
    """True when sequence, qualities and CIGAR agree on the read length, as far as they are there.

    A read without sequence passes: it has no bases that could be wrong, and none to expand. An unmapped
    one has no CIGAR (``*``) to agree with.
    """
    length = F.length("seq")
    fits = (F.col("qual").isNull() | (F.length("qual") == length)) & (
        (F.col("cigar") == "*") | (read_length("cigar") == length)
    )
    return F.coalesce(F.col("seq").isNull() | fits, F.lit(False))


def read_problems(reads: DataFrame) -> DataFrame:
    """One row that counts reads without sequence, qualities or MD, and those that are not well formed."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("seq", "qual", "md")]
    return reads.agg(F.count(F.lit(1)).alias("reads"), *missing, F.count_if(~well_formed()).alias("malformed"))


def load_reads(
    spark: SparkSession,
    path: str | list[str],
    token: int = 0,
    mapped: bool = True,
    non_duplicate: bool = True,
    passed_quality_checks: bool = True,
    header: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Reads and contig dictionary of SAM text files (or of a Parquet reads table).

    ``header`` names a text file with the header lines alone; with it the alignment files are read
    once instead of also being searched for their few header lines.
    """
    if isinstance(path, str) and is_parquet(path):
        reads = spark.read.parquet(path).withColumn("token", F.lit(token)).withColumn("seq", to_bases("seq"))
        contigs = (
            contig_dictionary(read_lines(spark, header)) if header
            else reads.groupBy("contig").agg(F.max("end").alias("length"))
        )
    else:
        lines = read_lines(spark, path)
        head = read_lines(spark, header) if header else lines
        contigs = contig_dictionary(head)
        reads = parse_alignments(lines, token, read_groups(head))
    return select_reads(reads, mapped, non_duplicate, passed_quality_checks), contigs


def load_tumor_normal(
    spark: SparkSession, tumor: str, normal: str, mapped: bool = True, non_duplicate: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both read sets in one DataFrame (token 1 tumor, 2 normal) and the two dictionaries."""
    tumor_reads, tumor_contigs = load_reads(spark, tumor, 1, mapped, non_duplicate)
    normal_reads, normal_contigs = load_reads(spark, normal, 2, mapped, non_duplicate)
    return tumor_reads.unionByName(normal_reads), tumor_contigs, normal_contigs


def same_dictionary(left: DataFrame, right: DataFrame) -> bool:
    """True when two contig dictionaries are equal. Headers are small, so this runs an action."""
    extra = left.select("contig", "length").exceptAll(right.select("contig", "length"))
    missing = right.select("contig", "length").exceptAll(left.select("contig", "length"))
    return extra.unionByName(missing).isEmpty()


def load_simple_reads(
    spark: SparkSession, path: str, mapped: bool = True, non_duplicate: bool = True, token: int = 0
) -> DataFrame:
    """Reads with normalised contig names; vendor-failed reads stay in."""
    reads, _ = load_reads(spark, path, token, mapped, non_duplicate, passed_quality_checks=False)
    return reads.withColumn("contig", normalize_contig("contig"))
