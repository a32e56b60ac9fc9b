"""Locus specs such as ``chr1:100-200,chr2:0-50`` as interval tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.operators.intervals import merge

# Fixed value: the spec of one range.
_RANGE = r"^([^:,]+):([0-9]+)-([0-9]+)$"


def parse_specs(specs: DataFrame, column: str = "spec") -> DataFrame:
    """Every range of every spec text as ``contig, start, end`` plus the other columns.

    Spaces are ignored, empty ranges are kept out, malformed text raises when the row is read.
    """
    others = [c for c in specs.columns if c != column]
    pieces = specs.select(
        *others, F.explode(F.split(F.regexp_replace(column, r"\s", ""), ",")).alias("_piece")
    ).filter("_piece <> ''")
    problem = F.raise_error(F.concat(F.lit("bad locus range: "), F.col("_piece")))
    # Positions come from the checked text too, so that no later filter can hide a bad range.
    piece = F.when(F.col("_piece").rlike(_RANGE), F.col("_piece")).otherwise(problem)
    start = F.regexp_extract(piece, _RANGE, 2).try_cast("bigint")
    end = F.regexp_extract(piece, _RANGE, 3).try_cast("bigint")
    return pieces.select(
        *others,
        F.regexp_extract(piece, _RANGE, 1).alias("contig"),
        start.alias("start"),
        F.when(end >= start, end).otherwise(problem.cast("bigint")).alias("end"),
    ).filter("end > start")


def parse(spark: SparkSession, spec: str) -> DataFrame:
    """A locus set from one spec string: disjoint, coalesced intervals."""
    return merge(parse_specs(spark.createDataFrame([(spec,)], "spec string")))


def all_contigs(contigs: DataFrame) -> DataFrame:
    return contigs.select("contig", F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end"))


def from_reads(reads: DataFrame) -> DataFrame:
    """``[0, largest read end)`` per contig."""
    return reads.groupBy("contig").agg(
        F.lit(0).cast("bigint").alias("start"), F.max("end").alias("end")
    )


def select_loci(spark: SparkSession, spec: str, contigs: DataFrame) -> DataFrame:
    """``all`` takes every contig, anything else is a spec string."""
    return all_contigs(contigs) if spec == "all" else parse(spark, spec)
