"""Reads stored by position: bucketed tables whose pileups and pairs need no further shuffle.

:func:`write_reads` shuffles reads once, when they are stored. A row is a read and a stretch of its contig
that the read touches; rows lie in buckets by contig and stretch, sorted by start. Every stretch is
then complete on its own, so pileups are aggregated where the rows are, and two tables of equal layout can be joined
bucket by bucket (:func:`join_in_place`). Reads that touch several stretches are stored once for each; ``first`` marks the
copy at the start, so plain scans see each read once.

One task reads one bucket. Deep loci are no matter, as pileups are aggregates; a single stretch that holds a
large part of all reads is, so choose a smaller ``width`` for such data (amplicons), or the callers
over unstored reads, which split hot stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.operators.pileup import elements

#: Loci of a stretch and files of a table by default.
WIDTH, BUCKETS = 16_384, 64
KEYS = ["contig", "stretch"]
#: Spark's setting that makes a join shuffle both sides unless they are partitioned by every join key.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def _stretch(locus: Column, width: int) -> Column:
    return F.floor(locus / width).cast("bigint")


def write_reads(
    reads: DataFrame, table: str, buckets: int = BUCKETS, width: int = WIDTH, path: str | None = None
) -> DataFrame:
    """Store reads as ``table`` (at ``path``, else in the warehouse) and return it as :func:`read_stored` does.

    A table of that name must not exist. Reads without a start are kept under the null stretch, reads without an end
    lie in the stretch of their start. Columns ``stretch`` and ``first`` are replaced.

    The shuffle is a rebalance by stretch: adaptive execution sizes the writing tasks by their bytes and splits stretches
    that hold many reads, so a task sorts a bounded part of a bucket and a large bucket has several files.
    """
    low = _stretch(F.col("start"), width)
    high = _stretch(F.greatest(F.col("end"), F.col("start") + 1) - 1, width)
    rows = reads.drop("stretch", "first").withColumn("stretch", F.explode_outer(F.sequence(low, high)))
    rows = rows.withColumn("first", F.coalesce(F.col("stretch") == low, F.lit(True))).withColumn(
        "stretch", F.col("stretch").alias("stretch", metadata={"width": width})
    )
    writer = rows.hint("rebalance", *[F.col(c) for c in KEYS]).write.format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS, "start")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return read_stored(reads.sparkSession, table)


def join_in_place(spark: SparkSession) -> None:
    """Let joins of this session use a partitioning by some of their keys, as :func:`stored_pair` wants.

    A setting of the whole session, so it is the caller's choice: other joins of bucketed tables then stay
    in their buckets too, and adaptive execution does not split those.
    """
    spark.conf.set(ALL_KEYS, "false")


def read_stored(spark: SparkSession, table: str) -> DataFrame:
    """A stored table: the columns of its reads, ``stretch`` and ``first``."""
    return spark.table(table)


def width_of(stored: DataFrame) -> int:
    """Loci of a stretch, from the table's schema."""
    return stored.schema["stretch"].metadata["width"]


def whole_reads(stored: DataFrame) -> DataFrame:
    """Every stored read once."""
    return stored.filter("first").drop("stretch", "first")


def reads_in_range(stored: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Reads that overlap ``[start, end)`` of a contig, each once; an empty range has none.

    The conditions on contig, stretch and start reach the files' statistics, and rows are sorted by them.
    """
    if end <= start:
        return whole_reads(stored).limit(0)
    width = width_of(stored)
    low, high = start // width, (end - 1) // width
    near = stored.filter((F.col("contig") == contig) & F.col("stretch").between(low, high) & (F.col("start") < end))
    # The copy in the first stretch of the range, or the one at the read's start inside it.
    once = F.col("first") | (F.col("stretch") == low)
    return near.filter((F.col("end") > start) & once).drop("stretch", "first")


def stored_elements(stored: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`~lociforge.operators.pileup.elements` of stored reads with their ``stretch``, each element once."""
    rows = elements(stored, keep=("stretch", *keep))
    return rows.filter(_stretch(F.col("locus"), width_of(stored)) == F.col("stretch"))


def stored_pileup(stored: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates per locus, ``contig, stretch, locus`` and theirs, computed inside the buckets without a shuffle."""
    return stored_elements(stored).groupBy(*KEYS, "locus").agg(*aggregates)


def stored_pair(left: DataFrame, right: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates per locus of two stored tables side by side, as ``<name>_1`` and ``<name>_2``.

    A locus may be missing on either side. After :func:`join_in_place`, tables of one width and one number of
    buckets are joined without a shuffle; else the aggregated rows, one per locus, are shuffled for the join.
    Tables of two widths raise ``ValueError``.
    """
    if width_of(left) != width_of(right):
        raise ValueError("the tables are stored with stretches of different width")
    keys = [*KEYS, "locus"]

    def side(stored: DataFrame, n: int) -> DataFrame:
        found = stored_pileup(stored, *aggregates)
        return found.select(*keys, *[F.col(c).alias(f"{c}_{n}") for c in found.columns if c not in keys])

    return side(left, 1).join(side(right, 2), keys, "full_outer").drop("stretch")
