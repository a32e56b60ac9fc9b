"""Counters and reports that ride along with a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lociforge.operators.overlap import values_met


def observed_count(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows as they pass. ``observation.get`` has the number after the next action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def scan_counters(reads: DataFrame, buckets: DataFrame, half_window: int = 0) -> DataFrame:
    """Total reads, reads that touch any bucket, (read, bucket) rows and the expansion percent.

    Reads are first reduced to distinct positions with a count, so each position is joined once.
    Buckets are disjoint, as splitting gives them.
    """
    spots = reads.groupBy("contig", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    met = values_met(spots, buckets, half_window=half_window, disjoint=True)
    n, copies = F.col("n"), F.col("copies")
    sums = met.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
            for name, c in (("total", n), ("relevant", F.when(copies > 0, n)), ("expanded", n * copies))
        ]
    )
    return sums.withColumn(
        "expansion_percent",
        F.try_divide((F.col("expanded") - F.col("relevant")) * 100.0, F.col("relevant")),
    )


def skew_report(counts: DataFrame, column: str = "reads") -> DataFrame:
    """Spread of a per-bucket count: min, quartiles, mean, max and by how much max tops the mean."""
    quartile: Column = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return counts.agg(
        F.min(column).alias("min"),
        quartile.alias("_q"),
        F.avg(column).alias("mean"),
        F.max(column).alias("max"),
    ).select(
        "min",
        F.col("_q")[0].alias("p25"),
        F.col("_q")[1].alias("median"),
        "mean",
        F.col("_q")[2].alias("p75"),
        "max",
        F.try_divide((F.col("max") - F.col("mean")) * 100.0, F.col("mean")).alias("max_over_mean_percent"),
    )


def range_report(counts: DataFrame, column: str = "reads") -> DataFrame:
    return counts.agg(
        F.min(column).alias("min"), F.avg(column).alias("mean"), F.max(column).alias("max")
    )
