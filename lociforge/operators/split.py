"""Splitting loci into buckets: evenly, or so that buckets overlap about as many reads.

The result is a locus map ``contig, start, end, value`` where ``value`` is the bucket number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.operators.intervals import merge, with_offsets
from lociforge.operators.overlap import rows_per_value
from lociforge.operators.prefix import running_total

# Fixed value: default number of micro buckets per bucket.
ACCURACY = 250


def _edge(k: Column, per_bucket: Column) -> Column:
    """First locus of bucket ``k``: the rounded multiple of the bucket size."""
    return F.floor(k * per_bucket + F.lit(0.5)).cast("bigint")


def _bucket_of(x: Column, per_bucket: Column) -> Column:
    guess = F.floor(x / per_bucket).cast("bigint")
    return (
        F.when(_edge(guess + 1, per_bucket) <= x, guess + 1)
        .when(_edge(guess, per_bucket) > x, guess - 1)
        .otherwise(guess)
    )


def _even_pieces(loci: DataFrame, buckets: int, at_most_loci: bool = False, disjoint: bool = False) -> DataFrame:
    """Ranges cut at bucket edges: ``contig, start, end, value, at`` (``at`` counts loci before).

    ``at_most_loci`` lowers the bucket count to the number of loci.
    """
    loci = loci.select("contig", "start", "end")
    n = F.lit(buckets).cast("bigint")
    if at_most_loci:
        n = F.least(n, F.col("total"))
    placed = with_offsets(loci if disjoint else merge(loci)).withColumn(
        "_per", F.greatest(F.lit(1.0), F.col("total").cast("double") / n.cast("double"))
    )
    last = F.col("offset") + F.col("end") - F.col("start") - 1
    return (
        placed.select(
            "*",
            F.explode(
                F.sequence(_bucket_of(F.col("offset"), F.col("_per")), _bucket_of(last, F.col("_per")))
            ).alias("value"),
        )
        .withColumn("_from", F.greatest(F.col("offset"), _edge(F.col("value"), F.col("_per"))))
        .withColumn(
            "_to",
            F.least(
                F.col("offset") + F.col("end") - F.col("start"),
                _edge(F.col("value") + 1, F.col("_per")),
            ),
        )
        .select(
            "contig",
            (F.col("start") + F.col("_from") - F.col("offset")).alias("start"),
            (F.col("start") + F.col("_to") - F.col("offset")).alias("end"),
            "value",
            F.col("_from").alias("at"),
        )
        .filter("end > start")
    )


def split_evenly(loci: DataFrame, buckets: int, disjoint: bool = False) -> DataFrame:
    """Bucket ``k`` starts at the rounded ``k * max(1, loci / buckets)``-th locus.

    ``disjoint`` says that the loci are a merged set and need no merging.
    """
    return _even_pieces(loci, buckets, disjoint=disjoint).drop("at")


def reads_per_bucket(reads: list[DataFrame] | tuple[DataFrame, ...], buckets: DataFrame) -> DataFrame:
    """``value, reads``: overlapping reads of all read sets per bucket, zero-read buckets included.

    A read that overlaps two buckets counts for both. Buckets are disjoint. Reads are counted at distinct
    positions first, so copies are joined once.
    """
    spots = (
        reduce(DataFrame.unionByName, [one.select("contig", "start", "end") for one in reads])
        .groupBy("contig", "start", "end").agg(F.count(F.lit(1)).alias("reads"))
    )
    return rows_per_value(spots, buckets, "reads", disjoint=True)


def split_by_depth(
    loci: DataFrame, buckets: int, *reads: DataFrame, accuracy: int = ACCURACY, disjoint: bool = False
) -> DataFrame:
    """Locus map whose buckets overlap about the same number of reads.

    Loci are cut into ``buckets * accuracy`` even micro buckets, reads are counted per micro
    bucket, and the running count says where each bucket edge falls; inside a micro bucket reads
    are taken to lie evenly. A micro bucket without reads stays with the bucket before it.
    """
    micro = _even_pieces(loci, buckets * accuracy, at_most_loci=True, disjoint=disjoint)
    sizes = micro.groupBy("value").agg(
        F.sum(F.col("end") - F.col("start")).alias("size"), F.min("at").alias("at")
    )
    counts = reads_per_bucket(reads, micro.drop("at"))
    sized = (
        sizes.join(counts, "value", "left")
        .select(
            F.lit(0).alias("all"), F.col("value").alias("micro"), "size", "at",
            F.coalesce("reads", F.lit(0)).cast("bigint").alias("reads"),
        )
    )
    # Micro buckets can be many: their running total works in stretches.
    table = (
        running_total(sized, ["all"], "micro", "reads", "upto", ("size", "at"), total="_total")
        .withColumn("before", F.col("upto") - F.col("reads"))
        .withColumn("_per", F.greatest(F.lit(1.0), F.col("_total").cast("double") / F.lit(float(buckets))))
    )
    cuts = table.select("micro", "at", F.explode(_cuts()).alias("c")).select(
        "micro",
        (F.col("at") + F.col("c.from")).alias("cut_from"),
        (F.col("at") + F.col("c.to")).alias("cut_to"),
        F.col("c.bucket").alias("bucket"),
    )
    pieces = micro.withColumnRenamed("value", "micro").withColumn(
        "_end_at", F.col("at") + F.col("end") - F.col("start")
    )
    joined = pieces.join(cuts, "micro").filter(
        (F.col("cut_from") < F.col("_end_at")) & (F.col("cut_to") > F.col("at"))
    )
    low = F.greatest(F.col("at"), F.col("cut_from")) - F.col("at")
    high = F.least(F.col("_end_at"), F.col("cut_to")) - F.col("at")
    return merge(
        joined.select(
            "contig",
            (F.col("start") + low).alias("start"),
            (F.col("start") + high).alias("end"),
            F.col("bucket").alias("value"),
        ),
        ("contig", "value"),
    )


def _cuts() -> Column:
    """Loci ranges of one micro bucket per target bucket: ``ARRAY<STRUCT<from, to, bucket>>``.

    Walks the bucket edges that fall strictly inside this micro bucket's read range. Each step
    takes the share of the remaining loci that its share of the remaining reads stands for, one
    locus at least.
    """
    edge = "cast(floor({k} * _per + 0.5) AS BIGINT)"
    guess = "cast(floor({x} / _per) AS BIGINT)"

    def count_edges(x: str, compare: str) -> str:
        # Number of k >= 1 whose edge lies below x ("<") or at most at x ("<=").
        g = guess.format(x=x)
        k1, k0, km = (edge.format(k=f"({g} + {d})") for d in (1, 0, -1))
        return (
            f"greatest(CASE WHEN {k1} {compare} {x} THEN {g} + 1 "
            f"WHEN {k0} {compare} {x} THEN {g} WHEN {km} {compare} {x} THEN {g} - 1 "
            f"ELSE {g} - 2 END, 0L)"
        )

    first = count_edges("before", "<=")
    lazy = count_edges("before", "<")
    last = count_edges("upto", "<")
    struct = "ARRAY<STRUCT<from: BIGINT, to: BIGINT, bucket: BIGINT>>"
    return F.expr(f"""
      CASE WHEN reads = 0 THEN
        array(named_struct('from', 0L, 'to', size, 'bucket', {lazy}))
      ELSE aggregate(
        CASE WHEN {last} > {first} THEN sequence({first} + 1, {last}) ELSE cast(array() AS ARRAY<BIGINT>) END,
        named_struct('at', 0L, 'seen', before, 'bucket', {first}, 'out', cast(array() AS {struct})),
        (s, k) -> named_struct(
          'at', s.at + least(size - s.at, greatest(1L, cast(floor(
              cast({edge.format(k='k')} - s.seen AS DOUBLE) / (upto - s.seen) * (size - s.at)) AS BIGINT))),
          'seen', {edge.format(k='k')},
          'bucket', k,
          'out', concat(s.out, array(named_struct(
            'from', s.at,
            'to', s.at + least(size - s.at, greatest(1L, cast(floor(
              cast({edge.format(k='k')} - s.seen AS DOUBLE) / (upto - s.seen) * (size - s.at)) AS BIGINT))),
            'bucket', s.bucket)))),
        s -> filter(concat(s.out, array(named_struct('from', s.at, 'to', size, 'bucket', s.bucket))),
                    c -> c.to > c.from)) END
    """)


def split_loci(
    loci: DataFrame, reads: list[DataFrame], buckets: int = 0, accuracy: int = ACCURACY, disjoint: bool = False
) -> DataFrame:
    """Even split when ``accuracy`` is 0, depth-balanced split otherwise.

    With 0 ``buckets`` there are as many as the session's default parallelism.
    """
    buckets = buckets or loci.sparkSession.sparkContext.defaultParallelism
    if accuracy == 0:
        return split_evenly(loci, buckets, disjoint)
    return split_by_depth(loci, buckets, *reads, accuracy=accuracy, disjoint=disjoint)
