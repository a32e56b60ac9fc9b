"""Interval overlap as a binned equi-join, never a nested loop.

The right side is always a disjoint set or map, as locus sets and maps are, so one bin of it holds
at most ``bin_width`` ranges and a left row meets a bounded number of candidates per bin. Bins come in two
sizes: a long range lies in small bins at its ends and in large ones between, so a whole contig has a row for
each 65,536 loci; a left row looks into both. The left
side may be skewed at will: adaptive execution splits hot join partitions, or broadcasts the right
side when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.operators.intervals import JOIN_BIN, merge_with_previous, with_previous


#: Small bins to a large one.
LARGE = 256


def _bins(a: str, b: str, width: int) -> str:
    return (
        f"if({b} > {a}, sequence(cast(floor({a} / {width}) as bigint), cast(floor(({b} - 1) / {width}) as bigint)), cast(array() as array<bigint>))"
    )


def _bins_touched(a: str, b: str, width: int) -> Column:
    """The bins of both sizes that ``[a, b)`` touches; large ones count down from -1."""
    large = f"transform({_bins(a, b, width * LARGE)}, x -> -1 - x)"
    return F.expr(f"concat({_bins(a, b, width)}, {large})")


def _bins_filled(a: str, b: str, width: int) -> Column:
    """The bins that ``[a, b)`` lies in: large ones where it fills them, small ones at its ends."""
    size = width * LARGE
    first, last = f"cast(ceil({a} / {size}) as bigint)", f"cast(floor({b} / {size}) as bigint)"
    ends = f"concat({_bins(a, f'{first} * {size}', width)}, {_bins(f'{last} * {size}', b, width)})"
    large = f"transform(sequence({first}, {last} - 1), x -> -1 - x)"
    return F.expr(f"if({first} < {last}, concat({ends}, {large}), {_bins(a, b, width)})")


def _bin_of(locus: Column, like: Column, width: int) -> Column:
    """The bin of a locus, of the size of the bin ``like``."""
    return F.when(like >= 0, F.floor(locus / width)).otherwise(-1 - F.floor(locus / (width * LARGE))).cast("bigint")


def _met(reads: DataFrame, ranges: DataFrame, half_window: int, width: int, how: str = "inner") -> DataFrame:
    """Rows that share a bin, with ``_hit``: the two overlap and this is the first bin they share.

    Outer joins keep rows of either side that meet nothing; their ``_hit`` is false.
    """
    left = reads.withColumn(
        "_from", F.greatest(F.col("start") - half_window, F.lit(0)).cast("bigint")
    ).withColumn("_to", (F.col("end") + half_window).cast("bigint"))
    if how != "left":
        left = left.filter("_to > _from")
    left = left.select("*", F.explode_outer(_bins_touched("_from", "_to", width)).alias("_bin"))
    right = ranges.select(
        F.col("contig").alias("_contig"), *[c for c in ranges.columns if c != "contig"],
        F.explode_outer(_bins_filled("_start", "_end", width)).alias("_range_bin"),
    )
    first_shared = _bin_of(F.greatest("_from", "_start"), F.col("_bin"), width)
    hit = (F.col("_from") < F.col("_end")) & (F.col("_start") < F.col("_to")) & (F.col("_bin") == first_shared)
    same = (F.col("contig") == F.col("_contig")) & (F.col("_bin") == F.col("_range_bin"))
    return left.join(right, same, how).withColumn("_hit", F.coalesce(hit, F.lit(False)))


def _candidates(reads: DataFrame, ranges: DataFrame, half_window: int, width: int) -> DataFrame:
    """Each overlapping (read, range) pair once."""
    return _met(reads, ranges, half_window, width).filter("_hit").drop("_hit", "_contig", "_range_bin")


def _is_first() -> Column:
    """The earliest range of its key that the read touches."""
    return F.col("_prev").isNull() | (F.col("_prev") <= F.col("_from"))


def overlapping_values(
    reads: DataFrame,
    intervals: DataFrame,
    value: str = "value",
    half_window: int = 0,
    bin_width: int = JOIN_BIN,
    disjoint: bool = False,
) -> DataFrame:
    """Each read once per distinct ``value`` of the locus map it overlaps, padded by the window.

    Reads that overlap nothing are dropped. No read id and no distinct is needed: a read counts for
    a value at the first range of that value it touches. ``disjoint`` says that the map has no
    overlaps, as overlay and splitting give it, and saves merging it again.
    """
    ranges = value_ranges(intervals, value, disjoint)
    hits = _candidates(reads, ranges, half_window, bin_width).filter(_is_first())
    return hits.select(*[F.col(c) for c in reads.columns], value)


def value_ranges(intervals: DataFrame, value: str, disjoint: bool) -> DataFrame:
    """The ranges of a map as the right side of a join, with the end of the range before of the same value."""
    normal = with_previous if disjoint else merge_with_previous
    return normal(intervals, ("contig", value)).select(
        "contig", value,
        F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("prev_end").alias("_prev"),
    )


def values_met(
    spots: DataFrame, intervals: DataFrame, value: str = "value", half_window: int = 0,
    bin_width: int = JOIN_BIN, disjoint: bool = False,
) -> DataFrame:
    """Each row of distinct ``spots`` with ``copies``, the number of distinct values it overlaps, zero included."""
    met = _met(spots, value_ranges(intervals, value, disjoint), half_window, bin_width, "left")
    return met.groupBy(*spots.columns).agg(F.count_if(F.col("_hit") & _is_first()).alias("copies"))


def rows_per_value(
    spots: DataFrame, intervals: DataFrame, n: str, value: str = "value",
    bin_width: int = JOIN_BIN, disjoint: bool = False,
) -> DataFrame:
    """``value`` and the sum of ``n`` over the spots that overlap it, zero included."""
    met = _met(spots, value_ranges(intervals, value, disjoint), 0, bin_width, "right")
    return met.groupBy(value).agg(F.sum(F.when(F.col("_hit") & _is_first(), F.col(n)).otherwise(0)).cast("bigint").alias(n))


def overlapping_pairs(
    reads: DataFrame, intervals: DataFrame, half_window: int = 0, bin_width: int = JOIN_BIN
) -> DataFrame:
    """Every (read, range) pair that overlaps, with the range as ``range_start, range_end``."""
    extra = [c for c in intervals.columns if c not in ("contig", "start", "end")]
    ranges = intervals.filter("end > start").select(
        "contig", *extra, F.col("start").alias("_start"), F.col("end").alias("_end")
    )
    hits = _candidates(reads, ranges, half_window, bin_width)
    return hits.select(
        *[F.col(c) for c in reads.columns],
        F.col("_start").alias("range_start"), F.col("_end").alias("range_end"), *extra,
    )


def first_overlaps(
    reads: DataFrame, loci: DataFrame, half_window: int = 0, bin_width: int = JOIN_BIN, disjoint: bool = False
) -> DataFrame:
    """Each read that touches the set, once, with its padded span ``_from, _to`` and the first
    range it touches as ``_start, _end``."""
    ranges = (with_previous if disjoint else merge_with_previous)(loci).select(
        "contig",
        F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("prev_end").alias("_prev"),
    )
    return _candidates(reads, ranges, half_window, bin_width).filter(_is_first()).drop("_prev", "_bin")


def overlapping(
    reads: DataFrame, loci: DataFrame, half_window: int = 0, bin_width: int = JOIN_BIN, disjoint: bool = False
) -> DataFrame:
    """Reads that overlap a locus set at all (semi join), each kept exactly once."""
    return first_overlaps(reads, loci, half_window, bin_width, disjoint).select(*reads.columns)


def lookup(points: DataFrame, intervals: DataFrame, bin_width: int = JOIN_BIN) -> DataFrame:
    """Rows with a ``locus`` inside the set or map, plus the columns of the range they fall in."""
    extra = [c for c in intervals.columns if c not in ("contig", "start", "end")]
    right = intervals.filter("end > start").select(
        "contig", *extra, F.col("start").alias("_start"), F.col("end").alias("_end")
    )
    right = right.select("*", F.explode(_bins_filled("_start", "_end", bin_width)).alias("_bin"))
    left = points.select("*", F.explode(_bins_touched("locus", "(locus + 1)", bin_width)).alias("_bin"))
    return (
        left.join(right, ["contig", "_bin"])
        .filter((F.col("locus") >= F.col("_start")) & (F.col("locus") < F.col("_end")))
        .select(*[F.col(c) for c in points.columns], *extra)
    )


def values_in_ranges(
    ranges: DataFrame, intervals: DataFrame, value: str = "value", disjoint: bool = False
) -> DataFrame:
    """Every query range with each distinct value it meets, one row per (range, value)."""
    return overlapping_values(ranges, intervals, value, disjoint=disjoint)


def overlaps_locus(locus: Column | int, half_window: int = 0) -> Column:
    """Does the read touch ``[locus - half_window, locus + half_window]``?"""
    point = F.lit(locus) if isinstance(locus, int) else locus
    return (F.col("start") - half_window <= point) & (F.col("end") + half_window > point)


def intersects(loci: DataFrame, start: int, end: int) -> DataFrame:
    """Ranges of a locus set that share a locus with ``[start, end)``; none for empty ranges."""
    if end <= start:
        return loci.limit(0)
    return loci.filter((F.col("start") < end) & (F.col("end") > start))

