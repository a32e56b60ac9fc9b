"""Interval sets and maps: merge, union, overlay, invert, take, statistics, membership.

A locus set is ``contig, start, end`` with disjoint, coalesced rows; a locus map adds ``value``.
Merging works bin by bin along the contig, so a contig that holds most of the intervals is still
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lociforge.operators.nested import FACTOR, TOP, around, blocks
from lociforge.operators.prefix import BIN_WIDTH, position_bin, running_total

#: Width of the bins used by overlay and by overlap joins.
JOIN_BIN = 256
#: Bins to a stretch of a wide overlay.
STRETCH = 256


def merge_with_previous(
    intervals: DataFrame, keys: tuple[str, ...] = ("contig",), width: int = BIN_WIDTH
) -> DataFrame:
    """Fused intervals per ``keys`` plus ``prev_end``, the end of the one before (null if none).

    Intervals are cut at bin edges and fused inside each bin. Only the first and the last run of a
    bin can touch another bin, so only those meet in one window per key to be joined up; that is at
    most two rows per bin. Copies of a start are reduced to the longest before anything else.
    """
    bin_start, bin_end = F.col("bin") * width, (F.col("bin") + 1) * width
    pieces = (
        intervals.filter("end > start")
        .select(
            *keys, "start", "end",
            F.explode(
                F.sequence(position_bin("start", width), position_bin(F.col("end") - 1, width))
            ).alias("bin"),
        )
        .groupBy(*keys, "bin", F.greatest("start", bin_start).alias("start"))
        .agg(F.max(F.least("end", bin_end)).alias("end"))
    )
    in_bin = Window.partitionBy(*keys, "bin").orderBy("start")
    reach = F.max("end").over(in_bin.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        pieces.withColumn("reach", reach)
        .withColumn("opens", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0))
        .withColumn("run", F.sum("opens").over(in_bin.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "bin", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    by_start = Window.partitionBy(*keys, "bin").orderBy("start")
    runs = runs.withColumn("local_prev", F.lag("end").over(by_start)).withColumn(
        "outer", F.col("local_prev").isNull() | F.lead("end").over(by_start).isNull()
    )
    # The partition key is a column of its own, so that both windows below share one shuffle.
    runs = runs.withColumn("stitch", F.when(F.col("outer"), F.lit(-1)).otherwise(F.col("bin")))
    joined = Window.partitionBy(*keys, "stitch").orderBy("start")
    return (
        runs.withColumn("prev_end", F.coalesce("local_prev", F.lag("end").over(joined)))
        .withColumn(
            "head",
            F.max(
                F.when(F.col("prev_end").isNull() | (F.col("prev_end") < F.col("start")), F.col("start"))
            ).over(joined.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .groupBy(*keys, F.col("head").alias("start"))
        .agg(F.max("end").alias("end"), F.min_by("prev_end", "start").alias("prev_end"))
    )


def merge(
    intervals: DataFrame, keys: tuple[str, ...] = ("contig",), width: int = BIN_WIDTH, wide: bool = False
) -> DataFrame:
    """Fuse touching and overlapping intervals that share ``keys``.

    A long range has a row for each bin it spans. That is little for disjoint ranges; where many long ones
    overlap, ``wide`` fuses their whole bins first, at the price of reading the input twice.
    """
    return merge_with_previous(_narrowed(intervals, keys, width) if wide else intervals, keys, width).drop("prev_end")


def _narrowed(intervals: DataFrame, keys: tuple[str, ...], width: int) -> DataFrame:
    """The same loci with whole bins of ranges fused: the ends of each range, and disjoint stretches of bins."""
    a, b = F.ceil(F.col("start") / width).cast("bigint"), F.floor(F.col("end") / width).cast("bigint")
    rows = intervals.filter("end > start").select(*keys, "start", "end", a.alias("a"), b.alias("b"))
    ends = F.array(
        F.struct(F.col("start").alias("start"), (F.col("a") * width).alias("end")),
        F.struct((F.col("b") * width).alias("start"), F.col("end").alias("end")),
    )
    alone = F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end")))
    edges = rows.select(*keys, F.explode(F.when(F.col("a") < F.col("b"), ends).otherwise(alone)).alias("e")).select(*keys, "e.*")
    whole = merge(rows.filter("a < b").select(*keys, F.col("a").alias("start"), F.col("b").alias("end")), keys, BIN_WIDTH)
    return edges.filter("end > start").unionByName(
        whole.select(*keys, (F.col("start") * width).alias("start"), (F.col("end") * width).alias("end"))
    )


def with_previous(
    disjoint: DataFrame, keys: tuple[str, ...] = ("contig",), width: int = BIN_WIDTH
) -> DataFrame:
    """Disjoint rows plus ``prev_end``, the end of the one before with the same ``keys``.

    Only the first and last row of a bin look beyond it, so no window holds a whole contig.
    """
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("start")
    rows = (
        disjoint.withColumn("_bin", position_bin("start", width))
        .withColumn("_prev", F.lag("end").over(in_bin))
        .withColumn("_outer", F.col("_prev").isNull() | F.lead("end").over(in_bin).isNull())
        .withColumn("_stitch", F.when(F.col("_outer"), F.lit(-1)).otherwise(F.col("_bin")))
    )
    across = Window.partitionBy(*keys, "_stitch").orderBy("start")
    return rows.withColumn("prev_end", F.coalesce("_prev", F.lag("end").over(across))).select(
        *disjoint.columns, "prev_end"
    )


def union(*sets: DataFrame, wide: bool = False) -> DataFrame:
    """Union of any number of locus sets; ``wide`` as in :func:`merge`."""
    rows = sets[0].select("contig", "start", "end")
    for other in sets[1:]:
        rows = rows.unionByName(other.select("contig", "start", "end"))
    return merge(rows, wide=wide)


def union_maps(*maps: DataFrame, wide: bool = False) -> DataFrame:
    """Union of locus maps; on conflicts the later-starting range wins, then the later operand.

    ``wide`` is for maps with ranges as long as contigs, as in :func:`overlay`.
    """
    rows = maps[0].select("contig", "start", "end", "value", F.lit(0).alias("operand"))
    for n, other in enumerate(maps[1:], start=1):
        rows = rows.unionByName(other.select("contig", "start", "end", "value", F.lit(n).alias("operand")))
    return overlay(rows, order="operand", wide=wide)


def union_on_contig(left: DataFrame, right: DataFrame, contig: str) -> DataFrame:
    return union_maps(on_contig(left, contig), on_contig(right, contig))


def put(base: DataFrame | None, loci: DataFrame, value, wide: bool = False) -> DataFrame:
    """Add a locus set under one value to a locus map under construction; ``wide`` as in :func:`overlay`."""
    rows = loci.select("contig", "start", "end").withColumn("value", F.lit(value))
    return overlay(rows, wide=wide) if base is None else union_maps(base, rows, wide=wide)


def on_contig(intervals: DataFrame, contig: str) -> DataFrame:
    return intervals.filter(F.col("contig") == contig)


def overlay(
    intervals: DataFrame,
    value: str = "value",
    order: str | None = None,
    bin_width: int = JOIN_BIN,
    wide: bool = False,
) -> DataFrame:
    """Disjoint locus map from possibly conflicting ranges: the later-starting range wins.

    Equal starts are settled by ``order`` (larger wins), then by the larger value. Each range is
    cut into whole bins, kept as one candidate per bin, and its two ragged edges. Edges are cut at
    the endpoints of the other edges in their bin, and each piece keeps its winner. Copies shrink to
    one before the shuffle. A range has a row for each bin, which is the least work for ranges of some
    thousand loci; with ``wide`` it has three rows at most, see :func:`_latest`.
    """
    rank = F.struct(
        F.col("start").alias("s"),
        (F.col(order) if order else F.lit(0)).cast("bigint").alias("o"),
        F.col(value).alias("v"),
    )
    if wide:
        return _latest(intervals.select("contig", "start", "end", rank.alias("cand")), value, bin_width * STRETCH)
    clipped = intervals.filter("end > start").select(
        "contig", "start", "end", rank.alias("cand"),
        F.explode(
            F.sequence(
                F.floor(F.col("start") / bin_width).cast("bigint"),
                F.floor((F.col("end") - 1) / bin_width).cast("bigint"),
            )
        ).alias("bin"),
    ).select(
        "contig", "bin", "cand",
        F.greatest(F.col("start"), F.col("bin") * bin_width).alias("from"),
        F.least(F.col("end"), (F.col("bin") + 1) * bin_width).alias("to"),
    )
    whole = F.col("to") - F.col("from") == bin_width
    spans = clipped.groupBy("contig", "bin", "from", "to", whole.alias("is_whole")).agg(F.max("cand").alias("cand"))
    # A bin has at most bin_width + 1 distinct endpoints, and a range meets those it spans.
    in_bin = Window.partitionBy("contig", "bin")
    ragged = lambda name: F.collect_set(F.when(~F.col("is_whole"), F.col(name))).over(in_bin)
    spans = spans.withColumn("points", F.array_sort(F.array_union(ragged("from"), ragged("to"))))
    steps = F.expr(
        "transform(sequence(array_position(points, from), array_position(points, to) - 1), "
        "k -> named_struct('at', get(points, int(k) - 1), 'next', get(points, int(k))))"
    )
    unit = F.array(F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("next")))
    candidates = (
        spans.select("contig", "bin", "cand", F.explode(F.when(F.col("is_whole"), unit).otherwise(steps)).alias("s"))
        .groupBy("contig", "bin", F.col("s.at").alias("at"), F.col("s.next").alias("stop"))
        .agg(F.max("cand").alias("cand"))
    )
    # Row -1 of a bin is its whole-bin winner: every piece sees it, and the stretches between pieces fall to it.
    first_locus = F.col("bin") * bin_width
    rows = (
        candidates.withColumn("whole", F.max(F.when(F.col("at") < 0, F.col("cand"))).over(in_bin))
        .withColumn(
            "next", F.coalesce(F.lead("at").over(in_bin.orderBy("at")), first_locus + bin_width)
        )
        .withColumn("gap", F.when(F.col("at") < 0, first_locus).otherwise(F.col("stop")))
    )

    def piece(start: Column, end: Column, cand: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), cand["v"].alias(value))

    own = piece(F.col("at"), F.col("stop"), F.greatest("cand", "whole"))
    after = piece(F.col("gap"), F.col("next"), F.col("whole"))
    pieces = rows.select(
        "contig",
        F.explode(
            F.when(F.col("at") < 0, F.array(after))
            .when(F.col("whole").isNull(), F.array(own))
            .otherwise(F.array(own, after))
        ).alias("p"),
    ).select("contig", "p.*")
    return merge(pieces, ("contig", value))


def _latest(ranges: DataFrame, value: str, width: int) -> DataFrame:
    """Disjoint fused ``contig, value, start, end``: the value of the largest ``cand`` over each locus.

    ``cand`` is ``s, o, v`` with the start of its range first, so that ranges in order of start take over from those
    before them. A range is cut at the first and last edge between stretches of ``width`` loci. What lies between is
    overlaid in whole stretches, of which each has one winner; that winner is one more range of its stretch, from end
    to end. Then each stretch is swept once in order of start.
    """
    a, b = F.ceil(F.col("start") / width).cast("bigint"), F.floor(F.col("end") / width).cast("bigint")
    spans = ranges.filter("end > start").select(
        "contig", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "cand", a.alias("a"), b.alias("b")
    )

    def part(whole: bool, stretch: Column, low: Column, high: Column) -> Column:
        return F.struct(
            F.lit(whole).alias("whole"), stretch.cast("bigint").alias("stretch"), low.cast("bigint").alias("from"), high.cast("bigint").alias("to")
        )

    parts = F.filter(
        F.array(
            part(False, F.col("a") - 1, F.col("start"), F.least("end", F.col("a") * width)),
            part(False, F.col("b"), F.when(F.col("a") <= F.col("b"), F.greatest("start", F.col("b") * width)), F.col("end")),
            part(True, F.lit(None), F.col("a"), F.col("b")),
        ),
        lambda p: p["to"] > p["from"],
    )
    rows = _shared(spans.select("contig", "cand", F.explode(parts).alias("p")).select("contig", "p.*", "cand.*").distinct())
    cand = F.struct("s", "o", "v").alias("cand")
    # Whole stretches, in groups of as many as a stretch has loci: a group holds whole contigs in practice.
    group = F.explode(F.sequence(position_bin("from", width), position_bin(F.col("to") - 1, width)))
    whole = (
        rows.filter("whole").select("contig", "from", "to", cand, group.alias("stretch"))
        .groupBy(
            "contig", "stretch", F.greatest(F.col("from"), F.col("stretch") * width).alias("from"),
            F.least(F.col("to"), (F.col("stretch") + 1) * width).alias("to"),
        )
        .agg(F.max("cand").alias("cand"))
    )
    winners = _swept(whole, "cand").select("contig", F.explode(F.expr("sequence(start, end - 1)")).alias("stretch"), F.col("held").alias("cand"))
    over = winners.select(
        "contig", "stretch", (F.col("stretch") * width).alias("from"), ((F.col("stretch") + 1) * width).alias("to"), "cand"
    )
    pieces = _swept(rows.filter("not whole").select("contig", "stretch", "from", "to", cand).unionByName(over), "cand.v")
    # Pieces of a stretch are fused already; those at its edges meet in one window per contig and value.
    edge = (F.col("start") == F.col("stretch") * width) | (F.col("end") == (F.col("stretch") + 1) * width)
    placed = pieces.select(
        "contig", F.col("held").alias(value), "start", "end", F.when(edge, F.lit(-1)).otherwise(F.col("stretch")).alias("_stitch")
    )
    by_start = Window.partitionBy("contig", value, "_stitch").orderBy("start")
    opens = F.coalesce(F.lag("end").over(by_start) < F.col("start"), F.lit(True)).cast("int")
    return (
        placed.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(by_start))
        .groupBy("contig", value, "_stitch", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select("contig", value, "start", "end")
    )


def _swept(rows: DataFrame, held: str) -> DataFrame:
    """Fused pieces ``contig, stretch, start, end, held`` of the ranges ``from, to, cand`` of each stretch.

    ``held`` is what a piece shows of its range. Of two ranges over a locus the one with the larger ``cand`` shows,
    which must not start before the other. Memory follows the ranges that are open at once, and of those only ones
    that end after all later ones are held.
    """
    by_start = (
        rows.repartition("contig", "stretch").sortWithinPartitions("contig", "stretch", "from", "cand")
        .select("contig", "stretch", "from", "to", F.col(held).alias("held"))
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = stretch = types = None
        at, ends, values = 0, [], []  # open ranges, the one that shows last
        made: list[tuple] = []
        last: list | None = None

        def put(start: int, end: int, value) -> None:
            nonlocal last
            if last is not None and last[3] == start and (last[4] == value or (last[4] != last[4] and value != value)):
                last[3] = end
                return
            last = [name, stretch, start, end, value]
            made.append(last)

        def close() -> None:
            nonlocal at, last
            while ends:
                put(at, ends[-1], values[-1])
                at = ends.pop()
                values.pop()
            last = None

        def batch_of(pieces: list) -> pa.RecordBatch:
            columns = list(zip(*pieces))
            return pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, [types[0], pa.int64(), pa.int64(), pa.int64(), types[1]])],
                ["contig", "stretch", "start", "end", "held"],
            )

        for batch in batches:
            types = types or (batch.schema.field(0).type, batch.schema.field(4).type)
            for c, t, low, high, value in zip(*map(_listed, batch.columns)):
                if t != stretch or c != name:
                    close()
                    name, stretch = c, t
                while ends and ends[-1] <= low:
                    put(at, ends[-1], values[-1])
                    at = ends.pop()
                    values.pop()
                if ends and at < low:
                    put(at, low, values[-1])
                at = low
                while ends and ends[-1] <= high:
                    ends.pop()
                    values.pop()
                ends.append(high)
                values.append(value)
            if len(made) > 16_384:  # the last piece may go on
                ready, made[:] = made[:-1], made[-1:]
                yield batch_of(ready)
        close()
        if made:
            yield batch_of(made)

    schema = by_start.schema
    fields = [schema["contig"], schema["stretch"], StructField("start", LongType()), StructField("end", LongType()), schema["held"]]
    return by_start.mapInArrow(sweep, StructType([StructField(f.name, f.dataType) for f in fields]))


def _listed(column: pa.Array) -> list:
    """The values of a column; each distinct text is made once."""
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        known = [*coded.dictionary.to_pylist(), None]
        return [known[i] for i in coded.indices.fill_null(len(known) - 1).to_pylist()]
    return column.to_pylist()


def highest(ranges: DataFrame, bin_width: int = JOIN_BIN) -> DataFrame:
    """Disjoint pieces ``contig, start, end, cand`` of the covered loci with the largest ``cand`` of the ranges over them.

    Each range is cut into nested blocks of whole bins, kept as one candidate a block, and its two ragged edges.
    Edges are cut at the endpoints of the other edges in their bin, and each piece keeps its winner. A block
    that holds smaller ones hands them its winner and keeps the gaps between them. Copies shrink to one before
    the shuffle; rows follow the number of ranges, not of loci, however long they are.
    """
    first = F.ceil(F.col("start") / bin_width).cast("bigint")
    last = F.floor(F.col("end") / bin_width).cast("bigint")
    spans = ranges.filter("end > start").select("contig", "start", "end", "cand", first.alias("a"), last.alias("b"))
    edge = lambda low, high, block: F.struct(
        F.lit(-1).alias("level"), block.alias("block"), low.cast("bigint").alias("from"), high.cast("bigint").alias("to")
    )
    whole = F.transform(
        blocks(F.col("a"), F.col("b")),
        lambda n: F.struct(n["level"].alias("level"), n["block"].alias("block"), F.lit(None).cast("bigint").alias("from"), F.lit(None).cast("bigint").alias("to")),
    )
    head = edge(F.col("start"), F.least("end", F.col("a") * bin_width), F.col("a") - 1)
    tail = edge(F.greatest("start", F.col("b") * bin_width), F.col("end"), F.col("b"))
    inside = F.col("a") > F.col("b")  # within one bin
    edges = F.when(inside, F.array(head)).otherwise(F.filter(F.array(head, tail), lambda e: e["to"] > e["from"]))
    rows = (
        spans.select("contig", "cand", F.explode(F.concat(whole, edges)).alias("n"))
        .groupBy("contig", F.col("n.level").alias("level"), F.col("n.block").alias("block"), F.col("n.from").alias("from"), F.col("n.to").alias("to"))
        .agg(F.max("cand").alias("cand"))
    )
    rows = _shared(rows)
    cut = rows.filter("level < 0").drop("level")
    held = rows.filter("level >= 0").select("contig", "level", "block", "cand")

    # every block in use and those around it; one with anything smaller in it is inner
    is_edge = F.col("level") < 0
    at = F.struct(
        F.greatest("level", F.lit(0)).alias("level"), F.col("block").alias("block"), F.when(~is_edge, F.col("cand")).alias("own"), is_edge.alias("inner")
    )
    outer = F.transform(
        around(F.col("block"), F.greatest("level", F.lit(0))),
        lambda n: F.struct(n["level"].alias("level"), n["block"].alias("block"), F.lit(None).cast(ranges.schema["cand"].dataType).alias("own"), F.lit(True).alias("inner")),
    )
    tree = rows.select("contig", F.explode(F.concat(F.array(at), outer)).alias("n")).groupBy(
        "contig", F.col("n.level").alias("level"), F.col("n.block").alias("block")
    ).agg(F.max("n.own").alias("own"), F.max("n.inner").alias("inner"))
    above = held.select("contig", F.col("level").alias("up"), F.col("block").alias("up_block"), F.col("cand").alias("over"))
    tree = (
        tree.select("*", F.explode_outer(around(F.col("block"), F.col("level"))).alias("n"))
        .select("contig", "level", "block", "own", "inner", F.col("n.level").alias("up"), F.col("n.block").alias("up_block"))
        .join(above, ["contig", "up", "up_block"], "left")
        .groupBy("contig", "level", "block").agg(F.max("own").alias("own"), F.max("inner").alias("inner"), F.max("over").alias("over"))
        .withColumn("best", F.greatest("own", "over"))
    )

    # gaps beside a block belong to the block around it, a block with nothing in it is a piece of its own
    width = (F.lit(bin_width) * F.pow(F.lit(float(FACTOR)), F.col("level"))).cast("bigint")
    siblings = Window.partitionBy("contig", "level", "parent").orderBy("block")
    placed = tree.withColumn("parent", F.when(F.col("level") < TOP, F.floor(F.col("block") / FACTOR).cast("bigint")).otherwise(F.col("block")))
    placed = placed.withColumns({"next": F.lead("block").over(siblings), "before": F.lag("block").over(siblings), "width": width})
    part = lambda low, high, cand: F.struct(low.alias("start"), high.alias("end"), cand.alias("cand"))
    start, end = F.col("block") * F.col("width"), (F.col("block") + 1) * F.col("width")
    until = F.coalesce(F.col("next"), (F.col("parent") + 1) * FACTOR) * F.col("width")
    leading = F.when(F.col("before").isNull(), F.col("parent") * FACTOR * F.col("width")).otherwise(start)
    gaps = F.when(F.col("level") < TOP, F.array(part(leading, start, F.col("over")), part(end, until, F.col("over")))).otherwise(
        F.array().cast("array<struct<start: bigint, end: bigint, cand: " + ranges.schema["cand"].dataType.simpleString() + ">>")
    )
    # a bin with edges is not alone: its winner goes on to the pieces between the endpoints
    alone = F.array(part(start, end, F.when(~F.col("inner") | (F.col("level") == 0), F.col("best"))))
    pieces = placed.select(
        "contig", "block", (F.col("inner") & (F.col("level") == 0)).alias("has_edges"), F.posexplode(F.concat(gaps, alone)).alias("at", "p"),
        F.size(gaps).alias("n_gaps"),
    ).select("contig", "block", (F.col("has_edges") & (F.col("at") == F.col("n_gaps"))).alias("is_bin"), "p.*")
    pieces = _shared(pieces.filter("end > start and cand is not null"))
    covered = pieces.filter("is_bin").select("contig", "block", "cand")
    wide = pieces.filter("not is_bin").select("contig", "start", "end", "cand")
    return _cut_bins(cut, covered, bin_width).unionByName(wide)


def _shared(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator: filters on them stay above the last exchange, so that branches share it."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("r")).select("r.*")


def _cut_bins(edges: DataFrame, covered: DataFrame, bin_width: int) -> DataFrame:
    """The pieces of bins with edges, of which some are covered as a whole."""
    # A bin has at most bin_width + 1 distinct endpoints, and a range meets those it spans.
    in_bin = Window.partitionBy("contig", "block")
    spans = edges.withColumn(
        "points", F.array_sort(F.array_union(F.collect_set("from").over(in_bin), F.collect_set("to").over(in_bin)))
    )
    steps = F.expr(
        "transform(sequence(array_position(points, from), array_position(points, to) - 1), "
        "k -> named_struct('at', get(points, int(k) - 1), 'stop', get(points, int(k))))"
    )
    unit = covered.select("contig", "block", F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("stop"), "cand")
    candidates = (
        spans.select("contig", "block", "cand", F.explode(steps).alias("s"))
        .groupBy("contig", "block", F.col("s.at").alias("at"), F.col("s.stop").alias("stop"))
        .agg(F.max("cand").alias("cand"))
        .unionByName(unit)
    )
    first_locus = F.col("block") * bin_width
    rows = (
        candidates.withColumn("whole", F.max(F.when(F.col("at") < 0, F.col("cand"))).over(in_bin))
        .withColumn("next", F.coalesce(F.lead("at").over(in_bin.orderBy("at")), first_locus + bin_width))
        .withColumn("gap", F.when(F.col("at") < 0, first_locus).otherwise(F.col("stop")))
    )
    piece = lambda start, end, cand: F.struct(start.alias("start"), end.alias("end"), cand.alias("cand"))
    own = piece(F.col("at"), F.col("stop"), F.greatest("cand", "whole"))
    after = piece(F.col("gap"), F.col("next"), F.col("whole"))
    return rows.select(
        "contig",
        F.explode(
            F.when(F.col("at") < 0, F.array(after)).when(F.col("whole").isNull(), F.array(own)).otherwise(F.array(own, after))
        ).alias("p"),
    ).select("contig", "p.*").filter("end > start")


def invert(intervals: DataFrame, value: str = "value") -> DataFrame:
    """Value to locus set, as rows ``value, contig, start, end`` ordered by nothing."""
    return merge(intervals, (value, "contig")).select(value, "contig", "start", "end")


def statistics(intervals: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Loci, ranges and non-empty contigs per ``keys`` of a disjoint set."""
    return intervals.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("bigint").alias("loci"),
        F.count(F.lit(1)).alias("ranges"),
        F.countDistinct("contig").alias("contigs"),
    )


def contigs(intervals: DataFrame) -> DataFrame:
    return intervals.filter("end > start").select("contig").distinct().orderBy("contig")


def loci(intervals: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """Every locus of a set as its own row. Ranges are cut into bins first: no array is longer than a bin."""
    others = [c for c in intervals.columns if c not in ("start", "end")]
    bins = intervals.filter("end > start").select(
        *intervals.columns,
        F.explode(F.sequence(position_bin("start", width), position_bin(F.col("end") - 1, width))).alias("_bin"),
    )
    first = F.greatest(F.col("start"), F.col("_bin") * width)
    last = F.least(F.col("end"), (F.col("_bin") + 1) * width) - 1
    return bins.select(*others, F.explode(F.sequence(first, last)).alias("locus"))


def with_offsets(intervals: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """Disjoint intervals plus ``offset`` (loci before this one) and ``total``.

    Loci count in contig-name and start order. The window across bins sees one row per bin in use.
    """
    sized = intervals.withColumn("_len", F.col("end") - F.col("start"))
    others = tuple(c for c in intervals.columns if c not in ("contig", "start"))
    placed = running_total(sized, ["contig"], "start", "_len", "_upto", others, width, total="total")
    return placed.withColumn("offset", F.col("_upto") - F.col("_len")).select(*intervals.columns, "offset", "total")


def split_at(intervals: DataFrame, n: int) -> DataFrame:
    """A disjoint set or map cut after its first ``n`` loci: the same rows plus ``part``, which is
    ``first`` or ``rest``. One range may be cut in two."""
    placed = with_offsets(intervals)
    cut = F.col("start") + F.least(
        F.greatest(F.lit(n) - F.col("offset"), F.lit(0)), F.col("end") - F.col("start")
    )
    others = [F.col(c) for c in intervals.columns if c not in ("start", "end")]
    piece = lambda low, high, part: F.struct(
        low.alias("start"), high.alias("end"), F.lit(part).alias("part")
    )
    pieces = F.array(
        piece(F.col("start"), F.col("cut"), "first"), piece(F.col("cut"), F.col("end"), "rest")
    )
    return (
        placed.withColumn("cut", cut.cast("bigint"))
        .select(*others, F.explode(pieces).alias("p"))
        .select(*others, "p.*")
        .filter("end > start")
        .select(*intervals.columns, "part")
    )


def take(intervals: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` loci of a disjoint set or map, and the rest."""
    parts = split_at(intervals, n)
    return tuple(parts.filter(F.col("part") == part).drop("part") for part in ("first", "rest"))


def same_loci(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("contig",)) -> bool:
    """Set equality after normalisation. Runs one action that returns a flag."""
    a, b = merge(left, keys), merge(right, keys)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).isEmpty()


def display(intervals: DataFrame, max_length: int = 500, value: str | None = None) -> DataFrame:
    """One row ``text``: ``contig:start-end[=value]`` pieces in order, then an ellipsis if cut.

    A piece is shown while the text before it leaves room. Every piece takes six characters or
    more, so a bounded number of ranges can show, whatever the size of the set.
    """
    separator, ellipsis = ",", " [...]"
    text = F.format_string("%s:%d-%d", "contig", "start", "end")
    if value:
        text = F.concat(text, F.lit("="), F.col(value).cast("string"))
    head = (
        intervals.filter("end > start").orderBy("contig", "start").limit(max_length // 6 + 2)
        .select(F.struct("contig", "start", text.alias("text")).alias("p"))
        .agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]).alias("texts"))
    )
    return head.select(F.expr(f"""
      aggregate(texts, named_struct('left', {max_length}, 'out', '', 'cut', false),
        (s, t) -> CASE
          WHEN s.left <= {len(ellipsis)} THEN named_struct('left', s.left, 'out', s.out, 'cut', true)
          ELSE named_struct('left', s.left - length(t) - {len(separator)},
                            'out', concat(s.out, if(s.out = '', '', '{separator}'), t), 'cut', s.cut)
        END,
        s -> if(s.cut, concat(s.out, '{separator}{ellipsis}'), s.out))""").alias("text"))
