"""Running totals that never need one task to hold a whole contig.

A plain window ordered by position puts each contig into one task. Here every row also feeds a
total row of its position bin. One window sums the few total rows of a key by bin and, in separate
partitions, the rows inside each bin by position; a second window hands the total of the earlier
bins to the rows. A bin holds at most ``width`` distinct positions and a key has at most
length / width bins, so both kinds of window partition are bounded. No self-join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_WIDTH = 65_536


def position_bin(pos: Column | str, width: int) -> Column:
    col = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(col / F.lit(width)).cast("bigint")


def running_total(
    df: DataFrame,
    keys: list[str],
    pos: str,
    value: str,
    out: str,
    payload: tuple[str, ...] = (),
    width: int = BIN_WIDTH,
    total: str | None = None,
) -> DataFrame:
    """``keys, pos, value, out``: values summed per position and their inclusive running total.

    Columns named in ``payload`` must be the same for all rows of one ``(keys, pos)``. With ``total``
    the running total goes on from key to key, in their order, and a column of that name has the sum
    of everything; the window over the total rows then sees one row per bin of all keys.
    """
    extra = F.struct(*[F.col(c) for c in payload]) if payload else F.lit(0)
    detail = F.struct(F.col(pos).cast("bigint").alias("p"), extra.alias("x"))
    bin_row = F.struct(F.lit(None).cast("bigint").alias("p"), F.lit(None).alias("x"))
    rows = (
        df.select(
            *keys, position_bin(pos, width).alias("_bin"), F.col(value).alias("_v"),
            F.explode(F.array(detail, bin_row)).alias("_r"),
        )
        .groupBy(*keys, "_bin", F.col("_r.p").alias("_p"))
        .agg(F.sum("_v").alias("_v"), F.max("_r.x").alias("_x"))
    )
    is_total = F.col("_p").isNull()
    names = [F.col(k) if total is None else F.when(~is_total, F.col(k)) for k in keys]
    order = [] if total is None else [F.when(is_total, F.col(k)) for k in keys]
    group = Window.partitionBy(*names, F.when(is_total, F.lit(-1)).otherwise(F.col("_bin")))
    scan = group.orderBy(*order, F.coalesce("_p", "_bin")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum("_v").over(scan))
    own_bin = Window.partitionBy(*keys, "_bin")
    carry = F.max(F.when(is_total, F.col("_s") - F.col("_v"))).over(own_bin)
    extras = [F.col("_x")[c].alias(c) for c in payload]
    if total is not None:
        rows = rows.withColumn("_all", F.sum(F.when(is_total, F.col("_v"))).over(group))
        rows = rows.withColumn("_all", F.max("_all").over(own_bin))
        extras.append(F.col("_all").alias(total))
    return (
        rows.withColumn("_carry", carry)
        .filter(~is_total)
        .select(
            *keys, F.col("_p").alias(pos), F.col("_v").alias(value), (F.col("_carry") + F.col("_s")).alias(out), *extras
        )
    )
