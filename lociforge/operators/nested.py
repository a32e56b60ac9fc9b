"""Nested bins: a stretch of bins as a few blocks of doubling size, and the blocks a bin lies in.

A block of level k holds ``FACTOR ** k`` bins. Any stretch is a union of at most ``2 * (FACTOR - 1)`` blocks a level,
so a range as long as a contig costs some hundred rows instead of one for each of its bins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FACTOR = 32
TOP = 4


def blocks(low: Column, high: Column) -> Column:
    """The blocks of bins ``low`` to ``high`` (exclusive), as an array of ``level, block``.

    Level by level: the ends that don't fill a larger block, then the larger blocks between them.
    """
    none = F.array().cast("array<struct<level: int, block: bigint>>")

    def span(a: Column, b: Column, level: int) -> Column:
        made = F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(level).alias("level"), x.alias("block")))
        return F.when(b > a, made).otherwise(none)

    size = lambda level: FACTOR**level
    low, high, out = low.cast("bigint"), high.cast("bigint"), []
    up = [F.ceil(low / size(k)).cast("bigint") for k in range(TOP + 2)]
    down = [F.floor(high / size(k)).cast("bigint") for k in range(TOP + 2)]
    for k in range(TOP):
        larger = up[k + 1] < down[k + 1]
        ends = F.concat(span(up[k], up[k + 1] * FACTOR, k), span(down[k + 1] * FACTOR, down[k], k))
        out.append(F.when(larger, ends).otherwise(span(up[k], down[k], k)))
    return F.concat(*out, span(up[TOP], down[TOP], TOP))


def around(block: Column, level: Column) -> Column:
    """The blocks of higher levels that hold a block, as an array of ``level, block``."""
    levels = F.when(level < TOP, F.sequence(level + 1, F.lit(TOP))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        levels,
        lambda k: F.struct(k.alias("level"), F.floor(block / F.pow(F.lit(float(FACTOR)), k - level)).cast("bigint").alias("block")),
    )
