"""FASTA text as reference fragments and per-base rows, keyed by true base positions.

Lines are read split-parallel, so a contig is never held whole by one task. The position of a
line follows from a two-level running total over byte offsets, not from line numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociforge.functions.bases import normalize_contig

# Fixed value: default longest fragment.
FRAGMENT_LENGTH = 10_000


def read_lines(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """Sequence lines as ``contig, line_start, bases``; headers are left out.

    A file split is bounded by ``spark.sql.files.maxPartitionBytes``, so the windows inside a split
    are bounded too; the windows across splits see one row per split. A compressed file is a single
    split: unpack whole genomes first.
    """
    text = F.rtrim(F.col("value"))
    is_header = F.col("value").startswith(">")
    name = F.regexp_extract("value", r"^>\s*([^\s]+)", 1)
    lines = (
        spark.read.text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
        )
        .select(
            "file", "split", "row",
            F.when(~is_header, F.upper(text)).alias("bases"),
            F.when(is_header, normalize_contig(name) if normalize else name).alias("header"),
        )
        .withColumn("size", F.coalesce(F.length("bases"), F.lit(0)).cast("bigint"))
    )
    in_split = Window.partitionBy("file", "split").orderBy("row")
    earlier = in_split.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_split.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).withColumn(
        "opened",
        F.last(
            F.when(F.col("header").isNotNull(), F.struct("header", "before")), ignorenulls=True
        ).over(so_far),
    )
    earlier_splits = Window.partitionBy("file").orderBy("split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    splits = (
        lines.groupBy("file", "split")
        .agg(F.sum("size").alias("total"), F.max_by("opened", "row").alias("last_opened"))
        .withColumn("carry", F.coalesce(F.sum("total").over(earlier_splits), F.lit(0)))
        .withColumn(
            "inherited",
            F.last(
                F.when(
                    F.col("last_opened").isNotNull(),
                    F.struct(
                        F.col("last_opened.header").alias("header"),
                        (F.col("carry") + F.col("last_opened.before")).alias("at"),
                    ),
                ),
                ignorenulls=True,
            ).over(earlier_splits),
        )
        .select("file", "split", "carry", "inherited")
    )
    opened_at = F.coalesce(F.col("carry") + F.col("opened.before"), F.col("inherited.at"))
    return (
        lines.filter("size > 0")
        .join(splits, ["file", "split"])
        .select(
            F.coalesce("opened.header", "inherited.header").alias("contig"),
            (F.col("carry") + F.col("before") - opened_at).alias("line_start"),
            "bases",
        )
        .filter(F.col("contig").isNotNull())
    )


def fragment(lines: DataFrame, length: int = FRAGMENT_LENGTH) -> DataFrame:
    """Lines regrouped into ``contig, frag, frag_start, bases`` with ``length`` bases each.

    A group holds at most ``length`` bases. Slices come from binary, where a slice does not walk
    the text before it.
    """
    last = F.col("line_start") + F.length("bases") - 1
    pieces = lines.select(
        "contig", "line_start", F.col("bases").cast("binary").alias("bases"),
        F.explode(
            F.sequence(
                F.floor(F.col("line_start") / length).cast("bigint"),
                F.floor(last / length).cast("bigint"),
            )
        ).alias("frag"),
    ).select(
        "contig", "frag",
        F.struct(
            F.greatest(F.col("line_start"), F.col("frag") * length).alias("at"),
            F.expr(
                f"cast(substring(bases, int(greatest(frag * {length} - line_start, 0)) + 1, "
                f"int(least((frag + 1) * {length} - line_start, length(bases)) "
                f"- greatest(frag * {length} - line_start, 0))) AS STRING)"
            ).alias("text"),
        ).alias("piece"),
    )
    return pieces.groupBy("contig", "frag").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"]), ""
        ).cast("binary").alias("bases")
    ).select("contig", fragment_number(length), (F.col("frag") * length).alias("frag_start"), "bases")


def fragment_number(length: int) -> Column:
    """The column ``frag``, which carries the fragment length in its metadata, also through Parquet."""
    return F.col("frag").alias("frag", metadata={"length": length})


def fragment_length(fragments: DataFrame) -> int:
    """The length that a fragment table was cut at. Raises ``ValueError`` if it does not say."""
    length = fragments.schema["frag"].metadata.get("length")
    if length is None:
        raise ValueError("the fragment table carries no length; build it with fragment() or fragment_number()")
    return length


def base_table(fragments: DataFrame) -> DataFrame:
    """One row per reference base: ``contig, locus, base``."""
    return fragments.select(
        "contig", "frag_start", "bases",
        F.explode(F.sequence(F.lit(0), F.length("bases") - 1)).alias("i"),
    ).select(
        "contig",
        (F.col("frag_start") + F.col("i")).alias("locus"),
        F.expr("cast(substring(bases, i + 1, 1) AS STRING)").alias("base"),
    )


def with_reference_base(
    rows: DataFrame, fragments: DataFrame, name: str = "ref", keep_missing: bool = False
) -> DataFrame:
    """Add the reference base at ``(contig, locus)``; rows outside the reference are dropped, or get null.

    Joins on fragments, never on single reference bases. Their length comes with the table.
    """
    keyed = rows.withColumn("frag", F.floor(F.col("locus") / fragment_length(fragments)).cast("bigint"))
    base = F.expr("cast(substring(bases, int(locus - frag_start) + 1, 1) AS STRING)")
    found = keyed.join(fragments, ["contig", "frag"], "left" if keep_missing else "inner").withColumn(name, base)
    if keep_missing:
        found = found.withColumn(name, F.when(F.length(name) == 1, F.col(name)))
    else:
        found = found.filter(F.length(name) == 1)
    return found.drop("frag", "frag_start", "bases")


def load_reference(spark: SparkSession, path: str, length: int = FRAGMENT_LENGTH) -> DataFrame:
    return fragment(read_lines(spark, path), length)
