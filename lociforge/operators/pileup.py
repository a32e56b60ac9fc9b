"""Reads expanded to one row per aligned position, and the aggregates built on those rows.

Base rows are coverage x genome many, so they are never shuffled: :func:`by_neighbourhood` moves
the compact reads so that neighbours share a task, the rows are expanded there, and partial
aggregation shrinks them to about one row per locus and allele before the second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.functions.cigar import BASE_OPS, REFERENCE_OPS, cigar_blocks
from lociforge.functions.cigar import alignment_end, leading_clip
from lociforge.functions.md import aligned_text, md_length, reference_text
from lociforge.functions.quality import PHRED_OFFSET
from lociforge.operators.intervals import highest, loci as each_locus, merge
from lociforge.operators.overlap import first_overlaps, lookup, overlapping, overlapping_pairs
from lociforge.operators.prefix import BIN_WIDTH, running_total

#: Contig width that lands in one task before adaptive execution splits or joins tasks.
NEIGHBOURHOOD = 16_384

# Kinds of a pileup element. "aligned" is a base whose read has no MD tag.
MATCH, MISMATCH, INSERTION, DELETION, ALIGNED = (
    "match", "mismatch", "insertion", "deletion", "aligned",
)

READ_KEYS = ["contig", "sample", "token", "mapq", "fwd"]


def by_neighbourhood(reads: DataFrame, width: int = NEIGHBOURHOOD) -> DataFrame:
    """Move reads so that reads of one stretch of a contig share a task.

    A rebalance is a hint about layout only: adaptive execution splits a stretch that holds too
    much data over several tasks and joins small ones, so a hot spot cannot overload one task.
    Skip it when the input is already sorted by position.
    """
    placed = reads.withColumn("_stretch", F.floor(F.col("start") / width))
    return placed.hint("rebalance", F.col("contig"), F.col("_stretch")).drop("_stretch")


def _stored_blocks() -> Column:
    """The blocks of reads with a sequence. Others get none here: a filter would be moved down to where the
    sequence text is made, and make it twice."""
    return F.when(F.col("seq").isNotNull(), cigar_blocks("cigar"))


def prepared(reads: DataFrame) -> DataFrame:
    """Reads with parsed CIGAR blocks and, where MD allows, the reference text under them.

    Reads without sequence have no blocks, so nothing to expand. A tag that speaks of another number of
    positions than the CIGAR (with or without its skipped regions) counts as missing.
    """
    with_blocks = reads.withColumn("blocks", _stored_blocks())
    with_text = with_blocks.withColumn("aligned", aligned_text("seq", "blocks"))
    span = lambda offset, ops: F.expr(
        f"element_at(blocks, -1).{offset} + if(element_at(blocks, -1).op IN ({ops}), element_at(blocks, -1).len, 0)"
    )
    whole, aligned = span("ref_off", "'M', 'D', 'N', '=', 'X'"), span("aln_off", "'M', 'D', '=', 'X'")
    fits = md_length("md").isin(whole, aligned)
    return (
        with_text.withColumn("sample", sample_key())
        .withColumn("ref_text", F.when(fits, reference_text("md", "aligned").cast("binary")))
        .withColumn("gaps_in_md", F.length("ref_text") == whole)
        .withColumn("seq_bytes", F.col("seq").cast("binary"))
        .withColumn("qual_bytes", F.col("qual").cast("binary"))
        .drop("aligned")
    )


def elements(reads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per read and reference position it spans.

    Columns: ``contig, locus, sample, token, mapq, fwd, kind, allele, q, ref_base, read_pos,
    cigar_idx, idx_in_elem`` plus ``keep``. The allele of a deletion (also of a skipped region) is
    the empty string, that of an insertion its anchor base and the inserted bases. Columns nobody
    asks for cost nothing: the optimizer prunes their expressions.
    """
    last = F.col("b.read_off") + F.col("b.len")
    ins_text = F.substring(F.col("seq"), last, F.col("b.ins_len") + 1)
    ins_qual = F.array_min(F.split(F.substring(F.col("qual"), last, F.col("b.ins_len") + 1), ""))
    attached = (F.col("b.ins_len") > 0) & F.col("b.op").isin(*BASE_OPS)
    per_block = (
        prepared(reads)
        .select(
            *READ_KEYS, *keep, "start", "seq", "qual", "seq_bytes", "qual_bytes", "ref_text",
            "gaps_in_md", F.explode_outer("blocks").alias("b"),
        )
        .filter(F.col("b.op").isin(*REFERENCE_OPS) & (F.col("b.len") > 0))
        .select(
            *READ_KEYS, *keep, "seq_bytes", "qual_bytes", "ref_text",
            (F.col("start") + F.col("b.ref_off")).alias("block_start"),
            F.col("b.op").alias("op"),
            F.col("b.len").alias("len"),
            F.col("b.idx").alias("cigar_idx"),
            F.col("b.read_off").alias("read_off"),
            F.when(
                F.col("b.op") != "N",
                F.when(F.col("gaps_in_md"), F.col("b.ref_off")).otherwise(F.col("b.aln_off")),
            ).when(F.col("gaps_in_md"), F.col("b.ref_off")).alias("md_off"),
            F.when(attached, ins_text).alias("ins_text"),
            F.when(attached, F.ascii(ins_qual) - PHRED_OFFSET).alias("ins_q"),
        )
    )
    rows = per_block.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i")
    )
    is_base = F.col("op").isin(*BASE_OPS)
    at_insertion = F.col("ins_text").isNotNull() & (F.col("i") == F.col("len") - 1)
    base = F.expr("cast(substring(seq_bytes, read_off + i + 1, 1) AS STRING)")
    qual = F.expr("ascii(cast(substring(qual_bytes, read_off + i + 1, 1) AS STRING))") - PHRED_OFFSET
    ref_base = F.expr("cast(substring(ref_text, md_off + i + 1, 1) AS STRING)")
    return rows.select(
        *READ_KEYS, *keep,
        (F.col("block_start") + F.col("i")).alias("locus"),
        F.when(~is_base, DELETION)
        .when(at_insertion, INSERTION)
        .when(F.col("ref_text").isNotNull(), F.when(base == ref_base, MATCH).otherwise(MISMATCH))
        .when(F.col("op") == "=", MATCH)
        .when(F.col("op") == "X", MISMATCH)
        .otherwise(ALIGNED)
        .alias("kind"),
        F.when(~is_base, "").when(at_insertion, F.col("ins_text")).otherwise(base).alias("allele"),
        F.when(~is_base, F.col("mapq"))
        .when(F.col("qual_bytes").isNull(), 0)
        .when(at_insertion, F.col("ins_q"))
        .otherwise(qual)
        .alias("q"),
        F.when(F.length(ref_base) == 1, ref_base).alias("ref_base"),
        F.when(is_base, F.col("read_off") + F.col("i")).otherwise(F.col("read_off")).alias("read_pos"),
        "cigar_idx",
        F.col("i").alias("idx_in_elem"),
    )


def is_single_base(kind: Column | str = "kind") -> Column:
    """Elements that count as one base: everything but insertions and deletions."""
    col = F.col(kind) if isinstance(kind, str) else kind
    return ~col.isin(INSERTION, DELETION)


def single_base(allele: Column | str = "allele") -> Column:
    """The one sequenced base, null for deletions and longer insertions."""
    col = F.col(allele) if isinstance(allele, str) else allele
    return F.when(F.length(col) == 1, col)


def element_at_locus(reads: DataFrame, locus: int) -> DataFrame:
    """Elements of the reads that overlap one locus."""
    hit = reads.filter((F.col("start") <= locus) & (alignment_end() > locus))
    return elements(hit).filter(F.col("locus") == locus)


def base_reads(reads: DataFrame, clip_mode: str = "aligned") -> DataFrame:
    """Plain base rows ``contig, locus, sample, token, base, bq, mapq, fwd``; deletions have null base.

    Insertions, clips, skipped regions and padding give no rows. ``clip_mode='unclipped'`` counts
    positions from the unclipped start, which moves soft-clipped reads left by their clip.
    """
    start = F.col("start")
    if clip_mode == "unclipped":
        start = start - leading_clip("cigar")
    # An outer explode: the inner one makes the optimizer parse the CIGAR twice to test for rows.
    blocks = (
        reads.withColumn("sample", sample_key()).withColumn("blocks", _stored_blocks())
        .select(
            "contig", "sample", "token", "mapq", "fwd", start.alias("start"),
            F.col("seq").cast("binary").alias("seq_bytes"),
            F.col("qual").cast("binary").alias("qual_bytes"),
            F.explode_outer("blocks").alias("b"),
        )
        .filter(F.col("b.op").isin("M", "=", "X", "D") & (F.col("b.len") > 0))
        .select(
            "contig", "sample", "token", "mapq", "fwd", "seq_bytes", "qual_bytes",
            F.col("b.op").alias("op"),
            F.col("b.read_off").alias("read_off"),
            (F.col("start") + F.col("b.ref_off")).alias("block_start"),
            F.col("b.len").alias("len"),
        )
    )
    rows = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i"))
    has_base = F.col("op") != "D"
    base = F.expr("cast(substring(seq_bytes, read_off + i + 1, 1) AS STRING)")
    qual = F.expr("ascii(cast(substring(qual_bytes, read_off + i + 1, 1) AS STRING))") - PHRED_OFFSET
    return rows.select(
        "contig", (F.col("block_start") + F.col("i")).alias("locus"), "sample", "token",
        F.when(has_base, base).alias("base"),
        F.when(has_base, F.when(F.col("qual_bytes").isNull(), 0).otherwise(qual)).alias("bq"),
        "mapq", "fwd",
    )


def allele_counts(rows: DataFrame, keys: tuple[str, ...] = ("contig", "locus", "sample")) -> DataFrame:
    """Per key and allele: ``kind`` group, ``n``, forward reads and the reference base seen."""
    return rows.groupBy(*keys, is_single_base().alias("is_base"), "allele").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("fwd").alias("n_fwd"),
        reference_base().alias("ref_base"),
    )


def base_allele_counts(
    rows: DataFrame, keys: tuple[str, ...] = ("contig", "locus", "sample")
) -> DataFrame:
    """Counts per single-base allele; everything else shares the null allele (it counts as depth)."""
    return rows.groupBy(*keys, F.when(is_single_base(), F.col("allele")).alias("allele")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("fwd").alias("n_fwd"), reference_base().alias("ref_base")
    )


def reference_base(column: Column | str = "ref_base", smallest: bool = False) -> Column:
    """The reference base of a pileup as an aggregate.

    Compared as a number: a text maximum would turn the hash aggregate into a sort of base rows.
    """
    code = F.ascii(column)
    found = F.min(code) if smallest else F.max(code)
    return F.when(found.isNotNull(), F.char(found))


def depth(rows: DataFrame, keys: tuple[str, ...] = ("contig", "locus")) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("depth"))


def sample_key() -> Column:
    """Group key for a split by sample; reads without one are the sample ``default``."""
    return F.coalesce("sample", F.lit("default")).alias("sample")


def pileup(
    rows: DataFrame, *aggregates: Column, keys: tuple[str, ...] = ("contig", "locus")
) -> DataFrame:
    """A function of the pileup at every locus, given as aggregate columns.

    Aggregates are combined map-side, so a locus deeper than a task's memory is no problem.
    """
    return rows.groupBy(*keys).agg(*aggregates)


def restrict(reads: DataFrame, loci: DataFrame | None, disjoint: bool = False) -> DataFrame:
    """Reads that overlap the locus set (all reads without one), before anything is expanded."""
    return reads if loci is None else overlapping(reads, loci, disjoint=disjoint)


def on_loci(rows: DataFrame, loci: DataFrame | None, disjoint: bool = False) -> DataFrame:
    """Per-locus rows inside the set. Meant for aggregated rows, one or a few per locus."""
    return rows if loci is None else lookup(rows, loci if disjoint else merge(loci))


def pileup_over(
    reads: DataFrame, loci: DataFrame, *aggregates: Column, include_empty: bool = False
) -> DataFrame:
    """:func:`pileup` over a locus set; with ``include_empty`` also at loci without reads.

    Reads are picked by the set first and loci after aggregation; base rows meet no join.
    """
    loci = merge(loci)
    found = on_loci(pileup(elements(restrict(reads, loci, disjoint=True)), *aggregates), loci, disjoint=True)
    if not include_empty:
        return found
    return each_locus(loci).join(found, ["contig", "locus"], "left")


def paired(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("contig", "locus")) -> DataFrame:
    """Two pileup aggregates side by side; a locus may be missing on either side."""
    names = list(keys)
    l = left.select(*names, *[F.col(c).alias(f"{c}_1") for c in left.columns if c not in names])
    r = right.select(*names, *[F.col(c).alias(f"{c}_2") for c in right.columns if c not in names])
    return l.join(r, names, "full_outer")


def pileup_pair(
    rows: DataFrame,
    *aggregates: Column,
    tokens: tuple[int, int] = (1, 2),
    keys: tuple[str, ...] = ("contig", "locus"),
) -> DataFrame:
    """A function of two pileups: the aggregates per token, as ``<name>_1`` and ``<name>_2``.

    Both come from one aggregate by token; the few rows left are laid side by side.
    """
    both = pileup(rows.filter(F.col("token").isin(*tokens)), *aggregates, keys=(*keys, "token"))
    names = [c for c in both.columns if c not in (*keys, "token")]
    sides = [
        F.max(F.when(F.col("token") == t, F.col(c))).alias(f"{c}_{n}") for n, t in enumerate(tokens, 1) for c in names
    ]
    return both.groupBy(*keys).agg(*sides)


def coverage(reads: DataFrame, half_window: int = 0, width: int = BIN_WIDTH) -> DataFrame:
    """Run-length coverage ``contig, start, end, depth`` (depth > 0): reads near each locus.

    Two boundary events per read and running totals; no row per base is made.
    """
    events = (
        reads.filter("end > start")
        .select(
            "contig",
            F.explode(
                F.array(
                    F.struct(
                        F.greatest(F.col("start") - half_window, F.lit(0)).cast("bigint").alias("pos"),
                        F.lit(1).cast("bigint").alias("step"),
                    ),
                    F.struct(
                        (F.col("end") + half_window).cast("bigint").alias("pos"),
                        F.lit(-1).cast("bigint").alias("step"),
                    ),
                )
            ).alias("e"),
        )
        .select("contig", F.col("e.pos").alias("start"), F.col("e.step").alias("step"))
    )
    totals = running_total(events, ["contig"], "start", "step", "depth", (), width)
    return _close_runs(totals.filter("step <> 0"), width)


def _close_runs(totals: DataFrame, width: int, total: str = "depth") -> DataFrame:
    """Give each run its end, the start of the next one, looking across bins by their first row.

    Runs with a total of 0 are left out."""
    bin_ = F.floor(F.col("start") / width).cast("bigint")
    in_bin = Window.partitionBy("contig", "bin").orderBy("start")
    rows = (
        totals.withColumn("bin", bin_)
        .withColumn("next", F.lead("start").over(in_bin))
        .withColumn("edge", F.lag("start").over(in_bin).isNull() | F.col("next").isNull())
    )
    across = Window.partitionBy(
        "contig", F.when(F.col("edge"), F.lit(-1)).otherwise(F.col("bin"))
    ).orderBy("start")
    return (
        rows.withColumn("end", F.coalesce("next", F.lead("start").over(across)))
        .filter(F.col(total) != 0)
        .select("contig", "start", "end", total)
    )


def new_reads(reads: DataFrame, loci: DataFrame, half_window: int = 0, disjoint: bool = False) -> DataFrame:
    """Reads that enter a sliding window, per locus of a set: ``contig, locus, n_new``.

    A read enters at the first locus of the set whose window it touches, so it counts once.
    """
    spots = reads.groupBy("contig", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    return (
        first_overlaps(spots, loci, half_window, disjoint=disjoint)
        .select("contig", F.greatest("_from", "_start").alias("locus"), "n")
        .groupBy("contig", "locus").agg(F.sum("n").alias("n_new"))
    )


def window_pileup(
    reads: DataFrame, loci: DataFrame, half_window: int, *aggregates: Column, disjoint: bool = False
) -> DataFrame:
    """Aggregates over the reads near each locus: ``start <= locus + h`` and ``end - 1 >= locus - h``."""
    near = overlapping_pairs(reads, loci if disjoint else merge(loci), half_window)
    low = F.greatest(F.col("start") - half_window, F.col("range_start"))
    high = F.least(F.col("end") + half_window, F.col("range_end"))
    at = near.select("*", F.explode(F.sequence(low, high - 1)).alias("locus"))
    return at.groupBy("contig", "locus").agg(*aggregates)


def window_totals(
    reads: DataFrame,
    loci: DataFrame,
    half_window: int,
    sums: dict[str, Column] | None = None,
    minima: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    count: str = "n_reads",
    disjoint: bool = False,
) -> DataFrame:
    """Number of reads near each locus of a set, sums, least and largest values over them.

    A read is near as in :func:`window_pileup`, which takes any aggregate but has a row for each read and locus.
    Here a read has two difference events for counts and sums, and one range for each extreme, whose winner
    is found by nested blocks: rows follow reads and loci, not the width of the window. Sums take
    whole numbers (nulls add nothing); an extreme over nulls only is null. Loci without a read near give no row.
    The reads are read and combined once, to one row per distinct span; events and ranges are made of those.
    """
    whole = {count: F.lit(1), **(sums or {})}
    totals = {name: F.sum(F.coalesce(value.cast("bigint"), F.lit(0))) for name, value in whole.items()}
    extremes = [F.min(v).alias(f"_least_{n}") for n, v in (minima or {}).items()]
    extremes += [F.max(v).alias(f"_most_{n}") for n, v in (maxima or {}).items()]
    padded = (
        reads.filter("end > start")
        .groupBy(
            "contig", F.greatest(F.col("start") - half_window, F.lit(0)).cast("bigint").alias("_from"),
            (F.col("end") + half_window).cast("bigint").alias("_to"),
        )
        .agg(*[total.alias(f"_total_{name}") for name, total in totals.items()], *extremes)
    )
    at = each_locus(loci if disjoint else merge(loci)).select("contig", "locus")
    for name in whole:
        value = F.col(f"_total_{name}")
        steps = padded.select(
            "contig", F.explode(F.array(
                F.struct(F.col("_from").alias("start"), value.alias("step")), F.struct(F.col("_to").alias("start"), (-value).alias("step"))
            )).alias("e"),
        ).select("contig", "e.*")
        runs = _close_runs(running_total(steps, ["contig"], "start", "step", name), BIN_WIDTH, name)
        at = at.join(lookup(at.select("contig", "locus"), runs), ["contig", "locus"], "inner" if name == count else "left")
        at = at.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    for least, columns in ((True, minima), (False, maxima)):
        for name in columns or {}:
            value = F.col(f"_least_{name}" if least else f"_most_{name}")
            rank = F.struct((-value if least else value).alias("rank"), value.alias("value"))
            ranges = padded.select("contig", F.col("_from").alias("start"), F.col("_to").alias("end"), rank.alias("cand"))
            best = highest(ranges.filter("cand.value is not null")).select("contig", "start", "end", F.col("cand.value").alias(name))
            at = at.join(lookup(at.select("contig", "locus"), best), ["contig", "locus"], "left")
    return at
