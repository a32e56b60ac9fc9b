"""One spelling for equal variants: trimmed and moved as far left as the reference allows.

The same insertion or deletion inside a repeat can be written at several places. Its leftmost place follows from
one comparison: text before it against the same text with the inserted or deleted bases behind; as many
bases as both have in common at their ends, so far can it move. The text comes from reference fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.sources.fasta import fragment_length

#: Bases to the left that a variant looks at in a round.
REACH = 256
#: Longest common end of two alleles, and the end that a pattern looks at before any halving.
MOST, NEAR = (1 << 20) - 1, 16


def trimmed(pos: Column, ref: Column, alt: Column) -> Column:
    """``pos, ref, alt`` without the bases that both alleles have in common at their ends, last ones first.

    What is left of an insertion or deletion has an empty allele; equal alleles are both empty.
    """
    # each length is a field of its own, so that it is found once for the three values that depend on it
    row = F.array(F.struct(pos.cast("bigint").alias("pos"), ref.alias("ref"), alt.alias("alt"), _common(ref, alt).alias("n")))
    without_end = F.transform(row, lambda v: _cut(v, v["n"], last=True))
    sized = F.transform(without_end, lambda v: v.withField("n", _common(F.reverse(v["ref"]), F.reverse(v["alt"]))))
    return F.transform(sized, lambda v: _cut(v, v["n"], last=False))[0]


def _common(a: Column, b: Column, longest: int = MOST) -> Column:
    """How many characters two texts have in common at the end, at most ``longest``.

    A pattern compares the last few characters; only texts that agree in all of them are compared by halving steps.
    """
    near = min(NEAR, longest)
    ends = F.concat(F.reverse(F.right(a, F.lit(near))), F.lit("\n"), F.reverse(F.right(b, F.lit(near))))
    # a line break in a text would end it for the pattern
    in_ends = F.length(F.regexp_extract(ends, r"(?s)^([^\n]*)[^\n]*\n\1", 1))
    plain = ~F.contains(a, F.lit("\n")) & ~F.contains(b, F.lit("\n"))
    steps = [1 << k for k in range(longest.bit_length() - 1, -1, -1)]
    more = lambda k, step: (k + step <= F.least(F.length(a), F.length(b), F.lit(longest))) & (F.right(a, k + step) == F.right(b, k + step))
    halving = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda k, step: F.when(more(k, step), k + step).otherwise(k)
    )
    differ = F.right(a, F.lit(1)) != F.right(b, F.lit(1))
    return F.when(differ, F.lit(0)).when(plain & (in_ends < near), in_ends).otherwise(halving)


def _cut(v: Column, n: Column, last: bool) -> Column:
    """The variant without ``n`` bases at one end."""
    kept = lambda t: F.substring(t, F.lit(1) if last else n + 1, F.length(t) - n)
    moved = v["pos"] if last else v["pos"] + n
    return F.struct(moved.alias("pos"), kept(v["ref"]).alias("ref"), kept(v["alt"]).alias("alt"))


def text_windows(fragments: DataFrame, reach: int) -> DataFrame:
    """``contig, frag, at, text``: each fragment with up to ``reach`` bases before it, as far as there is no gap.

    ``text`` is binary and starts at position ``at``.
    """
    length = fragment_length(fragments)
    later = -(-reach // length)
    pieces = fragments.filter(F.col("bases").isNotNull()).select(
        "contig", F.explode(F.sequence(F.col("frag"), F.col("frag") + later)).alias("frag"),
        F.col("frag_start").alias("at"), F.col("bases").cast("binary").alias("text"),
    )
    skip = F.greatest(F.col("frag") * length - reach - F.col("at"), F.lit(0)).cast("int")
    pieces = pieces.select("contig", "frag", (F.col("at") + skip).alias("at"), F.substring("text", skip + 1, F.length("text")).alias("text"))
    grouped = pieces.groupBy("contig", "frag").agg(F.reverse(F.array_sort(F.collect_list(F.struct("at", "text")))).alias("f"))
    # the pieces that follow each other without a gap, the last one first
    joined = F.aggregate(
        "f", F.struct((F.col("f")[0]["at"] + F.length(F.col("f")[0]["text"])).alias("at"), F.lit("").cast("binary").alias("text")),
        lambda s, x: F.when(
            x["at"] + F.length(x["text"]) >= s["at"],
            F.struct(x["at"].alias("at"), F.concat(F.substring(x["text"], F.lit(1), (s["at"] - x["at"]).cast("int")), s["text"]).alias("text")),
        ).otherwise(s),
    )
    return grouped.select("contig", "frag", joined.alias("w")).select("contig", "frag", "w.at", "w.text")


def with_text_before(rows: DataFrame, fragments: DataFrame, reach: int) -> DataFrame:
    """Rows plus ``before``: up to ``reach`` reference bases left of ``pos``, as far as the reference goes without a gap.

    Each row meets the one window that holds the base before it; the texts are put together per fragment, not per row.
    """
    names = {"contig": "_contig", "frag": "_frag", "at": "_at", "text": "_text"}
    windows = text_windows(fragments, reach).select(*[F.col(c).alias(n) for c, n in names.items()])
    before_pos = F.floor((F.col("pos") - 1) / fragment_length(fragments)).cast("bigint")
    met = (F.col("contig") == F.col("_contig")) & (F.when(F.col("pos") > 0, before_pos) == F.col("_frag"))
    size = F.least(F.col("pos") - F.col("_at"), F.lit(reach)).cast("int")
    inside = (F.col("pos") > F.col("_at")) & (F.col("pos") <= F.col("_at") + F.length("_text"))
    text = F.substring("_text", (F.col("pos") - F.col("_at") - size + 1).cast("int"), size).cast("string")
    found = rows.join(windows, met, "left").withColumn("before", F.when(inside, text).otherwise(""))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns if c != "before"], "before")


def normalized(variants: DataFrame, fragments: DataFrame, reach: int = REACH, rounds: int = 1) -> DataFrame:
    """The same rows with ``pos, ref, alt`` trimmed and moved left.

    Deletions come out as the deleted bases against the empty allele, insertions as the base before them against that base
    and the inserted ones, as all callers write them; at position 0 the base is missing. A round moves a variant by ``reach``
    bases at most; repeats longer than ``reach`` need more ``rounds``. Null or equal alleles stay as they are.
    """
    others = [c for c in variants.columns if c not in ("pos", "ref", "alt")]
    kept = [F.col(f"`{c}`") for c in others]
    plain = F.col("ref").isNotNull() & F.col("alt").isNotNull() & (F.col("ref") != F.col("alt"))
    rows = variants.withColumn("_v", F.when(plain, trimmed(F.col("pos"), F.upper("ref"), F.upper("alt"))))
    rows = rows.select(
        *kept, F.coalesce("_v.pos", F.col("pos").cast("bigint")).alias("pos"), F.coalesce("_v.ref", "ref").alias("ref"),
        F.coalesce("_v.alt", "alt").alias("alt"),
    )
    is_indel = (F.col("ref") == "") != (F.col("alt") == "")
    for _ in range(rounds):
        # one base more than a move can use: the one that an insertion stands behind afterwards
        near = with_text_before(rows.drop("_base"), fragments, reach + 1)
        bases = F.concat("ref", "alt")  # one of them is empty
        near = near.withColumn("_whole", F.concat(F.col("before"), bases))
        moves = F.when(is_indel, _common(F.col("before"), F.col("_whole"), reach)).otherwise(0)
        near = near.withColumn("_k", moves)
        turned = F.substring(F.col("_whole"), F.length("before") - F.col("_k") + 1, F.length(bases))
        rest = F.length("before") - F.col("_k")
        rows = near.select(
            *kept, (F.col("pos") - F.col("_k")).alias("pos"), F.when(is_indel & (F.col("ref") != ""), turned).otherwise(F.col("ref")).alias("ref"),
            F.when(is_indel & (F.col("alt") != ""), turned).otherwise(F.col("alt")).alias("alt"),
            F.when(rest > 0, F.substring("before", rest, F.lit(1))).otherwise("").alias("_base"),
        )
    near = rows if rounds else with_text_before(rows, fragments, 1).withColumnRenamed("before", "_base")
    # insertions stand behind the base before them
    inserted = (F.col("ref") == "") & (F.col("alt") != "") & (F.length("_base") == 1)
    return near.select(
        *kept, F.when(inserted, F.col("pos") - 1).otherwise(F.col("pos")).alias("pos"), F.when(inserted, F.col("_base")).otherwise(F.col("ref")).alias("ref"),
        F.when(inserted, F.concat("_base", "alt")).otherwise(F.col("alt")).alias("alt"),
    ).select(*[F.col(f"`{c}`") for c in variants.columns])
