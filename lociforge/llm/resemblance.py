"""Near copies by the Jaccard similarity of their 5-word shingles.

A text's signature is 64 least hashes of its shingles, in 16 bands of 4. Texts of similarity 0.8 share
a band with probability 0.9997, more alike ones almost surely. Texts that share a band are
candidates, in two steps. First all pairs of a band value with few texts, and each text of a common one
with a few that are drawn anew for every band: that joins groups of close copies at little cost. Then the
common band values whose texts are still in several groups: each text outside the largest of these
is compared with all others, block by block, so no pair that shares a band is left out. All links are
verified by whole shingle sets, so no pair below the bound is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.llm.components import components
from lociforge.llm.store import materialise
from lociforge.llm.words import BASES, RangeHash, mix, names, plain, slices, split

SHINGLE = 5
#: Least similarity of near copies, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 16, 4
#: Band values with up to so many texts are compared pair by pair.
PAIRWISE = 16
#: Texts of a more common band value that each of its texts is compared with.
DRAWN = 4
#: Shingles in a block of a common band value; two blocks meet in a task at a time.
BLOCK = 1 << 21
#: Shingles that one in so many texts of a block has, or more, are compared as bitmaps.
DENSE = 32
#: Bytes of text worked off at once.
SLICE = 1 << 19


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text in order, and the start of each text among them; under 5 words, one for all."""
    flat, starts = split(pc.ascii_lower(texts))
    counts = np.diff(starts)
    made = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=first[1:])
    at = np.arange(first[-1]) + np.repeat(starts[:-1] - first[:-1], made)
    return RangeHash(names(flat)).of(at, np.minimum(at + SHINGLE, np.repeat(starts[1:], made))), first


def band_values(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of band values for each of the starts ``first``, no two of them equal."""
    out = np.empty((len(first), BANDS), np.uint64)
    for band in range(BANDS):
        value = np.full(len(first), band + 1, np.uint64)
        for row in range(ROWS):
            salt = mix(np.array([band * ROWS + row + 1], np.uint64) * np.uint64(BASES[1]))
            least = np.minimum.reduceat((hashes ^ salt) * (mix(salt) | np.uint64(1)), first)
            value = mix(value * np.uint64(BASES[0]) + least)
        out[:, band] = value
    return out


def bands(text: Column) -> Column:
    """The band values of a text; null for a text without words."""

    @F.arrow_udf("array<long>")
    def values(texts: pa.Array) -> pa.Array:
        texts, out, some = plain(texts), [], []
        for a, b in slices(texts, SLICE):
            hashes, first = shingles(texts.slice(a, b - a))
            has = np.diff(first) > 0
            some.append(has)
            if has.any():
                out.append(band_values(hashes, first[:-1][has]))
        has = np.concatenate([np.zeros(0, bool), *some])
        flat = np.concatenate([np.zeros((0, BANDS), np.uint64), *out]).view(np.int64).ravel()
        offsets = np.append(0, np.cumsum(has) * BANDS).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(~has))

    return values(text)


def shingle_sets(rows: DataFrame) -> DataFrame:
    """``node, shingles`` (distinct hashes) of rows with ``node`` and ``text``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nodes = plain(batch.column("text")), batch.column("node")
            for a, b in slices(texts, SLICE):
                hashes, first = shingles(texts.slice(a, b - a))
                sets = [np.unique(hashes[s:e]).view(np.int64) for s, e in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.record_batch([nodes.slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return rows.select("node", "text").mapInArrow(make, "node long, shingles array<long>")


def candidates(keys: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes that share a band value, from rows of ``node`` and ``key``; of common values some only."""
    # a node xor a number of the key: its least value gives a member drawn by the key, without sorting
    salt = [F.xxhash64("key", F.lit(k)) for k in range(DRAWN)]
    found = keys.groupBy("key").agg(
        F.count("*").alias("n"), *[F.min(F.col("node").bitwiseXOR(s)).alias(f"m{k}") for k, s in enumerate(salt)]
    ).filter("n > 1")
    few = keys.join(found.filter(F.col("n") <= PAIRWISE).select("key"), "key")
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").filter("a < b")
    drawn = found.filter(F.col("n") > PAIRWISE).select(
        "key", F.array(*[F.col(f"m{k}").bitwiseXOR(s) for k, s in enumerate(salt)]).alias("drawn")
    )
    many = keys.join(drawn, "key").select("node", F.explode("drawn").alias("other")).filter("node != other")
    return pairs.select("a", "b").unionByName(
        many.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    ).distinct()


def linked_groups(flat: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> list[tuple[int, int]]:
    """Links between the groups of texts (sets of ``sizes`` distinct hashes, one after the other): enough to join all
    groups with a pair of texts at the bound.

    Every text outside the largest group meets all others. Shingles that many texts have are counted by
    bitmaps, the others by the lists of their texts; those of one text only play no part.
    """
    n = len(sizes)
    shingle, df = np.unique(flat, return_inverse=True, return_counts=True)[1:]
    owner, common = np.repeat(np.arange(n), sizes), np.maximum(2, n // DENSE)
    dense = df >= common
    column = np.cumsum(dense) - 1
    width = -(-int(dense.sum()) // 64)
    bits = np.zeros((n, width * 64), bool)
    at = dense[shingle]
    bits[owner[at], column[shingle[at]]] = True
    bits = np.packbits(bits, axis=1).view(np.uint64).reshape(n, width)
    rare = np.flatnonzero(~dense[shingle] & (df[shingle] > 1))
    by = rare[np.argsort(shingle[rare], kind="stable")]  # texts of each rare shingle, one shingle after the other
    texts, begin = owner[by], np.searchsorted(shingle[by], np.arange(len(df) + 1))
    mine = np.searchsorted(rare, np.append(0, np.cumsum(sizes)))  # rare shingles of each text
    names, label, members = np.unique(groups, return_inverse=True, return_counts=True)
    found = []
    for x in np.flatnonzero(label != members.argmax()).tolist():
        shared = np.bitwise_count(bits & bits[x]).sum(axis=1, dtype=np.int64)
        own = shingle[rare[mine[x] : mine[x + 1]]]
        if len(own):
            many = begin[own + 1] - begin[own]
            place = np.repeat(begin[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            shared += np.bincount(texts[place], minlength=n)
        alike = LEAST[1] * shared >= LEAST[0] * (sizes + sizes[x] - shared)
        for other in np.unique(label[alike & (label != label[x])]).tolist():
            found.append((int(names[label[x]]), int(names[other])))
            label[label == other] = label[x]
    return found


def crowded_links(keys: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Links ``a, b`` between roots of texts that share a common band value.

    ``keys`` (node, key) are band values, ``sets`` the shingles of all their nodes in question, ``roots`` the
    group of each node. Band values with the same texts are worked off once; one with many shingles is
    divided into blocks, and each two blocks meet in a group of their own.
    """
    sized = keys.join(roots, "node").join(sets.select("node", F.size("shingles").alias("size")), "node")
    met = sized.groupBy("key").agg(
        F.bit_xor(F.xxhash64("node")).alias("who"), F.sum("size").alias("all"), F.count("*").alias("n"),
        (F.min("root") != F.max("root")).alias("several"),
    ).filter("several").groupBy("who", "all", "n").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("all") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(BLOCK)), F.col("blocks")).cast("int")
    pairs = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        sized.drop("size").join(met.select("key", blocks.alias("blocks")), "key").withColumn("block", mine).withColumn("other", pairs)
        .select("key", "node", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(sets, "node")
    )

    def compare(group: pa.Table) -> pa.Table:
        shingles = group.column("shingles").combine_chunks()
        found = linked_groups(
            np.asarray(shingles.flatten()), np.asarray(pc.list_value_length(shingles), dtype=np.int64),
            np.asarray(group.column("root").combine_chunks()),
        )
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def joined_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` (rows of ``text_hash`` and ``root``, a long) with the groups of near copies in one.

    Texts that are in one group already aren't compared. Null and blank texts have no shingles and
    stay in their groups. Equal texts count once; an empty table gives no rows.
    """
    texts = docs.select(F.xxhash64("text").alias("node"), "text")
    signed = texts.select("node", bands(F.col("text")).alias("bands")).filter("bands is not null").dropDuplicates(["node"])
    keys = materialise(signed.select("node", F.explode("bands").alias("key")), "bands")
    roots = groups.select(F.col("text_hash").alias("node"), "root").distinct()
    pairs = (
        candidates(keys)
        .join(roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a")
        .join(roots.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b")
        .filter("root_a != root_b")
    )
    pairs = materialise(pairs, "candidates")

    def sets_of(wanted: DataFrame, name: str) -> DataFrame:
        return materialise(shingle_sets(texts.join(wanted, "node", "left_semi").dropDuplicates(["node"])), name)

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    alike = LEAST[1] * shared >= LEAST[0] * (F.size("x") + F.size("y") - shared)
    groups = materialise(renamed(groups, both.filter(alike).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "joined")
    # what is left: common band values whose texts are in several groups
    roots = groups.select(F.col("text_hash").alias("node"), "root").distinct()
    common = keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > PAIRWISE)
    placed = keys.join(common.select("key"), "key").join(roots, "node")
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    left = materialise(placed.join(several.select("key"), "key").select("node", "key"), "crowded")
    if left.isEmpty():
        return groups
    sets = sets_of(left.select("node").distinct(), "crowded_shingles")
    return renamed(groups, crowded_links(left, sets, roots))


def renamed(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups with the least root of all that the links join."""
    tree = components(links)
    return groups.join(tree.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left").select(
        *[F.coalesce("least", "root").alias("root") if c == "root" else c for c in groups.columns]
    )
