"""Fingerprints of improbable features in chained Bloom filters.

A feature is a window of 16 bytes; a text under 16 bytes is one feature as a whole. The rank of a window is how
rare its entropy is among all windows of the corpus, rarest first; a Spark job counts them. In each run of 16
consecutive windows the one of least rank (the leftmost on ties) scores a point, and windows with 4 points
or more are selected: the locally most improbable ones. Where no window has so many, the first of most points is.
Their hashes set 5 bits each in a filter of 2048 bits; after 160 features the next filter of the chain begins. Two
fingerprints are compared filter by filter: the bits shared beyond what chance gives, divided by the most that could
be shared; each filter of the shorter chain counts with its best partner, and the mean, weighted by bits,
is the likeness. It is the same for texts of all lengths and depends on the two fingerprints only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.llm.words import BASES, mix, plain, slices

WINDOW = 16
RUN = 16
POINTS = 4
LEVELS = 1000
FILTER_BITS = 2048
FILTER_BYTES = FILTER_BITS // 8
FILTER_FEATURES = 160
HASHES = 5
SLICE = 1 << 20
#: Rows to a stretch of ids.
STRETCH_ROWS = 8192
LOWEST = -(1 << 63)

_fixed = np.round((1 << 20) * np.arange(WINDOW + 2) * np.log2(np.maximum(np.arange(WINDOW + 2), 1))).astype(np.int64)
GROW, SHRINK = np.diff(_fixed), -np.diff(_fixed)  # of count c: to c + 1; of count c + 1: to c


# --- features -------------------------------------------------------------------------------------

def levels(data: np.ndarray) -> np.ndarray:
    """Entropy of each window, from 0 to 1000 (4 bits, the most that 16 bytes can have)."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same  # equal bytes among those before in a window
        after[:-lag] += same
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _fixed[np.bincount(data[:WINDOW], minlength=256)].sum()
    total[1:] = SHRINK[after[: n - WINDOW]] + GROW[before[WINDOW:]]
    np.cumsum(total, out=total)
    most = WINDOW * (WINDOW.bit_length() - 1) << 20
    return ((most - total) * LEVELS + most // 2) // most


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the start of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def whole_windows(starts: np.ndarray, n: int) -> np.ndarray:
    """Whether the window from each byte lies within one text."""
    end = np.repeat(starts[1:], np.diff(starts))[:n]
    return np.arange(n) + WINDOW <= end


def histogram(texts: pa.Array) -> np.ndarray:
    """How many windows of the texts have each level."""
    found = np.zeros(LEVELS + 1, np.int64)
    for a, b in slices(texts, SLICE):
        data, starts = bytes_of(texts.slice(a, b - a))
        level = levels(data)
        found += np.bincount(level[whole_windows(starts, len(level))], minlength=LEVELS + 1)
    return found


def selected(data: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Begin of each selected feature."""
    level = levels(data)
    n = len(level)
    if not n:
        return np.zeros(0, np.int64)
    inside = whole_windows(starts, n)
    # rank and place in one number: the least of a run is the leftmost of least rank
    key = np.where(inside, rank[level] << 40, 1 << 60) | np.arange(n)
    best, width = key, 1
    while width < RUN:
        best = np.minimum(best, np.append(best[width:], np.full(min(width, n), 1 << 61)))
        width *= 2
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    winner = best & ((1 << 40) - 1)
    counts = inside & (doc[winner] == doc) & (best < 1 << 60)
    points = np.bincount(winner[counts], minlength=n)
    enough = points >= POINTS
    # a text without such a window has its first one of most points
    has = np.zeros(len(starts) - 1, bool)
    has[doc[enough]] = True
    rest = np.flatnonzero((points > 0) & ~has[doc])
    best = rest[np.lexsort((rest, -points[rest], doc[rest]))]
    first = best[np.flatnonzero(np.diff(doc[best], prepend=-1))]
    return np.sort(np.concatenate([np.flatnonzero(enough), first]))


def hashes_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of up to 16 bytes from each place, ``size`` of them."""
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin] * (np.arange(WINDOW) < size[:, None]).astype(np.uint8)
    lanes = np.ascontiguousarray(rows).view(np.uint64)
    out = size.astype(np.uint64)
    for k in range(WINDOW // 8):
        out = mix(out * np.uint64(BASES[0]) + mix(lanes[:, k] + np.uint64(k + 1)))
    return out


def fingerprints(texts: pa.Array, rank: np.ndarray) -> list[bytes]:
    """The filters of each text, one after the other; an empty text has none."""
    out: list[bytes] = []
    for a, b in slices(texts, SLICE):
        data, starts = bytes_of(texts.slice(a, b - a))
        size = np.diff(starts)
        tiny = np.flatnonzero((size > 0) & (size < WINDOW))
        begin = np.concatenate([selected(data, starts, rank), starts[tiny]])
        doc = np.searchsorted(starts, begin, side="right") - 1
        hashes = hashes_of(data, begin, np.minimum(size[doc], WINDOW))
        # features of a text once each, in their order
        by = np.lexsort((begin, hashes, doc))
        first = np.ones(len(by), bool)
        first[1:] = (hashes[by[1:]] != hashes[by[:-1]]) | (doc[by[1:]] != doc[by[:-1]])
        keep = by[first]
        keep = keep[np.lexsort((begin[keep], doc[keep]))]
        hashes, doc = hashes[keep], doc[keep]
        count = np.bincount(doc, minlength=b - a)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        chains = -(-count // FILTER_FEATURES)
        base = np.cumsum(chains) - chains
        row = base[doc] + nth // FILTER_FEATURES
        bits = np.zeros((int(chains.sum()), FILTER_BITS), np.uint8)
        for k in range(HASHES):
            bits[row, (hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)] = 1
        packed = np.packbits(bits, axis=1, bitorder="little").tobytes()
        ends = (base + chains) * FILTER_BYTES
        out += [packed[s:e] for s, e in zip((base * FILTER_BYTES).tolist(), ends.tolist())]
    return out


def likeness(one: bytes, two: bytes) -> float:
    """0 for no more shared bits than by chance, 1 for equal fingerprints."""
    if one == two:
        return 1.0
    if not one or not two:
        return 0.0
    if len(one) > len(two):
        one, two = two, one
    bits = lambda data: np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, FILTER_BYTES), axis=1).astype(np.float32)
    left, best = bits(one), np.zeros(len(one) // FILTER_BYTES)
    size = left.sum(axis=1)
    for a in range(0, len(two), 512 * FILTER_BYTES):
        right = bits(two[a : a + 512 * FILTER_BYTES])
        other = right.sum(axis=1)
        chance = np.outer(size, other) / FILTER_BITS
        most = np.minimum(size[:, None], other[None, :])
        score = (left @ right.T - chance) / np.maximum(most - chance, 1e-9)
        best = np.maximum(best, np.clip(score, 0, 1).max(axis=1))
    return float((best * size).sum() / size.sum())


# --- Spark ----------------------------------------------------------------------------------------

def rarity(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy level by its count over all windows of the table, rarest first.

    The counts are taken in the tasks and summed by Spark; the driver gets one number a level.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            total += histogram(plain(batch.column(0)))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["level", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "level long, n long")
    counts = np.zeros(LEVELS + 1, np.int64)
    for level, n in rows.groupBy("level").agg(F.sum("n")).collect():
        counts[level] = n
    rank = np.empty(LEVELS + 1, np.int64)
    rank[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    return rank


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in stretches of descending id, each followed by the first row of the next stretch.

    ``stretch, id, tie, doc_id, text, ahead``: ids are cut at quantiles, so a text moves once and only one row
    a stretch moves twice. Null ids come last, equal ids by a hash of the text.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).select("doc_id", "id", F.xxhash64("text").alias("tie"), "text")
    parts = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // STRETCH_ROWS))
    cuts = rows.agg(F.percentile_approx("id", [(k + 1) / parts for k in range(parts - 1)], 10 * parts)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.arrow_udf("int")
    def stretch(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, np.asarray(ids)).astype(np.int32))

    rows = rows.withColumn("stretch", stretch("id")).withColumn("ahead", F.lit(False))
    heads = rows.groupBy("stretch").agg(F.max(F.struct("id", "tie")).alias("h")).collect()  # a few numbers a stretch
    heads = sorted((r["stretch"], r["h"]["id"], r["h"]["tie"]) for r in heads)
    before = [(heads[(k + 1) % len(heads)][0], i, t) for k, (_, i, t) in enumerate(heads)]
    table = spark.createDataFrame(before, "stretch int, id long, tie long")
    ahead = (
        rows.drop("stretch", "ahead").join(F.broadcast(table), ["id", "tie"]).dropDuplicates(["id", "tie"])
        .select("doc_id", "id", "tie", "text", "stretch", F.lit(True).alias("ahead"))
    )
    return rows.unionByName(ahead)


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like it is to that and to the next text.

    The edited text has its last third of code points replaced by the first as many of the next
    document, in descending order of ids (after the last comes the first; a single document is its own next one).
    Null text is empty and has the fingerprint ""; two equal fingerprints have likeness 1. Rows that repeat an
    id with the same text follow each other. An empty table gives no rows.
    """
    rank = rarity(docs, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the last row, whose next one is still to come

        for batch in batches:
            for a, b in slices(batch.column(batch.schema.get_field_index("text")), SLICE):
                part = batch.slice(a, b - a).to_pydict()
                prints = fingerprints(pa.array(part["text"], pa.string()), rank)
                names = ("stretch", "doc_id", "text", "ahead", "print")
                rows = [dict(zip(names, r)) for r in zip(part["stretch"], part["doc_id"], part["text"], part["ahead"], prints)]
                if held is not None:
                    rows.insert(0, held)
                held = rows[-1]
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x["ahead"] and x["stretch"] == y["stretch"]]
                if pairs:
                    yield made(pairs)

    def made(pairs: list[tuple[dict, dict]]) -> pa.RecordBatch:
        edited = []
        for row, after in pairs:
            text = row["text"]
            third = len(text) // 3
            edited.append(text[: len(text) - third] + after["text"][:third])
        prints = fingerprints(pa.array(edited, pa.string()), rank)
        encode = lambda p: base64.b64encode(p).decode()
        columns = [
            pa.array([r["doc_id"] for r, _ in pairs], pa.int64()), pa.array([len(r["text"]) for r, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array([encode(r["print"]) for r, _ in pairs]), pa.array([encode(p) for p in prints]),
            pa.array([likeness(r["print"], p) for (r, _), p in zip(pairs, prints)], pa.float64()),
            pa.array([likeness(r["print"], n["print"]) for r, n in pairs], pa.float64()),
        ]
        return pa.record_batch(columns, [f.split()[0] for f in RESULT.split(", ")])

    rows = with_next(docs, id_col, text_col)
    ordered = rows.repartition("stretch").sortWithinPartitions("stretch", "ahead", F.desc("id"), F.desc("tie"))
    return ordered.select("stretch", "doc_id", "text", "ahead").mapInArrow(work, RESULT)
