"""Phrases whose words stand together oftener than chance, by vertical partitioning of the suffixes.

Every word starts a suffix: the words from it on, five at most, up to the end of its piece. Suffixes are
dealt to groups by a prefix, and each group builds its part of the suffix tree by itself: suffixes sorted,
shared prefixes of neighbours as nodes down to depth five, and the number of leaves under a node as the count
of its phrase. A prefix is one word, and a longer one while its words are hot (oftener than a share of the
memory budget), so no group gets a hot word whole. The number of groups follows the number of words.

Suffixes end where a phrase must: before a word, or within a pair of words, that is too rare. Tasks know rare words,
rare pairs and hot words by bitmaps of fixed size over hashes: a wrong bit only keeps a suffix longer, it
changes no count. Nodes above the end of a prefix lie in several groups; their counts are summed up at last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.llm.blobs import pack, rising, unpack
from lociforge.llm.store import materialise
from lociforge.llm.words import mix, names, plain, slices, split

LONGEST = 5
LEAST = 100
KEEP = 2000
#: Words of the corpus to a group; a word with more than a quarter of it is hot.
BUDGET = 1 << 20
#: Words a task gathers before it deals out their suffixes.
CHUNK = 1 << 20
#: Bits of the word bitmaps.
BITS = 26
BITMAP_BITS = 1 << 15  # of Spark's bitmap aggregates
#: Ranges of the bitmap of pairs that tasks count by themselves.
RANGES = 64
TEXT_BYTES = 2 << 20
SEPARATORS = r"[.,;:!?\x0A-\x0D]+"
STOP = "."  # stands for all separators; no word is equal to it


# --- words ----------------------------------------------------------------------------------------

def tokens(texts: pa.Array, langs: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Words and separators of the texts in order, one more separator at the end of each text, as codes into a
    dictionary of them; for each its language, as codes into a dictionary as well."""
    marked = pc.replace_substring_regex(pc.ascii_lower(texts), SEPARATORS, f" {STOP} ")
    flat, starts = split(pc.binary_join_element_wise(marked, STOP, " "))
    words = flat.dictionary_encode()
    named = langs.dictionary_encode()
    lang = np.repeat(np.asarray(named.indices, dtype=np.int64), np.diff(starts))
    return words.dictionary, named.dictionary, np.asarray(words.indices, dtype=np.int64), lang


def word_ids(words: pa.Array, langs: pa.Array, word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """64-bit names of words, apart for each language."""
    seeds = np.array([xxhash.xxh64_intdigest(name.encode(), 7) for name in langs.to_pylist()], np.uint64)
    return mix(names(words)[word] ^ seeds[lang])


def stop_code(words: pa.Array) -> int:
    return pc.index(words, STOP).as_py()


def word_counts(rows: DataFrame, least: int) -> DataFrame:
    """``lang, word, id, n`` of words with ``least`` occurrences or more; a null word has all words of the language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = plain(batch.column("text")), plain(batch.column("lang"))
            for a, b in slices(texts, TEXT_BYTES):
                words, named, word, lang = tokens(texts.slice(a, b - a), langs.slice(a, b - a))
                real = word != stop_code(words)
                key, n = np.unique(lang[real] * len(words) + word[real], return_counts=True)
                lang, word = key // len(words), key % len(words)
                ids = word_ids(words, named, word, lang).view(np.int64)
                whole = np.bincount(lang, n, len(named)).astype(np.int64)
                yield pa.record_batch(
                    [
                        pa.concat_arrays([named.take(pa.array(lang)), named]),
                        pa.concat_arrays([words.take(pa.array(word)), pa.nulls(len(named), pa.string())]),
                        pa.concat_arrays([pa.array(ids), pa.nulls(len(named), pa.int64())]),
                        pa.array(np.concatenate([n, whole])),
                    ],
                    ["lang", "word", "id", "n"],
                )

    found = rows.mapInArrow(count, "lang string, word string, id long, n long")
    sums = found.groupBy("lang", "word").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    return sums.filter(F.col("word").isNull() | (F.col("n") >= least))


def bitmap(ids: DataFrame) -> np.ndarray:
    """2**BITS bits with those of the ids set, packed, by Spark's bitmap aggregates: 8 MB whatever the ids."""
    place = F.shiftrightunsigned("id", 64 - BITS) + 1  # the aggregates count from 1
    parts = ids.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = np.zeros(1 << (BITS - 3), np.uint8)
    size = BITMAP_BITS // 8
    for row in parts.collect():  # at most 2**BITS / BITMAP_BITS rows of 4 KB
        out[(row["bucket"] - 1) * size : row["bucket"] * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def among(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = ids >> np.uint64(64 - BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def chunks(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and separators of the texts in order, about CHUNK at a time, as ids, and whether each is a frequent word."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        texts, langs = plain(batch.column("text")), plain(batch.column("lang"))
        for a, b in slices(texts, TEXT_BYTES):
            words, named, word, lang = tokens(texts.slice(a, b - a), langs.slice(a, b - a))
            ids = word_ids(words, named, word, lang)
            held.append((ids, (word != stop_code(words)) & among(frequent, ids)))
            size += len(ids)
            if size >= CHUNK:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def pair_ids(ids: np.ndarray) -> np.ndarray:
    """Names of each word with the one after it."""
    return mix(ids[:-1] * np.uint64(3) + mix(ids[1:]))


def pair_bitmap(rows: DataFrame, frequent, least: int) -> np.ndarray:
    """2**BITS bits, of which those of neighbours are set that may stand together ``least`` times: their slots do.

    A task counts the slots of a chunk, and one group a range of slots; 8 MB come to the driver, whatever the texts.
    """
    width = (1 << BITS) // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, good in chunks(batches, frequent.value):
            pairs = pair_ids(ids)[good[:-1] & good[1:]] >> np.uint64(64 - BITS)
            slots, n = np.unique(pairs, return_counts=True)
            bounds = np.searchsorted(slots, np.arange(RANGES + 1) * width)
            for r in np.flatnonzero(np.diff(bounds)).tolist():
                mine = slice(bounds[r], bounds[r + 1])
                data = pack(rising((slots[mine] - np.uint64(r * width)).astype(np.uint32)), n[mine].astype(np.uint32))
                yield pa.record_batch([pa.array([r], pa.int64()), pa.array([data], pa.binary())], ["grp", "data"])

    def add(group: pa.Table) -> pa.Table:
        sums = np.zeros(width, np.int64)
        for data in group.column("data").to_pylist():
            slots, n = unpack(data)
            sums[np.cumsum(slots, dtype=np.uint32)] += n
        bits = np.packbits(sums >= least, bitorder="little").tobytes()
        return pa.table({"grp": group.column("grp")[:1], "bits": pa.array([bits], pa.binary())})

    out = np.zeros(1 << (BITS - 3), np.uint8)
    for row in rows.mapInArrow(count, "grp long, data binary").groupBy("grp").applyInArrow(add, "grp long, bits binary").collect():
        out[row["grp"] * width // 8 : (row["grp"] + 1) * width // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


# --- suffixes -------------------------------------------------------------------------------------

def suffixes(ids: np.ndarray, links: np.ndarray, hot: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Distinct suffixes of two words or more with their counts, packed by group.

    ``links`` marks words a suffix may go on from, to the next one; ``hot`` those that prolong a prefix. A value has the word ids, a row of
    codes for each suffix, its count and its number of hot words at the front.
    """
    n = len(ids)
    stop = np.minimum.accumulate(np.where(links, n, np.arange(n))[::-1])[::-1]
    at = np.flatnonzero(links)
    length = np.minimum(stop[at] - at + 1, LONGEST)
    if not len(at):
        return
    place = np.minimum(at[:, None] + np.arange(LONGEST), n - 1)
    held = np.arange(LONGEST) < length[:, None]
    rows = np.where(held, ids[place], np.uint64(0))
    chain = np.empty_like(rows)  # names of the prefixes of each suffix
    name = np.zeros(len(at), np.uint64)
    for k in range(LONGEST):
        name = mix(name * np.uint64(3) + rows[:, k])
        chain[:, k] = name
    order = np.argsort(name)
    cut = np.flatnonzero(np.append(True, name[order[1:]] != name[order[:-1]]))
    first, count = order[cut], np.diff(np.append(cut, len(order)))
    rows, chain = rows[first], chain[first]
    lead = np.logical_and.accumulate(hot[place[first]] & held[first], axis=1).sum(axis=1)
    prefix = chain[np.arange(len(first)), np.minimum(lead, LONGEST - 1)]
    group = (mix(prefix) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group)
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(bounds)).tolist():
        mine = order[bounds[g] : bounds[g + 1]]
        known, code = np.unique(rows[mine], return_inverse=True)
        code = code.reshape(len(mine), LONGEST).astype(np.uint32)
        yield g, pack(rising(known), *code.T, count[mine].astype(np.uint32), lead[mine].astype(np.uint8))


def tree_nodes(blobs: list[bytes], least: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes of depth two to five of the suffix tree of a group: rows of word ids and numbers of leaves.

    Sorted suffixes are the leaves in order; a node of depth k is a run of those that agree in k words. Nodes
    below the end of their prefix are whole here and need ``least`` leaves.
    """
    parts = [unpack(b) for b in blobs]
    known = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    ids = np.unique(np.concatenate(known))
    code = [np.concatenate([np.searchsorted(ids, k)[p[1 + d]] for k, p in zip(known, parts)]) for d in range(LONGEST)]
    count = np.concatenate([p[LONGEST + 1] for p in parts]).astype(np.int64)
    lead = np.concatenate([p[LONGEST + 2] for p in parts])
    order = np.lexsort([code[4], code[2] << 32 | code[3], code[0] << 32 | code[1]])
    code, count, lead = [c[order] for c in code], count[order], lead[order]
    opens = np.ones(len(count), bool)
    opens[1:] = code[0][1:] != code[0][:-1]
    rows, sums = [], []
    for depth in range(2, LONGEST + 1):
        column = code[depth - 1]
        opens[1:] |= column[1:] != column[:-1]
        start = np.flatnonzero(opens)
        leaves = np.add.reduceat(count, start)
        real = ids[column[start]] != 0  # zero stands for the end of a shorter suffix
        shared = (lead[start] >= depth) & (depth < LONGEST)
        keep = real & (shared | (leaves >= least))
        rows.append(np.stack([ids[c[start[keep]]] for c in code[:depth]], axis=1))
        sums.append(leaves[keep])
    return rows, sums


def phrase_counts(rows: DataFrame, words: DataFrame, total: int, least: int) -> DataFrame:
    """``ids, n``: phrases of two to five words, as the ids of their words, with ``least`` occurrences or more."""
    groups = max(1, -(-total // BUDGET))
    context = rows.sparkSession.sparkContext
    frequent = context.broadcast(bitmap(words.select("id")))
    very = context.broadcast(bitmap(words.filter(F.col("n") > BUDGET // 4).select("id")))

    pairs = context.broadcast(pair_bitmap(rows, frequent, least))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, good in chunks(batches, frequent.value):
            links = np.zeros(len(ids), bool)
            links[:-1] = good[:-1] & good[1:] & among(pairs.value, pair_ids(ids))
            for g, data in suffixes(ids, links, among(very.value, ids), groups):
                yield pa.record_batch([pa.array([g], pa.int64()), pa.array([data], pa.binary())], ["grp", "data"])

    def build(group: pa.Table) -> pa.Table:
        rows, sums = tree_nodes(group.column("data").to_pylist(), least)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(r.view(np.int64).ravel()), r.shape[1]).cast(pa.list_(pa.int64())) for r in rows]
        return pa.table({"ids": pa.chunked_array(lists, pa.list_(pa.int64())), "n": pa.chunked_array([pa.array(s) for s in sums], pa.int64())})

    nodes = rows.mapInArrow(deal, "grp long, data binary").groupBy("grp").applyInArrow(build, "ids array<long>, n long")
    return nodes.groupBy("ids").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- scores ---------------------------------------------------------------------------------------

def cut_score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)), exact up to 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    over = (F.lit(1000).cast("decimal(4,0)") * (wide(a) * wide(n))).cast("decimal(38,0)")
    under = (wide(l) * wide(r)).cast("decimal(38,0)")
    return F.call_function("div", over, under).cast("long")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, keep: int = KEEP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``keep`` phrases of each language.

    Words are lower-cased in A-Z; pieces end at ``. , ; : ! ?`` and at line breaks. A phrase has two to five words
    of a piece and ``least`` occurrences or more (``a``); its score is that of its lowest-scoring cut, whose parts
    occur ``l`` and ``r`` times among ``n`` words. A phrase as frequent as a longer one around it is left out. Null
    text is empty, a null language is ``und``; repeated rows count as often as they stand; an empty table gives no rows.
    """
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    counted = materialise(word_counts(rows, least), "words")
    totals = counted.filter("word is null").select("lang", F.col("n").alias("total"))
    words = counted.filter("word is not null")
    total = totals.agg(F.sum("total").alias("t")).first()["t"] or 0
    phrases = materialise(phrase_counts(rows, words, total, least), "phrases")
    size = F.size("ids")

    around = phrases.filter(size > 2).select(
        F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), F.col("n").alias("longer")
    ).groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = phrases.join(around, "ids", "left").filter("longer is null or longer < n").select("ids", F.col("n").alias("a"))

    parts = phrases.unionByName(words.select(F.array("id").alias("ids"), "n"))
    first = words.select(F.col("id").alias("first"), "lang").join(totals, "lang")
    cuts = (
        kept.withColumn("first", F.col("ids")[0]).join(first, "first")
        .select("ids", "a", "lang", F.col("total").alias("n"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
        .withColumn("left", F.slice("ids", F.lit(1), F.col("k"))).withColumn("right", F.slice("ids", F.col("k") + 1, size - F.col("k")))
        .join(parts.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left")
        .join(parts.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right")
        .withColumn("score", cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    )
    scored = cuts.groupBy("ids", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelled = (
        scored.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
        .groupBy("ids").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    )
    ranked = scored.join(spelled, "ids").select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
