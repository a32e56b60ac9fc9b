"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's 64-bit fingerprint holds, bit by bit, the majority of the hashes of its 3-word
shingles. Two fingerprints link if they differ in at most 3 bits. Links are found exactly:

* 3 errors leave one of 4 blocks of 16 bits unchanged (pigeonhole), and of the two halves of the
  other 48 bits one has at most 1 error;
* 23 bits of that half are decoded with the perfect [23, 12, 7] Golay code. A word and all words at
  distance 1 decode to 1 or 6 codewords. Two words that differ in at most 1 bit share one of them.

So each distinct fingerprint has up to 48 keys of 28 bits (16 exact, 12 of the codeword index) with
the block and half they stand for, and linked fingerprints share a key. Rows of one key are
verified by their Hamming distance. A key with many fingerprints (near copies of one text) isn't
expanded into pairs: a search from its members over those not yet reached gives a spanning forest
of its links, which has fewer edges than members and the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.llm.components import components
from lociforge.llm.resemblance import joined_groups
from lociforge.llm.store import materialise, tasks_for
from lociforge.llm.words import plain, slices, split

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
BLOCK_BITS, BLOCKS = 16, 4
#: Generator of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
#: Keys with up to so many fingerprints are compared pair by pair, in bulk.
PAIRWISE = 16
#: Keys with more fingerprints are divided by exact pieces of their remaining bits first.
DIVIDE_ABOVE = 20_000
#: Fingerprints a task makes keys of.
ROWS_A_TASK = 65_536


# --- fingerprints ---------------------------------------------------------------------------------

def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles in order, and the start of each document among them."""
    flat, starts = split(pc.ascii_lower(texts))
    counts = np.diff(starts)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), " ")
    spaced = whole[0].as_buffer().to_pybytes()
    ends = np.cumsum(np.asarray(pc.binary_length(flat), dtype=np.int64) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(flat) else ends
    made = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=first[1:])
    at = np.arange(first[-1]) + np.repeat(starts[:-1] - first[:-1], made)
    last = np.minimum(at + SHINGLE, np.repeat(starts[1:], made)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(spaced[a:b], SEED) for a, b in zip(begins[at].tolist(), ends[last].tolist())),
        dtype=np.uint64, count=len(at),
    )
    return hashes, first


def bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, from each of the starts ``first`` to the next."""
    out = np.empty((len(first), 64), np.int64)
    for bit in range(64):
        out[:, bit] = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).view(np.int64), first)
    return out


def fingerprint_values(texts: pa.Array) -> np.ndarray:
    """Fingerprints as unsigned 64-bit integers; a text without words has 0."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in slices(texts):
        hashes, first = shingle_hashes(texts.slice(a, b - a))
        n = np.diff(first)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        ones = bit_counts(hashes, first[some])
        majority = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little")
        out[a + some] = np.ascontiguousarray(majority).view(np.uint64).ravel()
    return out


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column as a signed 64-bit integer; null counts as empty."""

    @F.arrow_udf("long")
    def values(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprint_values(plain(texts)).view(np.int64))

    return values(text)


# --- keys -----------------------------------------------------------------------------------------

@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity of each 12-bit message; by syndrome, what to add to a message for its codeword indices, and how many."""
    parity = np.zeros(1 << 12, np.int64)
    for k in range(12):
        rest = 1 << (k + 11)
        for bit in range(k + 11, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        parity[1 << k] = rest
    for m in range(1, 1 << 12):
        parity[m] = parity[m & (m - 1)] ^ parity[m & -m]
    one = [1 << i for i in range(23)]
    errors = [0, *one]
    errors += [a | b for i, a in enumerate(one) for b in one[:i]]
    errors += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    errors = np.array(errors)
    error_of = np.full(1 << 11, -1, np.int64)
    error_of[parity[errors >> 11] ^ (errors & 0x7FF)] = errors
    decode = lambda w: (w ^ error_of[parity[w >> 11] ^ (w & 0x7FF)]) >> 11
    near = np.stack([decode(np.arange(1 << 11) ^ flip) for flip in errors[:24]], axis=1)
    sets = [sorted(set(row)) for row in near.tolist()]
    count = np.array([len(s) for s in sets])
    padded = np.array([s + [0] * (count.max() - len(s)) for s in sets])
    return parity, padded, count


def remaining(prints: np.ndarray, block: int) -> np.ndarray:
    """The 48 bits of fingerprints outside one block."""
    low = prints & np.uint64((1 << block * BLOCK_BITS) - 1)
    high = prints >> np.uint64((block + 1) * BLOCK_BITS) if block < BLOCKS - 1 else np.zeros_like(prints)
    return low | (high << np.uint64(block * BLOCK_BITS))


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and, for each, the row of its fingerprint."""
    parity, offsets, count = golay()
    rows, keys = [], []
    for block in range(BLOCKS):
        exact = ((prints >> np.uint64(block * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
        rest = remaining(prints, block)
        for half in range(2):
            word = ((rest >> np.uint64(24 * half)) & np.uint64(0x7FFFFF)).astype(np.int64)
            syndrome = parity[word >> 11] ^ (word & 0x7FF)
            owner = np.repeat(np.arange(len(prints)), count[syndrome])
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count[syndrome]) - count[syndrome], count[syndrome])
            index = (word >> 11)[owner] ^ offsets[syndrome[owner], nth]
            rows.append(owner)
            keys.append(((block * 2 + half) << 28) | (exact[owner] << 12) | index)
    return np.concatenate(keys), np.concatenate(rows)


def fuzzy_keys(prints: DataFrame) -> DataFrame:
    """``key, print`` rows for distinct fingerprints ``print``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            for a in range(0, len(values), 4096):
                keys, rows = keys_of(values[a : a + 4096])
                yield pa.record_batch([pa.array(keys), pa.array(values[a : a + 4096][rows].view(np.int64))], ["key", "print"])

    return prints.select("print").mapInArrow(make, "key long, print long")


# --- links ----------------------------------------------------------------------------------------

def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_DISTANCE


def forest(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints.

    Each search step compares members just reached with those not reached yet, so a tight group
    costs about its size and only mutually distant members are compared with each other.
    """
    found = []
    while len(values) > 1:
        front, values = values[:1], values[1:]
        while len(front) and len(values):
            width = max(1, (1 << 20) // len(values))
            now, front = front[:width], front[width:]
            hit = near(now[:, None], values[None, :])
            reached = hit.any(axis=0)
            if reached.any():
                found.append((now[hit.argmax(axis=0)[reached]], values[reached]))
                front = np.concatenate([front, values[reached]])
                values = values[~reached]
    return found


def large_forest(values: np.ndarray, key: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The links of a very common key, piece by piece.

    Its members agree in 16 bits; 3 errors leave one of 4 pieces of 12 bits of the others unchanged.
    """
    if len(values) <= DIVIDE_ABOVE:
        return forest(values)
    rest = remaining(values, key >> 29)
    found = []
    for piece in range(4):
        part = (rest >> np.uint64(12 * piece)) & np.uint64(0xFFF)
        order = np.argsort(part, kind="stable")
        for run in np.split(values[order], np.flatnonzero(np.diff(part[order])) + 1):
            found += forest(run)
    return found


def run_links(keys: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among the rows of each key; rows come sorted by key and fingerprint, without repeats."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    bounds = np.concatenate([[0], cuts, [len(keys)]])
    size = np.diff(bounds)
    length = np.repeat(size, size)
    left = length - (np.arange(len(keys)) - np.repeat(bounds[:-1], size)) - 1  # rows of the key still to come
    found = []
    small = np.flatnonzero((length > 1) & (length <= PAIRWISE))
    for lag in range(1, PAIRWISE):
        small = small[left[small] >= lag]
        hit = small[near(values[small], values[small + lag])]
        if len(hit):
            found.append((values[hit], values[hit + lag]))
    for k in np.flatnonzero(size > PAIRWISE):
        found += large_forest(values[bounds[k] : bounds[k + 1]], int(keys[bounds[k]]))
    return found


def verified_links(keyed: DataFrame) -> DataFrame:
    """Links ``a, b`` between fingerprints that share a key: all pairs of small keys, a spanning forest of large ones."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last key so far, which may go on

        def made(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in run_links(keys, values) if len(keys) > 1 else []:
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and held[0][0][0] != keys[0]):
                whole = [*held, (keys[:cut], values[:cut])]
                yield from made(np.concatenate([k for k, _ in whole]), np.concatenate([v for _, v in whole]))
                held = []
            held.append((keys[cut:].copy(), values[cut:].copy()))
        if held:
            yield from made(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, print, root, component_id`` of every document.

    component_id is the smallest id among the documents reachable over links, itself included.
    Null text is empty; all texts without words have fingerprint 0 and form one component with
    what is near 0. root names the component, also where its ids are null. Repeated rows give repeated rows. A null id never names a component, unless all
    ids of it are null. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), fingerprint(F.col("text")).alias("print")
    )
    rows = materialise(rows, "prints")
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("first"))
    # a row becomes some forty keys, so tasks follow the number of rows
    dealt = prints.repartition(tasks_for(docs.sparkSession, rows.count(), ROWS_A_TASK), "print")
    tree = components(verified_links(fuzzy_keys(dealt)))
    rooted = prints.join(tree, prints["print"] == tree["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    label = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(label, "root").select("print", "root", "component_id")
    return rows.join(named, "print").select("doc_id", "text_hash", "print", "root", "component_id")


def hex_print(value: Column) -> Column:
    """16 lowercase hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def one_of_each(docs: DataFrame, resembling: bool = False) -> DataFrame:
    """One document of each component stays, with all its columns: that of the smallest id.

    With ``resembling``, components are also joined by texts of like shingles, see ``resemblance``.
    Null ids come last; rows with one id are told apart by their text, and of equal rows one stays.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    groups = near_duplicates(docs)
    if resembling:
        groups = joined_groups(docs, materialise(groups.select("doc_id", "text_hash", "root"), "groups"))
    found = groups.groupBy("root").agg(F.min(rank).alias("r"))
    keep = found.select(F.col("r.doc_id").alias("keep_id"), F.col("r.text_hash").alias("keep_hash"))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.struct("*").alias("row"))
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("hash") == F.col("keep_hash"))
    return rows.join(keep, same, "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
