"""Packing of tokenised documents into windows by Karmarkar-Karp differencing.

Each task reads documents in batches and keeps a pool of pieces. A full pool is divided into windows
by multiway differencing: the partial partition with the largest difference between its windows is
merged with the next largest, largest window on smallest, until one partition is left. The number
of windows starts at the least that can hold the pool and rises whenever a window is over its
capacity. Pools are bounded, so is a task's memory; nothing is shuffled, so a hot source or a very
long document is only more pieces.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.llm.words import plain, slices, split, wide_hashes

CAPACITY = 4096
END_OF_DOCUMENT = 2
#: Longer documents are cut: into whole windows, and the rest into pieces of at most this size.
PIECE = 1024
#: Tokens a pool gathers before it is divided into windows.
POOL_TOKENS = 1 << 20
#: Word parts whose ids a worker remembers (about 50 bytes each); a full memory is emptied.
REMEMBERED = 500_000
#: Text tokenised at a time.
TEXT_BYTES = 1 << 20
#: Tokenised slices after which freed Arrow memory goes back to the system.
RELEASE_EVERY = 16
#: Set between parts to encode many at once: a digit is always a token of its own.
MARK = "0"
#: Signs that are cut off the end of a word; not those of special tokens.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~")] = True


# --- tokens ---------------------------------------------------------------------------------------

class WordTokenizer:
    """Ids of whole texts by way of their distinct words.

    The vocabulary lower-cases text, drops white space and never joins a letter with a punctuation
    mark after it, so the ids of a text are those of words and of the marks at their ends one after the
    other. A worker remembers the ids of parts it has seen, by a hash of 128 bits.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark_id = mark[0] if len(mark) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def look_up(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Places of parts in the memory, -1 for new ones."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts and how many each has."""
        encode = self.tokenizer.encode_batch_fast
        odd = np.array([MARK in p or "<|" in p or self.mark_id is None for p in parts], bool)
        alone, joint = np.flatnonzero(odd), np.flatnonzero(~odd)
        made = [np.array(m.ids, np.uint32) for m in encode([parts[i] for i in alone], add_special_tokens=False)]
        sizes, ids = [np.array([len(m) for m in made], np.int64)], made
        for a in range(0, len(joint), 512):
            text = MARK.join([parts[i] for i in joint[a : a + 512]])
            joined = np.array(encode([text], add_special_tokens=False)[0].ids, np.uint32)
            is_mark = joined == self.mark_id
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(is_mark), [len(joined)]])) - 1)
            ids.append(joined[~is_mark])
        size, order = np.concatenate(sizes), np.concatenate([alone, joint])
        ids = np.concatenate([np.zeros(0, np.uint32), *ids])
        if not len(alone):
            return ids, size
        back = np.argsort(order)  # in the order given
        begin, size = (np.cumsum(size) - size)[back], size[back]
        return ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(ids))], size

    def remember(self, parts: pa.Array, key: np.ndarray, check: np.ndarray) -> None:
        _, first = np.unique(key, return_index=True)
        ids, size = self.encode_parts(parts.take(pa.array(first)).to_pylist())
        start = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, ids])
        order = np.argsort(np.concatenate([self.key, key[first]]), kind="stable")
        join = lambda old, new: np.concatenate([old, new])[order]
        self.check, self.start, self.size = join(self.check, check[first]), join(self.start, start), join(self.size, size)
        self.key = join(self.key, key[first])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and where each text starts."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # marks of special tokens depend on case
            texts = pc.ascii_lower(texts)
        flat, starts = cut_marks(*split(texts))
        coded = flat.dictionary_encode()
        parts = coded.dictionary
        key, check = wide_hashes(parts)
        if len(self.key) > REMEMBERED:
            self.forget()
        # Starts in the pool stay valid when parts are added, places do not: only new parts are looked up again.
        where, count = np.zeros(len(key) + 1, np.int64), np.ones(len(key) + 1, np.int64)
        place = self.look_up(key, check)
        new, old = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
        where[old], count[old] = self.start[place[old]], self.size[place[old]]
        lost = new
        if len(new):
            self.remember(parts.take(pa.array(new)), key[new], check[new])
            place = self.look_up(key[new], check[new])
            old, lost = new[place >= 0], new[place < 0]  # lost: parts whose first hash is that of another part
            where[old], count[old] = self.start[place[place >= 0]], self.size[place[place >= 0]]
        pool = [self.pool]
        if len(lost):
            ids, size = self.encode_parts(parts.take(pa.array(lost)).to_pylist())
            where[lost], count[lost] = len(self.pool) + np.cumsum(size) - size, size
            pool.append(ids)
        pool = np.concatenate([*pool, np.array([END_OF_DOCUMENT], np.uint32)])
        where[-1] = len(pool) - 1
        word = np.insert(np.asarray(coded.indices, dtype=np.int64), starts[1:], len(parts))
        count, where = count[word], where[word]
        total = np.zeros(len(word) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = pool[np.repeat(where - total[:-1], count) + np.arange(total[-1])]
        return ids, total[starts + np.arange(len(starts))]


def cut_marks(flat: pa.Array, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words with the punctuation marks at their end, after a letter, made a word of their own."""
    if not len(flat):
        return flat, starts
    offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2], np.uint8)
    begin, at, end = offsets[:-1], np.arange(len(flat)), offsets[1:].copy()
    while len(at):  # ``end`` moves back over the marks, word by word where there are more
        at = at[(end[at] > begin[at]) & PUNCTUATION[data[end[at] - 1]]]
        end[at] -= 1
    last, before = data[np.maximum(end - 1, 0)], data[np.maximum(end - 2, 0)]
    letter = (last >= 97) & (last <= 122)
    # U+00DF to U+00FF without the division sign; composed letters of other texts stay with their marks
    letter |= (before == 0xC3) & (last >= 0x9F) & (last <= 0xBF) & (last != 0xB7)
    cut = letter & (end > begin) & (end < offsets[1:])
    moved = np.zeros(len(cut) + 1, np.int64)
    np.cumsum(cut, out=moved[1:])
    at = np.flatnonzero(cut)
    offsets = np.insert(offsets, at + 1, end[at]).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), flat.buffers()[2]), starts + moved[starts]


@cache
def tokenizer(path: str) -> WordTokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return WordTokenizer(path)


# --- differencing ---------------------------------------------------------------------------------

def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: the numbers divided into so many parts of near equal sums, as lists of their places.

    A partial partition is kept as its non-empty parts, largest first. Merging sets the largest
    parts of one against the smallest of the other.
    """
    parts: list[list[int]] = [[i] for i in range(len(sizes))]
    heap = [(-s, i, [s], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, one, mine = heapq.heappop(heap)
        _, _, two, other = heapq.heappop(heap)
        if len(one) < len(two):
            one, two, mine, other = two, one, other, mine
        over = max(0, len(one) + len(two) - ways)
        # the last `over` parts of one meet the smallest of two, the smallest of one the largest of those
        met = []
        for k in range(over):
            a, b = len(one) - over + k, len(two) - 1 - k
            parts[mine[a]] += parts[other[b]]
            met.append((one[a] + two[b], mine[a]))
        keep = len(two) - over
        rows = list(zip(one[: len(one) - over], mine)) + met + list(zip(two[:keep], other))
        rows.sort(key=itemgetter(0), reverse=True)
        sums, owners = [s for s, _ in rows], [i for _, i in rows]
        least = sums[-1] if len(sums) == ways else 0
        turn += 1
        heapq.heappush(heap, (least - sums[0], turn, sums, owners))
    return [parts[i] for i in heap[0][3]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The pieces divided into as few near-equal windows as differencing can make within capacity."""
    ways = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, ways)
        if max((sum(sizes[i] for i in part) for part in found), default=0) <= capacity:
            return found
        ways += 1


# --- Spark ----------------------------------------------------------------------------------------

PIECE_COLUMNS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
PIECE_TYPE = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents in windows of at most 4096 tokens, a row a piece.

    ``doc_id, start, length, ids`` (little-endian unsigned 32-bit integers) ``, doc_tokens,
    sequence_id, offset, sequence_tokens``. A document is its ids and the end id, so a null or empty text is
    that one id. Each row of the table is a document of its own, also if its id is null or stands
    twice. Sequence ids are unique over the table, offsets gapless from 0. An empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 33
        pool: list[tuple] = []
        held = 0

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], PIECE_COLUMNS)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for part in windows([p[2] for p in pool], CAPACITY):
                whole, at = sum(pool[i][2] for i in part), 0
                for i in part:
                    rows.append((*pool[i], sequence, at, whole))
                    at += pool[i][2]
                sequence += 1
            for a in range(0, len(rows), 1024):
                yield emit(rows[a : a + 1024])

        for batch in batches:
            texts, owners = plain(batch.column(1)), batch.column(0).to_pylist()
            for turn, (a, b) in enumerate(slices(texts, TEXT_BYTES), start=1):
                if turn % RELEASE_EVERY == 0:
                    pa.default_memory_pool().release_unused()
                ids, starts = coder.encode(texts.slice(a, b - a))
                full = []
                for doc, begin, end in zip(owners[a:b], starts[:-1].tolist(), starts[1:].tolist()):
                    n, start = end - begin, 0
                    while n - start >= CAPACITY:
                        data = ids[begin + start : begin + start + CAPACITY].tobytes()
                        full.append((doc, start, CAPACITY, data, n, sequence, 0, CAPACITY))
                        sequence += 1
                        start += CAPACITY
                    while start < n:
                        size = min(PIECE, n - start)
                        data = ids[begin + start : begin + start + size].tobytes()
                        pool.append((doc, start, size, data, n))
                        start += size
                        held += size
                    if len(full) >= 256:
                        yield emit(full)
                        full = []
                    if held >= POOL_TOKENS:
                        yield from close()
                        pool, held = [], 0
                if full:
                    yield emit(full)
        if pool:
            yield from close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, PIECE_TYPE)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, tokens, ids``: the pieces of each window joined in order, without padding."""
    rows = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), rows.alias("rows"))
    return joined.select("sequence_id", "tokens", F.unhex(F.array_join(F.col("rows.ids"), "")).alias("ids"))
