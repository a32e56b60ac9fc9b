"""Removal of repeated word windows by recompression.

Texts are rewritten in two rounds that depend on neighbouring symbols only: a word that stands
exactly twice in a row becomes one symbol (run round), then a symbol of the left class and a
following one of the right class become one (pair round). A new symbol's name is a 64-bit hash of its
parts, so it is the same in every document and no exchange is needed to agree on it. Whether a
boundary stays is decided by the words next to it: inside a window of 20 words, all boundaries
from word 3 to word 17 are the same wherever the window stands, so equal windows have the same
symbols there. A symbol has at most 4 words, so there are some.

Each window is represented by one of them, the leftmost of smallest hash (its anchor); consecutive
windows share anchors, about one in seven words. Spark groups anchors by their name with 3 words of
context on either side. An anchor has the words of all its windows as content hash:

* anchors of equal name and content: all windows of all but the first are repeats;
* the first of each content, where a name has several contents: its windows are compared one by one
  in a second grouping by window hash;
* names that stand once: no window of theirs is a repeat.

Only the second kind needs rows per window: the borders of repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociforge.llm.store import materialise
from lociforge.llm.words import BASES, RangeHash, mix, names, plain, slices, split

WIDTH = 20
#: Words at either end of a window whose boundaries may depend on words outside.
MARGIN = 3
CONTEXT = 3
NO_ID = (1 << 63) - 1


# --- rounds ---------------------------------------------------------------------------------------

def run_round(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word joins the one before: it is the second of a run of exactly two."""
    n = len(name)
    same = np.zeros(n + 2, bool)  # same[i]: word i continues the run of word i - 1
    same[1:n] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
    joins = same[:n] & ~same[1 : n + 1]
    joins[1:] &= ~same[: n - 1]
    return joins


def pair_round(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each symbol joins the one before: that is of the left class and it is of the right one."""
    left = (mix(name ^ np.uint64(BASES[1])) >> np.uint64(40)) & np.uint64(1) == 0
    joins = np.zeros(len(name), bool)
    joins[1:] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
    return joins


def symbols(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the symbols after both rounds and the word at which each starts."""
    joins = run_round(word, doc)
    start = np.flatnonzero(~joins)
    name = mix(word[start] + np.uint64(1))
    twice = np.zeros(len(word) + 1, bool)
    twice[:-1] = joins
    name = np.where(twice[start + 1], mix(name ^ np.uint64(BASES[0])), name) if len(start) else name
    joins = pair_round(name, doc[start])
    first = np.flatnonzero(~joins)
    paired = np.zeros(len(name) + 1, bool)
    paired[:-1] = joins
    second = name[np.minimum(first + 1, len(name) - 1)]
    out = np.where(paired[first + 1], mix(name[first] * np.uint64(3) + mix(second)), name[first])
    return out, start[first]


def least(values: np.ndarray, begin: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least value of each range, both ends included, of at most 16 values."""
    levels = [values]
    for k in range(4):
        prior = levels[-1]
        step = min(1 << k, len(prior))
        levels.append(np.minimum(prior, np.concatenate([prior[step:], prior[len(prior) - step :]])))
    size = last - begin + 1
    level = np.floor(np.log2(size)).astype(np.int64)
    stack = np.stack(levels)
    return np.minimum(stack[level, begin], stack[level, last + 1 - (1 << level)])


def anchors(word: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The anchors of documents given as word hashes: ``doc``, the windows ``low`` to ``high`` (word
    numbers over all documents) that each stands for, its ``name`` and the ``content`` of its windows."""
    n = len(word)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    window = np.arange(n)
    window = window[window + WIDTH <= np.repeat(starts[1:], np.diff(starts))]
    if not len(window):
        return {k: np.zeros(0, np.int64) for k in ("doc", "low", "high", "name", "content")}
    name, start = symbols(word, doc)
    end = np.append(start[1:], n)
    begins = np.zeros(n + 1, bool)
    begins[start] = True
    begins[n] = True
    symbol = np.cumsum(begins) - 1
    a, b = window + MARGIN, window + WIDTH - MARGIN
    begin = symbol[a] + ~begins[a]
    last = symbol[b - 1] - ~begins[b]
    rank = (mix(name + np.uint64(BASES[0])) >> np.uint64(1) & ~np.uint64(0xFFFFFFF)) | np.arange(len(name), dtype=np.uint64)
    best = (least(rank, begin, last) & np.uint64(0xFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (doc[window[1:]] != doc[window[:-1]])))
    low, high = window[new], window[np.append(new[1:], len(window)) - 1]
    best = best[new]
    one, two = RangeHash(word, BASES[0]), RangeHash(mix(word ^ np.uint64(BASES[1])), BASES[1])
    around = one.of(start[best] - CONTEXT, end[best] + CONTEXT)
    content = two.of(low, high + WIDTH) + (start[best] - low).astype(np.uint64) * np.uint64(BASES[0])
    return {"doc": doc[low], "low": low, "high": high, "name": mix(around ^ name[best]), "content": mix(content)}


# --- Spark ----------------------------------------------------------------------------------------

def _repeats_here(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch that are copies of others, all but one of each, and rows whose key (the first two
    columns) stands earlier in it, in the order of the other columns."""
    by = np.lexsort(columns[::-1])
    copy, again = np.zeros(len(by), bool), np.zeros(len(by), bool)
    if len(by) > 1:
        same = [c[by[1:]] == c[by[:-1]] for c in columns]
        copy[by[1:]] = np.logical_and.reduce(same)
        again[by[1:]] = same[0] & same[1]
    return copy, again


def _keyed(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows with a mark at repeats within the batch. Those need no grouping any more, so they get keys
    of their own, which keeps a common passage from meeting in one task. Rows that are equal in their
    document and place too come from copies of one document and are no repeats: one of them stays."""
    copy, here = _repeats_here(columns)
    if copy.any():
        columns, here = [c[~copy] for c in columns], here[~copy]
    own = mix(columns[2].view(np.uint64) * np.uint64(BASES[0]) + columns[4].astype(np.uint64)).view(np.int64)
    columns[0] = np.where(here, own, columns[0])
    return pa.record_batch([*map(pa.array, columns), pa.array(here)], ["k", "c", "d", "u", "at", "here"])


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column("_d")), np.asarray(batch.column("_u"))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, u = _ids(batch)
        texts = plain(batch.column("text"))
        found = []
        for a, b in slices(texts):
            flat, starts = split(texts.slice(a, b - a))
            rows = anchors(names(flat), starts)
            doc = rows["doc"]
            at = (rows["low"] - starts[doc]) << 8 | np.minimum(rows["high"] - rows["low"], 255)
            found.append([rows["name"].view(np.int64), rows["content"].view(np.int64), d[a:b][doc], u[a:b][doc], at])
        if found:
            yield _keyed([np.concatenate(c) for c in zip(*found)])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, u = _ids(batch)
        texts, lists = plain(batch.column("text")), batch.column("unsure")
        for a, b in slices(texts):
            flat, starts = split(texts.slice(a, b - a))
            word = names(flat)
            mine = lists.slice(a, b - a)
            at = np.asarray(mine.flatten(), dtype=np.int64)
            if not len(at):
                continue
            size = np.asarray(pc.list_value_length(mine), dtype=np.int64)
            many = (at & 255) + 1
            doc = np.repeat(np.repeat(np.arange(b - a), size), many)
            first = np.repeat(at >> 8, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            begin = starts[doc] + first
            one, two = RangeHash(word, BASES[0]), RangeHash(mix(word ^ np.uint64(BASES[1])), BASES[1])
            columns = [
                one.of(begin, begin + WIDTH).view(np.int64), two.of(begin, begin + WIDTH).view(np.int64),
                d[a:b][doc], u[a:b][doc], first,
            ]
            yield _keyed(columns)


def _kept(text: str | None, covered: list[int] | None, single: list[int] | None) -> tuple[int, int, list[bytes]]:
    """The number of words, of removed words and the kept words of one text."""
    found = (text or "").encode().split()
    if not covered and not single:
        return len(found), 0, found
    marks = np.zeros(len(found) + 1, np.int64)
    packed = np.asarray(covered or [], dtype=np.int64)
    lone = np.asarray(single or [], dtype=np.int64)
    low = np.concatenate([packed >> 8, lone])
    high = np.concatenate([(packed >> 8) + (packed & 255), lone])
    np.add.at(marks, low, 1)
    np.add.at(marks, high + WIDTH, -1)
    keep = np.cumsum(marks)[:-1] == 0
    return len(found), int(len(found) - keep.sum()), list(compress(found, keep.tolist()))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and the pair that orders documents: null ids come last, equal ids go by a hash of the text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"), F.xxhash64("text").alias("_u"), "doc_id", "text"
    )


ROW_TYPE = "k long, c long, d long, u long, at long, here boolean"


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``_d, _u, covered, unsure``: arrays of anchors, packed as first window << 8 | windows after it.

    Windows of ``covered`` are repeats; those of ``unsure`` have to be compared one by one.
    """
    found = rows.select("_d", "_u", "text").mapInArrow(_anchor_rows, ROW_TYPE)
    named = Window.partitionBy("k", "here")
    first = F.min(F.struct("d", "u", "at")).over(Window.partitionBy("k", "here", "c"))
    several = F.min("c").over(named) != F.max("c").over(named)
    marked = found.select(
        "d", "u", "at", (F.col("here") | (F.struct("d", "u", "at") != first)).alias("again"), several.alias("several")
    )
    return (
        marked.filter("again or several")
        .groupBy(F.col("d").alias("_d"), F.col("u").alias("_u"))
        .agg(
            F.collect_list(F.when(F.col("again"), F.col("at"))).alias("covered"),
            F.collect_list(F.when(~F.col("again"), F.col("at"))).alias("unsure"),
        )
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (kept words joined by one space, UTF-8 bytes) per document.

    A word goes if some window of 20 words over it also starts earlier: in a document of smaller id,
    or further left in the same one. Windows are those of the input. Null text is empty; documents
    under 20 words lose nothing. Null ids count as larger than all others; rows of one id with
    different texts are ordered by a 64-bit hash of the text, and rows equal in both are one document,
    so they have one result. An empty table gives no rows.
    """
    rows = _rows(docs, id_col, text_col)
    flags = materialise(repeated_windows(rows), "repeats")
    unsure = flags.filter(F.size("unsure") > 0).select("_d", "_u", "unsure")
    single = (
        rows.join(unsure, ["_d", "_u"]).select("_d", "_u", "text", "unsure").dropDuplicates(["_d", "_u"])
        .mapInArrow(_window_rows, ROW_TYPE)
    )
    first = F.min(F.struct("d", "u", "at")).over(Window.partitionBy("k", "here", "c"))
    single = (
        single.select("d", "u", "at", (F.col("here") | (F.struct("d", "u", "at") != first)).alias("again"))
        .filter("again").groupBy(F.col("d").alias("_d"), F.col("u").alias("_u"))
        .agg(F.collect_list("at").alias("single"))
    )
    joined = rows.join(flags.select("_d", "_u", "covered"), ["_d", "_u"], "left").join(single, ["_d", "_u"], "left")

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(plain(batch.column("text"))):
                part = batch.slice(a, b - a).to_pydict()
                kept = [_kept(*row) for row in zip(part["text"], part["covered"], part["single"])]
                yield pa.record_batch(
                    [
                        pa.array(part["doc_id"], pa.int64()), pa.array([k[0] for k in kept], pa.int64()),
                        pa.array([k[1] for k in kept], pa.int64()), pa.array([b" ".join(k[2]) for k in kept], pa.binary()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return joined.select("doc_id", "text", "covered", "single").mapInArrow(
        result, "doc_id long, n_words long, n_removed long, kept binary"
    )


