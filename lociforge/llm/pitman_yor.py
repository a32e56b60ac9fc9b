"""Hierarchical Pitman-Yor language model: word pairs, trained by Gibbs sampling of Chinese-restaurant seats.

Each word that stands before others is a restaurant (its context); the words that follow it are dishes. A
customer of a dish sits down at one of its tables or opens a new one, and a new table sends a customer to the
parent, one restaurant that all contexts share, which seats it in the same way over a uniform base with one
place for all unknown words. In a sweep all customers of every dish in every restaurant leave and sit down again,
given the seats of the others as the sweep before left them (blocked Gibbs sampling, all dishes side by side); after the
first sweeps the seats give samples of the probabilities, and a text is scored by their average.

What depends on what: the seats of a dish need its count, the number of tables of its restaurant and its
probability at the parent. So pairs are dealt to buckets by their hash, whichever word is common; a bucket keeps
the counts of its pairs, and a sweep sends it two numbers for each of its words and gets back sums of
tables. Counting and scoring move pairs as packed blocks of a task and a bucket. The buckets follow the size of
the texts, so each holds about the same amount, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.llm.blobs import pack, rising, unpack
from lociforge.llm.store import drop, materialise
from lociforge.llm.words import BASES, give_back, mix, names, plain, slices, split

#: Bytes of text to a bucket.
BUCKET_BYTES = 24 << 20
#: Tokens a task gathers before it deals out their pairs.
CHUNK = 1 << 22
TEXT_BYTES = 2 << 20
SWEEPS, SAMPLES = 3, 2
#: Concentrations of the contexts and of their parent; discounts follow from the counts.
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
#: Customers of a dish whose tables are drawn at once; later ones come in parties.
AT_ONCE = 128
#: Stands for the end of a text and for what is before its first word. No word is empty.
END = np.uint64(xxhash.xxh64_intdigest(b"", BASES[0]))


# --- seats ----------------------------------------------------------------------------------------

@cache
def seatings(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: at ``[c, t]`` the weight of all ways to seat c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(most + 1)
    for c in range(most):
        joins = np.where(t <= c, out[c] + np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        out[c + 1] = np.logaddexp(np.append(-np.inf, out[c][:-1]), joins)
    return out


def seated(
    customers: np.ndarray, others: np.ndarray, p: np.ndarray, strength: float, discount: float, seed: tuple[int, ...]
) -> np.ndarray:
    """Tables of each dish once its customers have left and sat down again, given everything else.

    ``others`` are the tables of the other dishes in the restaurant, ``p`` is the dish's probability at the parent. The
    tables of up to AT_ONCE customers are drawn from their conditional distribution, which is the number of seatings
    times ``p * (strength + discount * (others + i))`` for table i. Later customers come in parties that
    grow with the number seated and meet the odds of their first.
    """
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed)))
    tables, first = np.ones(len(customers), np.int64), np.minimum(customers, AT_ONCE)
    ways = seatings(discount, AT_ONCE)
    order = np.argsort(first, kind="stable")
    for c in np.unique(first[first > 1]).tolist():
        rows = order[np.searchsorted(first[order], c) : np.searchsorted(first[order], c, "right")]
        for part in np.array_split(rows, -(-len(rows) * c // (1 << 20))):
            weight = np.log(p[part])[:, None] + np.log(strength + discount * (others[part][:, None] + np.arange(c)))
            weight = np.cumsum(weight, axis=1) + ways[c, 1 : c + 1]
            share = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[part] = 1 + (share < rng.random(len(part))[:, None] * share[:, -1:]).sum(axis=1)
    left, n = np.flatnonzero(customers > AT_ONCE), AT_ONCE
    while len(left):
        t, party = tables[left], n // 16
        new = p[left] * (strength + discount * (others[left] + t))
        tables[left] += rng.binomial(np.minimum(party, customers[left] - n), new / (new + n - discount * t))
        n += party
        left = left[customers[left] > n]
    return tables


def discount_of(ones: int, twos: int) -> float:
    """The usual estimate from the numbers of things seen once and twice, kept inside 0.05 to 0.95."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos) if ones + twos else 0.5))


@dataclass(frozen=True)
class Model:
    """What all tasks need: training tokens, distinct ones, discounts, customers and tables of the parent."""

    tokens: int
    vocabulary: int
    discount: float
    parent_discount: float
    customers: int
    tables: int

    @property
    def new_word(self) -> float:
        """The weight of a new table in the parent restaurant: its base is uniform, with one place for unknown words."""
        return (PARENT_STRENGTH + self.parent_discount * self.tables) / (self.vocabulary + 1)


# --- pairs ----------------------------------------------------------------------------------------

def pair_names(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(BASES[1]) + mix(word))


def bucket_of(pair: np.ndarray, buckets: int) -> np.ndarray:
    return ((pair >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def text_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token names of all texts, an end after each, and the number of tokens of each text."""
    flat, starts = split(pc.ascii_lower(texts))
    return np.insert(names(flat), starts[1:], END), np.diff(starts) + 1


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    code = np.empty(len(values), np.int64)
    code[order] = np.cumsum(new) - 1
    return ordered[new], code


def taken_codes(size: int, *codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which of ``size`` codes stand in the arrays, and the arrays as places among those."""
    mask = np.zeros(size, bool)
    for c in codes:
        mask[c] = True
    place = np.cumsum(mask, dtype=np.uint32) - np.uint32(1)
    return np.flatnonzero(mask), [place[c] for c in codes]


def packed_pairs(
    word: np.ndarray, sizes: np.ndarray, learned: np.ndarray, buckets: int, about: tuple[np.ndarray, ...] | None
) -> Iterator[tuple[int, bytes]]:
    """The distinct pairs of some texts by bucket: word names, the pairs as codes into them in order, and the tokens of each.

    Texts have ``sizes`` tokens. Without ``about`` only tokens of ``learned`` texts count; with it (arrays with a value for each
    text) all do, the texts they are from follow, and the first block has ``about``, the others have it empty.
    """
    ids, code = coded(word)
    before = np.empty_like(code)
    before[1:] = code[:-1]
    starts = np.cumsum(sizes) - sizes
    before[starts] = np.searchsorted(ids, END)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # pairs in order, and the texts of a pair in order: one number holds all three where it can
    wide, low = int(len(ids) - 1).bit_length(), int(len(sizes) - 1).bit_length()
    if 2 * wide + low < 64:
        before <<= wide + low
        before |= code << low
        before |= owner
        before.sort()
        owner = before & ((1 << low) - 1)
        x, y = before >> (wide + low), (before >> low) & ((1 << wide) - 1)
        del before, code
        key = x << 32 | y
    else:
        order = np.lexsort((owner, code, before))
        key, owner = (before << 32 | code)[order], owner[order]
    owner = owner.astype(np.uint32)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(first, len(key))).astype(np.uint32)
    if about is None:
        n = np.add.reduceat(learned[owner].astype(np.uint32), first)
    x, y = key[first] >> 32, key[first] & 0xFFFFFFFF
    del key
    home = bucket_of(pair_names(ids[x], ids[y]), buckets)
    by = np.argsort(home, kind="stable")  # pairs stay in order within a bucket
    bounds = np.searchsorted(home[by], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        mine = by[bounds[b] : bounds[b + 1]]
        use, (mx, my) = taken_codes(len(ids), x[mine], y[mine])
        parts = [rising(ids[use]), rising(mx), my, n[mine]]
        if about is not None:
            count = n[mine].astype(np.int64)
            place = np.repeat(first[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            texts = owner[place]  # as steps within each pair
            step = np.diff(texts, prepend=np.uint32(0))
            begin = np.cumsum(count) - count
            step[begin] = texts[begin]
            parts += [step, *about]
            about = tuple(a[:0] for a in about)
        yield b, pack(*parts)


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """Word names, the two codes of each pair, and the rest as packed."""
    known, x, *rest = unpack(data)
    return (np.cumsum(known, dtype=np.uint64), np.cumsum(x, dtype=np.uint32), *rest)


def dealt(rows: DataFrame, buckets: int, scoring: bool) -> DataFrame:
    """``bucket, base, data``: packed pairs of about CHUNK tokens each; with ``scoring`` also the rows they come from.

    The pairs' weights are their tokens in training rows. Rows are numbered from ``base`` on.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen, size = TaskContext.get().partitionId() << 33, 0, 0
        held: list[tuple[np.ndarray, ...]] = []

        def made() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            word, sizes, learned, doc, flags = (np.concatenate(c) for c in zip(*held))
            held.clear()
            for b, data in packed_pairs(word, sizes, learned, buckets, (doc, flags) if scoring else None):
                yield pa.record_batch(
                    [pa.array([b], pa.int64()), pa.array([base + seen], pa.int64()), pa.array([data], pa.binary())], ["bucket", "base", "data"]
                )
            seen += len(sizes)
            give_back()

        for batch in batches:
            texts, learned = plain(batch.column("text")), np.asarray(batch.column("learned").cast(pa.int8()))
            doc = np.asarray(pc.fill_null(batch.column("doc_id"), 0))
            flags = (np.asarray(batch.column("doc_id").is_valid()) | learned.astype(np.uint8) << 1).astype(np.uint8)
            for a, b in slices(texts, TEXT_BYTES):
                word, sizes = text_tokens(texts.slice(a, b - a))
                if held and size + len(word) > CHUNK:
                    yield from made()
                    size = 0
                held.append((word, sizes, learned[a:b], doc[a:b], flags[a:b]))
                size += len(word)
        if held:
            yield from made()

    return rows.select("doc_id", "text", "learned").mapInArrow(work, "bucket long, base long, data binary")


def merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word names of a bucket and its distinct pairs: two codes and the count in training, zero too."""
    parts = [unpacked(b) for b in blobs]
    known = np.unique(np.concatenate([p[0] for p in parts]))
    keys, n = [], np.concatenate([p[3] for p in parts])
    for ids, x, y, *_ in parts:
        place = np.searchsorted(known, ids)
        keys.append(place[x] << 32 | place[y])
    key = np.concatenate(keys)
    del parts, keys
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key = key[first]
    return known, key >> 32, key & 0xFFFFFFFF, np.add.reduceat(n[order], first, dtype=np.int64)


# --- training -------------------------------------------------------------------------------------
#
# Buckets of pairs and parts of the words (by ranges of their names) send each other packed columns of numbers. What
# a bucket asks a part for stays the same in all sweeps, so answers come in the order of the asking, without names.

MESSAGE = "bucket long, part long, kind string, data binary, sums array<long>"
MESSAGE_TYPES = {"bucket": pa.int64(), "part": pa.int64(), "kind": pa.string(), "data": pa.binary(), "sums": pa.list_(pa.int64())}


def messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(MESSAGE_TYPES)
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(MESSAGE_TYPES.items(), columns)})


def by_kind(group: pa.Table, order: str) -> dict[str, list[tuple[int, bytes]]]:
    """The data of each kind, with the number of their ``order`` (bucket or part), in that order."""
    out: dict[str, list[tuple[int, bytes]]] = {}
    for number, kind, data in zip(*(group.column(k).to_pylist() for k in (order, "kind", "data"))):
        out.setdefault(kind, []).append((number, data))
    return {kind: sorted(rows, key=lambda r: -1 if r[0] is None else r[0]) for kind, rows in out.items()}


def part_bounds(ids: np.ndarray, parts: int) -> np.ndarray:
    """Where the words of each part begin among sorted names."""
    return np.searchsorted(bucket_of(ids, parts), np.arange(parts + 1))


def counted(blocks: DataFrame, parts: int) -> DataFrame:
    """The training pairs of each bucket, packed, and what it knows of its words.

    ``again`` has the pairs with two tokens or more, ``once`` the others, as places among the bucket's words in order; ``sums``
    are the numbers of pairs with one token and with two. ``words`` rows go to the parts: names, tokens, distinct pairs that a
    word begins and ends, and those among them that are in ``again``; all of this bucket.
    """

    def count(group: pa.Table) -> pa.Table:
        known, x, y, n = merged(group.column("data").to_pylist())
        bucket, size = group.column("bucket")[0].as_py(), len(known)
        bins = lambda at, w=None: np.bincount(at, w, size).astype(np.uint32)
        rows, twos = [], [int((n == 1).sum()), int((n == 2).sum())]
        for kind, mine in (("again", n > 1), ("once", n == 1)):
            codes = [c[mine].astype(np.uint32) for c in (x, y, n)]
            rows.append((bucket, None, kind, pack(rising(codes[0]), *codes[1:]), twos))
            twos = [0, 0]
        seen, again = n > 0, n > 1
        columns = [bins(y, n), bins(x[seen]), bins(y[seen]), bins(x[again]), bins(y[again])]
        bounds = part_bounds(known, parts)
        for part in np.flatnonzero(np.diff(bounds)).tolist():
            mine = slice(bounds[part], bounds[part + 1])
            rows.append((bucket, part, "words", pack(rising(known[mine]), *(c[mine] for c in columns)), None))
        return messages(rows)

    return blocks.groupBy("bucket").applyInArrow(count, MESSAGE)


def introduced(state: DataFrame) -> DataFrame:
    """The words of each part: ``total`` (names and tokens), ``live`` and, for each bucket, its ``ask``.

    Words of one token have one customer at one table everywhere, so only the others are live: names, followers and contexts in
    pairs with one token, then tables, customers and their seats at the parent, which start with one table
    for each pair and one seat for each word. An ask has the places of a bucket's ``again`` words among the live ones. ``sums`` of
    total: tokens, words, customers of the parent, words with one context and with two, words of one token.
    """

    def introduce(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        told = [(bucket, unpack(data)) for bucket, data in by_kind(group, "bucket")["words"]]
        names_of = {bucket: np.cumsum(columns[0], dtype=np.uint64) for bucket, columns in told}
        ids = np.unique(np.concatenate(list(names_of.values())))
        sums = np.zeros((5, len(ids)), np.int64)
        for bucket, columns in told:
            at = np.searchsorted(ids, names_of[bucket])
            for k in range(5):
                sums[k, at] += columns[k + 1]
        known = sums[0] > 0
        ids_known, (c, followers, contexts, again_f, again_c) = ids[known], sums[:, known]
        live = c > 1
        rows = [(None, part, "total", pack(rising(ids_known), c), [
            int(c.sum()), len(c), int(contexts.sum()), int((contexts == 1).sum()), int((contexts == 2).sum()), int((c == 1).sum())
        ])]
        live_ids = ids_known[live]
        state = [(followers - again_f)[live], (contexts - again_c)[live], followers[live], contexts[live], np.ones(len(live_ids), np.int64)]
        rows.append((None, part, "live", pack(rising(live_ids), *state), None))
        for bucket, columns in told:
            wanted = names_of[bucket][(columns[4] > 0) | (columns[5] > 0)]
            if len(wanted):
                rows.append((bucket, part, "ask", pack(rising(np.searchsorted(live_ids, wanted).astype(np.uint32))), None))
        return messages(rows)

    return state.filter("kind = 'words'").groupBy("part").applyInArrow(introduce, MESSAGE)


def answered(words: DataFrame, live: DataFrame, seats: DataFrame | None, model: Model, sweep: int) -> DataFrame:
    """The parts' turn: new customers and seats of their live words, and an ``answer`` for each ask.

    ``seats`` is the result of the buckets' turn before, with the ``tables`` of the words asked for; none stands for the start.
    An answer has tables, customers and seats of the words; ``sums`` of ``live`` are all customers and all seats.
    """

    def answer(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        told = by_kind(group, "bucket")
        ids, single_f, single_c, tables, customers, taken = unpack(told["live"][0][1])
        asks = {bucket: np.cumsum(unpack(data)[0], dtype=np.int64) for bucket, data in told.get("ask", [])}
        if "tables" in told:
            tables, customers = single_f.copy(), single_c.copy()
            for bucket, data in told["tables"]:
                as_context, as_dish = unpack(data)
                tables[asks[bucket]] += as_context
                customers[asks[bucket]] += as_dish
        base = np.full(len(ids), 1 / (model.vocabulary + 1))
        taken = seated(customers, model.tables - taken, base, PARENT_STRENGTH, model.parent_discount, (sweep, 1, part))
        rows = [(None, part, "live", pack(ids, single_f, single_c, tables, customers, taken), [int(customers.sum()), int(taken.sum())])]
        rows += [(bucket, part, "answer", pack(tables[at], customers[at], taken[at]), None) for bucket, at in asks.items()]
        return messages(rows)

    feed = words.filter("kind = 'ask'").unionByName(live)
    if seats is not None:
        feed = feed.unionByName(seats.filter("kind = 'tables'"))
    return feed.groupBy("part").applyInArrow(answer, MESSAGE)


def probability(customers: np.ndarray, seats: np.ndarray, model: Model) -> np.ndarray:
    """Predictive probability of words in the parent restaurant."""
    return (customers - model.parent_discount * seats + model.new_word) / (PARENT_STRENGTH + model.customers)


def seated_pairs(state: DataFrame, answers: DataFrame, seats: DataFrame | None, model: Model, sweep: int) -> DataFrame:
    """The buckets' turn: ``seats``, the tables of each pair of ``again``, and ``tables``, their sums over the words of each part.

    ``seats`` is the result of the turn before; without one each pair has one table.
    """

    def sit(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        told = by_kind(group, "part")
        x, y, n = unpack(told["again"][0][1])
        if not len(n):
            return messages([])
        heard = [unpack(data) for _, data in told["answer"]]
        tables, customers, taken = (np.concatenate(c) for c in zip(*heard))  # parts in order: words in order
        x = np.cumsum(x, dtype=np.uint32)
        use, (x, y) = taken_codes(int(max(x.max(), y.max())) + 1, x, y)
        before = unpack(told["seats"][0][1])[0].astype(np.int64) if "seats" in told else np.ones(len(n), np.int64)
        p = probability(customers, taken, model)
        own = seated(n.astype(np.int64), tables[x] - before, p[y], STRENGTH, model.discount, (sweep, 0, bucket))
        rows = [(bucket, None, "seats", pack(own.astype(np.uint32)), None)]
        sums, begin = [np.bincount(c, own, len(use)).astype(np.int64) for c in (x, y)], 0
        for (part, _), told_of in zip(told["answer"], heard):
            mine = slice(begin, begin := begin + len(told_of[0]))
            rows.append((bucket, part, "tables", pack(sums[0][mine], sums[1][mine]), None))
        return messages(rows)

    feed = state.filter("kind = 'again'").unionByName(answers.filter("kind = 'answer'"))
    if seats is not None:
        feed = feed.unionByName(seats.filter("kind = 'seats'"))
    return feed.groupBy("bucket").applyInArrow(sit, MESSAGE)


@dataclass
class Trained:
    """The model of each sample, the seats of its pairs and its live words; the pairs and words they are about."""

    models: list[Model]
    seats: list[DataFrame]
    live: list[DataFrame]
    state: DataFrame
    words: DataFrame


def totals(rows: DataFrame, n: int) -> list[int]:
    """The ``sums`` of some rows, added up."""
    row = rows.agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)).alias(f"s{k}") for k in range(n)]).first()
    return list(row)


def train(rows: DataFrame, buckets: int) -> Trained | None:
    """The language model of the rows with ``learned``; none if there are no rows."""
    state = materialise(counted(dealt(rows, buckets, False), buckets), "pairs")
    words = materialise(introduced(state), "words")
    once, twice = totals(state.filter("kind in ('again', 'once')"), 2)
    tokens, size, customers, ones, twos, single = totals(words.filter("kind = 'total'"), 6)
    if not size:
        return None
    model = Model(tokens, size, discount_of(once, twice), discount_of(ones, twos), customers, size)
    out, live, seats = Trained([], [], [], state, words), words.filter("kind = 'live'"), None
    before_told = None
    for sweep in range(SWEEPS + 1):
        told = materialise(answered(words, live, seats, model, sweep), "answers")
        live = told.filter("kind = 'live'")
        now = totals(live, 2)
        model = replace(model, customers=now[0] + single, tables=now[1] + single)
        if sweep > SWEEPS - SAMPLES:
            out.models.append(model)
            out.live.append(live)
            out.seats.append(seats.filter("kind = 'seats'"))
        old, before = seats, before_told
        if sweep < SWEEPS:
            seats = materialise(seated_pairs(state, told, seats, model, sweep + 1), "seats")
        if sweep <= SWEEPS - SAMPLES:  # neither a sample nor needed by the next sweep
            drop(old)
            drop(before)
        before_told = told
    return out


def spoken(trained: Trained) -> DataFrame:
    """``word`` rows for the buckets: names of their words, tokens, and for each sample tables, customers and seats; zeros
    for words that training has not seen."""
    n = len(trained.models)

    def speak(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        told = by_kind(group, "bucket")
        ids, c = unpack(told["total"][0][1])
        ids = np.cumsum(ids, dtype=np.uint64)
        live = np.flatnonzero(c > 1)
        columns = [c]
        for k in range(n):
            for values in unpack(told[f"live_{k}"][0][1])[3:]:
                whole = np.ones(len(ids), np.int64)
                whole[live] = values
                columns.append(whole)
        rows = []
        for bucket, data in told["words"]:
            wanted = np.cumsum(unpack(data)[0], dtype=np.uint64)
            at = np.searchsorted(ids, wanted)
            at[at < len(ids)] = np.where(ids[at[at < len(ids)]] == wanted[at < len(ids)], at[at < len(ids)], len(ids))
            rows.append((bucket, part, "word", pack(rising(wanted), *(np.append(v, 0)[at] for v in columns)), None))
        return messages(rows)

    feed = trained.state.filter("kind = 'words'").unionByName(trained.words.filter("kind = 'total'"))
    for k, live in enumerate(trained.live):
        feed = feed.unionByName(live.withColumn("kind", F.lit(f"live_{k}")))
    return feed.groupBy("part").applyInArrow(speak, MESSAGE)


# --- scores ---------------------------------------------------------------------------------------

#: Units of the sums of logarithms on their way.
UNIT = 10**10
PART = "base long, data binary"
SCORED = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"


def texts_of(step: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The texts of the tokens of each pair from the steps between them."""
    whole = np.cumsum(step, dtype=np.int64)
    begin = np.cumsum(many.astype(np.int64)) - many
    return whole - np.repeat(np.append(0, whole)[begin], many)


def score_bucket(model: Model, models: list[Model], group: pa.Table) -> pa.Table:
    """What the tokens of a bucket add to their texts, packed by block, from the blocks and what is known of its pairs and words."""
    told = by_kind(group, "part")
    heard = [unpack(data) for _, data in told.get("word", [])]
    ids = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(h[0], dtype=np.uint64) for h in heard)])
    columns = [np.concatenate(c) for c in list(zip(*heard))[1:]] or [np.zeros(0, np.int64)] * (1 + 3 * len(models))
    # the last row stands for words unheard of
    columns = [np.append(c, 0) for c in columns]
    c, taken = columns[0], columns[1::3]
    p = [probability(columns[2 + 3 * k], columns[3 + 3 * k], m) for k, m in enumerate(models)]

    def place(known: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ids, known)
        return np.where((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == known), at, len(ids)) if len(ids) else np.zeros(len(known), np.int64)

    key, count, tables = [], [], [[] for _ in models]
    for name in ("again", "once"):
        for _, data in told.get(name, []):
            x, y, n = unpack(data)
            key.append(np.cumsum(x, dtype=np.int64) << 32 | y)
            count.append(n)
            for k, held in enumerate(tables):
                seats = told.get(f"seats_{k}") if name == "again" else None
                held.append(unpack(seats[0][1])[0] if seats else np.ones(len(n), np.uint32))
    join = lambda some, kind: np.concatenate(some).astype(kind) if some else np.zeros(0, kind)
    key, count, tables = join(key, np.int64), join(count, np.float64), [join(t, np.float64) for t in tables]
    order = np.argsort(key)
    key, count, tables = key[order], np.append(count[order], 0.0), [np.append(t[order], 0.0) for t in tables]

    out: list[tuple[int, bytes]] = []
    for base, data in zip(*(group.filter(pc.equal(group.column("kind"), "block")).column(k).to_pylist() for k in ("base", "data"))):
        known, x, y, many, owner, doc, flags = unpacked(data)
        at = place(known)
        x, y = at[x], at[y]
        want = x << 32 | y
        found = np.searchsorted(key, want)
        found = np.where((found < len(key)) & (key[np.minimum(found, len(key) - 1)] == want), found, len(key)) if len(key) else np.zeros(len(want), np.int64)
        chance = np.zeros(len(want))
        for k in range(len(models)):
            new = STRENGTH + model.discount * taken[k][x]
            chance += (count[found] - model.discount * tables[k][found] + new * p[k][y]) / (STRENGTH + c[x])
        logs = np.log10(chance / len(models))
        plain_logs = np.log10((c[y] + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
        owner = texts_of(owner, many)
        token = np.repeat(np.arange(len(want)), many)
        sums = [np.bincount(owner, values) for values in (None, (c[y] > 0)[token], plain_logs[token], logs[token])]
        mine = np.flatnonzero(sums[0])
        tokens, seen = (v[mine].astype(np.uint32) for v in sums[:2])
        fixed = [np.rint(v[mine] * UNIT).astype(np.int64) for v in sums[2:]]
        out.append((base, pack(rising(mine.astype(np.uint32)), tokens, seen, *fixed, doc, flags)))
    return pa.table({"base": pa.array([o[0] for o in out], pa.int64()), "data": pa.array([o[1] for o in out], pa.binary())})


def added_up(group: pa.Table) -> pa.Table:
    """The texts of a chunk from what its buckets give: the sums of all, and the one part that tells their ids."""
    parts = [unpack(data) for data in group.column("data").to_pylist()]
    doc, flags = next(p[5:] for p in parts if len(p[5]))
    sums = np.zeros((4, len(doc)), np.int64)
    for at, *values in parts:
        at = np.cumsum(at, dtype=np.int64)
        for k in range(4):
            sums[k, at] += values[k]
    return pa.table({
        "doc_id": pa.array(doc, pa.int64(), mask=flags & 1 == 0), "learned": pa.array(flags & 2 != 0), "n_tokens": sums[0], "n_known": sums[1],
        "base_score": sums[2] / UNIT, "score": sums[3] / UNIT,
    })


def score(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text, learning from the rows with ``learned``.

    Tokens are words, A-Z lower-cased, and an end. ``n_known`` counts those that training has seen. ``base_score`` is the sum of
    log10((c + 0.5) / (N + 0.5 * (V + 1))), ``score`` the log10 probability of the text under the model. Null text is
    empty, which is one end; a null in ``learned`` counts as true. Repeated rows are rows of their own; an empty table
    gives no rows; with no row to learn from, all words are unknown and equally likely.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(learned, F.lit(True)).alias("learned"),
    )
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"]
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    feed = dealt(rows, buckets, True).withColumn("kind", F.lit("block"))
    trained = train(rows, buckets)
    models = trained.models if trained else [Model(0, 0, 0.5, 0.5, 0, 0)]
    nothing = {"part": F.lit(None).cast("long"), "sums": F.lit(None).cast("array<long>")}
    feed = feed.withColumns(nothing)
    if trained:
        known = spoken(trained).unionByName(trained.state.filter("kind in ('again', 'once')"))
        for k, seats in enumerate(trained.seats):
            known = known.unionByName(seats.withColumn("kind", F.lit(f"seats_{k}")))
        feed = feed.unionByName(known.withColumn("base", F.lit(None).cast("long")))
    model = models[0]
    found = feed.groupBy("bucket").applyInArrow(lambda group: score_bucket(model, models, group), PART)
    return found.groupBy("base").applyInArrow(added_up, SCORED).select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
