import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociforge.llm import blobs, pitman_yor
from lociforge.llm.pitman_yor import PARENT_STRENGTH, STRENGTH, discount_of



def learned():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def brute(rows):
    count = Counter(t for doc, text in rows if not held_out(doc) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    out = []
    for doc, text in rows:
        words = tokens(text)
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in words)
        out.append((doc, held_out(doc), len(words), sum(count[t] > 0 for t in words), n, round(base, 6)))
    return out


def gibbs(train, test, sweeps=12, burn=4, seed=1):
    """One customer at a time with explicit tables: log10 probability of the test texts under the averaged model."""
    rng = random.Random(seed)
    pairs = Counter()
    for text in train:
        words = [None, *tokens(text)]
        pairs.update(zip(words, words[1:]))
    contexts = defaultdict(set)
    for u, w in pairs:
        contexts[w].add(u)
    d = discount_of(sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values()))
    d0 = discount_of(sum(len(c) == 1 for c in contexts.values()), sum(len(c) == 2 for c in contexts.values()))
    size = len(contexts)
    rooms = defaultdict(lambda: defaultdict(list))  # restaurant, dish: sizes of tables; the parent is 0
    held, open_ = Counter(), Counter()

    def p0(w):
        return (held[0, w] - d0 * len(rooms[0][w]) + (PARENT_STRENGTH + d0 * open_[0]) / (size + 1)) / (PARENT_STRENGTH + held[0])

    def sit(r, w, disc, weight):
        tables = rooms[r][w]
        odds = [t - disc for t in tables] + [weight]
        k = rng.choices(range(len(odds)), odds)[0]
        held[r, w] += 1
        held[r] += 1
        if k < len(tables):
            tables[k] += 1
            return False
        tables.append(1)
        open_[r] += 1
        return True

    def leave(r, w):
        tables = rooms[r][w]
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        held[r, w] -= 1
        held[r] -= 1
        if tables[k]:
            return False
        del tables[k]
        open_[r] -= 1
        return True

    def add(u, w):
        if sit((u,), w, d, (STRENGTH + d * open_[(u,)]) * p0(w)):
            sit(0, w, d0, (PARENT_STRENGTH + d0 * open_[0]) / (size + 1))

    customers = list(pairs.elements())
    for u, w in customers:
        add(u, w)
    texts = [[None, *tokens(t)] for t in test]
    chance = [np.zeros(len(t) - 1) for t in texts]
    for s in range(sweeps):
        for u, w in customers:
            if leave((u,), w):
                leave(0, w)
            add(u, w)
        if s >= burn:
            for words, total in zip(texts, chance):
                for i, (u, w) in enumerate(zip(words, words[1:])):
                    r = (u,)
                    new = (STRENGTH + d * open_[r]) * p0(w)
                    total[i] += (held[r, w] - d * len(rooms[r][w]) + new) / (STRENGTH + held[r])
    return [float(np.log10(c / (sweeps - burn)).sum()) for c in chance]


def corpus(seed, texts=150):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    follow = {w: rng.sample(words, 4) for w in words}
    rows = []
    for doc in range(texts):
        word, out = rng.choice(words), []
        for _ in range(rng.randint(0, 40)):
            out.append(word if rng.random() < 0.95 else word.upper())
            word = rng.choice(follow.get(word, words)) if rng.random() < 0.8 else rng.choice(words) if rng.random() < 0.9 else f"r{rng.getrandbits(20)}"
        rows.append((doc, rng.choice([" ", "\n", " \t "]).join(out)))
    return rows


@pytest.mark.parametrize("bucket_bytes, chunk", [(1 << 25, 1 << 21), (1500, 300)])
def test_counts_and_base_match_brute_force(llm, monkeypatch, bucket_bytes, chunk):
    """With one bucket, and with many and several blocks each."""
    monkeypatch.setattr(pitman_yor, "CHUNK", chunk)
    monkeypatch.setattr(pitman_yor, "TEXT_BYTES", 1000)
    rows = [*corpus(4), (None, "w1 w2"), (None, None), (7, ""), (7, ""), (-3, "É É x"), (9, "w1 " * 3000)]
    docs = llm.createDataFrame(rows, "doc_id long, text string").withColumns({"data": F.lit(1), "bucket": F.lit("x"), "score": F.lit(2)})
    got = pitman_yor.score(docs.repartition(3), learned(), bucket_bytes=bucket_bytes).collect()
    assert got[0].asDict().keys() == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    order = lambda r: (r[0] is not None, *r[:1], *r[2:])
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=order)
    want = sorted(brute(rows), key=order)
    assert [h[:5] for h in have] == [w[:5] for w in want]
    assert all(abs(h[5] - w[5]) < 1e-5 for h, w in zip(have, want))
    assert all(r.score < 0 for r in got)


def test_model_is_near_one_seat_at_a_time(llm):
    """Held-out probabilities near those of a sampler that moves single customers between explicit tables."""
    rows = corpus(11, 250)
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.score, r.base_score) for r in pitman_yor.score(docs, learned(), bucket_bytes=4000).collect()}
    test = [doc for doc, _ in rows if held_out(doc)]
    want = gibbs([t for doc, t in rows if not held_out(doc)], [dict(rows)[doc] for doc in test])
    mine, base = sum(got[doc][0] for doc in test), sum(got[doc][1] for doc in test)
    assert abs(mine - sum(want)) < 0.02 * abs(sum(want))
    assert mine > 0.75 * base  # much likelier than under single words


def test_probabilities_of_a_context_add_up_to_one():
    """All words and an unknown one after one context, each in a text of its own."""
    u64 = lambda *x: np.array(x, np.uint64)
    known = u64(10, 20, 30, 40)
    counts, seats = {20: 5, 30: 2, 40: 1}, {20: 2, 30: 1, 40: 1}  # after word 10
    customers, parent = np.array([4, 3, 1, 1]), np.array([2, 2, 1, 1])
    model = pitman_yor.Model(50, 4, 0.6, 0.5, customers.sum(), parent.sum())
    p = pitman_yor.probability(customers, parent, model)
    again = blobs.pack(blobs.rising(np.array([0, 0], np.uint32)), np.array([1, 2], np.uint32), np.array([5, 2], np.uint32))
    once = blobs.pack(np.array([0], np.uint32), np.array([3], np.uint32), np.array([1], np.uint32))
    word, size = u64(10, 10, 20, 30, 40, 99), len(known) + 1
    about = np.arange(size), np.full(size, 3, np.uint8)
    ids, code = pitman_yor.coded(word)
    first = np.searchsorted(ids, 10)
    x, y = np.full(size, first, np.uint32), np.arange(size, dtype=np.uint32)
    ones = np.ones(size, np.uint32)
    block = blobs.pack(blobs.rising(ids), blobs.rising(x), y, ones, y, *about)
    word = blobs.pack(blobs.rising(known), np.array([8, 20, 10, 3]), np.array([sum(seats.values()), 3, 3, 3]), customers, parent)
    told = {"word": word, "again": again, "once": once, "seats_0": blobs.pack(np.array([seats[20], seats[30]], np.uint32)), "block": block}
    group = pa.table({
        "kind": list(told), "data": list(told.values()), "part": pa.nulls(5, pa.int64()), "base": pa.array([None] * 4 + [0], pa.int64())
    })
    rows = pitman_yor.added_up(pitman_yor.score_bucket(model, [model], group)).to_pydict()
    chance = dict(zip(rows["doc_id"], (10**x for x in rows["score"])))
    assert abs(sum(chance.values()) - 1) < 1e-8
    new = STRENGTH + model.discount * 4
    assert abs(chance[1] - (5 - 2 * model.discount + new * p[1]) / (STRENGTH + 8)) < 1e-9
    assert rows["n_known"] == [1, 1, 1, 1, 0] and rows["learned"] == [True] * 5


def test_seats_follow_the_restaurant():
    """Mean number of tables against a sampler of single customers and explicit tables, also beyond those drawn at once."""
    rng = random.Random(5)
    for c, others, p, d in ((2, 0, 0.4, 0.7), (10, 400, 0.01, 0.95), (9, 5, 0.3, 0.5), (160, 3, 0.2, 0.6)):
        got = pitman_yor.seated(np.full(4000, c), np.full(4000, others), np.full(4000, p), 1.0, d, (c,)).mean()
        tables, sums, rounds = [1] * c, 0, 60_000 // c + 400
        for step in range(rounds * c):
            k = rng.choices(range(len(tables)), tables)[0]
            tables[k] -= 1
            tables = [t for t in tables if t]
            new = p * (1 + d * (others + len(tables)))
            k = rng.choices(range(len(tables) + 1), [t - d for t in tables] + [new])[0] if tables else 0
            tables = tables + [1] if k == len(tables) else [t + (j == k) for j, t in enumerate(tables)]
            sums += len(tables) if step >= rounds * c // 5 else 0
        assert abs(got - sums / (rounds * c - rounds * c // 5)) < 0.06 * got
    none = np.zeros(3, np.int64)
    assert pitman_yor.seated(np.array([1, 1, 5]), none, np.array([0.9, 0.1, 1e-12]), 1.0, 0.5, (1,)).tolist() == [1, 1, 1]


def test_odd_tables(llm):
    kind = "doc_id long, text string"
    assert pitman_yor.score(llm.createDataFrame([], kind), learned()).collect() == []
    lone = llm.createDataFrame([(1, "a b"), (2, None)], kind)
    rows = pitman_yor.score(lone, F.lit(False)).collect()  # nothing to learn from
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [(1, True, 3, 0, 0), (2, True, 1, 0, 0)]
    assert all(r.score == 0 for r in rows)
    again = [pitman_yor.score(lone, F.lit(True)).collect() for _ in range(2)]
    assert sorted(again[0]) == sorted(again[1])


def test_packed_arrays_come_back():
    rng = np.random.default_rng(3)
    arrays = [np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64)), np.zeros(0, np.int64), rng.integers(0, 9, 7).astype(np.uint8)]
    back = blobs.unpack(blobs.pack(blobs.rising(arrays[0]), *arrays[1:]))
    assert np.cumsum(back[0], dtype=np.uint64).tolist() == arrays[0].tolist()
    assert all(a.tolist() == b.tolist() and a.dtype == b.dtype for a, b in zip(arrays[1:], back[1:]))
