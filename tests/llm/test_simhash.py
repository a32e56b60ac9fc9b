import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lociforge.llm import simhash
from lociforge.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def close(prints):
    return lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3


def brute_components(ids, linked):
    """The least id of each row's component; ``linked`` tells whether rows i and j are linked."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints_match_brute_force():
    texts = ["", " \n", "One", "one TWO", "a b c", "É é a a a a", "x\x00 y z w " * 9, " ".join(map(str, range(500)))]
    assert simhash.fingerprint_values(pa.array(texts)).tolist() == [brute_print(t) for t in texts]


def test_golay_sets_meet_within_one_bit():
    parity, offsets, count = simhash.golay()
    assert sorted(set(count.tolist())) == [1, 6]
    rng = np.random.default_rng(0)
    word = rng.integers(0, 1 << 23, 500)

    def keys(w):
        s = parity[w >> 11] ^ (w & 0x7FF)
        return {int((w >> 11) ^ o) for o in offsets[s][: count[s]]}

    for w in word.tolist():
        assert all(keys(w) & keys(w ^ 1 << bit) for bit in range(23))


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_linked_fingerprints_share_a_key(distance):
    rng = random.Random(distance)
    one = [rng.getrandbits(64) for _ in range(800)]
    two = [v ^ sum(1 << b for b in rng.sample(range(64), distance)) for v in one]
    found = [set(), set()]
    for side, values in enumerate((one, two)):
        keys, rows = simhash.keys_of(np.array(values, np.uint64))
        found[side] = set(zip(rows.tolist(), keys.tolist()))
    assert {r for r, _ in found[0] & found[1]} == set(range(800))


def test_forests_have_the_links_of_all_pairs(monkeypatch):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    block = 0xFFFF
    values = sorted({(center & block) | ((center ^ sum(1 << b for b in rng.sample(range(16, 64), rng.randint(0, 7)))) & ~block) for _ in range(400)})
    array = np.array(values, np.uint64)

    def roots(links):
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(v) for v in values]

    want = roots([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])
    flat = lambda found: [(int(x), int(y)) for a, b in found for x, y in zip(a, b)]
    assert roots(flat(simhash.forest(array))) == want
    monkeypatch.setattr(simhash, "DIVIDE_ABOVE", 10)
    assert roots(flat(simhash.large_forest(array, 0))) == want
    assert len(flat(simhash.forest(array))) < len(values)


def test_components(llm):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randint(0, 50), 100 + rng.randint(0, 50)) for _ in range(30)] + [(7, 7)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(llm.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: find(v) for v in list(root)}
    assert components(llm.createDataFrame([], "a long, b long")).collect() == []


def make_rows():
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(300)) for _ in range(12)]
    rows = []
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = "new" + str(rng.randint(0, 9))
        rows.append((i, " ".join(words), "s"))
    return rows + [(200, None, "s"), (201, "", None), (202, "word", "s"), (202, "word", "s"), (None, "word", "s"), (None, "lone text", "s"), (203, "long " * 30000, "s")]


def test_near_duplicates_match_brute_force(llm):
    rows = make_rows()
    docs = llm.createDataFrame(rows, "doc_id long, text string, print string").repartition(7)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.print, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [brute_print(t or "") for _, t, _ in rows]
    want = brute_components([r[0] for r in rows], close(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert got == sorted((r[0] is None, r[0] or 0, p, c) for r, p, c in zip(rows, signed, want))


def test_one_of_each_keeps_a_document_of_every_component(llm):
    rows = make_rows()
    docs = llm.createDataFrame(rows, "doc_id long, text string, hash string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    prints = [brute_print(t or "") for _, t, _ in rows]
    comps = brute_components([r[0] for r in rows], close(prints))
    want = sorted({c for c in comps if c is not None})
    got = [r.doc_id for r in kept.collect()]
    assert sorted(g for g in got if g is not None) == want
    assert got.count(None) == 1  # the text that only a null id has


def test_empty_table(llm):
    docs = llm.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.one_of_each(docs).collect() == []


def test_hex(llm):
    row = llm.createDataFrame([(-1,), (10,)], "v long").select(simhash.hex_print(F.col("v")).alias("h")).collect()
    assert [r.h for r in row] == ["f" * 16, "000000000000000a"]
