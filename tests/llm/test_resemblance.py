import random

import pyarrow as pa
import pytest

import corpus_pipeline
from lociforge.llm import resemblance
from test_simhash import brute_components


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(one, two):
    one, two = brute_set(one), brute_set(two)
    return bool(one and two) and 5 * len(one & two) >= 4 * len(one | two)


def edited(rng, words, changes):
    words = list(words)
    for k in rng.sample(range(len(words)), changes):
        words[k] = f"new{rng.getrandbits(40)}"
    return " ".join(words)


def test_shingles_match_brute_force():
    texts = ["", " \n", "One", "a b c d", "a b c d e", "A b c d E a b c d e", "x " * 50, " ".join(map(str, range(300)))]
    hashes, first = resemblance.shingles(pa.array(texts))
    assert [len(set(hashes[a:b].tolist())) for a, b in zip(first, first[1:])] == [len(brute_set(t)) for t in texts]


@pytest.mark.parametrize("size", [60, 400])
def test_stage_takes_near_copies_from_similarity_080(llm, size):
    rng = random.Random(size)
    rows, copies, others = [], set(), set()
    for k in range(150):
        words = [f"w{rng.getrandbits(30)}" for _ in range(size)]
        source, other = " ".join(words), edited(rng, words, rng.randint(1, size // 30 + 1))
        rows += [(2 * k, source), (2 * k + 1, other)]
        (copies if alike(source, other) else others).add(2 * k + 1)
    assert len(copies) > 40
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(llm, docs, "").collect()}
    assert set(range(0, 300, 2)) <= left and not copies & left


def test_large_groups_and_odd_rows(llm):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, edited(rng, words, 2)) for k in range(120)]  # more than PAIRWISE texts to a band value
    short = [(200, None), (201, ""), (202, "one two"), (203, "One  two"), (204, "one three"), (204, "one three"), (None, "a lone text")]
    docs = llm.createDataFrame(rows + short, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(llm, docs, "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["0", "200", "202", "204", "None"]
    assert corpus_pipeline.near_duplicates(llm, docs.filter("doc_id > 900"), "").collect() == []


@pytest.mark.parametrize("texts, size, changes", [(300, 300, 5), (400, 200, 4)])
def test_common_bands_lose_no_near_copy(llm, texts, size, changes):
    """A family of texts of which few are near copies of each other: groups as by all pairs."""
    rng = random.Random(texts)
    words = [f"w{k}" for k in range(size)]
    rows = [(k, edited(rng, words, changes)) for k in range(texts)]
    sets = [brute_set(t) for _, t in rows]
    linked = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    comps = brute_components([k for k, _ in rows], linked)
    assert 5 < texts - len(set(comps)) < texts - 100
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashed = docs.selectExpr("doc_id", "xxhash64(text) text_hash").selectExpr("*", "text_hash root")
    got = {r.doc_id: r.root for r in resemblance.joined_groups(docs, hashed).collect()}
    for i in range(texts):
        for j in range(i):
            assert (got[i] == got[j]) == (comps[i] == comps[j])


def test_blocks_of_a_common_band(llm, monkeypatch):
    """A band value divided into blocks: each two blocks meet."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, edited(rng, words, rng.randint(0, 2))) for k in range(80)]
    monkeypatch.setattr(resemblance, "BLOCK", 400)
    monkeypatch.setattr(resemblance, "DRAWN", 1)
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    hashed = docs.selectExpr("doc_id", "xxhash64(text) text_hash").selectExpr("*", "text_hash root")
    got = {r.doc_id: r.root for r in resemblance.joined_groups(docs, hashed).collect()}
    sets = [brute_set(t) for _, t in rows]
    comps = brute_components([k for k, _ in rows], lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    assert len(set(got.values())) == len(set(comps))
