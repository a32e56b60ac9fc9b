from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociforge.llm import mixing


def water(sizes, share=1.5, repeats=2):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, target, free = share * sum(sizes.values()), {}, set(names)
    while True:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if budget * weight[s] / whole > repeats * sizes[s] + 1e-9]
        if not over:
            return target | {s: budget * weight[s] / whole for s in free}
        for s in over:
            target[s] = repeats * sizes[s]
        budget -= sum(repeats * sizes[s] for s in over)
        free -= set(over)


def sample(n=400):
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else None if i % 17 == 0 else f"s{i % 7}"
        rows.append((i, " ".join(["w"] * (i * 37 % 211)), source, i))
    return rows + [(900, None, "hot", 0), (901, "", "only-empty", 0), (902, " a\tb\n", "tiny", 0), (902, " a\tb\n", "tiny", 0), (None, "x y z", None, 0), (903, "w " * 5000, "s1", 0)]


@pytest.fixture(scope="module")
def mixed(llm):
    docs = llm.createDataFrame(sample(), "doc_id long, text string, source string, size int").repartition(5)
    found, queue = mixing.mix(docs)
    return docs, found.collect(), queue.collect()


def test_targets_and_taken(mixed):
    _, rows, _ = mixed
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = water(sizes)
    assert len(rows) == len(sample())
    for s in sizes:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - want[s]) <= 1
        assert all(r.source_size == sizes[s] for r in rows if r.source == s)


def test_sizes_are_words(mixed):
    _, rows, _ = mixed
    want = Counter((i, len((t or "").split())) for i, t, _, _ in sample())
    assert Counter((r.doc_id, r.size) for r in rows) == want


def test_queue_is_served_in_order_of_finish(mixed):
    _, rows, queue = mixed
    assert sum(q.words for q in queue) == sum(r.taken for r in rows)
    slices = {}
    for q in queue:
        low, high = slices.get(q.slice, (q.finish, q.finish))
        slices[q.slice] = min(low, q.finish), max(high, q.finish)
    bounds = [slices[k] for k in sorted(slices)]
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))


def test_reruns_agree(llm, mixed):
    docs, rows, _ = mixed
    again, _ = mixing.mix(docs.repartition(3))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, again.collect())) == sorted(map(key, rows))


def test_budget_beyond_all_words(llm):
    docs = llm.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id long, text string, source string")
    found, queue = mixing.mix(docs, share=5.0)
    assert sorted((r.doc_id, r.taken) for r in found.collect()) == [(1, 4), (2, 2)]
    assert queue.count() == 4


def test_given_weights(llm):
    docs = llm.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    weights = llm.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    found, _ = mixing.mix(docs, share=0.5, repeats=1, weights=weights)
    taken = Counter()
    for r in found.collect():
        taken[r.source] += r.taken
    assert taken == {"a": 50, "b": 150}


def test_mixed_documents(llm, mixed):
    docs, rows, _ = mixed
    out = mixing.mixed_documents(docs.withColumn("n_chars", F.length("text").cast("long")))
    assert out.columns == ["doc_id", "text", "source", "size", "n_chars"]
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
    got = Counter()
    texts = {i: t for i, t, _, _ in sample()}
    for r in out.collect():
        got[r.source] += len(r.text.split())
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert got == +taken


def test_empty_table(llm):
    docs = llm.createDataFrame([], "doc_id long, text string, source string")
    found, queue = mixing.mix(docs)
    assert found.collect() == [] and queue.collect() == []
    assert mixing.mixed_documents(docs).collect() == []
