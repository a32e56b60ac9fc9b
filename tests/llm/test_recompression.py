import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lociforge.llm import recompression


def brute(rows):
    """Rows with distinct ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words, covered = (text or "").encode().split(), set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                covered.update(range(i, i + 20))
            seen.add(window)
        out[doc] = len(words), len(covered), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in covered)).hexdigest()
    return out


def result(docs):
    found = recompression.remove_repeats(docs).withColumn("h", F.sha2("kept", 256)).collect()
    return [(r.doc_id, (r.n_words, r.n_removed, r.h)) for r in found]


def sample(seed):
    rng = random.Random(seed)

    def some(n, letters):
        return [rng.choice("abcdefghijklmnopqrstuvwxyz"[:letters]) + rng.choice("xyz"[: 1 + letters // 9]) for _ in range(n)]

    pool = [some(rng.randint(15, 60), rng.choice([1, 2, 4, 26])) for _ in range(10)]
    rows = []
    for doc in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(pool) if rng.random() < 0.5 else some(rng.randint(0, 40), rng.choice([1, 2, 3, 5, 26]))
        if rows and rng.random() < 0.1:
            words = (rows[-1][1] or "").split()
        rows.append((doc if doc else None, " ".join(words) if rng.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(llm, seed):
    rows = sample(seed)
    docs = llm.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, k string, at int").repartition(6)
    assert dict(result(docs)) == brute(rows)


def test_runs_periods_and_long_texts(llm):
    rows = [
        (1, "a " * 500), (2, "a b " * 300), (3, "a a b " * 200), (4, "a " * 19), (5, "b a " * 15 + "c"), (6, "x y z " * 20000),
        (7, ""), (8, None), (9, "\t\n "), (10, "a " * 20),
    ]
    assert dict(result(llm.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_repeated_rows_are_one_document(llm):
    text = " ".join(map(str, range(30)))
    rows = [(1, text), (1, text), (2, text), (1, "other")]
    got = sorted((d, n, r) for d, (n, r, _) in result(llm.createDataFrame(rows, "doc_id long, text string")))
    assert got == [(1, 1, 0), (1, 30, 0), (1, 30, 0), (2, 30, 30)]


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_repeated_rows_in_one_batch_are_one_document(llm, parts):
    text, period = " ".join(map(str, range(30))), "a b " * 30
    rows = [(1, text)] * 3 + [(2, text)] * 2 + [(3, period)] * 3 + [(None, "z " + text)] * 2 + [(1, "other")]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    got = result(docs.coalesce(1) if parts == 1 else docs.repartition(parts))
    want = brute([(1, text), (2, text), (3, period), (None, "z " + text)])
    assert sorted(((d is None, d or 0), r) for d, r in got if r[0] > 1) == sorted(((d is None, d or 0), want[d]) for d, _ in rows[:-1])


def test_equal_ids_with_different_texts_are_ordered(llm):
    shared = " ".join(map(str, range(25)))
    got = result(llm.createDataFrame([(1, shared + " p"), (1, shared + " q")], "doc_id long, text string"))
    assert sorted(r for _, (_, r, _) in got) == [0, 25]


def test_null_ids_whose_texts_have_equal_32_bit_hashes(llm):
    shared = " ".join(map(str, range(25)))
    one, two = "x26388 " + shared, "z172888 " + " ".join(f"y{k}" for k in range(30))
    docs = llm.createDataFrame([(1, shared), (None, one), (None, two), (None, "z172888")], "doc_id long, text string")
    assert docs.filter(F.col("text").isin(one, two)).select(F.hash("text")).distinct().count() == 1
    assert sorted((n, r) for _, (n, r, _) in result(docs)) == [(1, 0), (25, 0), (26, 25), (31, 0)]


def test_empty_table(llm):
    assert result(llm.createDataFrame([], "doc_id long, text string")) == []
