import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.llm import collocations


def brute(rows, least=100, keep=2000):
    total, count = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    found = []
    for (lang, g), a in count.items():
        if len(g) < 2 or a < least:
            continue
        longer = [
            h for (other, h), c in count.items()
            if other == lang and len(h) > len(g) and c >= a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        ]
        if longer:
            continue
        cuts = [(1000 * a * total[lang] // (count[lang, g[:k]] * count[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        found.append((lang, " ".join(g), a, count[lang, g[:k]], count[lang, g[k:]], total[lang], score))
    out = []
    for lang in sorted({f[0] for f in found}):
        best = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))[:keep]
        out += [(lang, rank, *f[1:]) for rank, f in enumerate(best, 1)]
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "a", "new", "york", "city", "é", "x1", "THE", "hot"]
    rows = []
    for k in range(120):
        text = ""
        for _ in range(rng.randint(5, 60)):
            text += rng.choice(["New York City", "in the end of", "hot hot hot", *words, f"r{rng.getrandbits(30)}"])
            text += rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "])
        rows.append((text, rng.choice(["en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), (" . ,,", "de"), (rows[0][0], "en"), (rows[0][0], "en")]


@pytest.mark.parametrize("budget, chunk", [(1 << 21, 1 << 21), (300, 400)])
def test_phrases_match_brute_force(llm, monkeypatch, budget, chunk):
    """Also with many groups, where most words are hot and prefixes have several words."""
    monkeypatch.setattr(collocations, "BUDGET", budget)
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "TEXT_BYTES", 2000)
    rows = corpus(budget)
    docs = llm.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit(1)).repartition(3)
    got = sorted(tuple(r) for r in collocations.mine(docs, least=8, keep=25).collect())
    want = sorted(brute(rows, least=8, keep=25))
    assert got == want and len(want) > 40


def test_empty_and_small(llm):
    empty = llm.createDataFrame([], "text string, lang string")
    assert collocations.mine(empty).collect() == []
    few = llm.createDataFrame([("a b " * 40, "en"), ("a b " * 60, "en")], "text string, lang string")
    got = [tuple(r) for r in collocations.mine(few).collect()]
    assert got == sorted(brute([("a b " * 40, "en"), ("a b " * 60, "en")]))


def test_scores_are_exact(llm):
    rng = random.Random(3)
    rows = [(rng.randrange(100, 10**12), rng.randrange(10**10, 10**14), *(rng.randrange(10**11, 10**13) for _ in "lr")) for _ in range(50)]
    df = llm.createDataFrame(rows, "a long, n long, l long, r long")
    for r in df.select("*", collocations.cut_score(*map(F.col, "anlr")).alias("s")).collect():
        assert r.s == 1000 * r.a * r.n // (r.l * r.r)


def test_tree_nodes_are_runs_of_sorted_suffixes():
    ids = np.array([5, 7, 7, 5, 9, 5, 7, 7, 5], np.uint64)
    links = np.append((ids[:-1] != 9) & (ids[1:] != 9), False)
    blobs = [data for _, data in collocations.suffixes(ids, links, np.zeros(9, bool), 1)]
    rows, sums = collocations.tree_nodes(blobs, least=1)
    got = {tuple(r): n for part, count in zip(rows, sums) for r, n in zip(part.tolist(), count.tolist())}
    assert got == {(5, 7): 2, (7, 7): 2, (7, 5): 2, (5, 7, 7): 2, (7, 7, 5): 2, (5, 7, 7, 5): 2}
