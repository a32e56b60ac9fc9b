import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lociforge.llm import quality
from lociforge.llm.words import plain

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    words, seen, covered = re.findall(WORD, text), {}, set()
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            for p in places:
                covered.update(range(p, p + 8))
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TEXTS = ["", " \n\t", "a", "a b " * 30, "é|#\n é|#\n\n é|#", "x\x00y \x1c z", "one two three four five six seven eight " * 3 + "nine", "w" * 5000]


def test_measurements_match_brute_force():
    got = quality.measure(pa.array(TEXTS))
    assert [tuple(int(got[n][i]) for n in NAMES) for i in range(len(TEXTS))] == [brute(t) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#", max_size=60), max_size=6))
def test_measurements_of_random_texts(texts):
    got = quality.measure(plain(pa.array(texts, pa.string())))
    assert [tuple(int(got[n][i]) for n in NAMES) for i in range(len(texts))] == [brute(t) for t in texts]


def test_colliding_window_hashes_are_told_apart(monkeypatch):
    class Weak(quality.RangeHash):
        def of(self, begin, end):
            return np.zeros(len(begin), np.uint64)

    monkeypatch.setattr(quality, "RangeHash", Weak)
    codes = np.array([1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11])
    assert quality.repeated_words(codes, np.array([0, len(codes)])).tolist() == [16]


def test_ledger_and_policies(llm):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "x"), (2, None, "x"), (3, "short", None), (4, "a b c d e f g h " * 5, "x"), (5, good + "".join(f" ##{i}$" for i in range(20)), "x"), (1, good, "x"), (None, good, "x")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, bits string")
    held = quality.ledger(docs)
    assert held.columns == ["doc_id", "text", "bits", "_ledger"]
    got = [
        (r.doc_id, r.bits, r.b, r.base, r.kept)
        for r in held.select(
            "doc_id", "bits", held._ledger.bits.alias("b"), quality.passes(held._ledger.bits, "base").alias("base"),
            quality.passes(held._ledger.bits, quality.PRODUCTION).alias("kept"),
        ).collect()
    ]
    assert [g[3:] for g in got] == [(True, True), (False, False), (False, False), (False, False), (True, False), (True, True), (True, True)]
    assert got[0][1] == "x" and got[2][1] is None
    assert got[2][2] == quality.BIT["few_words"]


def test_ablations_follow_from_bits(llm):
    few, symbols, lines = (quality.BIT[n] for n in ("few_words", "symbols", "repeated_lines"))
    bits = llm.createDataFrame([(few,), (few | symbols,), (symbols,), (0,), (quality.BIT["huge_word"],), (lines,)], "bits long")
    got = {r.rule: (r.failed, r.only_this, r.kept_without) for r in quality.ablations(bits, "1").collect()}
    assert got["few_words"] == (2, 1, 3)
    assert got["symbols"] == (2, 1, 3)
    assert got["repeated_lines"] == (1, 1, 3)
    assert got["long_words"] == (0, 0, 2)


def test_empty_table(llm):
    docs = llm.createDataFrame([], "doc_id long, text string")
    assert quality.ledger(docs).collect() == []
    assert quality.ablations(quality.ledger(docs).select("_ledger.bits"), "1").first().failed == 0
