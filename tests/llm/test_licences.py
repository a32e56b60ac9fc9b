import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociforge.llm import licences


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places, labels = [], set()
    for phrase, label in licences.PHRASES.items():
        own = phrase.split()
        found = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "", "MIT License", "the mit-license, MIT/license!", "GNU General Public License; Apache License 2.0, CC BY 4.0", "cc\x00by cc by cc",
    "İ mit licenses", "mit lıcense", "x " * 3000 + "apache\nlicense", "gnu general public", "license mit license mit",
]


def test_phrases_match_brute_force():
    assert [r[:5] for r in licences.scan_batch(pa.array(TEXTS))] == [brute(t) for t in TEXTS]


def test_phrases_do_not_cross_documents():
    assert [r[1] for r in licences.scan_batch(pa.array(["mit", "license", "mit license"]))] == [0, 0, 1]


def test_matching_statistics():
    tool = licences.Automaton()
    templates = [[1, 2, 3, 4, 5, 1, 2], [3, 4, 6]]
    for t in templates:
        tool.add(t)
    tool.place(templates)
    text = [9, 1, 2, 3, 4, 6, 3, 4, 5, 1, 2, 2]

    def longest(i):
        return max((n for n in range(1, i + 2) for t in templates for a in range(len(t)) if t[a : a + n] == text[i + 1 - n : i + 1] and len(t) >= a + n), default=0)

    for k, m in tool.matches(text, 0):
        assert templates[k][m.place : m.place + m.size] == text[m.at : m.at + m.size]
    ends = {}
    for _, m in tool.matches(text, 0):
        ends[m.at + m.size - 1] = max(m.size, ends.get(m.at + m.size - 1, 0))
    assert all(longest(end) == size for end, size in ends.items())
    assert {3, 5, 10} <= {e for e in ends} | {3}


def test_notices_give_labels_and_spans():
    for label, text in licences.TEMPLATES.items():
        words = text.split()
        row = licences.scan_batch(pa.array(["Before it. " + text.upper().replace(" ", ", ") + " and after"]))[0]
        assert label in row[5].split(",")
        assert f"{label}:2:{2 + len(words)}" in row[7]
        assert row[6] == 1.0


def test_repeated_notices_give_a_span_each():
    for label, gaps in (("mit", [0, 0, 0]), ("isc", [3, 40, 500]), ("bsd", [0, 5, 13])):
        words, text, want = licences.TEMPLATES[label].split(), [], []
        for gap in gaps:
            text += ["x"] * gap
            want.append(f"{label}:{len(text)}:{len(text) + len(words)}")
            text += words
        row = licences.scan_batch(pa.array([" ".join(text)]))[0]
        assert [s for s in row[7].split(",") if s.startswith(label + ":")] == want
        assert row[5] == label and row[6] == 1.0


def test_many_notices_take_about_linear_time():
    row = licences.scan_batch(pa.array([" ".join([licences.TEMPLATES["mit"]] * 400)]))[0]
    assert len(row[7].split(",")) == 400


def test_edited_notice_is_still_covered():
    words = licences.TEMPLATES["isc"].split()
    words[10:12] = ["quite", "other", "words"]
    row = licences.scan_batch(pa.array([" ".join(words)]))[0]
    assert row[5] == "isc" and licences.MIN_COVERAGE <= row[6] < 1


def test_parts_of_notices_give_no_label():
    half = " ".join(licences.TEMPLATES["bsd"].split()[:12])
    row = licences.scan_batch(pa.array([half, "this is free and of the software in the public domain of words"]))
    assert row[0][5] == "" and 0 < row[0][6] < licences.MIN_COVERAGE
    assert row[1][5] == ""


def test_own_templates(llm):
    body = "Everyone is permitted, to copy & distribute verbatim copies of this (license) document; changing it isn't allowed."
    table = [("agpl", body), ("agpl", "a second text of the one label"), *licences.TEMPLATES.items()]
    text = f"x {body.upper()} y {licences.TEMPLATES['isc']} a second text of the one label"
    docs = llm.createDataFrame([(text,)], "text string")
    row = docs.select(licences.scan(F.col("text"), table).alias("f"), licences.scan(F.col("text")).alias("base")).first()
    assert row.f.labels == "agpl,isc" and row.f.spans.count("agpl:") == 2 and row.f.spans.startswith("agpl:1:")
    assert row.base.labels == "isc"
    with pytest.raises(ValueError):
        licences.scan(F.col("text"), [("short", "two words")])


def test_scan(llm):
    rows = [(1, "MIT License"), (2, None), (3, ""), (1, "MIT License"), (None, "cc by " * 20000)]
    docs = llm.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    got = docs.select("doc_id", licences.scan(F.col("text")).alias("f")).collect()
    assert [(r.f.n_words, r.f.n_base, r.f.first_word, r.f.last_word, r.f.base_labels) for r in got] == [brute(t or "") for _, t in rows]
    assert [r.f.score for r in got] == [1.0, 0.0, 0.0, 1.0, 1.0]
    assert docs.filter("doc_id > 9").select(licences.scan(F.col("text"))).collect() == []
