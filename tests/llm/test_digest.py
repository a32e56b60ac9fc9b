import base64
import hashlib
import math
import random

import numpy as np
import pyarrow as pa

from lociforge.llm import digest

RANK = np.arange(digest.LEVELS + 1)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_levels_are_entropies():
    data = np.frombuffer((prose(random.Random(1), 60) + "a" * 100 + "é").encode(), np.uint8)
    got = digest.levels(data)
    for i in range(len(data) - 15):
        counts = [c for c in np.bincount(data[i : i + 16]).tolist() if c]
        entropy = -sum(c / 16 * math.log2(c / 16) for c in counts)
        assert abs(got[i] - entropy / 4 * digest.LEVELS) <= 0.51


def brute_features(raw, rank):
    """The bytes of the selected features, in order and once each."""
    if len(raw) < 16:
        return [raw] if raw else []
    level = digest.levels(np.frombuffer(raw, np.uint8))
    rank, points = [int(rank[x]) for x in level], [0] * len(level)
    for i in range(len(rank)):
        run = rank[i : i + 16]
        points[i + run.index(min(run))] += 1
    at = [i for i, p in enumerate(points) if p >= 4] or [points.index(max(points))]
    return list(dict.fromkeys(raw[i : i + 16] for i in at))


def brute_mix(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor % 2**64
    return x ^ x >> 33


def brute_print(text, rank):
    """The filters as sets of bits."""
    features, chain = brute_features(text.encode(), rank), []
    for k in range(0, len(features), 160):
        bits = set()
        for f in features[k : k + 160]:
            value = len(f)
            for lane in range(2):
                number = int.from_bytes(f.ljust(16, b"\0")[8 * lane : 8 * lane + 8], "little")
                value = brute_mix((value * 0x9E3779B97F4A7C15 + brute_mix((number + lane + 1) % 2**64)) % 2**64)
            bits |= {value >> 11 * j & 2047 for j in range(5)}
        chain.append(bits)
    return chain


def brute_likeness(one, two):
    if one == two:
        return 1.0
    if not one or not two:
        return 0.0
    if len(one) > len(two):
        one, two = two, one
    total = 0.0
    for a in one:
        best = 0.0
        for b in two:
            chance = len(a) * len(b) / 2048
            best = max(best, min(1.0, (len(a & b) - chance) / max(min(len(a), len(b)) - chance, 1e-9)))
        total += best * len(a)
    return total / sum(map(len, one))


def bit_sets(data):
    rows = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 256), axis=1, bitorder="little")
    return [set(np.flatnonzero(r).tolist()) for r in rows]


def test_fingerprints_and_likeness_match_brute_force():
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (0, 1, 2, 3, 5, 9, 40, 200, 900)] + ["a" * 700, "é" * 30, "x"]
    texts += [t[: 2 * len(t) // 3] + "other " * 4 for t in texts[5:9]]
    prints = digest.fingerprints(pa.array(texts), RANK)
    plain = [brute_print(t, RANK) for t in texts]
    assert [bit_sets(p) if p else [] for p in prints] == plain
    for i in range(len(texts)):
        for j in range(i):
            assert abs(digest.likeness(prints[i], prints[j]) - brute_likeness(plain[i], plain[j])) < 1e-5


def test_fingerprints_depend_on_their_text_only():
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 400)) for _ in range(30)] + ["", "a", "ab", "abcdefgh", "é" * 600, " " * 5000]
    together = digest.fingerprints(pa.array(texts), RANK)
    assert together == [digest.fingerprints(pa.array([t]), RANK)[0] for t in texts]
    assert together[30] == b"" and all(together[31:])
    assert len(set(together[:30])) == len(set(texts[:30]))


def test_likeness():
    rng = random.Random(4)
    one, two = prose(rng, 3000), prose(rng, 3000)
    half = one[: len(one) // 2] + two[len(two) // 2 :]
    a, b, c = digest.fingerprints(pa.array([one, two, half]), RANK)
    assert digest.likeness(a, a) == 1.0 and digest.likeness(b"", b"") == 1.0
    assert digest.likeness(a, b"") == 0.0
    assert digest.likeness(a, b) < 0.12
    assert 0.35 < digest.likeness(a, c) < 0.65
    assert abs(digest.likeness(a, c) - digest.likeness(c, a)) < 0.1


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        out[doc] = len(text), hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
    return out


def test_next_documents(llm):
    rng = random.Random(5)
    rows = [(i * 7 % 500 - 20, prose(rng, rng.randint(0, 60)) + "é" * (i % 4)) for i in range(300)]
    rows += [(None, "null id " * 9), (9001, None), (9002, ""), (9003, "long text " * 20000)]
    docs = llm.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, stretch int, tie string").repartition(4)
    got = digest.compare_with_next(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == brute(rows)
    assert len(got) == len(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_equal_texts_and_repeated_rows(llm):
    text = prose(random.Random(6), 300)
    docs = llm.createDataFrame([(1, text), (2, text), (2, text), (3, "other")], "doc_id long, text string")
    got = digest.compare_with_next(docs).collect()
    same = [r for r in got if r.doc_id < 3]
    assert len(same) == 3 and len({r.fingerprint for r in same}) == 1
    assert [r.near_next for r in same if r.doc_id == 2] == [1.0, 1.0]


def test_single_document_is_its_own_next(llm):
    row = digest.compare_with_next(llm.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_empty_table(llm):
    assert digest.compare_with_next(llm.createDataFrame([], "doc_id long, text string")).collect() == []


def some_text(seed, size):
    rng = random.Random(seed)
    text = ""
    while len(text) < size:
        text += "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) + " "
    return text[:size]


def test_likeness_is_that_of_the_returned_fingerprints(llm):
    """Short and long texts, copies that end earlier, parts of others: near values follow from the strings alone."""
    text = some_text(1, 530)
    rows = [(k, text[: 30 + 100 * (5 - k)]) for k in range(6)] + [(10, some_text(2, 3000)), (9, some_text(2, 3000)[1000:1400]), (8, "tiny"), (7, None)]
    got = {r.doc_id: r for r in digest.compare_with_next(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    decode = lambda p: base64.b64decode(p)
    order = sorted(got, reverse=True)
    for k, doc in enumerate(order):
        row, after = got[doc], got[order[(k + 1) % len(order)]]
        assert row.near_edited == digest.likeness(decode(row.fingerprint), decode(row.edited_fingerprint))
        assert row.near_next == digest.likeness(decode(row.fingerprint), decode(after.fingerprint))
    assert all(got[k].near_next > 0.8 for k in range(1, 5))
    assert got[10].near_next > 0.6  # a part of it
    assert got[9].near_next < 0.3 and got[0].near_next < 0.3 and got[7].near_next == 0


def test_edited_text_that_becomes_short(llm):
    rows = [(4, some_text(4, 600)), (3, some_text(5, 60)), (2, some_text(6, 700)), (1, None)]
    got = {r.doc_id: r for r in digest.compare_with_next(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4].near_edited > 0.5 and got[2].near_edited > 0.8
