import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lociforge.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
REFERENCE = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "a", "A.b C,, d.", "don't I'LL we're", "É. é́ İstanbul ß. 1.2,3 a1. １２", "é. Å", "　x y.",
    "\x00a.\x00", "a" * 3000, "🙂. 🙂a.", ".a a. .. a.. !a! 'a.' a.'", "ΑΣ. ΣΑΣ,", "one,two;three:four!five?six",
]
SPECIAL = ["<|endoftext|> x", "x<|startoftext|>y Z", "<|STARTOFTEXT|>", "a <| b"]


def want(text):
    return REFERENCE.encode(text, add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("texts", [ODD, ODD + SPECIAL, []])
def test_ids_are_the_tokenizers(texts):
    coder = packing.WordTokenizer(PATH)
    for _ in range(2):  # the second time from memory
        ids, starts = coder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [want(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_ids_of_random_texts(texts):
    ids, starts = packing.tokenizer(PATH).encode(pa.array([t.encode(errors="ignore").decode() for t in texts], pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [want(t.encode(errors="ignore").decode()) for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 2)
    coder = packing.WordTokenizer(PATH)
    for text in ODD:
        ids, _ = coder.encode(pa.array([text]))
        assert ids.tolist() == want(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_windows_hold_every_piece_once_within_capacity(sizes):
    found = packing.windows(sizes, 100)
    assert sorted(i for part in found for i in part) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in part) <= 100 for part in found)


def test_differencing_balances():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1000, 2000).tolist()
    sums = [sum(sizes[i] for i in part) for part in packing.differencing(sizes, 50)]
    assert max(sums) - min(sums) <= 5 and sum(sums) == sum(sizes)


def test_pieces_tile_documents_and_sequences(llm):
    rows = [(i, " ".join(f"w{i} of {j}" for j in range(i % 40 * 7))) for i in range(200)]
    rows += [(500, "word " * 30000), (501, None), (501, None), (None, "null id"), (502, "")]
    docs = llm.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(3)
    pieces = packing.pack(docs, PATH)
    got = pieces.collect()
    texts = defaultdict(list)
    for doc, text in rows:
        texts[doc].append(want(text or ""))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        ids = list(struct.unpack(f"<{p.length}I", p.ids))
        by_doc[p.doc_id].append((p.start, ids, p.doc_tokens))
        by_sequence[p.sequence_id].append((p.offset, p.length, ids, p.sequence_tokens))
    for doc, lists in texts.items():
        if len(lists) == 1:
            parts = sorted(by_doc[doc])
            assert [i for _, ids, _ in parts for i in ids] == lists[0]
            assert all(n == len(lists[0]) for _, _, n in parts)
    assert len(by_doc[501]) == 2
    for parts in by_sequence.values():
        at = 0
        for offset, length, _, whole in sorted(parts):
            assert offset == at
            at += length
        assert at == whole <= 4096
    joined = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    for number, parts in by_sequence.items():
        ids = [i for _, _, own, _ in sorted(parts) for i in own]
        assert bytes(joined[number].ids) == struct.pack(f"<{len(ids)}I", *ids) and joined[number].tokens == len(ids)
    from pyspark.sql import functions as F

    assert {(zlib.crc32(bytes(p.ids))) for p in got} == {r.c for r in pieces.select(F.crc32("ids").alias("c")).collect()}


def test_little_padding(llm):
    rows = [(i, " ".join(f"{(i * j) % 97}x" for j in range(20 + i % 300))) for i in range(1500)]
    got = packing.pack(llm.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH).collect()
    used = {p.sequence_id: p.sequence_tokens for p in got}
    assert sum(used.values()) > 0.97 * 4096 * len(used)


def test_empty_table(llm):
    assert packing.pack(llm.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_parts_are_hashed_once(monkeypatch):
    """One 128-bit hash a part tells parts apart; known parts are looked up once, and parts that share a half are kept apart."""
    import xxhash

    texts = pa.array(["one two, three two", "", "three four one", "two four five one"])
    plain = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    wanted = [plain.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts.to_pylist()]
    for cut in (16, 1):  # with one byte kept, most parts share the half that is the key
        digest = xxhash.xxh3_128_digest
        hashed = []
        monkeypatch.setattr("lociforge.llm.words.xxhash.xxh3_128_digest", lambda w, d=digest, c=cut: hashed.append(w) or (d(w) if c == 16 else bytes(8) + d(w)[8:]))
        coder = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
        for _ in range(2):
            ids, starts = coder.encode(texts)
            assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == wanted
        assert len(hashed) == 2 * len(set(hashed))
        monkeypatch.setattr("lociforge.llm.words.xxhash.xxh3_128_digest", digest)


def test_marks_at_the_end_are_parts_of_their_own():
    """Words that differ by the marks at their end are tokenised once; parts with the joining digit or special tokens keep their place."""
    texts = pa.array(["ab ab&& cd cd&& fé fé&&!", "0 x0y ab.0 10 <|endoftext|>&& cd'!", "ñ÷!! ÷!! ab's!! 日!! é!", "&&"])
    coder = packing.WordTokenizer(PATH)
    asked = []
    encode_parts = coder.encode_parts
    coder.encode_parts = lambda parts: asked.append(parts) or encode_parts(parts)
    for _ in range(2):
        ids, starts = coder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [want(t) for t in texts.to_pylist()]
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0]))
    coder.forget()
    asked.clear()
    coder.encode(texts.slice(0, 1))
    assert sorted(asked[0]) == ["&&", "&&!", "ab", "cd", "fé"]
