import pyarrow as pa
import public_tokenizers
import numpy as np
from tokenizers import Tokenizer

from lociforge.llm import packing, resemblance
from lociforge.llm.recompression import remove_repeats
from lociforge.llm.words import BASES, RangeHash, names


def thue_morse(length, one, two):
    marks = [0]
    while len(marks) < length:
        marks += [1 - m for m in marks]
    return [one if m == 0 else two for m in marks], [two if m == 0 else one for m in marks]


#: Two words on which every polynomial hash modulo a power of two agrees.
ONE, TWO = ("".join(w) for w in thue_morse(2048, "a", "b"))


def test_regular_words_have_names_of_their_own():
    for base in BASES:
        assert len(set(names(pa.array([ONE, TWO]), base).tolist())) == 2


def test_ranges_have_equal_hashes_only_if_equal():
    one, two = thue_morse(2048, 11, 12)
    values = np.array([*one, *two, *one], np.uint64)
    begin = np.array([0, 2048, 4096])
    hashes = RangeHash(values).of(begin, begin + 2048)
    assert hashes[0] == hashes[2] != hashes[1]
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2, 300).astype(np.uint64)
    begin = rng.integers(0, 280, 2000)
    end = begin + rng.integers(0, 20, 2000)
    seen = {}
    for a, b, h in zip(begin, end, RangeHash(values).of(begin, end).tolist()):
        key = tuple(values[a:b].tolist())
        assert seen.setdefault(key, h) == h
    assert len(set(seen.values())) == len(seen)


def test_packing_tells_regular_words_apart():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, starts = packing.WordTokenizer(path).encode(pa.array([ONE, TWO]))
    plain = Tokenizer.from_file(path)
    for text, a, b in zip((ONE, TWO), starts, starts[1:]):
        assert ids[a:b].tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END_OF_DOCUMENT]


def test_repeats_and_shingles_tell_regular_words_apart(llm):
    common = " ".join(f"w{k}" for k in range(19))
    docs = llm.createDataFrame([(1, f"{common} {ONE}"), (2, f"{common} {TWO}"), (3, f"{common} {ONE}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 20}
    hashes, _ = resemblance.shingles(pa.array([f"a b c d {ONE.lower()}", f"a b c d {TWO.lower()}"]))
    assert len(set(hashes.tolist())) == 2
