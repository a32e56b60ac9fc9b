import random

import pytest
from pyspark.sql import functions as F

from lociforge.operators import variants
from lociforge.plans import concordance
from lociforge.sources.fasta import fragment_number


def fragments(spark, text, length=7, contig="c"):
    rows = [(contig, k // length, k, text[k : k + length].encode()) for k in range(0, len(text), length)]
    df = spark.createDataFrame(rows, "contig string, frag long, frag_start long, bases binary")
    return df.select("contig", fragment_number(length), "frag_start", "bases")


def applied(text, pos, ref, alt):
    assert text[pos : pos + len(ref)] == ref
    return text[:pos] + alt + text[pos + len(ref) :]


def leftmost(text, pos, ref, alt):
    """The normal form by trying every place: the leftmost shortest spelling with the same result."""
    want = applied(text, pos, ref, alt)
    size = len(want) - len(text)
    if size < 0:
        return next((p, text[p : p - size], "") for p in range(len(text)) if text[:p] + text[p - size :] == want)
    if size > 0:
        p = next(p for p in range(len(text) + 1) if want[:p] + want[p + size :] == text)
        ins = want[p : p + size]
        return (p - 1, text[p - 1], text[p - 1] + ins) if p else (0, "", ins)
    a = next(k for k in range(len(text)) if text[k] != want[k])
    b = next(k for k in range(len(text), 0, -1) if text[k - 1] != want[k - 1])
    return a, text[a:b], want[a:b]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_spellings_meet_at_the_leftmost(spark, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["A", "C", "G", "T", "ACAC", "TTTTT", "GAT" * 3]) for _ in range(25))
    rows = []
    for _ in range(150):
        pos, n = rng.randrange(len(text)), rng.randint(0, 4)
        ref = text[pos : pos + n]
        alt = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 3)))
        if rng.random() < 0.5:  # a pure insertion or deletion, written with bases around it
            a, b = max(0, pos - rng.randint(0, 3)), min(len(text), pos + len(ref) + rng.randint(0, 3))
            ref, alt = text[a:b], text[a:pos] + ("" if ref else alt) + text[pos + len(ref) : b]
            pos = a
        if applied(text, pos, ref, alt) != text and (len(ref) == len(alt) or min(len(ref), len(alt)) == 0 or text[pos : pos + len(ref)] == ref):
            rows.append((len(rows), "c", pos, ref, alt))
    df = spark.createDataFrame(rows, "id int, contig string, pos long, ref string, alt string")
    got = {r.id: (r.pos, r.ref, r.alt) for r in variants.normalized(df, fragments(spark, text), reach=200).collect()}
    checked = 0
    for i, _, pos, ref, alt in rows:
        p, r, a = got[i]
        assert applied(text, p, r, a) == applied(text, pos, ref, alt)
        t = variants_trim(ref, alt)
        if not (t[0] and t[1]):  # a pure insertion or deletion, or a substitution
            assert got[i] == leftmost(text, pos, ref, alt)
            checked += 1
        elif len(t[0]) == len(t[1]):
            assert got[i] == leftmost(text, pos, ref, alt)
    assert checked > 60


def variants_trim(ref, alt):
    while ref and alt and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    while ref and alt and ref[0] == alt[0]:
        ref, alt = ref[1:], alt[1:]
    return ref, alt


def test_long_repeats_need_rounds(spark):
    text = "G" + "A" * 60 + "C"
    df = spark.createDataFrame([("c", 55, "A", "", "x")], "contig string, pos long, ref string, alt string, `a.b` string")
    one = variants.normalized(df, fragments(spark, text), reach=20).first()
    assert (one.pos, one.ref, one.alt, one["a.b"]) == (35, "A", "", "x")
    assert variants.normalized(df, fragments(spark, text), reach=20, rounds=3).first().pos == 1


def test_odd_variants(spark):
    rows = [("c", 3, None, "A"), ("c", 3, "A", "A"), ("c", 0, "", "G"), ("z", 5, "CC", "C"), ("c", 2, "aC", "a")]
    df = spark.createDataFrame(rows, "contig string, pos long, ref string, alt string")
    got = {tuple(r) for r in variants.normalized(df, fragments(spark, "GCACACT")).collect()}
    assert got == {("c", 3, None, "A"), ("c", 3, "A", "A"), ("c", 0, "", "G"), ("z", 5, "C", ""), ("c", 3, "C", "")}
    assert variants.normalized(df.limit(0), fragments(spark, "GC")).collect() == []


def test_equal_deletions_agree(spark):
    """A deletion in a repeat written at two places: a false positive and a false negative, or with the reference a hit."""
    kind = "contig string, pos long, ref string, alt string, sample string, alleles array<string>"
    called = spark.createDataFrame([("c", 5, "A", "", "s", ["Ref", "Alt"])], kind)
    truth = spark.createDataFrame([("c", 2, "A", "", "s", ["Ref", "Alt"])], kind)
    reference = fragments(spark, "GCAAAAT")
    plain = concordance.evaluate(called, truth).first()
    assert (plain.true_positives, plain.false_positives, plain.false_negatives) == (0, 1, 1)
    met = concordance.evaluate(called, truth, reference=reference).first()
    assert (met.true_positives, met.false_positives, met.false_negatives) == (1, 0, 0)


@pytest.mark.parametrize("before, whole, longest", [
    ("A" * 40 + "C" * 30, "G" * 40 + "C" * 30, 256), ("C" * 16, "C" * 16, 256), ("C" * 16, "C" * 17, 10), ("G" * 15 + "\n" + "A", "GG\nA", 256),
    ("", "", 256), ("A", "", 256), ("TA", "CA", 1), ("é" * 20, "a" + "é" * 18, 256), ("A" * 300, "A" * 300, 256), ("A" * 2000, "T" + "A" * 1500, (1 << 20) - 1),
])
def test_common_ends(spark, before, whole, longest):
    k = next((k for k in range(min(len(before), len(whole), longest)) if before[-1 - k] != whole[-1 - k]), min(len(before), len(whole), longest))
    row = spark.createDataFrame([(before, whole)], "a string, b string")
    assert row.select(variants._common(F.col("a"), F.col("b"), longest)).first()[0] == k


def test_text_before_across_fragments(spark):
    """Text ends at a missing fragment and at the end of the contig; fragments and rows may repeat."""
    text = "GATTACAGATTCCAGTAACG"
    known = fragments(spark, text, length=4).filter("frag <> 2")
    rows = [(i, "c", p) for i, p in enumerate([None, -1, 0, 1, 3, 8, 9, 12, 13, 14, 20, 21, 24, 25, 14])] + [(99, None, 3)]
    df = spark.createDataFrame(rows, "id int, contig string, pos long")
    for reach in (1, 3, 4, 9):
        for reference in (known, known.unionByName(known)):
            got = {r.id: r.before for r in variants.with_text_before(df, reference, reach).collect()}
            for i, c, p in rows:
                low = 12 if p and p > 12 else 0
                want = text[max(low, p - reach):p] if c and p and 0 < p <= 20 and not 8 < p <= 12 else ""
                assert got[i] == want, (i, p, reach)


def test_rows_are_not_grouped(spark):
    """Each row meets one window of the reference in one join; no row is spread over fragments and gathered again."""
    df = spark.createDataFrame([("c", 5, "A", "")], "contig string, pos long, ref string, alt string")
    plan = variants.normalized(df, fragments(spark, "GCAAAAT"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 1 and "_id" not in plan
