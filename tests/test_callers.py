import math
import random
from itertools import combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from helpers import make_read, reads_df
from lociforge.operators import pileup
from lociforge.plans import callers, concordance
from lociforge.sources import fasta, loci

GENOTYPE = ("contig string, pos bigint, ref string, alt string, sample string, alleles array<string>, "
            "read_depth int, alt_read_depth int, fwd_reads int")


def calls(df):
    return sorted((r["pos"], r["ref"], r["alt"], "/".join(r["alleles"])) for r in df.collect())


PLAIN, SNV = ("GATTACA", "7M", "7"), ("GATCACA", "7M", "3T3")


@pytest.mark.parametrize("reads,options,want", [
    ([PLAIN] * 3, dict(threshold=0), []),
    ([PLAIN, SNV, SNV], dict(threshold=0), [(4, "T", "C", "Ref/Alt")]),
    ([("AATTACA", "7M", "0G6")] * 3, dict(threshold=0), [(1, "G", "A", "Alt/Alt")]),
    ([("GCTTACA", "7M", "1A5")] * 3, dict(threshold=50), [(2, "A", "C", "Alt/Alt")]),
    ([PLAIN, ("CATTACA", "7M", "0G6"), ("CATTACA", "7M", "0G6")], dict(threshold=50), [(1, "G", "C", "Alt/Alt")]),
    ([("CATTACA", "7M", "0G6"), ("AATTACA", "7M", "0G6"), ("AATTACA", "7M", "0G6")], dict(threshold=8),
     [(1, "G", "A", "Alt/OtherAlt"), (1, "G", "C", "Alt/OtherAlt")]),
    ([("A", "1M", "1")] * 2, dict(threshold=50, emit_ref=True), [(1, "A", "A", "Ref/Ref")]),
    ([("A", "1M", "1"), ("C", "1M", "0A0")], dict(threshold=60, emit_no_call=True), [(1, "A", "A", "NoCall/NoCall")]),
    ([("A", "1M", None)] * 2, dict(threshold=50, emit_ref=True), []),
])
def test_threshold(spark, reads, options, want):
    df = reads_df(spark, *[make_read(*r) for r in reads])
    assert calls(callers.threshold_calls(df, **options)) == want


def test_threshold_counts_indels_in_the_depth_and_per_sample(spark):
    df = reads_df(
        spark,
        *[make_read("AC", "1M1D1M", "1^G1", start=0, sample="del")] * 3,
        *[make_read("ATC", "3M", "1G1", start=0, sample="del")] * 1,
        *[make_read("ATC", "3M", "1G1", start=0, sample="alt", fwd=False)] * 2,
    )
    rows = {(r["sample"], r["pos"]): r for r in callers.threshold_calls(df, threshold=24).collect()}
    assert set(rows) == {("del", 1), ("alt", 1)}
    hit = rows[("del", 1)]
    assert (hit["alt"], hit["read_depth"], hit["alt_read_depth"], hit["fwd_reads"]) == ("T", 4, 1, 4)
    assert rows[("alt", 1)]["fwd_reads"] == 0
    assert not callers.threshold_calls(df, threshold=25).filter("sample = 'del'").collect()


def test_somatic_threshold(spark):
    normal = [make_read("AAAA", "4M", "4", start=0, token=2)] * 20
    tumor = [make_read("AAAA", "4M", "4", start=0, token=1)] * 7
    one = [make_read("ACAA", "4M", "1A2", start=0, token=1)] * 2
    two = [make_read("AGAA", "4M", "1A2", start=0, token=1)] * 1
    got = callers.somatic_threshold_calls(reads_df(spark, *normal, *tumor, *one, *two), threshold_tumor=9)
    assert calls(got) == [(1, "A", "C", "Alt/OtherAlt"), (1, "A", "G", "Alt/OtherAlt")]
    got = callers.somatic_threshold_calls(reads_df(spark, *normal, *tumor, *one, *two))
    assert calls(got) == [(1, "A", "C", "Alt/Ref")]
    assert got.first()["sample"] == "somatic"
    leaked = [make_read("ACAA", "4M", "1A2", start=0, token=2)]
    assert calls(callers.somatic_threshold_calls(reads_df(spark, *normal, *leaked, *tumor, *one))) == []
    assert calls(callers.somatic_threshold_calls(reads_df(spark, *tumor, *one))) == []
    lost = [make_read("CCAA", "4M", "0A0A2", start=0, token=2)] * 20
    both = reads_df(spark, *lost, *tumor)
    assert calls(callers.somatic_threshold_calls(both)) == []
    assert calls(callers.somatic_threshold_calls(both, allow_ref=True)) == [(0, "A", "A", "Alt/Ref"), (1, "A", "A", "Alt/Ref")]


def reference(spark, text, contig="chr1", length=4):
    lines = spark.createDataFrame([(contig, 0, text)], "contig string, line_start bigint, bases string")
    return fasta.fragment(lines, length)


def test_somatic_simple(spark):
    same = [make_read("AAAAAAAA", "8M", None, start=0, token=t) for t in (1, 2) for _ in range(10)]
    ref = reference(spark, "AAAAAAAA")
    run = lambda rows, **o: calls(callers.somatic_calls(reads_df(spark, *rows), ref, **o))
    assert run(same) == []
    tumor = [make_read("TAAAAAAA", "8M", None, start=0, token=1)] * 9 + same[:1]
    assert run(tumor + same[10:]) == [(0, "A", "T", "Alt/Alt")]
    back = [make_read("TAAAAAAA", "8M", None, start=0, token=1, fwd=False)] * 4 + tumor[4:]
    found = callers.somatic_calls(reads_df(spark, *back, *same[10:]), ref).first()
    assert (found["read_depth"], found["alt_read_depth"], found["fwd_reads"]) == (10, 9, 6)
    assert run(tumor + same[11:]) == []  # normal depth 9
    assert run(tumor + same[11:], min_normal_coverage=9) == [(0, "A", "T", "Alt/Alt")]
    poor = [make_read("TAAAAAAA", "8M", None, start=0, token=1, quals=[19] * 8)] * 9 + same[:1]
    assert run(poor + same[10:]) == []
    gone = [make_read("A" * 7, "3M1D4M", None, start=0, token=1)] * 10
    assert run(gone + same[10:]) == []
    tail = [make_read("T", "1M", None, start=8, token=1)] * 10 + [make_read("A", "1M", None, start=8, token=2)] * 10
    assert run(tail) == []  # outside the reference


def test_somatic_normal_top_set(spark):
    # Normal: A 17, C 2, T 1. A alone is 85 percent, A and C reach 95, so T is outside the set.
    normal = [make_read(b, "1M", None, start=0, token=2) for b in "A" * 17 + "CC" + "T"]
    for alt, want in (("T", [(0, "A", "T", "Alt/Alt")]), ("C", []), ("G", [(0, "A", "G", "Alt/Alt")])):
        tumor = [make_read(alt, "1M", None, start=0, token=1)] * 12
        got = callers.somatic_calls(reads_df(spark, *normal, *tumor), reference(spark, "A"))
        assert calls(got) == want


def err(q):
    return 10 ** (-q / 10)


def likelihoods(spark, bases, quals):
    reads = [make_read(b, "1M", "1" if b == "C" else "0C0", start=1, quals=[q]) for b, q in zip(bases, quals)]
    alleles = callers.bayes_evidence(reads_df(spark, *reads), min_mapq=0)
    return {(r["a1"], r["a2"]): r for r in callers.genotype_likelihoods(alleles).collect()}


def test_log_likelihoods(spark):
    same = likelihoods(spark, "CCC", [30, 40, 30])
    hit = lambda q: math.log(2 * (1 - err(q)))
    assert set(same) == {("C", "C")}
    assert same["C", "C"]["log_likelihood"] == pytest.approx(2 * hit(30) + hit(40) - 3, abs=1e-6)
    mixed = likelihoods(spark, "CCA", [30, 40, 30])
    assert mixed["C", "C"]["log_likelihood"] == pytest.approx(hit(30) + hit(40) + math.log(2 * err(30)) - 3, abs=1e-6)
    assert mixed["A", "A"]["log_likelihood"] == pytest.approx(
        hit(30) + math.log(2 * err(30)) + math.log(2 * err(40)) - 3, abs=1e-6)
    assert mixed["A", "C"]["log_likelihood"] == pytest.approx(-3, abs=1e-6)
    assert mixed["A", "C"]["likelihood"] == pytest.approx(1 / 8)
    assert same["C", "C"]["likelihood"] == pytest.approx((1 - err(30)) ** 2 * (1 - err(40)), rel=1e-6)


def direct_best(elements):
    alleles = sorted({a for a, _ in elements})
    best = None
    for i, a in enumerate(alleles):
        for b in alleles[i:]:
            units = 0
            for x, q in elements:
                p = sum((1 - err(q)) if x == y else err(q) for y in (a, b))
                units += -math.inf if p == 0 else round(math.log(p) * 1e9)
            if best is None or units > best[0]:
                best = (units, a, b)
    return best[1:]


def test_most_likely_genotype_equals_direct_enumeration(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for locus in range(200):
        pool = rng.sample(["", "A", "C", "G", "T", "AT", "GTT"], rng.randint(1, 5))
        elements = [(rng.choice(pool), rng.choice([0, 2, 10, 20, 20, 30, 40])) for _ in range(rng.randint(1, 12))]
        want[locus] = direct_best(elements)
        rows += [("c", locus, "s", a, 60, q, True, "A") for a, q in elements]
    df = spark.createDataFrame(
        rows, "contig string, locus bigint, sample string, allele string, mapq int, q int, fwd boolean, ref_base string")
    alleles = callers.allele_evidence(df).cache()
    got = {r["locus"]: (r["a1"], r["a2"]) for r in callers.most_likely_genotypes(alleles).collect()}
    assert got == want
    flat = spark.createDataFrame([("A", "A", 0.0)], "a1 string, a2 string, log_prior double")
    via_pairs = {r["locus"]: (r["a1"], r["a2"]) for r in callers.most_likely_genotypes(alleles, flat).collect()}
    close = [k for k in want if via_pairs[k] != want[k]]
    assert not close


def test_bayes_calls(spark):
    het = [make_read(*PLAIN, mapq=40)] * 5 + [make_read(*SNV, mapq=40)] * 5
    hom = [make_read(*SNV, mapq=40)] * 10
    assert calls(callers.bayes_calls(reads_df(spark, *het))) == [(4, "T", "C", "Ref/Alt")]
    assert calls(callers.bayes_calls(reads_df(spark, *hom))) == [(4, "T", "C", "Alt/Alt")]
    assert calls(callers.bayes_calls(reads_df(spark, *[make_read(*PLAIN, mapq=40)] * 3))) == []
    # Elements mapped at 30 or below do not count, and a locus left empty is absent.
    low = [make_read(*PLAIN, mapq=40)] * 5 + [make_read(*SNV, mapq=30)] * 5
    assert calls(callers.bayes_calls(reads_df(spark, *low))) == []
    assert calls(callers.bayes_calls(reads_df(spark, *[make_read(*SNV, mapq=30)] * 5))) == []
    refs = callers.bayes_calls(reads_df(spark, *het), emit_ref=True).filter("pos <> 4").collect()
    assert len(refs) == 6 and {tuple(r["alleles"]) for r in refs} == {("Ref", "Ref")}
    assert {r["alt_read_depth"] for r in refs} == {10}
    row = callers.bayes_calls(reads_df(spark, *het)).first()
    assert (row["read_depth"], row["alt_read_depth"], row["fwd_reads"]) == (10, 5, 10)


def test_bayes_prior_changes_the_call(spark):
    het = reads_df(spark, *[make_read(*PLAIN, mapq=40)] * 5, *[make_read(*SNV, mapq=40)] * 5)
    prior = spark.createDataFrame([("C", "T", -1000.0), ("T", "T", -1000.0)], "a1 string, a2 string, log_prior double")
    assert calls(callers.bayes_calls(het, prior=prior)) == [(4, "T", "C", "Alt/Alt")]


def test_bayes_filter_chain(spark):
    rows = [make_read(*PLAIN, mapq=40)] * 6 + [make_read(*SNV, mapq=40)] * 6 + [make_read(*PLAIN, mapq=0)]
    df = reads_df(spark, *rows)
    assert calls(callers.bayes_calls(df)) == [(4, "T", "C", "Ref/Alt")]
    assert calls(callers.bayes_calls(df, no_ambiguous=True)) == []
    assert calls(callers.bayes_calls(df, max_complexity=5)) == []
    assert calls(callers.bayes_calls(df, max_complexity=25, max_ploidy=2)) == [(4, "T", "C", "Ref/Alt")]
    assert calls(callers.bayes_calls(df, max_ploidy=1)) == []


def test_calls_on_loci(spark):
    mixed = [PLAIN, ("AATCACA", "7M", "0G2T3"), ("AATCACA", "7M", "0G2T3")]
    df = reads_df(spark, *[make_read(*m, mapq=40) for m in mixed], make_read("A", "1M", "0C0", start=90))
    one = loci.parse(spark, "chr1:2-6")
    want = [(4, "T", "C", "Ref/Alt")]
    assert calls(callers.threshold_calls(df, 0, loci=one)) == want
    assert [c[0] for c in calls(callers.threshold_calls(df, 0))] == [1, 4, 90]
    assert calls(callers.bayes_calls(df, loci=one)) == want
    assert calls(callers.bayes_calls(df, loci=one, max_ploidy=2)) == want


def test_allele_percents(spark):
    df = reads_df(spark, make_read("AC", "2M", "2", start=0), make_read("GC", "2M", "0A1", start=0),
                  make_read("A", "1M1D", "1^C", start=0), make_read("AC", "2M", "2", start=0))
    counts = pileup.base_allele_counts(pileup.elements(df))
    got = {(r["locus"], r["allele"]): r["percent"] for r in callers.allele_percents(counts).collect()}
    assert got == {(0, "A"): 75.0, (0, "G"): 25.0, (1, "C"): 75.0}


def genotypes(spark, rows):
    return spark.createDataFrame([(*r[:4], "s", r[4].split("/"), None, None, None) for r in rows], GENOTYPE)


def test_concordance(spark):
    called = genotypes(spark, [
        ("20", 1, "A", "T", "Alt/Alt"), ("20", 1, "A", "T", "Alt/Alt"), ("20", 2, "A", "T", "Ref/Alt"),
        ("20", 3, "A", "T", "Ref/Alt"), ("20", 4, "A", "AT", "Ref/Alt"), ("21", 1, "A", "T", "Ref/Alt"),
        ("20", 9, "A", "A", "Ref/Ref"), ("20", 9, "A", "A", "NoCall/NoCall")])
    truth = genotypes(spark, [
        ("20", 1, "A", "T", "Ref/Alt"), ("20", 2, "A", "T", "Ref/Alt"), ("20", 5, "A", "T", "Ref/Alt"),
        ("20", 4, "A", "AT", "Ref/Alt"), ("20", 6, "AT", "A", "Ref/Alt")])
    table = concordance.concordance_table(called, truth, exclude_indels=True, contig="20").collect()
    assert sorted(tuple(r) for r in table) == [
        ("HET", "HET", 1), ("HET", "NO_CALL", 1), ("HOM_ALT", "HET", 1), ("NO_CALL", "HET", 1)]
    row = concordance.evaluate(called, truth, exclude_indels=True, contig="20").first()
    assert (row["true_positives"], row["false_positives"], row["false_negatives"]) == (2, 1, 1)
    assert (row["precision"], row["recall"], row["f1"]) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    everything = concordance.evaluate(called, truth).first()
    assert (everything["true_positives"], everything["false_positives"], everything["false_negatives"]) == (3, 2, 2)
    indels = concordance.evaluate(called, truth, exclude_snvs=True).first()
    assert (indels["true_positives"], indels["false_positives"], indels["false_negatives"]) == (1, 0, 1)
    nothing = concordance.evaluate(called, truth, exclude_snvs=True, exclude_indels=True).first()
    assert nothing["precision"] is None and nothing["true_positives"] == 0
    assert concordance.evaluate(called, truth, match_sample=True).first()["sample"] == "s"


def test_one_sample_is_scored(spark):
    rows = [("1", 5, "A", "T", "b", ["Alt", "Alt"]), ("1", 5, "A", "T", "a", ["Ref", "Alt"]), ("1", 6, "A", "C", "b", ["Ref", "Alt"])]
    called = spark.createDataFrame([(*r, None, None, None) for r in rows], GENOTYPE)
    truth = genotypes(spark, [("1", 5, "A", "T", "Ref/Alt")])
    types = lambda **o: sorted(tuple(r) for r in concordance.concordance_table(called, truth, **o).collect())
    assert types() == types(sample="a") == [("HET", "HET", 1)]
    assert types(sample="b", truth_sample="s") == [("HET", "NO_CALL", 1), ("HOM_ALT", "HET", 1)]


def test_clustered_and_stored_order_agree(spark):
    df = reads_df(spark, *[make_read(*PLAIN, mapq=40)] * 6, *[make_read(*SNV, mapq=40)] * 6)
    assert calls(callers.threshold_calls(df, cluster=False)) == calls(callers.threshold_calls(df))
    assert calls(callers.bayes_calls(df, cluster=False)) == calls(callers.bayes_calls(df))


@pytest.mark.parametrize("ploidy", [1, 2, 3, 4, 8])
def test_any_ploidy_equals_enumeration(spark, ploidy):
    """The knapsack over copies against all genotypes, ties and quality 0 included."""
    rng = random.Random(ploidy)
    rows = []
    for locus in range(25):
        for _ in range(rng.randint(1, 12)):
            rows.append(("c", locus, "s", rng.choice(["A", "C", "", "GT"][: rng.randint(1, 4)]), rng.choice([0, 2, 10, 30, 30]), True, "A"))
    data = spark.createDataFrame(rows, "contig string, locus long, sample string, allele string, q int, fwd boolean, ref_base string")
    got = {r.locus: r for r in callers.most_likely_copies(callers.copy_evidence(data, ploidy), ploidy).collect()}
    for locus in range(25):
        mine = [r for r in rows if r[1] == locus]
        best = None
        for genotype in combinations_with_replacement(sorted({r[3] for r in mine}), ploidy):
            total = 0
            for r in mine:
                e, k = 10.0 ** (-r[4] / 10.0), genotype.count(r[3])
                p = k * (1.0 - e) + (ploidy - k) * e
                total += math.floor(math.log(p) * 1e9 + 0.5) if p > 0 else -math.inf
            if total > -math.inf and (best is None or total > best[0]):
                best = (total, genotype)
        if best is None:
            assert got[locus].genotype == [min(r[3] for r in mine)] * ploidy and got[locus].log_likelihood == -math.inf
            continue
        assert tuple(got[locus].genotype) == best[1]
        assert got[locus].log_likelihood == pytest.approx(best[0] / 1e9 - len(mine) * math.log(ploidy), abs=1e-9)
        names = ["Ref"] * best[1].count("A")
        others = [a for a in best[1] if a != "A"]
        names += ["Alt"] * others.count(others[0]) + ["OtherAlt"] * (len(others) - others.count(others[0])) if others else []
        assert got[locus].calls == names


def test_two_copies_are_the_diploid_caller(spark):
    rng = random.Random(3)
    rows = [("c", locus, "s", rng.choice("ACG"), rng.choice([5, 20, 40]), 60, True, "A") for locus in range(60) for _ in range(rng.randint(1, 9))]
    data = spark.createDataFrame(rows, "contig string, locus long, sample string, allele string, q int, mapq int, fwd boolean, ref_base string")
    two = {r.locus: tuple(r.genotype) for r in callers.most_likely_copies(callers.copy_evidence(data, 2), 2).collect()}
    plain = {r.locus: (r.a1, r.a2) for r in callers.most_likely_genotypes(callers.allele_evidence(data)).collect()}
    assert two == plain
