import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import at, intervals_df, make_read, reads_df, text_of
from lociforge.functions import cigar as cg
from lociforge.functions import md as mdf
from lociforge.functions.genotypes import classify_pair, is_variant, non_reference_alleles, unique_alleles, variant_count
from lociforge.functions.quality import phred_array
from lociforge.operators import filters, metrics, nested, pileup
from lociforge.operators import intervals as iv
from lociforge.plans import callers
from lociforge.sources import loci


def elements(spark, *reads):
    return pileup.elements(reads_df(spark, *reads), keep=("start",)).collect()


def generated(rng, name, with_md=True):
    """A random read and, walked base by base, the elements it must give."""
    start, mapq = rng.randint(0, 40), rng.randint(1, 60)
    ops = [(rng.choice("MMM=X"), rng.randint(1, 6))]
    for _ in range(rng.randint(0, 5)):
        ops += rng.choice([[("I", 1)], [("I", 3)], [("D", 2)], [("N", 4)], [("P", 1), ("I", 2)], [("I", 1), ("P", 2), ("I", 1)], []])
        ops.append((rng.choice("MMM=X"), rng.randint(1, 6)))
    if rng.random() < 0.3:
        ops = [("H", 2), ("S", 2), *ops]
    if rng.random() < 0.3:
        ops.append(("S", 1))
    seq, quals, md, run, want, locus = "", [], "", 0, [], start
    for idx, (op, size) in enumerate(ops):
        if op in "M=X":
            for i in range(size):
                ref = rng.choice("ACGT")
                other = rng.choice([c for c in "ACGTN" if c != ref])
                base = other if op == "X" or (op == "M" and rng.random() < 0.2) else ref
                kind = ("match" if base == ref else "mismatch") if with_md else {"M": "aligned", "=": "match", "X": "mismatch"}[op]
                run, md = (run + 1, md) if base == ref else (0, md + f"{run}{ref}")
                q = rng.randint(0, 40)
                want.append([locus, kind, base, q, ref if with_md else None, len(seq), idx, i])
                seq, quals, locus = seq + base, [*quals, q], locus + 1
        elif op in "DN":
            gone = "".join(rng.choice("ACGT") for _ in range(size))
            if op == "D":
                run, md = 0, md + f"{run}^{gone}"
            for i in range(size):
                want.append([locus, "deletion", "", mapq, gone[i] if op == "D" and with_md else None, len(seq), idx, i])
                locus += 1
        elif op in "IS":
            text = "".join(rng.choice("ACGT") for _ in range(size))
            own = [rng.randint(0, 40) for _ in text]
            if op == "I" and want and want[-1][1] != "deletion":
                want[-1][1:4] = "insertion", want[-1][2] + text, min([want[-1][3], *own])
            seq, quals = seq + text, quals + own
    cigar = "".join(f"{n}{op}" for op, n in ops)
    read = make_read(seq, cigar, md + str(run) if with_md else None, start=start, quals=quals, mapq=mapq, sample=name)
    return read, sorted(map(tuple, want))


FIELDS = ("locus", "kind", "allele", "q", "ref_base", "read_pos", "cigar_idx", "idx_in_elem")


@pytest.mark.parametrize("with_md", [True, False])
def test_elements_of_generated_reads(spark, with_md):
    rng = random.Random(int(with_md))
    made = {f"r{i}": generated(rng, f"r{i}", with_md) for i in range(120)}
    got = {name: [] for name in made}
    for r in pileup.elements(reads_df(spark, *[read for read, _ in made.values()])).collect():
        got[r["sample"]].append(tuple(r[f] for f in FIELDS))
    for name, (read, want) in made.items():
        assert sorted(got[name]) == want, read[:6]


def test_generated_reads_cover_every_operator():
    rng = random.Random(1)
    text = "".join(generated(rng, "x")[0][3] for _ in range(120))
    assert set("MIDNSHP=X") <= set(text)


def test_elements_cluster_by_locus(spark):
    rows = elements(spark, *[make_read("GATTAC", "6M", "6", start=11)] * 4)
    assert len(rows) == 24 and {r["kind"] for r in rows} == {"match"}
    assert {(r["ref_base"], r["read_pos"], r["q"]) for r in at(rows, 13)} == {("T", 2, 31)}


@pytest.mark.parametrize("md", ["3", "9", "2A1", "3^AC3A9"])
def test_md_of_another_length_counts_as_missing(spark, md):
    rows = elements(spark, make_read("GATTAC", "6M", md, start=0))
    assert {(r["kind"], r["ref_base"]) for r in rows} == {("aligned", None)}


def test_reads_without_sequence_have_no_elements(spark):
    read = list(make_read("GATTAC", "6M", "6"))
    read[5] = None
    assert elements(spark, tuple(read)) == []
    assert pileup.base_reads(reads_df(spark, tuple(read))).collect() == []


def test_md_that_counts_skipped_regions(spark):
    rows = {r["locus"]: r for r in elements(spark, make_read("CAGTTC", "3M2N3M", "3^GA3", start=7))}
    assert [rows[i]["ref_base"] for i in range(7, 15)] == ["C", "A", "G", "G", "A", "T", "T", "C"]
    assert rows[10]["kind"] == "deletion" and rows[12]["kind"] == "match"


def test_missing_qualities_are_zero(spark):
    read = list(make_read("GAT", "3M", "3"))
    read[6] = None
    assert {r["q"] for r in elements(spark, tuple(read))} == {0}
    df = reads_df(spark, tuple(read))
    assert df.select(phred_array("qual", "seq").alias("q")).first()[0] == [0, 0, 0]


def test_cigar_functions(spark):
    df = reads_df(spark, make_read("GATTACAGATTA", "4H1S6M2I1M3D2S", None, start=30))
    row = df.select(
        cg.alignment_end().alias("end"), cg.unclipped_start().alias("us"), cg.unclipped_end().alias("ue"),
        cg.read_length().alias("rl"), cg.cigar_elements().alias("els"),
        cg.is_valid_cigar("cigar").alias("ok"),
    ).first()
    assert (row["end"], row["us"], row["ue"], row["rl"], row["ok"]) == (40, 25, 42, 12, True)
    assert [(e["op"], e["len"]) for e in row["els"]] == [
        ("H", 4), ("S", 1), ("M", 6), ("I", 2), ("M", 1), ("D", 3), ("S", 2)]
    assert spark.createDataFrame([("*",)], "cigar string").select(cg.is_valid_cigar("cigar")).first()[0] is False


def test_md_functions(spark):
    df = spark.createDataFrame([("2A1^CG0T3",)], "md string")
    row = df.select(mdf.md_tokens().alias("t"), mdf.md_mismatches().alias("m")).first()
    assert row["t"] == ["2", "A", "1", "^CG", "0", "T", "3"]
    assert [(m["off"], m["base"]) for m in row["m"]] == [(2, "A"), (6, "T")]


def test_window_pileups_equal_padded_coverage(spark):
    rng = random.Random(9)
    spans = [(s, s + rng.randint(1, 15)) for s in (rng.randint(3, 60) for _ in range(25))]
    reads = intervals_df(spark, [("c", s, e) for s, e in spans])
    at_locus = loci.parse(spark, "c:0-40,c:45-90")
    inside = [*range(40), *range(45, 90)]
    for half in (0, 2):
        near = {p: sum(s <= p + half and e - 1 >= p - half for s, e in spans) for p in inside}
        got = {r["locus"]: r["n"] for r in pileup.window_pileup(reads, at_locus, half, F.count(F.lit(1)).alias("n")).collect()}
        assert got == {p: n for p, n in near.items() if n}
        depth = {}
        for r in pileup.coverage(reads, half_window=half).collect():
            depth.update({p: r["depth"] for p in range(r["start"], r["end"])})
        assert {p: depth.get(p, 0) for p in inside} == near
        entered = {}
        for s, e in spans:
            first = next((p for p in inside if s <= p + half and e - 1 >= p - half), None)
            if first is not None:
                entered[first] = entered.get(first, 0) + 1
        assert {r["locus"]: r["n_new"] for r in pileup.new_reads(reads, at_locus, half).collect()} == entered


@pytest.mark.parametrize("width", [1, 3, 65_536])
def test_coverage_across_bins(spark, width):
    reads = intervals_df(spark, [("c", 0, 5), ("c", 3, 9), ("c", 20, 22), ("d", 1, 2)])
    runs = sorted(tuple(r) for r in pileup.coverage(reads, width=width).collect())
    assert runs == [("c", 0, 3, 1), ("c", 3, 5, 2), ("c", 5, 9, 1), ("c", 20, 22, 1), ("d", 1, 2, 1)]


def test_pileup_over_loci_with_empty_ones(spark):
    reads = reads_df(spark, make_read("ACG", "3M", "3", start=2))
    got = pileup.pileup_over(reads, loci.parse(spark, "chr1:0-4"), F.count(F.lit(1)).alias("n"), include_empty=True)
    assert sorted((r["locus"], r["n"]) for r in got.collect()) == [(0, None), (1, None), (2, 1), (3, 1)]
    assert pileup.element_at_locus(reads_df(spark, make_read("ACG", "3M", "3", start=2)), 5).count() == 0


def test_two_inputs_pair_up(spark):
    reads = reads_df(
        spark, make_read("ACG", "3M", "3", start=2, token=1), make_read("ACG", "3M", "3", start=4, token=2),
        make_read("TCG", "3M", "3", start=4, token=2))
    got = pileup.pileup_pair(pileup.elements(reads), F.count(F.lit(1)).alias("n")).orderBy("locus").collect()
    assert [(r["locus"], r["n_1"], r["n_2"]) for r in got] == [
        (2, 1, None), (3, 1, None), (4, 1, 2), (5, None, 2), (6, None, 2)]


def test_split_by_sample_defaults_null(spark):
    reads = reads_df(spark, make_read("A", "1M", "1", sample=None), make_read("A", "1M", "1", sample="x"))
    got = pileup.elements(reads).groupBy(pileup.sample_key()).count().collect()
    assert sorted(tuple(r) for r in got) == [("default", 1), ("x", 1)]


def test_base_reads_and_clip_modes(spark):
    reads = reads_df(spark, make_read("TTACGT", "2S2M1D2M", None, start=10, quals=[2, 2, 30, 31, 32, 33]))
    got = sorted((r["locus"], r["base"] or "-", r["bq"]) for r in pileup.base_reads(reads).collect())
    assert got == [(10, "A", 30), (11, "C", 31), (12, "-", None), (13, "G", 32), (14, "T", 33)]
    moved = sorted(r["locus"] for r in pileup.base_reads(reads, clip_mode="unclipped").collect())
    assert moved == [8, 9, 10, 11, 12]
    kept = filters.min_base_quality(pileup.base_reads(reads), 32).collect()
    assert sorted(r["base"] or "-" for r in kept) == ["-", "G", "T"]


def test_top_bases(spark):
    rows = [("c", 1, 1, "A", 60), ("c", 1, 1, "C", 29), ("c", 1, 1, "G", 10), ("c", 1, 1, None, 1),
            ("c", 2, 1, "T", 90), ("c", 2, 1, None, 10), ("c", 3, 1, None, 5), ("c", 3, 1, "G", 5)]
    df = spark.createDataFrame(rows, "contig string, locus bigint, token int, base string, n bigint")
    got = {}
    for r in callers.top_bases(df).orderBy("rank").collect():
        got.setdefault(r["locus"], []).append(r["base"])
    assert got == {1: ["A", "C", "G"], 2: ["T"], 3: ["G", None]}


def test_pileup_filters(spark):
    rows = [
        (1, "A", 60, 9), (1, "C", 0, 1),
        (2, "A", 60, 3), (2, "C", 60, 1), (2, "G", 60, 1),
        (3, "A", 60, 3), (3, "A", 30, 1),
        (4, "A", 60, 2), (4, "A", 20, 1)]
    bases = [("c", locus, "s", allele, mapq) for locus, allele, mapq, n in rows for _ in range(n)]
    df = spark.createDataFrame(bases, "contig string, locus bigint, sample string, allele string, mapq int")
    alleles = filters.evidence(df, min_mapq=30)
    loci_of = lambda found: sorted({r["locus"] for r in found.collect()})
    assert loci_of(filters.drop_ambiguous(alleles)) == [2, 3, 4]
    assert loci_of(filters.drop_multi_allelic(alleles)) == [1, 3, 4]
    assert loci_of(filters.drop_complex_regions(alleles)) == [1, 2, 3]
    assert loci_of(filters.min_mapping_quality(df, 59)) == [1, 2, 3, 4]
    chain = filters.filter_pileups(alleles, no_ambiguous=True, max_ploidy=2).collect()
    assert [(r["locus"], r["kept_mapq"], r["n"], r["n_all"]) for r in chain] == [(3, 60, 3, 4)]
    one = {r["allele"]: (r["n"], r["n_low"], r["low_mapq"]) for r in alleles.filter("locus = 1").collect()}
    assert one == {"A": (9, 0, 60), "C": (0, 1, 0)}


def test_long_ranges_are_expanded_bin_by_bin(spark):
    whole = intervals_df(spark, [("c", 5, 40), ("d", 0, 3)])
    rows = iv.loci(whole, width=8)
    assert sorted(r["locus"] for r in rows.filter("contig = 'c'").collect()) == list(range(5, 40))
    assert "_bin" not in rows.columns and rows.count() == 38


def test_genotype_filters(spark):
    rows = [(1, 20, 15, 10), (2, 10, 15, 5), (3, 30, 5, 15), (4, 30, 5, 30), (5, 40, 12, 40), (6, None, None, None)]
    df = spark.createDataFrame(rows, "pos bigint, read_depth int, alt_read_depth int, fwd_reads int")
    keep = lambda **o: [r["pos"] for r in filters.filter_genotypes(df, **o).orderBy("pos").collect()]
    assert keep() == [1, 2, 3, 4, 5, 6]
    assert keep(min_read_depth=10) == [1, 3, 4, 5, 6]
    assert keep(min_alt_depth=5) == [1, 2, 5, 6]
    assert keep(low_strand_bias=10, high_strand_bias=90) == [1, 2, 3, 5, 6]
    assert keep(min_read_depth=10, min_alt_depth=5, include_null=False) == [1, 5]


def test_genotype_classes(spark):
    cases = [("A", "A", ["Ref", "Ref"]), ("T", "T", ["Alt", "Alt"]), ("A", "T", ["Ref", "Alt"]), ("C", "T", ["Alt", "OtherAlt"])]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a1 string, a2 string")
    ref, pair = F.lit("A"), F.array("a1", "a2")
    got = df.select(
        classify_pair(F.col("a1"), F.col("a2"), ref).alias("c"), unique_alleles(pair).alias("u"),
        variant_count(pair, ref).alias("v"), is_variant(pair, ref).alias("is"),
        non_reference_alleles(pair, ref).alias("alts")).collect()
    assert [r["c"] for r in got] == [c for _, _, c in cases]
    assert [(r["u"], r["v"], r["is"], r["alts"]) for r in got] == [
        (1, 0, False, []), (1, 2, True, ["T", "T"]), (2, 1, True, ["T"]), (2, 2, True, ["C", "T"])]


def test_counters_and_skew(spark):
    reads = intervals_df(spark, [("c", 0, 5), ("c", 8, 12), ("c", 8, 12), ("c", 50, 60)])
    buckets = intervals_df(spark, [("c", 0, 10, 0), ("c", 10, 20, 1)], "int")
    row = metrics.scan_counters(reads, buckets).first()
    assert (row["total"], row["relevant"], row["expanded"]) == (4, 3, 5)
    assert math.isclose(row["expansion_percent"], 200 / 3)
    counts = spark.createDataFrame([(1,), (2,), (3,), (10,)], "reads bigint")
    report = metrics.skew_report(counts).first()
    assert (report["min"], report["p25"], report["median"], report["mean"], report["p75"], report["max"]) == (
        1, 1.75, 2.5, 4.0, 4.75, 10)
    assert report["max_over_mean_percent"] == 150.0
    seen_df, seen = metrics.observed_count(counts, "kept")
    seen_df.count()
    assert seen.get == {"rows": 4}


def test_row_wise_functions_accept_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("3M2D4M\n7M\n")
    stream = spark.readStream.format("text").load(str(tmp_path / "in"))
    out = stream.select(cg.reference_length("value").alias("n"))
    q = out.writeStream.format("memory").queryName("lengths").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("lengths").collect()) == [7, 9]


def test_coverage_equals_merged_union(spark):
    reads = intervals_df(spark, [("c", 0, 5), ("c", 3, 9), ("c", 20, 22)])
    assert text_of(loci.from_reads(reads), None) == "c:0-22"


@pytest.mark.parametrize("half", [0, 2, 500])
def test_window_totals_equal_brute_force(spark, half):
    """Counts, sums and extremes near each locus; equal to the aggregates of window_pileup as well."""
    rng = random.Random(half)
    rows = [(rng.choice("ab"), s, s + rng.choice([0, 1, 7, 300]), rng.choice([None, rng.randint(-5, 60)])) for s in (rng.randint(0, 3_000) for _ in range(80))]
    reads = spark.createDataFrame(rows, "contig string, start long, end long, mapq int")
    spots = [("a", 0, 40), ("a", 990, 1_020), ("b", 2_500, 2_530), ("c", 1, 5)]
    loci = spark.createDataFrame(spots, "contig string, start long, end long")
    want = set()
    for c, a, b in spots:
        for p in range(a, b):
            near = [r for r in rows if r[0] == c and r[2] > r[1] and max(r[1] - half, 0) <= p < r[2] + half]
            known = [r[3] for r in near if r[3] is not None]
            if near:
                want.add((c, p, len(near), sum(known), min(known, default=None), max(known, default=None)))
    mapq = F.col("mapq")
    got = pileup.window_totals(reads, loci, half, {"total": mapq}, {"low": mapq}, {"high": mapq})
    assert {tuple(r) for r in got.select("contig", "locus", "n_reads", "total", "low", "high").collect()} == want
    plain = pileup.window_pileup(reads.filter("end > start"), loci, half, F.count(F.lit(1)).alias("n"), F.min("mapq").alias("low"))
    assert {tuple(r) for r in plain.collect()} == {(w[0], w[1], w[2], w[4]) for w in want}


def test_window_events_do_not_grow_with_the_window(spark):
    """The rows that the plan of a wide window moves are those of a narrow one, give or take the bins they end in."""
    reads = spark.range(300).selectExpr("'a' contig", "id * 1000 start", "id * 1000 + 100 end", "cast(id as int) mapq")
    moved = []
    for half in (10, 100_000):
        padded = reads.selectExpr("contig", "greatest(start - %d, 0) start" % half, "end + %d end" % half, "named_struct('r', mapq) cand")
        n = F.size(nested.blocks(F.ceil(F.col("start") / 256), F.floor(F.col("end") / 256))) + 2
        moved.append(padded.select(F.sum(n)).first()[0])
    assert moved[1] < moved[0] * 75


def test_window_totals_follow_distinct_spans(spark):
    """Reads are combined to spans before events are made, and repeated reads count as often as they stand there."""
    from pyspark.sql import functions as F

    from lociforge.operators import pileup

    rows = [("c", 3, 5, 7, None), ("c", 3, 5, 9, None), ("c", 3, 5, None, 4), ("c", 9, 9, 1, 1), (None, 3, 5, 1, 1)]
    reads = spark.createDataFrame(rows, "contig string, start bigint, end bigint, mapq int, x int")
    loci = spark.createDataFrame([("c", 4, 5)], "contig string, start bigint, end bigint")
    found = pileup.window_totals(reads, loci, 2, {"s": F.col("mapq")}, {"low": F.col("mapq")}, {"high": F.col("x")})
    assert [tuple(r) for r in found.collect()] == [("c", 4, 3, 16, 7, 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [contig" in plan and "_total_n_reads" in plan
