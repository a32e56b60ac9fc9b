import os

import pytest
from pyspark.sql import functions as F

from lociforge.functions import bases
from lociforge.operators import pileup
from lociforge.sources import fasta, sam
from lociforge.sources import genotypes as gs

HEADER = ["@HD\tVN:1.6", "@SQ\tSN:scaffold7\tLN:903", "@SQ\tSN:chrM\tLN:16571",
          "@RG\tID:one\tSM:alice", "@RG\tID:two"]


def line(flag, contig, pos, mapq, cigar, seq, qual="*", *tags):
    return "\t".join(["r", str(flag), contig, str(pos), str(mapq), cigar, "=", "1", "0", seq, qual, *tags])


@pytest.fixture()
def sam_file(tmp_path):
    def write(rows, name="reads.sam", header=HEADER):
        path = tmp_path / name
        path.write_text("\n".join([*header, *rows]) + "\n")
        return str(path)
    return write


def test_header_and_projection(spark, sam_file):
    path = sam_file([
        line(67, "scaffold7", 6, 90, "4M", "ACGT", "IIII", "RG:Z:one", "MD:Z:4"),
        line(16, "chrM", 1, 7, "2S2M", "ACGT", "!!!!", "RG:Z:two"),
        line(1024, "scaffold7", 7, 90, "4M", "ACGT"),
        line(512, "scaffold7", 8, 90, "4M", "ACGT"),
        line(4, "scaffold7", 9, 90, "4M", "ACGT"),
        line(0, "*", 0, 0, "*", "ACGT"),
        line(0, "scaffold7", 9, 255, "4M", "ACGT"),
    ])
    lines = sam.read_lines(spark, path)
    assert sorted(tuple(r) for r in sam.contig_dictionary(lines).collect()) == [("chrM", 16571), ("scaffold7", 903)]
    reads, contigs = sam.load_reads(spark, path, mapped=False, non_duplicate=False, passed_quality_checks=False)
    rows = {(r["contig"], r["start"], r["mapq"]): r for r in reads.collect()}
    assert len(rows) == 7 and contigs.count() == 2
    first = rows["scaffold7", 5, 90]
    assert (first["sample"], first["md"], first["end"], first["fwd"], first["qual"]) == ("alice", "4", 9, True, "IIII")
    clipped = rows["chrM", 0, 7]
    assert (clipped["sample"], clipped["md"], clipped["fwd"], clipped["is_mapped"]) == ("default", None, False, False)
    assert rows["scaffold7", 6, 90]["is_dup"] and rows["scaffold7", 7, 90]["fail_qc"]
    assert [k for k, r in rows.items() if not r["is_mapped"]] and rows["*", -1, 0]["is_mapped"] is False
    kept, _ = sam.load_reads(spark, path)
    assert [(r["contig"], r["start"]) for r in kept.collect()] == [("scaffold7", 5)]
    simple = sam.load_simple_reads(spark, path)
    assert sorted((r["contig"], r["start"]) for r in simple.collect()) == [("scaffold7", 5), ("scaffold7", 7)]
    assert sam.select_reads(reads, False, False, False, md_present=True).count() == 1


def test_well_formed(spark, sam_file):
    path = sam_file([line(0, "scaffold7", 1, 9, "4M", "ACGT", "IIII"), line(0, "scaffold7", 1, 9, "5M", "ACGT", "IIII"),
                     line(0, "scaffold7", 1, 9, "4M", "ACGT", "III")])
    reads, _ = sam.load_reads(spark, path)
    assert reads.count() == 1
    path = sam_file([line(0, "scaffold7", 1, 9, "4M", "ac.T", "IIII"), line(0, "scaffold7", 1, 9, "4M", "*"),
                     line(0, "scaffold7", 1, 9, "5M", "ACGT")], "odd.sam")
    raw = sam.parse_alignments(sam.read_lines(spark, path))
    assert sorted((r["seq"] or "-") for r in raw.collect()) == ["-", "ACGT", "ACNT"]
    assert tuple(sam.read_problems(raw).first()) == (3, 1, 2, 3, 1)
    assert sam.select_reads(raw).count() == 2


def test_tumor_normal_and_dictionaries(spark, sam_file):
    tumor = sam_file([line(0, "scaffold7", 1, 9, "4M", "ACGT")] * 2, "t.sam")
    normal = sam_file([line(0, "scaffold7", 1, 9, "4M", "ACGT")], "n.sam")
    other = sam_file([], "o.sam", ["@SQ\tSN:x\tLN:1"])
    reads, a, b = sam.load_tumor_normal(spark, tumor, normal)
    assert sorted((r["token"], r["count"]) for r in reads.groupBy("token").count().collect()) == [(1, 2), (2, 1)]
    assert sam.same_dictionary(a, b)
    assert not sam.same_dictionary(a, sam.contig_dictionary(sam.read_lines(spark, other)))


def test_parquet_reads(spark, sam_file, tmp_path):
    reads, _ = sam.load_reads(spark, sam_file([line(0, "scaffold7", 1, 9, "4M", "ACGT")]))
    path = str(tmp_path / "reads.parquet")
    reads.write.parquet(path)
    again, contigs = sam.load_reads(spark, path, token=2)
    assert [(r["start"], r["end"], r["token"]) for r in again.collect()] == [(0, 4, 2)]
    assert contigs.first()["length"] == 4


def test_loaded_reads_pile_up(spark, sam_file):
    path = sam_file(
        [line(0, "scaffold7", 21, 50, "4M3D5M", "GATTACAGA", "I" * 9, "MD:Z:4^CCC5")] * 2
        + [line(16, "scaffold7", 23, 50, "6M", "TTCCCA", "I" * 6, "MD:Z:6")] * 3)
    reads, _ = sam.load_reads(spark, path)
    rows = pileup.pileup(pileup.elements(reads), F.count(F.lit(1)).alias("n"),
                         F.count_if(F.col("kind") == "deletion").alias("gone")).collect()
    assert {r["locus"]: (r["n"], r["gone"]) for r in rows} == {
        **dict.fromkeys([20, 21], (2, 0)), **dict.fromkeys([22, 23], (5, 0)), **dict.fromkeys([24, 25, 26], (5, 2)),
        27: (5, 0), **dict.fromkeys([28, 29, 30, 31], (2, 0))}


def test_base_helpers(spark):
    df = spark.createDataFrame([("chr1", "ACGT"), ("chrMT", "acgN"), ("MT", "")], "contig string, seq string")
    rows = df.select(bases.normalize_contig("contig").alias("c"), bases.is_standard("seq").alias("ok"),
                     bases.same_bases("seq", F.lit("acgt")).alias("same")).collect()
    assert [(r["c"], r["ok"], r["same"]) for r in rows] == [("1", True, True), ("M", False, False), ("M", False, False)]


@pytest.mark.parametrize("split_bytes", [64, 1 << 20])
def test_fasta_positions(spark, tmp_path, split_bytes):
    import random

    rng = random.Random(1)
    records = {"1": 700, "chrMT": 61, "empty": 0, "GL1": 240}
    texts = {n: "".join(rng.choice("ACGTN") for _ in range(k)) for n, k in records.items()}
    path = tmp_path / "ref.fasta"
    with open(path, "w") as out:
        for name, text in texts.items():
            out.write(f">{name} dna:chromosome x\n")
            out.writelines(text[i:i + 60].lower() + "\n" for i in range(0, len(text), 60))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        for length in (7, 100, 10_000):
            fragments = fasta.load_reference(spark, str(path), length)
            rows = fasta.base_table(fragments).collect()
            got = {}
            for r in rows:
                got.setdefault(r["contig"], {})[r["locus"]] = r["base"]
            assert {c: "".join(b for _, b in sorted(x.items())) for c, x in got.items()} == {
                "1": texts["1"], "M": texts["chrMT"], "GL1": texts["GL1"]}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    loci = spark.createDataFrame([("1", 0), ("1", 699), ("1", 700), ("M", 60), ("x", 0)], "contig string, locus bigint")
    found = fasta.with_reference_base(loci, fasta.load_reference(spark, str(path), 100)).collect()
    assert {(r["contig"], r["locus"], r["ref"]) for r in found} == {
        ("1", 0, texts["1"][0]), ("1", 699, texts["1"][-1]), ("M", 60, texts["chrMT"][-1])}


VCF = ["##fileformat=VCFv4.1", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "kid", "dad"]),
       "6\t3001\t.\tg\tC\t9\tPASS\tX=1\tGT\t0/1\t1|1", "6\t12\t.\tA\tT,C\t9\tPASS\t.\tDP:GT:AD\t13:1/2:1,5,7\t4:0/0:4,0,0",
       "6\t20\t.\tG\t<DEL>\t9\tPASS\t.\tGT\t./.\t0/1", "8\t7\t.\tGAT\tG\t9\tPASS\t.\tGT:AO:FW\t0/1:3:2\t."]


def test_vcf_scan(spark, tmp_path):
    path = tmp_path / "truth.vcf"
    path.write_text("\n".join(VCF) + "\n")
    fields = lambda rows: sorted(
        (r["contig"], r["pos"], r["ref"], r["alt"], r["sample"], "/".join(r["alleles"]), r["read_depth"], r["alt_read_depth"], r["fwd_reads"])
        for r in rows.collect())
    called = [
        ("6", 11, "A", "C", "kid", "OtherAlt/Alt", 13, 7, None), ("6", 11, "A", "T", "kid", "Alt/OtherAlt", 13, 5, None),
        ("6", 3000, "G", "C", "dad", "Alt/Alt", None, None, None), ("6", 3000, "G", "C", "kid", "Ref/Alt", None, None, None),
        ("8", 7, "AT", "", "kid", "Ref/Alt", None, 3, 2)]
    assert fields(gs.load_genotypes(spark, str(path))) == called
    uncalled = [("6", 11, "A", "A", "dad", "Ref/Ref", 4, None, None), ("6", 19, "G", "G", "kid", "NoCall/NoCall", None, None, None)]
    assert fields(gs.load_genotypes(spark, str(path), keep_uncalled=True)) == sorted(called + uncalled)


GENOTYPES = [
    ("2", 7, "A", "T", "s1", "Alt/Alt", 10, 9, 4), ("1", 30, "A", "ACC", "s2", "Ref/Alt", 11, 5, None),
    ("1", 30, "A", "ACC", "s1", "Alt/OtherAlt", 12, 6, 0), ("1", 4, "C", "", "s1", "Ref/Alt", 13, 7, 3),
    ("1", 0, "G", "", "s2", "Alt/Alt", 14, 8, 2), ("1", 9, "T", "T", "s1", "Ref/Ref", 15, 15, 7),
    ("1", 10, "T", "T", "s2", "NoCall/NoCall", 3, None, 1),
]


def sample_genotypes(spark):
    return spark.createDataFrame(
        [(*r[:5], r[5].split("/"), *r[6:]) for r in GENOTYPES],
        "contig string, pos bigint, ref string, alt string, sample string, alleles array<string>, "
        "read_depth int, alt_read_depth int, fwd_reads int")


def test_vcf_sink_loses_nothing(spark, tmp_path):
    out = str(tmp_path / "calls.vcf")
    bases = spark.createDataFrame([("1", 0, "GGGACCATTTTA")], "contig string, line_start bigint, bases string")
    gs.write_vcf(sample_genotypes(spark), out, reference=fasta.fragment(bases, 5))
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    text = "".join(open(os.path.join(out, p)).read() for p in parts).splitlines()
    head = [t for t in text if t.startswith("#")]
    assert text[: len(head)] == head and head[0] == "##fileformat=VCFv4.1" and head[-1].endswith("\tFORMAT\ts1\ts2")
    lines = [t.split("\t") for t in text[len(head) :]]
    assert [t[:2] for t in lines if t[0] == "1"] == sorted((t[:2] for t in lines if t[0] == "1"), key=lambda t: int(t[1]))
    assert ["1", "4", ".", "AC", "A"] in [t[:5] for t in lines]  # a deletion with the base before it
    assert all(len(t) == 11 and t[4] for t in lines)
    back = gs.load_genotypes(spark, out, keep_uncalled=True).collect()
    assert sorted(((*tuple(r)[:5], "/".join(r["alleles"]), *tuple(r)[6:]) for r in back), key=repr) == sorted(GENOTYPES, key=repr)


def test_parquet_sink_and_cap(spark, tmp_path, capsys):
    out = str(tmp_path / "g.parquet")
    gs.write_parquet(sample_genotypes(spark), out, codec="snappy", block_size=1 << 20, page_size=1 << 16, dictionary=False)
    back = gs.load_genotypes(spark, out)
    assert back.count() == len(GENOTYPES) and back.columns == gs.GENOTYPE_COLUMNS
    assert [(r["contig"], r["pos"]) for r in gs.capped(back, 2).collect()] == [("1", 0), ("1", 4)]
    assert gs.capped(back, 0).count() == len(GENOTYPES)
    gs.print_lines(back)
    assert len(capsys.readouterr().out.splitlines()) == len(GENOTYPES)


def test_reference_tables_carry_their_fragment_length(spark, tmp_path):
    lines = spark.createDataFrame([("c", 0, "GATTACAGATTACA")], "contig string, line_start bigint, bases string")
    path = str(tmp_path / "ref.parquet")
    fasta.fragment(lines, 4).write.parquet(path)
    stored = spark.read.parquet(path)
    assert fasta.fragment_length(stored) == 4
    points = spark.createDataFrame([("c", p) for p in (0, 5, 13, 20)], "contig string, locus bigint")
    assert sorted((r["locus"], r["ref"]) for r in fasta.with_reference_base(points, stored).collect()) == [(0, "G"), (5, "C"), (13, "A")]
    kept = fasta.with_reference_base(points, stored, keep_missing=True).collect()
    assert len(kept) == 4 and [r["ref"] for r in kept if r["locus"] == 20] == [None]
    with pytest.raises(ValueError):
        fasta.fragment_length(spark.createDataFrame([("c", 0, 0, "A")], "contig string, frag bigint, frag_start bigint, bases string"))


def test_registered_queries_and_oracles_match_names():
    from lociforge.plans.oracles import ORACLES
    from lociforge.plans.registry import QUERIES

    assert set(ORACLES) == set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("benchmark tables not here")
    df = entry.entry(spark)
    assert df.columns == ["contig", "pos", "ref", "alt", "sample", "alleles", "read_depth", "alt_read_depth", "fwd_reads"]
    assert df.count() > 0
