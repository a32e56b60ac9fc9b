"""The registered queries: name -> function of (spark, directory of the tables)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociforge.functions import bases, cigar, genotypes, md, quality
from lociforge.operators import filters, intervals, metrics, overlap, pileup, split, variants
from lociforge.plans import callers, concordance, views
from lociforge.sources import bam, fasta, genotypes as genotype_source, indexed_fasta, loci, sam, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TAKE_LOCI = 5_000
BUCKETS = 7
DEPTH_BUCKETS, DEPTH_ACCURACY = 4, 25
HALF_WINDOW = 3
WIDE_WINDOW = 1_000
SAMPLES = ["normal", "tumor"]
STORED_WIDTH, STORED_BUCKETS = 64, 8
BINARY_SPLIT = 1 << 20


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _count(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def _calls(rows: DataFrame) -> DataFrame:
    return rows.withColumn("alleles", F.array_join("alleles", "/"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return pileup.elements(views.reads(spark, d))


# --- reads -----------------------------------------------------------------------------------


def _groups(spark: SparkSession, d: str) -> DataFrame:
    # Two read groups, as a SAM header would list them.
    return sam.read_groups(
        spark.range(2).select(
            F.concat(
                F.lit("@RG\tID:"),
                F.when(F.col("id") == 0, "tumor\tSM:tumor").otherwise("normal\tSM:normal"),
            ).alias("value")
        )
    )


@query
def scan_filter_reads(spark, d):
    """SAM text to reads, then mapped, non-duplicate, passed and MD filters."""
    parsed = sam.parse_alignments(views.sam_lines(spark, d), 0, _groups(spark, d))
    kept = sam.select_reads(parsed, md_present=True)
    return kept.groupBy("contig", "sample").agg(
        _count("n_reads"),
        F.count_if("fwd").alias("n_fwd"),
        F.sum("mapq").alias("sum_mapq"),
        F.sum(F.col("end") - F.col("start")).alias("sum_span"),
        F.sum(F.length("seq")).cast("bigint").alias("sum_bases"),
        F.min("start").alias("first_start"),
        F.max("end").alias("last_end"),
        F.count_if(sam.well_formed()).alias("n_well_formed"),
    )


@query
def tumor_normal_load(spark, d):
    """A text file of reads for each sample, with its header, loaded as one set with tokens."""
    lines, paths = views.sam_lines(spark, d), []
    for sample in ("tumor", "normal"):
        paths.append(_folder(spark, sample))
        head = spark.range(1).select(F.lit(f"@RG\tID:{sample}\tSM:{sample}").alias("value"))
        own = lines.filter(F.col("value").contains(f"RG:Z:{sample}"))
        head.unionByName(own).write.text(paths[-1])
    reads, _, _ = sam.load_tumor_normal(spark, *paths)
    return reads.groupBy("contig", "token", "sample").agg(
        _count(), F.sum(F.col("end") - F.col("start")).alias("sum_span"), F.sum("mapq").alias("sum_mapq")
    )


@query
def sam_projection(spark, d):
    """Flags and positions of every parsed record, before any filter."""
    parsed = sam.parse_alignments(views.sam_lines(spark, d), 0, _groups(spark, d))
    return parsed.groupBy("contig", "start", "mapq", "is_dup", "fail_qc", "fwd", "sample").agg(_count())


def _odd(spark: SparkSession, d: str, strict: bool = False) -> DataFrame:
    return sam.parse_alignments(views.odd_sam_lines(spark, d), 0, _groups(spark, d), strict)


@query
def odd_read_predicates(spark, d):
    """Every scan predicate over reads of which some fail it: flags, qualities, tags, texts that disagree."""
    strict = _odd(spark, d, strict=True).filter("is_mapped").withColumn("kind", F.lit("strict"))
    rows = _odd(spark, d).withColumn("kind", F.when(F.col("is_mapped"), "mapped").otherwise("unmapped"))
    return rows.unionByName(strict).groupBy("kind", "cigar", "seq", "sample").agg(
        _count(), F.count_if("is_dup").alias("n_dup"), F.count_if("fail_qc").alias("n_fail"),
        F.count("md").alias("n_md"), F.count("qual").alias("n_qual"), F.count_if(sam.well_formed()).alias("n_well_formed"),
        F.count_if(bases.is_standard("seq")).alias("n_standard"),
    )


@query
def odd_alignment_kinds(spark, d):
    """Elements of every CIGAR operator, with and without MD tags and qualities."""
    rows = pileup.elements(sam.select_reads(_odd(spark, d)))
    return rows.groupBy("contig", "locus", "sample", "kind", "allele", "q", "ref_base").agg(_count())


@query
def element_at_locus(spark, d):
    """Elements at one locus of the mapped odd reads."""
    return pileup.element_at_locus(sam.select_reads(_odd(spark, d)), 1000).groupBy("contig", "kind", "allele").agg(_count())


@query
def contig_dictionary(spark, d):
    """Contigs and lengths from header lines."""
    return sam.contig_dictionary(views.header_lines(spark, d))


@query
def loci_selection(spark, d):
    """All loci: every contig of the header."""
    return loci.select_loci(spark, "all", sam.contig_dictionary(views.header_lines(spark, d)))


@query
def read_extent(spark, d):
    return loci.from_reads(views.read_spans(spark, d))


@query
def cigar_end_unclipped(spark, d):
    rows = views.reads(spark, d)
    return rows.groupBy("contig", "start").agg(
        _count(),
        F.sum(cigar.alignment_end()).alias("sum_end"),
        F.sum(cigar.unclipped_start()).alias("sum_unclipped_start"),
        F.sum(cigar.unclipped_end()).alias("sum_unclipped_end"),
        F.sum(cigar.read_length()).alias("sum_read_length"),
        F.sum(cigar.reference_length()).alias("sum_reference_length"),
    )


@query
def md_mismatches(spark, d):
    rows = views.reads(spark, d).select("contig", "start", F.explode(md.md_mismatches()).alias("m"))
    return rows.groupBy("contig", (F.col("start") + F.col("m.off")).alias("locus"), F.col("m.base").alias("base")).agg(_count())


@query
def reference_from_md(spark, d):
    """Reference base per locus, from the MD tags of the reads alone."""
    return pileup.pileup(
        _elements(spark, d), pileup.reference_base().alias("ref_base"),
        pileup.reference_base(smallest=True).alias("ref_low"),
    )


@query
def normalize_contig(spark, d):
    rows = views.read_spans(spark, d).select(
        bases.normalize_contig(F.when(F.col("contig") == "chr4", "chrMT").otherwise(F.col("contig"))).alias("contig")
    )
    return rows.groupBy("contig").agg(_count())


@query
def standard_bases(spark, d):
    """Reads whose whole sequence is made of standard bases, and their quality total."""
    rows = views.reads(spark, d)
    q = F.aggregate(quality.phred_array("qual", "seq"), F.lit(0), lambda s, x: s + x)
    return rows.groupBy("contig", bases.is_standard("seq").alias("standard")).agg(
        _count(), F.sum(q).alias("sum_q"), F.sum(F.length(bases.to_bases("seq"))).cast("bigint").alias("n_bases")
    )


# --- pileups ---------------------------------------------------------------------------------


@query
def pileup_allele_counts(spark, d):
    return pileup.allele_counts(_elements(spark, d), ("contig", "locus"))


@query
def pileup_by_sample(spark, d):
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("match", "mismatch", "insertion", "deletion")]
    return pileup.pileup(
        _elements(spark, d), _count("depth"), *counts, F.sum("q").alias("sum_q"),
        keys=("contig", "locus", "sample"),
    )


@query
def pileup_by_token(spark, d):
    return pileup.depth(_elements(spark, d), ("contig", "locus", "token"))


@query
def alignment_kinds(spark, d):
    """Element kinds with their CIGAR coordinates."""
    return _elements(spark, d).groupBy("contig", "locus", "kind", "cigar_idx").agg(
        _count(),
        F.sum("read_pos").alias("sum_read_pos"),
        F.sum("idx_in_elem").alias("sum_idx"),
        F.max("q").alias("max_q"),
        F.count(pileup.single_base()).alias("n_single"),
    )


@query
def pileup_over_loci(spark, d):
    """Depth at every target locus, zero-read loci included."""
    found = pileup.pileup_over(
        views.reads(spark, d), views.targets(spark, d), _count("depth"), include_empty=True
    )
    return found.select("contig", "locus", F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))


@query
def base_read_counts(spark, d):
    """Plain base rows per CIGAR operator, counted per base and quality floor."""
    rows = filters.min_base_quality(pileup.base_reads(views.reads(spark, d)), callers.MIN_BASE_QUALITY)
    return callers.base_counts(rows, keys=("contig", "locus", "token"))


@query
def unclipped_base_counts(spark, d):
    """As above, counting positions from the unclipped start."""
    rows = pileup.base_reads(views.reads(spark, d), clip_mode="unclipped")
    return callers.base_counts(rows, keys=("contig", "locus"))


@query
def min_depth_loci(spark, d):
    return filters.min_depth(pileup.depth(_elements(spark, d)), 200)


@query
def depth_sweep(spark, d):
    return pileup.coverage(views.read_spans(spark, d))


@query
def window_reads(spark, d):
    targets = intervals.merge(views.targets(spark, d))
    return pileup.window_pileup(
        views.read_spans(spark, d), targets, HALF_WINDOW, _count("n_reads"), F.sum("mapq").alias("sum_mapq"), disjoint=True
    )


@query
def window_totals_wide(spark, d):
    """Reads within 1000 loci of every target locus: their number, sum, least and largest mapping quality."""
    targets = intervals.merge(views.targets(spark, d))
    return pileup.window_totals(
        views.read_spans(spark, d), targets, WIDE_WINDOW, {"sum_mapq": F.col("mapq")}, {"min_mapq": F.col("mapq")}, {"max_span": F.col("end") - F.col("start")},
        disjoint=True,
    )


@query
def new_reads(spark, d):
    return pileup.new_reads(views.read_spans(spark, d), views.targets(spark, d), HALF_WINDOW)


@query
def paired_pileups(spark, d):
    rows = _elements(spark, d)
    mismatches = F.count_if(F.col("kind") == "mismatch").alias("mismatches")
    return pileup.pileup_pair(rows, _count("depth"), mismatches)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for files: in the shared folder of the cluster, else in the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/lociforge-{spark.sparkContext.applicationId}/{name}_{uuid.uuid4().hex}"


@query
def binary_round_trip(spark, d):
    """All reads written as binary files and scanned back by byte ranges, with their flags, texts and samples."""
    folder = _folder(spark, "binary")
    contigs = [(f"chr{c}", views.CONTIG_LENGTH) for c in range(1, views.CONTIGS + 1)]
    bam.write_reads(views.all_reads(spark, d), folder, contigs, SAMPLES)
    reads, _ = bam.load_reads(spark, folder, mapped=False, non_duplicate=False, passed_quality_checks=False, split_bytes=BINARY_SPLIT)
    return reads.groupBy("contig", "start", "mapq", "is_dup", "fail_qc", "fwd", "sample").agg(
        _count(), F.sum(F.length("seq")).cast("bigint").alias("sum_bases"),
        F.sum(F.when(F.col("is_mapped"), F.col("end") - F.col("start"))).alias("sum_span"), F.count_if(sam.well_formed()).alias("n_well_formed"),
    )


def _stored(reads: DataFrame, name: str) -> DataFrame:
    path = _folder(reads.sparkSession, name)
    return stored.write_reads(reads, path.rsplit("/", 1)[1], STORED_BUCKETS, STORED_WIDTH, path)


@query
def stored_reads(spark, d):
    """Reads stored by position: rows and reads per contig and stretch."""
    return _stored(views.read_spans(spark, d), "reads").groupBy("contig", "stretch").agg(
        _count("n_rows"), F.count_if("first").alias("n_reads"), F.min("start").alias("first_start"),
        F.max("end").alias("last_end"),
    )


@query
def stored_paired_pileups(spark, d):
    """Both samples stored by position, and their pileups side by side, bucket by bucket."""
    reads = views.reads(spark, d)
    sides = [_stored(reads.filter(F.col("token") == token), f"token{token}") for token in (1, 2)]
    mismatches = F.count_if(F.col("kind") == "mismatch").alias("mismatches")
    return stored.stored_pair(*sides, _count("depth"), mismatches)


@query
def top_bases(spark, d):
    counts = callers.base_counts(pileup.base_reads(views.reads(spark, d)), callers.MIN_BASE_QUALITY)
    return callers.top_bases(counts).select("contig", "locus", "token", "base", "n", "depth", "rank")


@query
def allele_percents(spark, d):
    counts = pileup.base_allele_counts(_elements(spark, d))
    return callers.allele_percents(counts).drop("n_fwd", "ref_base").withColumn("percent", F.round("percent", 6))


@query
def grouped_alleles_top2(spark, d):
    """The two most frequent single-base alleles per locus and sample."""
    rows = callers.allele_percents(pileup.base_allele_counts(_elements(spark, d)))

    rank = F.row_number().over(
        Window.partitionBy("contig", "locus", "sample").orderBy(F.desc("n"), "allele")
    )
    return rows.withColumn("rank", rank).filter("rank <= 2").select(
        "contig", "locus", "sample", "allele", "n", "rank"
    )


# --- pileup and genotype filters ---------------------------------------------------------------


def _evidence(spark: SparkSession, d: str, min_mapq: int = 0) -> DataFrame:
    # Reads mapped at 58 or better count as ambiguous here, so that the locus filters have something to do.
    rows = _elements(spark, d).withColumn("mapq", F.when(F.col("mapq") >= 58, 0).otherwise(F.col("mapq")))
    return filters.evidence(rows, min_mapq=min_mapq)


def _kept(alleles: DataFrame, n: str = "n", mapq: str = "kept_mapq") -> DataFrame:
    return alleles.groupBy("contig", "locus", "sample").agg(
        F.sum(n).alias("n"), F.count(F.lit(1)).alias("alleles"), F.min(mapq).alias("min_mapq")
    )


@query
def map_quality_filter(spark, d):
    return _kept(_evidence(spark, d, filters.MIN_MAPQ).filter("n > 0"))


@query
def region_complexity(spark, d):
    return _kept(filters.drop_complex_regions(_evidence(spark, d, filters.MIN_MAPQ)), "n_all", "low_mapq")


@query
def ambiguous_filter(spark, d):
    return _kept(filters.drop_ambiguous(_evidence(spark, d)))


@query
def multiallelic_filter(spark, d):
    return _kept(filters.drop_multi_allelic(_evidence(spark, d)))


@query
def pileup_filter_chain(spark, d):
    return _kept(filters.filter_pileups(_evidence(spark, d, 25), max_complexity=30, max_ploidy=4))


@query
def genotype_filters(spark, d):
    called = callers.threshold_calls(views.reads(spark, d), cluster=False)
    return _calls(
        filters.filter_genotypes(
            called, min_read_depth=20, min_alt_depth=10, max_strand_bias_depth=40,
            low_strand_bias=55, high_strand_bias=75,
        )
    )


# --- calls -----------------------------------------------------------------------------------


@query
def threshold_calls(spark, d):
    return _calls(callers.threshold_calls(views.reads(spark, d), cluster=False))


@query
def threshold_calls_on_loci(spark, d):
    """Threshold calls on a locus set only, hom-ref rows included."""
    return _calls(
        callers.threshold_calls(
            views.reads(spark, d), emit_ref=True, loci=views.targets(spark, d), cluster=False
        )
    )


@query
def threshold_calls_all(spark, d):
    """With hom-ref and no-call rows, at a threshold most loci fail."""
    return _calls(
        callers.threshold_calls(views.reads(spark, d), 90, emit_ref=True, emit_no_call=True, cluster=False)
    )


@query
def somatic_threshold_calls(spark, d):
    return _calls(callers.somatic_threshold_calls(views.reads(spark, d), cluster=False))


@query
def somatic_calls(spark, d):
    return _calls(callers.somatic_calls(views.clone_reads(spark, d), views.reference(spark, d), cluster=False))


@query
def bayes_likelihoods(spark, d):
    alleles = callers.bayes_evidence(views.reads(spark, d), cluster=False)
    rows = callers.genotype_likelihoods(alleles)
    return rows.select(
        "contig", "locus", "sample", "a1", "a2", "depth",
        F.round("log_likelihood", 6).alias("log_likelihood"),
        F.round(F.col("likelihood") * 1e6, 2).alias("likelihood_ppm"),
    )


@query
def bayes_calls(spark, d):
    return _calls(callers.bayes_calls(views.reads(spark, d), cluster=False))


@query
def bayes_calls_filtered(spark, d):
    """Likelihood calls behind the full pileup filter chain, with hom-ref rows."""
    return _calls(
        callers.bayes_calls(
            views.reads(spark, d), min_mapq=25, emit_ref=True, cluster=False, max_complexity=20, max_ploidy=4,
        )
    )


@query
def bayes_calls_prior(spark, d):
    """Likelihood calls under a prior table that disfavours genotypes of a deletion and one base or two deletions."""
    pairs = [("", other, -400.0) for other in ("", "A", "C", "G", "T")]
    prior = spark.createDataFrame(pairs, "a1 string, a2 string, log_prior double")
    return _calls(callers.bayes_calls(views.reads(spark, d), prior=prior, cluster=False))


@query
def genotype_classes(spark, d):
    """Allele calls of the most likely genotypes, and how many variants each holds."""
    best = callers.most_likely_genotypes(callers.bayes_evidence(views.reads(spark, d), cluster=False))
    pair = F.array("a1", "a2")
    return best.select(
        "contig", "locus", "sample", "a1", "a2",
        F.array_join(genotypes.classify_pair(F.col("a1"), F.col("a2"), F.col("ref")), "/").alias("alleles"),
        genotypes.unique_alleles(pair).cast("bigint").alias("n_unique"),
        genotypes.variant_count(pair, F.col("ref")).cast("bigint").alias("n_variants"),
        genotypes.ploidy(pair).cast("bigint").alias("ploidy"),
    )


@query
def concordance_table(spark, d):
    called = callers.bayes_calls(views.reads(spark, d), cluster=False)
    return concordance.concordance_table(called, views.truth(spark, d), exclude_indels=True)  # the first sample


def _scores(rows: DataFrame) -> DataFrame:
    return rows.select(
        "true_positives", "false_positives", "false_negatives",
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")],
    )


@query
def concordance_scores(spark, d):
    """Precision, recall and F1 of the threshold calls of one chosen sample, SNVs only."""
    called = callers.threshold_calls(views.reads(spark, d), cluster=False)
    return _scores(concordance.evaluate(called, views.truth(spark, d), exclude_indels=True, sample="tumor"))


@query
def call_filter_write_evaluate(spark, d):
    """The likelihood caller's whole chain: calls, genotype filters, VCF lines, and their scores when read back."""
    called = callers.bayes_calls(views.reads(spark, d))
    kept = filters.filter_genotypes(called, min_read_depth=20, min_alt_depth=10)
    lines = genotype_source.vcf_lines(kept, SAMPLES, views.reference(spark, d)).select("value")
    found = genotype_source.parse_vcf(lines, SAMPLES)
    return _scores(concordance.evaluate(found, views.truth(spark, d), exclude_indels=True, sample="normal"))


@query
def normalized_deletions(spark, d):
    """Deletions written at many places and with bases around them, counted at their leftmost place."""
    found = variants.normalized(views.written_deletions(spark, d), views.reference(spark, d))
    return found.groupBy("contig", "pos", "ref", "alt").agg(_count())


@query
def tetraploid_genotypes(spark, d):
    """The most likely genotype of four copies per locus and sample."""
    alleles = callers.copy_evidence(pileup.elements(pileup.by_neighbourhood(views.reads(spark, d))).filter("mapq > 30"), 4)
    best = callers.most_likely_copies(alleles, 4)
    return best.select("contig", "locus", "sample", F.array_join("genotype", "/").alias("genotype"), F.round("log_likelihood", 6).alias("log_likelihood"),
                       F.array_join("calls", "/").alias("calls"), "depth")


@query
def variant_types(spark, d):
    """Called variants per type and contig, after the type filter."""
    called = callers.bayes_calls(views.reads(spark, d), cluster=False)
    kept = filters.select_variants(called, exclude_snvs=True)
    return kept.groupBy("contig", bases.variant_type("ref", "alt").alias("type")).agg(_count())


@query
def parquet_genotypes(spark, d):
    """Threshold calls written as a sorted Parquet table and loaded back."""
    path = f"{_folder(spark, 'calls')}.parquet"
    genotype_source.write_parquet(callers.threshold_calls(views.reads(spark, d), cluster=False), path)
    return _calls(genotype_source.load_genotypes(spark, path))


@query
def vcf_round_trip(spark, d):
    """Genotypes of both samples, hom-ref rows, insertions and deletions, as VCF lines and back, all columns."""
    called = callers.bayes_calls(views.reads(spark, d), emit_ref=True, cluster=False)
    lines = genotype_source.vcf_lines(called, SAMPLES, views.reference(spark, d)).select("value")
    return _calls(genotype_source.parse_vcf(lines, SAMPLES, keep_uncalled=True))


@query
def first_genotypes(spark, d):
    """The capped sink: the first 25 genotypes by position."""
    called = callers.threshold_calls(views.reads(spark, d), cluster=False)
    return _calls(genotype_source.capped(called, 25))


# --- reference -------------------------------------------------------------------------------


@query
def reference_bases(spark, d):
    return fasta.base_table(views.reference(spark, d))


@query
def reference_at_reads(spark, d):
    """Reference base under the first base of every read, looked up in fragments."""
    starts = views.read_spans(spark, d).groupBy("contig", F.col("start").alias("locus")).agg(_count())
    return fasta.with_reference_base(starts, views.reference(spark, d))


@query
def indexed_reference(spark, d):
    """The reference written as FASTA text, indexed, and its bases at the target loci read by byte offset."""
    folder = _folder(spark, "reference")
    lines = views.reference(spark, d, 60).selectExpr("contig", "frag_start AS at", "cast(bases AS STRING) AS value")
    heads = lines.select("contig").distinct().selectExpr("contig", "-1L AS at", "concat('>', contig) AS value")
    lines.unionByName(heads).repartition("contig").sortWithinPartitions("contig", "at").select("value").write.text(folder)
    index = indexed_fasta.index_of(spark, folder, normalize=False, suffix=".txt")
    targets = views.targets(spark, d)
    found = indexed_fasta.fragments_at(index, targets, views.FRAGMENT)
    return fasta.with_reference_base(intervals.loci(intervals.merge(targets.select("contig", "start", "end"))), found, "base")


# --- intervals -------------------------------------------------------------------------------


@query
def interval_merge(spark, d):
    return intervals.merge(views.ranges(spark, d))


@query
def interval_union(spark, d):
    rows = views.ranges(spark, d)
    return intervals.union(*[rows.filter(F.col("value") == status) for status in ("O", "F", "P")])


@query
def interval_overlay(spark, d):
    return intervals.overlay(views.ranges(spark, d))


@query
def interval_overlay_wide(spark, d):
    """Ranges of 1 to 100,000,000 loci: later-starting ranges win."""
    return intervals.overlay(views.wide_ranges(spark, d), wide=True)


@query
def interval_put_wide(spark, d):
    """A fused set of long ranges put on top of a map of long ranges."""
    rows = views.wide_ranges(spark, d)
    base = intervals.overlay(rows.filter("value <> 'P'"), wide=True)
    return intervals.put(base, intervals.merge(rows.filter("value = 'P'"), wide=True), "late", wide=True)


@query
def lookup_wide(spark, d):
    """Loci looked up in a map of long ranges, and in the fused set of them."""
    points, rows = views.wide_points(spark, d), views.wide_ranges(spark, d)
    found = overlap.lookup(points, intervals.overlay(rows, wide=True)).groupBy("contig", "value").agg(_count("n_points"))
    spans = points.withColumnsRenamed({"locus": "start"}).withColumn("end", F.col("start") + 50)
    held = overlap.overlapping(spans, intervals.merge(rows, wide=True), disjoint=True).groupBy("contig").agg(_count("n_points"))
    return found.unionByName(held.withColumn("value", F.lit("any")))


@query
def interval_union_maps(spark, d):
    """Two maps united: later-starting ranges win, then the second operand."""
    rows = views.ranges(spark, d)
    return intervals.union_maps(rows.filter("value <> 'F'"), rows.filter("value = 'F'"))


@query
def interval_put(spark, d):
    """A locus set put under one value on top of a map."""
    rows = views.ranges(spark, d)
    base = intervals.overlay(rows.filter("value <> 'P'"))
    return intervals.put(base, intervals.merge(rows.filter("value = 'P'")), "late")


@query
def interval_invert(spark, d):
    return intervals.invert(views.ranges(spark, d))


@query
def interval_stats(spark, d):
    return intervals.statistics(intervals.merge(views.ranges(spark, d), ("contig", "value")), ("value",))


@query
def interval_union_on_contig(spark, d):
    """Two maps united on one contig."""
    rows = views.ranges(spark, d)
    return intervals.union_on_contig(rows.filter("value = 'O'"), rows.filter("value <> 'O'"), "chr3")


@query
def contig_variants(spark, d):
    """Called variants of one contig."""
    called = callers.threshold_calls(views.reads(spark, d), cluster=False)
    return _calls(filters.select_variants(called, contig="chr2"))


@query
def interval_contigs(spark, d):
    return intervals.contigs(views.ranges(spark, d))


@query
def interval_take(spark, d):
    return intervals.split_at(intervals.merge(views.ranges(spark, d)), TAKE_LOCI)


@query
def interval_lookup(spark, d):
    """Read starts looked up in the target map."""
    points = views.read_spans(spark, d).select("contig", F.col("start").alias("locus"), "sample")
    found = overlap.lookup(points, intervals.overlay(views.targets(spark, d)))
    return found.groupBy("contig", "value", "sample").agg(_count())


@query
def interval_values_in_range(spark, d):
    """Distinct target values inside each read span."""
    spans = views.read_spans(spark, d).select("contig", "start", "end").distinct()
    found = overlap.values_in_ranges(spans, intervals.overlay(views.targets(spark, d)), disjoint=True)
    return found.groupBy("contig", "start", "end").agg(
        F.count(F.lit(1)).alias("n_values"), F.sum("value").cast("bigint").alias("sum_values")
    )


@query
def interval_intersects(spark, d):
    """Merged ranges that share a locus with [50000, 60000)."""
    return overlap.intersects(intervals.merge(views.ranges(spark, d)), 50_000, 60_000)


@query
def interval_on_contig(spark, d):
    return intervals.on_contig(intervals.overlay(views.ranges(spark, d)), "chr2")


@query
def interval_loci(spark, d):
    """Every locus of the target set on its own."""
    return intervals.loci(intervals.merge(views.targets(spark, d)))


@query
def interval_difference(spark, d):
    """Symmetric difference of two normalised sets (empty means equal)."""
    rows = views.ranges(spark, d)
    a, b = intervals.merge(rows), intervals.merge(rows.filter("value <> 'P'"))
    return (
        a.exceptAll(b).withColumn("side", F.lit("left"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    )


@query
def interval_spec(spark, d):
    """Spec text of every order parsed back to ranges."""
    specs = views.ranges(spark, d).select(
        F.format_string(" %s:%d-%d , none:%d-%d", "contig", "start", "end", "end", "end").alias("spec"), "value"
    )
    return loci.parse_specs(specs).groupBy("contig", "start", "end", "value").agg(_count())


@query
def interval_display(spark, d):
    return intervals.display(intervals.overlay(views.ranges(spark, d)), 500, "value")


@query
def overlap_join(spark, d):
    """Reads per target value they overlap, a read once per distinct value."""
    found = overlap.overlapping_values(
        views.read_spans(spark, d), intervals.overlay(views.targets(spark, d)), half_window=HALF_WINDOW, disjoint=True
    )
    return found.groupBy("contig", "value", "sample").agg(_count(), F.sum("mapq").alias("sum_mapq"))


@query
def overlap_pairs(spark, d):
    """Reads per single target range."""
    found = overlap.overlapping_pairs(views.read_spans(spark, d), intervals.merge(views.targets(spark, d)))
    return found.groupBy("contig", "range_start", "range_end").agg(_count())


@query
def overlap_semi(spark, d):
    found = overlap.overlapping(views.read_spans(spark, d), views.targets(spark, d), HALF_WINDOW)
    return found.groupBy("contig", "sample").agg(
        _count(), F.sum("start").alias("sum_start"), F.sum("mapq").alias("sum_mapq")
    )


@query
def reads_at_locus(spark, d):
    """Reads whose padded span holds locus 1000."""
    found = views.read_spans(spark, d).filter(overlap.overlaps_locus(1000, HALF_WINDOW))
    return found.groupBy("contig", "sample").agg(_count(), F.sum("start").alias("sum_start"))


# --- splitting and reports -------------------------------------------------------------------


@query
def uniform_split(spark, d):
    return split.split_evenly(views.ranges(spark, d), BUCKETS)


@query
def balanced_split(spark, d):
    return split.split_by_depth(
        views.contig_loci(spark, d), DEPTH_BUCKETS, views.read_spans(spark, d), accuracy=DEPTH_ACCURACY, disjoint=True
    )


@query
def reads_by_bucket(spark, d):
    """Reads repeated across bucket borders, summed up per bucket, contig and token."""
    buckets = split.split_loci(views.contig_loci(spark, d), [], BUCKETS, accuracy=0, disjoint=True)
    found = overlap.overlapping_values(views.read_spans(spark, d), buckets, disjoint=True)
    return found.groupBy("value", "contig", "token").agg(
        _count(), F.min("start").alias("first_start"), F.max("end").alias("last_end")
    )


@query
def skew_report(spark, d):
    buckets = split.split_evenly(views.contig_loci(spark, d), BUCKETS, disjoint=True)
    counts = split.reads_per_bucket([views.read_spans(spark, d)], buckets)
    report = metrics.skew_report(counts)
    return report.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in report.columns])


@query
def bucket_report(spark, d):
    buckets = split.split_evenly(views.contig_loci(spark, d), 50, disjoint=True)
    report = metrics.range_report(split.reads_per_bucket([views.read_spans(spark, d)], buckets))
    return report.select("min", F.round("mean", 6).alias("mean"), "max")


@query
def scan_counters(spark, d):
    buckets = split.split_evenly(views.targets(spark, d), BUCKETS)
    report = metrics.scan_counters(views.read_spans(spark, d), buckets)
    return report.withColumn("expansion_percent", F.round("expansion_percent", 6))
