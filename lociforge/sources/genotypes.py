"""Genotype tables: VCF text and Parquet in, sorted VCF parts and Parquet out.

Schema: ``contig, pos, ref, alt, sample, alleles ARRAY<STRING>, read_depth, alt_read_depth,
fwd_reads``. Positions are 0-based in tables and 1-based in VCF text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.functions.genotypes import ALT, NO_CALL, OTHER_ALT, REF, call_array
from lociforge.sources.fasta import with_reference_base

# The eight fixed VCF columns and the format column.
VCF_COLUMNS = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
GENOTYPE_COLUMNS = [
    "contig", "pos", "ref", "alt", "sample", "alleles", "read_depth", "alt_read_depth", "fwd_reads",
]


def _calls(this: Column, indexes: Column) -> Column:
    """Call names for GT allele indexes, seen from the ALT number ``this``."""
    return F.transform(
        indexes,
        lambda i: F.when(i == "0", F.lit(REF)).when(i == this, F.lit(ALT)).otherwise(F.lit(OTHER_ALT)),
    )


def parse_vcf(lines: DataFrame, samples: list[str] | None = None, keep_uncalled: bool = False) -> DataFrame:
    """VCF data lines as genotypes, one row per sample and called alternate allele.

    A deletion written with the base before it (``CA`` to ``C``) becomes the deleted bases and an empty
    alternate allele at their own position, as callers write it. Depths come from DP, AO (or the
    allele's part of AD) and FW. Symbolic alleles (``<DEL>``) yield no row. With ``keep_uncalled``
    hom-ref genotypes and no-calls (``./.``) yield a row whose alternate allele is the reference; a sample
    that is only ``.`` never does. The open half of a partial call (``1/.``) is some other alternate
    allele. ``samples`` names the genotype columns in order; unnamed columns get ``sample<N>``.
    """
    # Null-safe access and casts: the optimizer may evaluate these on header lines as well.
    f = F.split("value", "\t")
    field = lambda i: F.get(f, F.lit(i))
    rows = lines.filter(~F.col("value").startswith("#") & (F.length("value") > 0)).select(
        field(0).alias("contig"),
        (field(1).try_cast("bigint") - 1).alias("pos"),
        F.upper(field(3)).alias("ref"),
        F.split(field(4), ",").alias("alts"),
        F.split(field(8), ":").alias("format"),
        F.posexplode(F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0)))).alias("col", "call"),
    )
    names = F.array(*[F.lit(s) for s in samples]) if samples else F.array().cast("array<string>")
    values = F.split("call", ":")
    part = lambda key: F.get(values, F.array_position("format", key).cast("int") - 1)
    called = rows.select(
        "contig", "pos", "ref", "alts",
        F.coalesce(
            F.get(names, F.col("col")), F.concat(F.lit("sample"), (F.col("col") + 1).cast("string"))
        ).alias("sample"),
        F.split(part("GT"), "[/|]").alias("gt"),
        part("DP").try_cast("int").alias("read_depth"),
        F.split(part("AO"), ",").alias("ao"), F.split(part("AD"), ",").alias("ad"),
        part("FW").try_cast("int").alias("fwd_reads"),
    )
    exploded = called.select("*", F.posexplode("alts").alias("alt_no", "alt")).withColumn(
        "_this", (F.col("alt_no") + 1).cast("string")
    )
    depth = F.coalesce(
        F.get("ao", F.col("alt_no")).try_cast("int"), F.get("ad", F.col("alt_no") + 1).try_cast("int")
    )
    alternate = exploded.filter(F.array_contains("gt", F.col("_this")) & F.col("alt").rlike("^[A-Za-z]+$")).select(
        "contig", "pos", "ref", F.upper("alt").alias("alt"), "sample",
        _calls(F.col("_this"), F.col("gt")).alias("alleles"),
        "read_depth", depth.alias("alt_read_depth"), "fwd_reads",
    )
    deletes = (F.length("alt") == 1) & (F.length("ref") > 1)
    anchored = deletes & F.col("ref").startswith(F.col("alt"))
    # The first base of a contig has none before it; its deletion is written with the one after it.
    first = deletes & ~anchored & (F.col("pos") == 0) & F.col("ref").endswith(F.col("alt"))
    alternate = alternate.select(
        "contig", (F.col("pos") + F.when(anchored, 1).otherwise(0)).alias("pos"),
        F.when(anchored, F.expr("substring(ref, 2)")).when(first, F.expr("left(ref, length(ref) - 1)"))
        .otherwise(F.col("ref")).alias("ref"),
        F.when(anchored | first, "").otherwise(F.col("alt")).alias("alt"),
        *GENOTYPE_COLUMNS[4:],
    )
    if not keep_uncalled:
        return alternate
    only = lambda text: F.forall("gt", lambda g: g == text)
    uncalled = called.filter((F.size("gt") == 2) & (only("0") | only("."))).select(
        "contig", "pos", "ref", F.col("ref").alias("alt"), "sample",
        F.when(only("0"), call_array(REF, REF)).otherwise(call_array(NO_CALL, NO_CALL)).alias("alleles"),
        "read_depth", F.get("ao", F.lit(0)).try_cast("int").alias("alt_read_depth"), "fwd_reads",
    )
    return alternate.unionByName(uncalled)


def _vcf_samples(lines: DataFrame) -> list[str]:
    """Sample names of the one ``#CHROM`` header line."""
    header = lines.filter(F.col("value").startswith("#CHROM")).limit(1).collect()
    return header[0]["value"].split("\t")[9:] if header else []


def is_parquet(path: str) -> bool:
    """Paths that end in ``.parquet`` are Parquet tables, all others text."""
    return path.rstrip("/").endswith(".parquet")


def load_genotypes(spark: SparkSession, path: str, keep_uncalled: bool = False) -> DataFrame:
    """A Parquet genotype table (``.parquet`` paths) or VCF text."""
    if is_parquet(path):
        return spark.read.parquet(path)
    lines = spark.read.text(path)
    return parse_vcf(lines, _vcf_samples(lines), keep_uncalled)


def capped(genotypes: DataFrame, max_genotypes: int = 0) -> DataFrame:
    """The first ``max_genotypes`` genotypes by position; 0 keeps all of them."""
    if max_genotypes <= 0:
        return genotypes
    return genotypes.orderBy("contig", "pos", "ref", "alt", "sample").limit(max_genotypes)


def sample_names(genotypes: DataFrame) -> list[str]:
    """The samples of a table, in order: one job, a name each."""
    return sorted(r["sample"] for r in genotypes.select("sample").distinct().collect())


def vcf_lines(genotypes: DataFrame, samples: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Genotypes as VCF text lines, a line per variant and a column per sample (GT, DP, AO, FW).

    A deletion gets the base before it, from the ``reference`` fragments where they have it and ``N``
    elsewhere; at the first base of a contig an ``N`` follows it. Samples without a row at the variant are ``.``; hom-ref rows and no-calls have ``.`` as
    alternate allele.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("."))
    gt = (
        F.when(F.col("alleles") == call_array(ALT, ALT), "1/1")
        .when(F.col("alleles") == call_array(REF, REF), "0/0")
        .when(F.col("alleles") == call_array(ALT, OTHER_ALT), "1/.")
        .when(F.array_contains("alleles", REF), "0/1")
        .otherwise("./.")
    )
    call = F.concat_ws(":", gt, text("read_depth"), text("alt_read_depth"), text("fwd_reads"))
    columns = [F.max(F.when(F.col("sample") == s, F.col("call"))).alias(f"s{i}") for i, s in enumerate(samples)]
    sites = genotypes.withColumn("call", call).groupBy("contig", "pos", "ref", "alt").agg(*columns)
    before = (F.col("alt") == "") & (F.col("pos") > 0)
    sites = sites.withColumn("locus", F.when(before, F.col("pos") - 1))
    if reference is None:
        sites = sites.withColumn("before", F.lit(None).cast("string"))
    else:
        sites = with_reference_base(sites, reference, "before", keep_missing=True)
    base = F.coalesce("before", F.lit("N"))
    deleted = F.col("alt") == ""
    return sites.select(
        "contig", F.when(before, F.col("pos") - 1).otherwise(F.col("pos")).alias("pos"), "ref", "alt",
        F.concat_ws(
            "\t", "contig", (F.col("pos") + F.when(before, 0).otherwise(1)).cast("string"), F.lit("."),
            F.when(before, F.concat(base, "ref")).when(deleted, F.concat("ref", base)).otherwise(F.col("ref")),
            F.when(deleted, base).when(F.col("alt") == F.col("ref"), ".").otherwise(F.col("alt")),
            F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:DP:AO:FW"),
            *[F.coalesce(f"s{i}", F.lit(".")) for i in range(len(samples))],
        ).alias("value"),
    )


def write_vcf(
    genotypes: DataFrame, path: str, mode: str = "errorifexists", reference: DataFrame | None = None,
    samples: list[str] | None = None,
) -> None:
    """A directory of position-sorted VCF parts; read in name order they form one VCF file.

    Header lines sort before every contig, so they open the first part. Parts are written in
    parallel by range; no task sees the whole output. Without ``samples`` their names are looked up first.
    """
    spark = genotypes.sparkSession
    samples = sample_names(genotypes) if samples is None else samples
    header = [
        "##fileformat=VCFv4.1",
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read depth">',
        '##FORMAT=<ID=AO,Number=A,Type=Integer,Description="Alternate allele observations">',
        '##FORMAT=<ID=FW,Number=1,Type=Integer,Description="Forward reads">',
        "#" + "\t".join([*VCF_COLUMNS, *samples]),
    ]
    head = spark.createDataFrame(
        [("", i, "", "", text) for i, text in enumerate(header)],
        "contig string, pos bigint, ref string, alt string, value string",
    )
    rows = head.unionByName(vcf_lines(genotypes, samples, reference)).orderBy("contig", "pos", "ref", "alt")
    rows.select("value").write.mode(mode).text(path)


def write_parquet(
    genotypes: DataFrame,
    path: str,
    mode: str = "errorifexists",
    codec: str = "zstd",
    block_size: int | None = None,
    page_size: int | None = None,
    dictionary: bool = True,
) -> None:
    """Parquet genotypes, range-sorted by position so scans can skip row groups."""
    writer = (
        genotypes.repartitionByRange("contig", "pos")
        .sortWithinPartitions("contig", "pos")
        .write.mode(mode)
        .option("compression", codec)
        .option("parquet.enable.dictionary", str(dictionary).lower())
    )
    if block_size:
        writer = writer.option("parquet.block.size", block_size)
    if page_size:
        writer = writer.option("parquet.page.size", page_size)
    writer.parquet(path)


def print_lines(genotypes: DataFrame) -> None:
    """Print every genotype by position. Rows come to the driver a partition at a time, never all at once."""
    ordered = genotypes.orderBy("contig", "pos", "ref", "alt", "sample")
    for row in ordered.toLocalIterator(prefetchPartitions=True):
        print("\t".join("" if v is None else "/".join(v) if isinstance(v, list) else str(v) for v in row))
