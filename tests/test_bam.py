import gzip
import struct

import pytest
from pyspark.sql import functions as F

from lociforge.sources import bam, sam

from helpers import make_read, reads_df

CONTIGS, SAMPLES = [("chr1", 5000), ("chr2", 900)], ["tumor", "normal"]
KINDS = [("ACGTACGTA", "9M", "9"), ("ACGTNC", "3M2N3M", "6"), ("ACGTA", "1S1M1I2M", "3"), ("ACGT", "2M3D2M", "2^GGG2")]


def some_reads(spark, n, long=0):
    rows = []
    for i in range(n):
        seq, cigar, md = KINDS[i % 4]
        if long and i % 7 == 3:
            seq, cigar, md = "ACGT" * long, f"{4 * long}M", str(4 * long)
        row = list(make_read(seq, cigar, md, start=(i * 31) % 800, contig=f"chr{1 + i % 2}", sample=SAMPLES[i % 2],
                             quals=[(i + j) % 41 for j in range(len(seq))], mapq=i % 60, fwd=i % 3 > 0))
        row[10], row[11] = i % 5 == 1, i % 11 == 2
        rows.append(tuple(row))
    return reads_df(spark, *rows)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(sam.READ_COLUMNS).collect()), key=str)


def plain_places(path):
    """All records of a file by a plain walk over its whole data: how many, and where in the data each starts."""
    data = gzip.decompress(open(path, "rb").read())
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    (n,) = struct.unpack_from("<i", data, at)
    at += 4
    for _ in range(n):
        at += 8 + struct.unpack_from("<i", data, at)[0]
    places = []
    while at < len(data):
        places.append(at)
        at += 4 + struct.unpack_from("<i", data, at)[0]
    assert at == len(data)
    return places


@pytest.mark.parametrize("block, split, long", [(0xFF00, 1 << 20, 0), (700, 900, 0), (97, 400, 0), (5000, 3000, 800)])
def test_round_trip(spark, tmp_path, block, split, long):
    reads = some_reads(spark, 500, long)
    path = str(tmp_path / "reads")
    written = bam.write_reads(reads.repartition(3), path, CONTIGS, SAMPLES, block)
    assert sum(r.reads for r in written.collect()) == 500
    back, contigs = bam.load_reads(spark, path, mapped=False, non_duplicate=False, passed_quality_checks=False, split_bytes=split)
    assert sorted(map(tuple, contigs.collect())) == CONTIGS
    assert rows_of(back) == rows_of(reads)
    kept, _ = bam.load_reads(spark, "file://" + path, token=3, split_bytes=split)
    assert rows_of(kept) == rows_of(sam.select_reads(reads).withColumn("token", F.lit(3)))


def test_starts_are_records(spark, tmp_path):
    path = str(tmp_path / "reads")
    bam.write_reads(some_reads(spark, 2000).coalesce(1), path, CONTIGS, SAMPLES, 500)
    name = path + "/part-000000.bam"
    starts = bam.record_starts(spark, name, 2000).collect()
    assert len(starts) > 8 and len({r.begin for r in starts}) == len(starts)
    places, offsets = set(plain_places(name)), {}
    with open(name, "rb") as f:
        packed, total, at = f.read(), 0, 0
    while at < len(packed):
        size = bam._block_size(packed[at:at + 18])
        offsets[at] = total
        total += struct.unpack_from("<I", packed, at + size - 4)[0]
        at += size
    assert all(offsets[r.block] + r.at in places for r in starts)
    assert bam.raw_records(spark, name, 2000).rdd.getNumPartitions() > 1


def test_false_start_is_noticed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "reads")
    bam.write_reads(some_reads(spark, 200).coalesce(1), path, CONTIGS, SAMPLES, 500)
    right = bam.record_starts(spark, path, 2000)
    monkeypatch.setattr(bam, "record_starts", lambda *a: right.withColumn("at", F.col("at") + F.when(F.col("begin") == 2000, 1).otherwise(0)))
    with pytest.raises(Exception, match="next start"):
        bam.raw_records(spark, path, 2000).collect()


def test_odd_files(spark, tmp_path):
    empty = some_reads(spark, 1).limit(0)
    path = str(tmp_path / "empty")
    bam.write_reads(empty.coalesce(1), path, CONTIGS, SAMPLES)
    assert bam.load_reads(spark, path)[0].count() == 0
    # Unmapped, without sequence, without qualities, of an unknown contig, repeated.
    odd = reads_df(
        spark, ("chr1", 7, None, "*", None, "ACG", "III", 0, "tumor", 0, False, False, True, False),
        ("chr1", 7, 11, "4M", "4", None, None, 9, "tumor", 0, False, False, True, True),
        *[("chr2", 0, 3, "3M", None, "ACG", None, 9, None, 0, False, False, False, True)] * 2,
        ("chrX", 7, 10, "3M", "3", "ACG", "III", 9, "normal", 0, False, False, True, True),
    )
    path = str(tmp_path / "odd")
    bam.write_reads(odd.coalesce(1), path, CONTIGS, SAMPLES)
    back = bam.raw_records(spark, path).collect()
    found = sorted((r.flag, r.contig, r.start, r.cigar, r.seq, r.qual, r.md, r.rg) for r in back if r.seq and r.qual)
    assert found == [(0, "*", 7, "3M", "ACG", "III", "3", "normal"), (4, "chr1", 7, "*", "ACG", "III", None, "tumor")]
    assert [r.md for r in back if r.seq is None] == ["4"] and sum(r.qual is None for r in back) == 3
    with pytest.raises(FileNotFoundError):
        bam.files(str(tmp_path / "nothing"))


def test_texts_are_coded_by_tables():
    """Bases of any case, unknown letters, odd lengths; a CIGAR is parsed once for all reads that share it."""
    from lociforge.sources import bam

    row = dict(contig="c", start=5, end=10, cigar="2S3M", md="3", seq="aC=x.", qual="!I~5#", mapq=9, sample="s", flag=0)
    bam._cigar_codes.cache_clear()
    data = bam._encode(row, {"c": 0}) + bam._encode({**row, "qual": None}, {"c": 0})
    assert bam._cigar_codes.cache_info().misses == 1
    rows, at = bam._decode(data, [("c", 100)], 0)
    assert at == len(data)
    assert [r[4:] for r in rows] == [("2S3M", "AC=NN", "!I~5#", "3", "s"), ("2S3M", "AC=NN", None, "3", "s")]
