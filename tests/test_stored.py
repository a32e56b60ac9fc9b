import uuid

import pytest
from pyspark.sql import functions as F

from lociforge.operators import pileup
from lociforge.sources import stored

from helpers import make_read, reads_df


@pytest.fixture()
def store(spark, tmp_path):
    names = []

    def write(reads, buckets=4, width=8):
        name = f"stored_{uuid.uuid4().hex}"
        names.append(name)
        return stored.write_reads(reads, name, buckets, width, str(tmp_path / name))

    yield write
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def some_reads(spark, token, n=60):
    rows = []
    for i in range(n):
        start = (i * 13 + token) % 90
        kind = [("ACGTACGT", "8M", "8"), ("ACGTAC", "3M20N3M", "6"), ("ACGTA", "2M1I2M", "4"), ("ACGT", "2M3D2M", "2^GGG2")][i % 4]
        rows.append(make_read(*kind, start=start, contig=f"chr{1 + i % 2}", token=token))
    return reads_df(spark, *rows, rows[0])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def aggregates():
    return F.count(F.lit(1)).alias("depth"), F.count_if(F.col("kind") == "deletion").alias("gaps")


def test_reads_come_back_once(spark, store):
    reads = some_reads(spark, 1)
    table = store(reads)
    assert table.count() > reads.count()
    assert rows_of(stored.whole_reads(table).select(reads.columns)) == rows_of(reads)
    assert stored.width_of(table) == 8


@pytest.mark.parametrize("start, end", [(0, 200), (0, 1), (7, 9), (16, 16), (20, 41), (8, 16), (95, 400)])
def test_range(spark, store, start, end):
    reads = some_reads(spark, 1)
    table = store(reads)
    found = stored.reads_in_range(table, "chr1", start, end).select(reads.columns)
    wanted = reads.filter((F.col("contig") == "chr1") & (F.col("start") < end) & (F.col("end") > start) & F.lit(end > start))
    assert rows_of(found) == rows_of(wanted)


def test_rows_are_sorted_in_each_bucket(spark, store):
    table = store(some_reads(spark, 1))
    parts = table.select(F.input_file_name().alias("f"), "contig", "stretch", "start", F.monotonically_increasing_id().alias("i"))
    files = {}
    for r in sorted(parts.collect(), key=lambda r: r["i"]):
        files.setdefault(r["f"], []).append((r["contig"], r["stretch"], r["start"]))
    assert len(files) > 1 and all(rows == sorted(rows) for rows in files.values())
    stretches = [key for rows in files.values() for key in {(c, s) for c, s, _ in rows}]
    assert len(stretches) == len(set(stretches))


def test_pileups_need_no_shuffle(spark, store):
    reads = some_reads(spark, 1)
    found = stored.stored_pileup(store(reads), *aggregates())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows_of(found.select("contig", "locus", "depth", "gaps")) == rows_of(pileup.pileup(pileup.elements(reads), *aggregates()))


def test_pairs_need_no_shuffle(spark, store):
    left, right = some_reads(spark, 1), some_reads(spark, 2, 25)
    # Without the hint of size, small tables would be broadcast.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", stored.ALL_KEYS: "true"}
    before = {name: spark.conf.get(name) for name in settings}
    wanted = pileup.pileup_pair(pileup.elements(left.unionByName(right)), *aggregates())
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        assert rows_of(stored.stored_pair(store(left), store(right), *aggregates()).select(wanted.columns)) == rows_of(wanted)
        stored.join_in_place(spark)
        found = stored.stored_pair(store(left), store(right), *aggregates())
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert rows_of(found.select(wanted.columns)) == rows_of(wanted)
        other = stored.stored_pair(store(left), store(right, buckets=3), *aggregates())
        assert rows_of(other.select(wanted.columns)) == rows_of(wanted)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    with pytest.raises(ValueError):
        stored.stored_pair(store(left), store(right, width=16), *aggregates())


def test_odd_rows(spark, store):
    empty = reads_df(spark, make_read("AC", "2M", "2")).limit(0)
    assert store(empty).count() == 0 and stored.stored_pileup(store(empty), *aggregates()).count() == 0
    odd = reads_df(
        spark, make_read("AC", "2M", "2"), (None,) * 14, ("chr1", 5, None, "*", None, None, None, 0, None, 0, None, None, None, False)
    ).withColumn("stretch", F.lit("x")).withColumn("first", F.lit(7))
    table = store(odd)
    assert rows_of(stored.whole_reads(table).select(odd.columns[:14])) == rows_of(odd.select(odd.columns[:14]))


def test_large_buckets_are_written_by_several_tasks(spark, store):
    """A stretch with more bytes than one task should sort is split; the rows stay those of its bucket."""
    settings = {
        "spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {name: spark.conf.get(name) for name in settings}
    n = 4_000
    reads = spark.range(0, n, 1, 8).selectExpr("id", "'chr1' AS contig", "id % 6 AS start", "id % 6 + 1 AS end")
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        table = store(reads, buckets=2, width=8)
        assert table.select(F.input_file_name()).distinct().count() > 2
        assert table.filter("first").count() == n and table.select("id").distinct().count() == n
        found = table.groupBy("contig", "stretch").count()
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in found.collect()] == [("chr1", 0, n)]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
