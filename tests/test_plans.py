import os
import re

import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="benchmark tables not here")


def plan(spark, name):
    df = entry.queries()[name](spark, TABLES)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "threshold_calls", "somatic_calls", "bayes_likelihoods", "interval_overlay", "overlap_join", "overlap_semi",
    "window_reads", "balanced_split", "scan_counters", "reference_at_reads",
])
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(spark, name)
    assert not re.search("NestedLoop|Cartesian|Python|ArrowEval|MapInPandas", text)


def test_pileups_count_before_they_shuffle(spark):
    text = plan(spark, "pileup_allele_counts")
    # One move of the reads, one of the reduced counts; no sort of base rows.
    assert text.count("Exchange hashpartitioning") == 2
    assert "REBALANCE_PARTITIONS_BY_COL" in text and "partial_count" in text
    assert "SortAggregate" not in text and "Sort [" not in text


def test_scans_read_only_what_they_need(spark):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(spark, "depth_sweep")).group(1)
    assert "l_extendedprice" not in schema and "l_returnflag" not in schema


def test_merge_shuffles(spark):
    assert plan(spark, "interval_merge").count("Exchange ") == 4


@pytest.mark.parametrize("name", ["bayes_calls_filtered", "pileup_filter_chain", "region_complexity"])
def test_pileup_filters_shuffle_alleles_only(spark, name):
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(spark, name))
    columns = {re.sub(r"#.*", "", c).strip() for k in keys for c in k.split(",")}
    assert columns and not columns & {"q", "fwd", "mapq", "ref_base"}


@pytest.mark.parametrize("name,reads,others", [
    ("scan_counters", 1, 1), ("paired_pileups", 1, 0), ("balanced_split", 2, 0), ("uniform_split", 0, 1),
])
def test_tables_are_scanned_once(spark, name, reads, others):
    df = entry.queries()[name](spark, TABLES)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = re.findall(r"FileScan parquet .*?/(\w+)\.parquet", final)
    assert scans.count("lineitem") == reads and len(scans) - scans.count("lineitem") == others


def test_single_windows_see_bins_only(spark):
    text = plan(spark, "balanced_split")
    assert "SinglePartition" not in text


def test_overlay_makes_no_row_per_locus(spark):
    text = plan(spark, "interval_overlay")
    assert text.count("Generate explode") <= 4 and "locus" not in text
