import random

import pytest
from pyspark.sql import functions as F

from helpers import intervals_df, text_of
from lociforge.operators import intervals as iv
from lociforge.operators import overlap, split
from lociforge.operators.nested import blocks
from lociforge.operators.prefix import running_total
from lociforge.sources import loci


def spec(spark, text):
    return loci.parse(spark, text)


def test_parse_count_and_contigs(spark):
    rng = random.Random(21)
    pieces = [(rng.choice("xyz"), s, s + rng.choice([0, 0, 3, 12])) for s in (rng.randint(0, 200) for _ in range(40))]
    s = spec(spark, ",".join(f"{c}:{a}-{b}" for c, a, b in pieces)).cache()
    covered = {(c, p) for c, a, b in pieces for p in range(a, b)}
    ranges = sum((c, p - 1) not in covered for c, p in covered)
    stats = iv.statistics(s).first()
    assert (stats["loci"], stats["ranges"], stats["contigs"]) == (len(covered), ranges, len({c for c, _ in covered}))
    assert [r[0] for r in iv.contigs(s).collect()] == sorted({c for c, _ in covered})
    on_y = iv.on_contig(s, "y").cache()
    for _ in range(25):
        a = rng.randint(0, 215)
        b = a + rng.randint(0, 9)
        assert (overlap.intersects(on_y, a, b).count() > 0) is any(("y", p) in covered for p in range(a, b)), (a, b)


def test_empty_sets_are_equal(spark):
    assert spec(spark, "").isEmpty()
    assert iv.same_loci(spec(spark, "p:7-7"), spec(spark, "q:0-0,q:9-9"))


def test_spaces_and_bad_text(spark):
    assert text_of(spec(spark, " chr1 : 5 - 9 ,, chr1:9-12"), None) == "chr1:5-12"
    for bad in ("chr1:9", "chr1:a-b", "chr1:9-5"):
        with pytest.raises(Exception, match="bad locus range"):
            spec(spark, bad).collect()


def test_contained_range_does_not_shrink_merge(spark):
    rows = intervals_df(spark, [("c", 0, 100), ("c", 10, 20), ("c", 100, 101), ("c", 103, 104)])
    assert text_of(iv.merge(rows), None) == "c:0-101,c:103-104"


@pytest.mark.parametrize("width", [1, 7, 64, 65_536])
def test_merge_equals_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("ab"), s, s + rng.randint(0, 25)) for s in (rng.randint(0, 600) for _ in range(90))]
    covered = {(c, p) for c, s, e in rows for p in range(s, e)}
    merged = iv.merge_with_previous(intervals_df(spark, rows), width=width).collect()
    assert {(r["contig"], p) for r in merged for p in range(r["start"], r["end"])} == covered
    by_contig = {}
    for r in sorted(merged, key=lambda r: (r["contig"], r["start"])):
        previous = by_contig.get(r["contig"])
        assert r["prev_end"] == previous
        assert previous is None or previous < r["start"]
        by_contig[r["contig"]] = r["end"]


@pytest.mark.parametrize("bin_width", [4, 256])
def test_overlay_equals_brute_force(spark, bin_width):
    rng = random.Random(bin_width)
    rows = [("c", s, s + rng.choice([1, 2, 9, 40, 700]), rng.choice("ABC")) for s in (rng.randint(0, 300) for _ in range(60))]
    rows += rows[:3] + [("c", 50, 50, "A")]
    want = {}
    for _, s, e, v in sorted(rows, key=lambda r: (r[1], r[3])):
        for p in range(s, e):
            want[p] = v
    got = iv.overlay(intervals_df(spark, rows, "string"), bin_width=bin_width).collect()
    assert {p: r["value"] for r in got for p in range(r["start"], r["end"])} == want
    assert sum(r["end"] - r["start"] for r in got) == len(want)


def painted(*layers):
    """Each locus of the layers' ranges with its value: later-starting ranges win, then later layers."""
    rows = [(s, n, v, c, e) for n, layer in enumerate(layers) for c, s, e, v in layer]
    out = {}
    for s, _, v, c, e in sorted(rows):
        out.update({(c, p): v for p in range(s, e)})
    return out


def loci_of(df):
    return {(r["contig"], p): r["value"] for r in df.collect() for p in range(r["start"], r["end"])}


def test_union_maps_put_and_invert(spark):
    a = [("p", 10, 35, "u"), ("q", 4, 19, "u"), ("r", 0, 6, "w")]
    b = [("q", 2, 8, "v"), ("p", 20, 28, "v"), ("p", 28, 50, "v")]
    left, right = intervals_df(spark, a, "string"), intervals_df(spark, b, "string")
    assert loci_of(iv.union_maps(left, right)) == painted(a, b)
    on_p = [[x for x in layer if x[0] == "p"] for layer in (a, b)]
    assert loci_of(iv.union_on_contig(left, right, "p")) == painted(*on_p)
    top = [("q", 15, 40, "z")]
    assert loci_of(iv.put(left, spec(spark, "q:15-40"), "z")) == painted(a, top)
    inverse = iv.invert(left).orderBy("value", "contig").collect()
    assert [tuple(r) for r in inverse] == [("u", "p", 10, 35), ("u", "q", 4, 19), ("w", "r", 0, 6)]
    covered = {(c, p) for c, s, e, _ in a + b for p in range(s, e)}
    merged = iv.union(left, right).collect()
    assert {(r["contig"], p) for r in merged for p in range(r["start"], r["end"])} == covered


def test_previous_end_of_disjoint_rows(spark):
    rng = random.Random(6)
    rows, p = [], 0
    while p < 400:
        size = rng.randint(1, 25)
        if rng.random() < 0.6:
            rows.append(("c", p, p + size, rng.choice("AB")))
        p += size
    for width in (8, 64, 65_536):
        got = iv.with_previous(intervals_df(spark, rows, "string"), ("contig", "value"), width).collect()
        assert len(got) == len(rows)
        for r in got:
            before = [e for _, s, e, v in rows if v == r["value"] and s < r["start"]]
            assert r["prev_end"] == max(before, default=None)


def test_values_in_range(spark):
    rows = [("c", 3, 20, "A"), ("c", 20, 31, "B"), ("c", 40, 44, "A")]
    m = intervals_df(spark, rows, "string")
    queries = [("c", a, a + n) for a in range(0, 50, 3) for n in (1, 4, 25)] + [("d", 0, 50)]
    want = {q: {v for c, s, e, v in rows if c == q[0] and s < q[2] and e > q[1]} for q in queries}
    for disjoint in (False, True):
        found = overlap.values_in_ranges(intervals_df(spark, queries), m, disjoint=disjoint).collect()
        assert {q: {r["value"] for r in found if tuple(r)[:3] == q} for q in queries} == want
        assert len(found) == sum(map(len, want.values()))
    met = {tuple(r)[:3]: r["copies"] for r in overlap.values_met(intervals_df(spark, queries), m, disjoint=True).collect()}
    assert met == {q: len(v) for q, v in want.items()}
    points = spark.createDataFrame([("c", p) for p in range(50)], "contig string, locus bigint")
    assert {(r["contig"], r["locus"]): r["value"] for r in overlap.lookup(points, m).collect()} == painted(rows)


def test_overlap_joins_equal_nested_loop(spark):
    rng = random.Random(5)
    reads = [("c", s, s + rng.randint(1, 90)) for s in (rng.randint(0, 900) for _ in range(120))]
    pieces, p = [], 0
    while p < 950:
        size = rng.randint(1, 30)
        if rng.random() < 0.6:
            pieces.append(("c", p, p + size, rng.choice("AB")))
        p += size
    m = iv.overlay(intervals_df(spark, pieces, "string"))
    left = intervals_df(spark, reads)
    for half in (0, 4):
        for width in (16, 256):
            want = sorted(
                (s, e, v)
                for _, s, e in reads
                for v in {x[3] for x in pieces if x[1] < e + half and x[2] > max(s - half, 0)}
            )
            got = overlap.overlapping_values(left, m, half_window=half, bin_width=width).collect()
            assert sorted((r["start"], r["end"], r["value"]) for r in got) == want
    semi = overlap.overlapping(left, m).collect()
    assert sorted((r["start"], r["end"]) for r in semi) == sorted(
        (s, e) for _, s, e in reads if any(x[1] < e and x[2] > s for x in pieces))


# These pin the rounding of bucket edges.
@pytest.mark.parametrize("text,buckets,want", [
    ("chrM:0-16571", 4, "chrM:0-4143=0,chrM:4143-8286=1,chrM:8286-12428=2,chrM:12428-16571=3"),
    ("chrM:0-10", 3, "chrM:0-3=0,chrM:3-7=1,chrM:7-10=2"),
])
def test_even_split_rounding(spark, text, buckets, want):
    assert text_of(split.split_evenly(spec(spark, text), buckets)) == want


@pytest.mark.parametrize("text,buckets", [("a:5-8", 9), ("a:4-4", 3), ("b:2-40,a:7-12,a:30-31,c:0-3", 4), ("a:0-60", 60)])
def test_even_split_equals_brute_force(spark, text, buckets):
    parts = [(p.split(":")[0], *map(int, p.split(":")[1].split("-"))) for p in text.split(",")]
    every = sorted((c, p) for c, a, b in parts for p in range(a, b))
    size = max(1.0, len(every) / buckets)
    want = {x: max(k for k in range(buckets) if int(k * size + 0.5) <= i) for i, x in enumerate(every)}
    got = split.split_evenly(spec(spark, text), buckets).collect()
    assert {(r["contig"], p): r["value"] for r in got for p in range(r["start"], r["end"])} == want


def test_split_into_as_many_buckets_as_cores(spark):
    got = split.split_loci(spec(spark, "a:0-800"), [], accuracy=0).collect()
    assert len(got) == spark.sparkContext.defaultParallelism


# This pins where the edge falls inside a micro bucket.
def test_depth_split_edge(spark):
    reads = intervals_df(spark, [("chr1", i, i + 1) for i in (5, 6, 7, 8)])
    got = split.split_by_depth(spec(spark, "chr1:0-100"), 2, reads, accuracy=100)
    assert text_of(got) == "chr1:0-7=0,chr1:7-100=1"


def test_depth_split_covers_loci_and_balances(spark):
    rng = random.Random(11)
    reads = intervals_df(spark, [("c", s, s + 5) for s in (int(rng.betavariate(2, 9) * 900) for _ in range(400))])
    whole = spec(spark, "c:0-950,d:0-50")
    buckets = split.split_by_depth(whole, 5, reads, accuracy=250).cache()
    assert iv.same_loci(buckets, whole)
    assert buckets.agg(F.sum(F.col("end") - F.col("start"))).first()[0] == 1000
    counts = {r["value"]: r["reads"] for r in split.reads_per_bucket([reads], buckets).collect()}
    assert set(counts) == {0, 1, 2, 3, 4}
    assert max(counts.values()) < 1.35 * sum(counts.values()) / 5


def test_depth_split_without_micro_buckets_is_even(spark):
    whole = spec(spark, "c:0-100")
    reads = intervals_df(spark, [("c", 1, 2)])
    assert text_of(split.split_loci(whole, [reads], 4, accuracy=0)) == "c:0-25=0,c:25-50=1,c:50-75=2,c:75-100=3"


def test_hot_micro_bucket_is_cut_several_times(spark):
    reads = intervals_df(spark, [("c", 40, 41)] * 90 + [("c", 0, 1)] * 10)
    got = split.split_by_depth(spec(spark, "c:0-100"), 4, reads, accuracy=1)
    pieces = sorted((r["start"], r["end"], r["value"]) for r in got.collect())
    assert pieces[0][0] == 0 and pieces[-1][1] == 100
    assert all(a[1] == b[0] and a[2] < b[2] for a, b in zip(pieces, pieces[1:]))
    assert len(pieces) == 4


def test_take(spark):
    s = spec(spark, "chr1:10-20,chr1:30-40,chr2:0-5")
    for n, first, rest in [
        (0, "", "chr1:10-20,chr1:30-40,chr2:0-5"),
        (12, "chr1:10-20,chr1:30-32", "chr1:32-40,chr2:0-5"),
        (20, "chr1:10-20,chr1:30-40", "chr2:0-5"),
        (25, "chr1:10-20,chr1:30-40,chr2:0-5", ""),
    ]:
        a, b = iv.take(s, n)
        assert (text_of(a, None), text_of(b, None)) == (first, rest)


def test_display_is_cut(spark):
    s = intervals_df(spark, [("chr1", i * 10, i * 10 + 5) for i in range(50)])
    assert iv.display(s, 30).first()[0] == "chr1:0-5,chr1:10-15,chr1:20-25, [...]"


def test_loci_and_selection(spark):
    assert [r["locus"] for r in iv.loci(spec(spark, "c:3-6")).orderBy("locus").collect()] == [3, 4, 5]
    contigs = spark.createDataFrame([("x", 7)], "contig string, length bigint")
    assert text_of(loci.select_loci(spark, "all", contigs), None) == "x:0-7"
    assert text_of(loci.select_loci(spark, "x:1-2", contigs), None) == "x:1-2"


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_running_total(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("ab"), rng.randint(0, 200), rng.randint(-3, 5)) for _ in range(150)]
    df = spark.createDataFrame(rows, "k string, p bigint, v bigint")
    got = running_total(df, ["k"], "p", "v", "t", width=width).collect()
    for r in got:
        assert r["t"] == sum(v for k, p, v in rows if k == r["k"] and p <= r["p"])
    assert len(got) == len({(k, p) for k, p, _ in rows})
    for r in running_total(df, ["k"], "p", "v", "t", width=width, total="all").collect():
        assert r["t"] == sum(v for k, p, v in rows if (k, p) <= (r["k"], r["p"]))
        assert r["all"] == sum(v for _, _, v in rows)


@pytest.mark.parametrize("bin_width", [1, 4])
def test_wide_overlay_equals_brute_force(spark, bin_width):
    """Ranges over several levels of nested blocks, short ones inside and beside them."""
    rng = random.Random(bin_width)
    rows = []
    for _ in range(60):
        s = rng.randint(0, 30_000)
        rows.append((rng.choice("ab"), s, s + rng.choice([0, 1, 3, 40, 700, 5_000, 20_000]), rng.choice("xyz")))
    data = spark.createDataFrame(rows, "contig string, start long, end long, value string")
    want = {}
    for c, s, e, v in sorted(rows, key=lambda r: (r[1], r[3])):
        want.update({(c, p): v for p in range(s, e)})
    got = {}
    for r in iv.overlay(data, bin_width=bin_width, wide=True).collect():
        for p in range(r["start"], r["end"]):
            assert (r["contig"], p) not in got
            got[r["contig"], p] = r["value"]
    assert got == want


def test_wide_merge_and_lookup_equal_narrow(spark):
    rng = random.Random(8)
    rows = [("a", s, s + rng.choice([1, 50, 70_000, 300_000, 2_000_000])) for s in (rng.randint(0, 5_000_000) for _ in range(40))]
    rows += [("a", 6_000_000 + 500 * k, 6_000_000 + 500 * k + 100) for k in range(300)]
    data = intervals_df(spark, rows)
    fused = iv.merge(data, wide=True)
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, iv.merge(data).collect()))
    points = spark.createDataFrame([("a", rng.randint(0, 7_000_000)) for _ in range(500)], "contig string, locus long")
    ranges = [(r["start"], r["end"]) for r in fused.collect()]
    inside = sorted(p.locus for p in points.collect() if any(s <= p.locus < e for s, e in ranges))
    assert sorted(r["locus"] for r in overlap.lookup(points, fused).collect()) == inside
    spans = points.selectExpr("contig", "locus start", "locus + 90000 end")
    met = sorted(r["start"] for r in overlap.overlapping(spans, fused, disjoint=True).collect())
    assert met == sorted(p.locus for p in points.collect() if any(s < p.locus + 90_000 and e > p.locus for s, e in ranges))


def test_rows_of_a_long_range_are_bounded(spark):
    """A range costs some hundred rows, whatever its length, in overlays and on the right side of joins."""
    rows = spark.createDataFrame([(1, 10**k) for k in range(2, 10)] + [(977, 3 * 10**9)], "start long, end long")
    sized = rows.select(F.size(blocks(F.ceil(F.col("start") / 256), F.floor(F.col("end") / 256))).alias("n")).collect()
    assert max(r["n"] for r in sized) <= 2 * 31 * 4 + 3 * 10**9 // 2**28 + 1
    filled = rows.select(F.size(overlap._bins_filled("start", "end", 256)).alias("n"), "start", "end").collect()
    assert all(r["n"] <= (r["end"] - r["start"]) // 65_536 + 2 * 257 for r in filled)


@pytest.mark.parametrize("kind", ["string", "double"])
def test_wide_overlay_sweeps_stretches(spark, kind):
    """Nested, equal and touching ranges, copies, null values and a settled order give what the narrow overlay gives."""
    rng = random.Random(kind)
    values = {"string": ["x", "y", None], "double": [1.0, float("nan"), None]}[kind]
    edge = iv.JOIN_BIN * iv.STRETCH
    rows = [("n", k, 4 * edge - k, k % 5, values[k % 3]) for k in range(0, 2 * edge, 9973)]  # one inside the other
    rows += [("t", k * edge // 2, (k + 1) * edge // 2, 0, values[k // 4 % 3]) for k in range(12)]  # edge to edge
    rows += [("e", edge + 7, edge + 7 + rng.choice([1, 60, edge, 3 * edge]), rng.randint(0, 3), rng.choice(values)) for _ in range(40)]
    for _ in range(120):
        s = rng.randint(0, 5 * edge)
        rows.append((rng.choice("ab"), s, s + rng.choice([0, 1, 30, 900, edge, 100_000, 6 * edge]), rng.randint(0, 3), rng.choice(values)))
    rows += rows[-30:]
    data = spark.createDataFrame(rows, f"contig string, start long, end long, o long, value {kind}")
    for order in (None, "o"):
        got = iv.overlay(data, order=order, wide=True)
        assert got.columns == iv.overlay(data, order=order).columns
        flat = lambda df: sorted((r["contig"], r["start"], r["end"], str(r["value"])) for r in df.collect())
        assert flat(got) == flat(iv.overlay(data, order=order))


def test_rows_of_a_wide_overlay_are_few(spark):
    """A range of thousands of loci moves at most three rows through the shuffles, of which there are few."""
    rows = spark.range(3_000).selectExpr("'a' AS contig", "id * 9973 AS start", "id * 10007 + 39000 AS end", "id % 3 AS value")
    got = iv.overlay(rows, wide=True)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan()
    text = plan.toString().split("== Initial Plan ==")[0]
    assert text.count("Exchange hashpartitioning") - text.count("ReusedExchange") <= 7

    def moved(node):
        kids = node.children()
        below = [moved(kids.apply(i)) for i in range(kids.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            return moved(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return moved(node.plan())
        own = node.metrics().get("shuffleRecordsWritten")
        return max([*below, own.get().value() if own.isDefined() and node.nodeName() == "Exchange" else 0])

    assert 3_000 <= moved(plan) <= 9_000 + 3_000 * 10_007 // (iv.JOIN_BIN * iv.STRETCH)
