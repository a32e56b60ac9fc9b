import contextlib
import io
import random
import re

from lociforge.plans import views


def lineitem(spark, folder, n=300):
    rng = random.Random(7)
    rows = [
        (rng.randrange(5_000), rng.randrange(2_000), rng.randrange(100), rng.randint(1, 7), float(rng.randint(1, 50)), rng.choice("RAN"), rng.choice("FO"))
        for _ in range(n)
    ]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([*rows, rows[0]], kind).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def under(read):
    """The reference text under a read from its MD tag, walked in Python."""
    blocks = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDS])", read.cigar)]
    aligned, at = "", 0
    for n, op in blocks:
        aligned += read.seq[at:at + n] if op == "M" else ""
        at += n if op in "MIS" else 0
    out, at = "", 0
    for token in re.findall(r"\d+|\^[A-Z]+|[A-Z]", read.md):
        if token.isdigit():
            out, at = out + aligned[at:at + int(token)], at + int(token)
        elif token[0] == "^":
            out += token[1:]
        else:
            out, at = out + token, at + 1
    return out


def test_md_tags_give_the_reference(spark, tmp_path):
    found = views.all_reads(spark, lineitem(spark, tmp_path)).collect()
    assert len(found) == 301 and sum(not r.md.isdigit() for r in found) > 100
    for r in found:
        c = int(r.contig[3:])
        assert under(r) == "".join(views._base(p, 0, c) for p in range(r.start, r.end)), r


def test_reads_are_made_by_compiled_code(spark, tmp_path):
    """MD text is not folded event by event for every read, and no method is too large to be compiled (8,000 bytes)."""
    reads = views.all_reads(spark, lineitem(spark, tmp_path, 5))
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        reads.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert all(n < 8_000 for n in sizes)
    assert "aggregate(" not in reads._jdf.queryExecution().optimizedPlan().toString()
