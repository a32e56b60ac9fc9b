"""Small builders shared by the tests."""

READ_SCHEMA = (
    "contig string, start bigint, end bigint, cigar string, md string, seq string, qual string, "
    "mapq int, sample string, token int, is_dup boolean, fail_qc boolean, fwd boolean, is_mapped boolean"
)


def make_read(seq, cigar, md, start=1, contig="chr1", quals=None, mapq=30, token=0, sample="s", fwd=True):
    import re

    quals = quals or [31] * len(seq)
    span = sum(int(n) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar) if op in "MDN=X")
    text = "".join(chr(33 + q) for q in quals)
    return (contig, start, start + span, cigar, md, seq, text, mapq, sample, token, False, False, fwd, True)


def reads_df(spark, *reads):
    return spark.createDataFrame(list(reads), READ_SCHEMA)


def at(rows, locus):
    return [r for r in rows if r["locus"] == locus]


def intervals_df(spark, rows, value_type=None):
    schema = "contig string, start bigint, end bigint" + (f", value {value_type}" if value_type else "")
    return spark.createDataFrame(rows, schema)


def text_of(df, value="value"):
    from lociforge.operators.intervals import display

    return display(df, 100_000, value).first()[0]
