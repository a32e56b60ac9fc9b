"""FASTA by byte offset: an index of contigs, and fragments that read only the bytes they need.

:func:`index_of` scans the file once by byte ranges and gives a row per contig. With it, :func:`fragments_at` turns the
loci that are asked for into fragments and each fragment into one byte range of the file, so a question about a
few genes does not read the genome. Index tables are small and can be stored as Parquet.

Files are uncompressed, with one kind of line end; paths are local ones or URIs that ``pyarrow.fs`` knows, and executors must see them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociforge.functions.bases import normalize_contig
from lociforge.operators.intervals import merge
from lociforge.sources.bam import _dealt, _open, files
from lociforge.sources.fasta import FRAGMENT_LENGTH, fragment_number

#: Bytes of a file for one task of the index scan.
SPLIT_BYTES = 32 << 20
NEWLINE, RETURN, HEADER = 10, 13, 62

_NUMBERS = ("at", "data_at", "bases", "line_bases", "line_bytes", "least", "most")
_PIECES = pa.schema([("path", pa.string()), ("name", pa.string()), *[(n, pa.int64()) for n in _NUMBERS]])
_PIECE_DDL = "path string, name string, " + ", ".join(f"{n} bigint" for n in _NUMBERS)
_FRAGMENTS = pa.schema([("contig", pa.string()), ("frag", pa.int64()), ("frag_start", pa.int64()), ("bases", pa.binary())])


def _next_line(source, at: int, size: int) -> int:
    """Where the line after the one that holds byte ``at`` starts."""
    while at < size:
        found = source.read_at(min(1 << 16, size - at), at).find(b"\n")
        if found >= 0:
            return at + found + 1
        at += 1 << 16
    return size


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per byte range the headers in it and, for each and for what stands before the first, the measures of its lines."""
    for batch in batches:
        for row in batch.to_pylist():
            system, path = _open(row["path"])
            with system.open_input_file(path) as source:
                size = source.size()
                # The lines that start in the range.
                begin = _next_line(source, row["begin"] - 1, size) if row["begin"] else 0
                end = _next_line(source, row["end"] - 1, size)
                text = source.read_at(end - begin, begin) if begin < min(row["end"], size) else b""
                more = source.read_at(1, end) if end < size else b""
            if text:
                yield pa.RecordBatch.from_pylist(_measured(row["path"], begin, text, more in (b"", b">")), schema=_PIECES)


def _measured(path: str, begin: int, text: bytes, closes: bool) -> list[dict]:
    data = np.frombuffer(text, np.uint8)
    stops = np.flatnonzero(data == NEWLINE)
    starts = np.concatenate(([0], stops + 1))
    if starts[-1] == len(data):
        starts = starts[:-1]
    else:
        stops = np.append(stops, len(data))
    header = data[starts] == HEADER
    returned = (stops > starts) & (data[np.maximum(stops - 1, 0)] == RETURN)
    sizes = stops - starts - returned
    # The last line of a contig may be shorter than the others.
    last = np.append(header[1:], closes)
    heads = np.flatnonzero(header)
    edges = np.unique(np.concatenate(([0], heads, [len(starts)])))
    found = []
    for a, b in zip(edges[:-1], edges[1:]):
        first = a + bool(header[a])
        inner = sizes[first:b][~last[first:b]]
        some = first < b
        words = text[starts[a] + 1:stops[a]].split() if header[a] else None
        found.append({
            "path": path, "at": begin + int(starts[a]), "name": None if words is None else (words or [b""])[0].decode(),
            "data_at": begin + int(starts[first]) if some else None, "bases": int(sizes[first:b].sum()),
            "line_bases": int(sizes[first]) if some else None,
            "line_bytes": int(sizes[first] + 1 + returned[first]) if some else None,
            "least": int(inner.min()) if len(inner) else None, "most": int(sizes[first:b].max()) if some else None,
        })
    return found


def index_of(
    spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES, normalize: bool = True, suffix: str = ".fa"
) -> DataFrame:
    """``path, contig, length, offset, line_bases, line_bytes, uniform``: a row per contig of the files, or of a
    folder's files that end in ``suffix``. A contig lies in one file.

    ``offset`` is the byte of the first base; ``uniform`` says that all lines but the last hold ``line_bases`` bases, as
    reading by offset needs. Lines before the first header are left out; a contig without bases has length 0.
    """
    cuts = spark.createDataFrame(files(path, suffix), "path string, size bigint").selectExpr(
        "path", f"explode(sequence(0L, greatest(size - 1, 0L), {split_bytes}L)) AS begin"
    ).withColumn("end", F.col("begin") + split_bytes)
    so_far = Window.partitionBy("path").orderBy("at")
    pieces = _dealt(cuts).mapInArrow(_pieces, _PIECE_DDL)
    name = normalize_contig("name") if normalize else F.col("name")
    opened = F.last(F.when(F.col("name").isNotNull(), F.struct("at", name.alias("contig"))), ignorenulls=True).over(so_far)
    by_contig = pieces.withColumn("opened", opened).filter(F.col("opened").isNotNull()).groupBy("path", "opened").agg(
        F.sum("bases").alias("length"), F.min("data_at").alias("offset"),
        F.min_by("line_bases", "data_at").alias("line_bases"), F.min_by("line_bytes", "data_at").alias("line_bytes"),
        F.min("least").alias("least"), F.max("most").alias("most"),
    )
    # A contig of a single line has no other ones, one without lines no measures at all.
    uniform = F.coalesce(F.col("least") == F.col("line_bases"), F.lit(True)) & F.coalesce(
        F.col("most") == F.col("line_bases"), F.lit(True)
    )
    return by_contig.select("path", "opened.contig", "length", "offset", "line_bases", "line_bytes", uniform.alias("uniform"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        path, source = None, None
        for row in batch.to_pylist():
            if row["path"] != path:
                if source:
                    source.close()
                path = row["path"]
                system, inner = _open(path)
                source = system.open_input_file(inner)
            text = source.read_at(row["until"] - row["since"], row["since"])
            yield pa.RecordBatch.from_pylist([{
                "contig": row["contig"], "frag": row["frag"], "frag_start": row["frag_start"],
                "bases": text.translate(None, b"\r\n").upper(),
            }], schema=_FRAGMENTS)
        if source:
            source.close()


def byte_ranges(index: DataFrame, loci: DataFrame | None = None, length: int = FRAGMENT_LENGTH) -> DataFrame:
    """``contig, frag, frag_start, path, since, until``: the fragments that hold any of the loci, and their bytes.

    Without loci, all fragments. Loci outside the contigs are left out. A contig with lines of different length
    stops the query: read such a file with :func:`lociforge.sources.fasta.load_reference`.
    """
    checked = index.withColumn(
        "length", F.when(F.col("uniform"), F.col("length")).otherwise(
            F.raise_error(F.concat(F.lit("lines of different length in contig "), "contig")).cast("bigint"))
    ).filter("length > 0").drop("uniform")
    first, last = F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / length)
    if loci is not None:
        wanted = merge(loci.select("contig", "start", "end"))
        checked = checked.join(wanted, "contig").filter("start < length AND end > 0 AND end > start")
        first = F.floor(F.greatest("start", F.lit(0)) / length)
        last = F.floor((F.least("end", "length") - 1) / length)
    frags = checked.withColumn("frag", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    if loci is not None:
        frags = frags.dropDuplicates(["contig", "frag"])
    byte = lambda base: f"offset + ({base}) div line_bases * line_bytes + ({base}) % line_bases"
    end = f"least((frag + 1) * {length}, length) - 1"
    return frags.selectExpr(
        "contig", "frag", f"frag * {length} AS frag_start", "path", f"{byte(f'frag * {length}')} AS since",
        f"{byte(end)} + 1 AS until",
    )


def fragments_at(index: DataFrame, loci: DataFrame | None = None, length: int = FRAGMENT_LENGTH) -> DataFrame:
    """Reference fragments ``contig, frag, frag_start, bases``, as :func:`lociforge.sources.fasta.fragment` gives them,
    of those contig parts only that hold any of the loci."""
    ranges = byte_ranges(index, loci, length)
    found = ranges.repartition(8 * ranges.sparkSession.sparkContext.defaultParallelism, "contig", "frag").sortWithinPartitions(
        "path", "since"
    ).mapInArrow(_read, "contig string, frag bigint, frag_start bigint, bases binary")
    return found.select("contig", fragment_number(length), "frag_start", "bases")
