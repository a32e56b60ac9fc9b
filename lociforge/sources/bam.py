"""Binary reads in compressed blocks (BAM), read and written by many tasks.

A file is cut into byte ranges. A first small job finds where records start in each range: the first block
after the range's begin, and in its data the first place from which all records up to the end of a probe make sense.
The second job reads from each start to the next one and decodes records in batches. It must
end exactly at the next start, so a place that only looked like a record stops the job with ``ValueError``; no record
is lost or read twice unnoticed. Tasks depend on the file and their range alone and can run again anywhere.

Paths are local ones or URIs that ``pyarrow.fs`` knows; executors must see them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociforge.functions.bases import to_bases
from lociforge.sources import sam

#: Bytes of a file for one task, bytes of decoded data in one batch, and what a probe looks at.
SPLIT_BYTES, BATCH_BYTES, PROBE_BYTES, PROBE_RECORDS = 64 << 20, 4 << 20, 128 << 10, 4

# Fixed values of the format.
MAGIC, BLOCK_MAGIC, BLOCK_BYTES = b"BAM\x01", b"\x1f\x8b\x08\x04", 0xFF00
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BASE_CODES, CIGAR_CODES = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
FIXED = struct.Struct("<iiBBHHHiiii")
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}

_HEX_TO_BASE = str.maketrans("0123456789abcdef", BASE_CODES)
_FROM_PHRED = bytes(max(i - 33, 0) for i in range(256))
_TO_PHRED = bytes(min(i + 33, 126) for i in range(256))
_FIELDS = pa.schema([
    ("flag", pa.int32()), ("contig", pa.string()), ("start", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()),
    ("seq", pa.string()), ("qual", pa.string()), ("md", pa.string()), ("rg", pa.string()),
])
_FIELDS_DDL = "flag int, contig string, start bigint, mapq int, cigar string, seq string, qual string, md string, rg string"
_STARTS_DDL = "path string, begin bigint, block bigint, at bigint"


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        system, path = pafs.FileSystem.from_uri(path)
    else:
        system = pafs.LocalFileSystem()
    return system, path


# --- blocks ----------------------------------------------------------------------------------


def _block_size(head: bytes) -> int | None:
    """Bytes of the block that starts with ``head``, None if no block does."""
    if len(head) < 18 or head[:4] != BLOCK_MAGIC:
        return None
    extra, at = head[12:12 + int.from_bytes(head[10:12], "little")], 0
    while at + 4 <= len(extra):
        length = int.from_bytes(extra[at + 2:at + 4], "little")
        if extra[at:at + 2] == b"BC" and length == 2:
            return int.from_bytes(extra[at + 4:at + 6], "little") + 1
        at += 4 + length
    return None


def _blocks(source, offset: int, size: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, data)`` of the blocks from ``offset``, where one starts, to the end of the file."""
    held, at = b"", offset
    while at < size:
        if len(held) < 1 << 16:
            held += source.read_at(min(1 << 20, size - at - len(held)), at + len(held))
        length = _block_size(held[:1 << 16])
        if length is None or length > len(held):
            raise ValueError(f"no whole block at byte {at}")
        data = zlib.decompress(held[:length], 31)
        yield at, data
        held, at = held[length:], at + length


def _first_block(source, begin: int, size: int) -> int | None:
    """The first block that starts at ``begin`` or later: one that unpacks and that a block or the end follows."""
    if begin == 0:
        return 0
    near = source.read_at(min(3 << 16, size - begin), begin)
    at = near.find(BLOCK_MAGIC)
    while 0 <= at < 1 << 16:
        length = _block_size(near[at:at + (1 << 16)])
        if length and at + length <= len(near):
            follows = near[at + length:at + length + 4]
            try:
                zlib.decompress(near[at:at + length], 31)
                if follows == BLOCK_MAGIC or begin + at + length == size:
                    return begin + at
            except zlib.error:
                pass
        at = near.find(BLOCK_MAGIC, at + 1)
    return None


class _Header:
    """Text, contigs and the place behind the header of a file."""

    def __init__(self, source, size: int):
        data, blocks = b"", []
        walk = _blocks(source, 0, size)

        def need(n: int) -> None:
            nonlocal data
            while len(data) < n:
                offset, more = next(walk, (None, None))
                if offset is None:
                    raise ValueError("the file ends inside its header")
                blocks.append((offset, len(data)))
                data += more

        need(8)
        if data[:4] != MAGIC:
            raise ValueError("not a file of binary reads")
        text_end = 8 + int.from_bytes(data[4:8], "little")
        need(text_end + 4)
        self.text = data[8:text_end].rstrip(b"\0").decode()
        self.contigs, at = [], text_end + 4
        for _ in range(int.from_bytes(data[text_end:at], "little")):
            need(at + 4)
            end = at + 4 + int.from_bytes(data[at:at + 4], "little")
            need(end + 4)
            self.contigs.append((data[at + 4:end - 1].decode(), int.from_bytes(data[end:end + 4], "little")))
            at = end + 4
        if at < len(data):
            offset, begins = [b for b in blocks if b[1] <= at][-1]
            self.records_at = (offset, at - begins)
        else:
            # The header fills its blocks: records start with the first block behind it that holds data.
            self.records_at = next(((offset, 0) for offset, more in walk if more), None)


# --- records ---------------------------------------------------------------------------------


def _record_end(data: bytes, at: int, contigs: list[tuple[str, int]]) -> int | None:
    """End of the record at ``at`` if it makes sense as far as ``data`` shows it, else None."""
    if len(data) - at < 36:
        return len(data) + 1
    size = int.from_bytes(data[at:at + 4], "little")
    contig, start, name, _, _, ops, _, bases, mate, mate_start, _ = FIXED.unpack_from(data, at + 4)
    known = all(
        -1 <= c < len(contigs) and -1 <= p <= (contigs[c][1] if c >= 0 else 1 << 31)
        for c, p in ((contig, start), (mate, mate_start))
    )
    if not known or name < 1 or bases < 0 or size < 32 + name + 4 * ops + (bases + 1) // 2 + bases:
        return None
    text = data[at + 36:at + 36 + name]
    if len(text) == name and (text[-1] != 0 or not all(33 <= c <= 126 for c in text[:-1])):
        return None
    if any(c & 15 >= len(CIGAR_CODES) for c in data[at + 36 + name:at + 36 + name + 4 * ops:4]):
        return None
    return at + 4 + size


def _sensible(data: bytes, at: int, contigs, whole: bool) -> tuple[bool, int]:
    """Whether records make sense from ``at`` to the end of ``data``, and how many are seen whole.

    ``whole`` says that the file ends with the data, so the last record must, too.
    """
    seen = 0
    while at < len(data):
        at = _record_end(data, at, contigs)
        if at is None:
            return False, seen
        seen += at <= len(data)
    return at == len(data) or not whole, seen


def _first_record(source, block: int, end: int, size: int, header: _Header) -> tuple[int, int] | None:
    """Block and offset in it of the first record that starts in the blocks from ``block`` on and before byte ``end``."""
    data, places, own, want = b"", [], 0, PROBE_BYTES
    walk, whole = _blocks(source, block, size), False
    while True:
        while len(data) < want and not whole:
            offset, more = next(walk, (None, b""))
            whole = offset is None
            if more:
                places.append((offset, len(data)))
                data += more
                own = len(data) if offset < end else own
        for at in range(own):
            fits, seen = _sensible(data, at, header.contigs, whole)
            if fits and (seen >= PROBE_RECORDS or whole):
                offset, begins = [p for p in places if p[1] <= at][-1]
                return offset, at - begins
            if fits:
                break  # Too few records to be sure: look at more data.
        else:
            return None
        want *= 4


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, path = _open(row["path"])
            with system.open_input_file(path) as source:
                size = source.size()
                header, found = _Header(source, size), None
                if row["begin"] == 0:
                    found = header.records_at
                else:
                    block = _first_block(source, row["begin"], size)
                    # Blocks of the header are no place for records.
                    if block is not None and block < row["end"] and header.records_at and block > header.records_at[0]:
                        found = _first_record(source, block, row["end"], size, header)
            if found:
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "begin": row["begin"], "block": found[0], "at": found[1]}])


def _tags(data: bytes, at: int, end: int) -> dict[str, str]:
    """The text tags ``MD`` and ``RG`` among the tags in ``data[at:end]``."""
    found = {}
    while at + 3 <= end:
        name, kind = data[at:at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(b"\0", at, end)
            if name in (b"MD", b"RG"):
                found[name.decode()] = data[at:stop].decode()
            at = stop + 1
        elif kind == "B":
            at += 5 + TAG_BYTES[chr(data[at])] * int.from_bytes(data[at + 1:at + 5], "little")
        else:
            at += TAG_BYTES[kind]
    return found


def _decode(data: bytes, contigs: list[tuple[str, int]], skip: int) -> tuple[list[tuple], int]:
    """Fields of the whole records in ``data``, and where the rest begins. Records with a flag of ``skip`` are left out."""
    rows, at = [], 0
    while at + 4 <= len(data):
        end = at + 4 + int.from_bytes(data[at:at + 4], "little")
        if end > len(data) or len(data) - at < 36:
            break
        contig, start, name, mapq, _, ops, flag, bases, _, _, _ = FIXED.unpack_from(data, at + 4)
        if _record_end(data, at, contigs) != end:
            raise ValueError("no record where one should be: the file is damaged or doesn't end at the next start")
        if not flag & skip:
            cigar_at = at + 36 + name
            seq_at = cigar_at + 4 * ops
            qual_at = seq_at + (bases + 1) // 2
            tags_at = qual_at + bases
            qual = data[qual_at:tags_at]
            tags = _tags(data, tags_at, end)
            rows.append((
                flag, contigs[contig][0] if contig >= 0 else "*", start, mapq,
                _cigar_text(data[cigar_at:seq_at]),
                data[seq_at:qual_at].hex().translate(_HEX_TO_BASE)[:bases] if bases else None,
                qual.translate(_TO_PHRED).decode() if bases and qual.strip(b"\xff") else None,
                tags.get("MD") or None, tags.get("RG") or None,
            ))
        at = end
    return rows, at


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], schema=_FIELDS)


def _records(skip: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _open(row["path"])
                with system.open_input_file(path) as source:
                    size = source.size()
                    contigs = _Header(source, size).contigs
                    data, drop = bytearray(), row["at"]
                    for offset, more in _blocks(source, row["block"], size):
                        if row["next_block"] is not None and offset >= row["next_block"]:
                            data += more[drop:row["next_at"]] if offset == row["next_block"] else b""
                            break
                        data += more[drop:]
                        drop = 0
                        if len(data) >= BATCH_BYTES:
                            rows, done = _decode(bytes(data), contigs, skip)
                            del data[:done]
                            yield _batch(rows)
                    rows, done = _decode(bytes(data), contigs, skip)
                    if done != len(data):
                        raise ValueError(f"records from block {row['block']} of {row['path']} don't end at the next start")
                    yield _batch(rows)

    return read


# --- reading ---------------------------------------------------------------------------------


def files(path: str | list[str], suffix: str = ".bam") -> list[tuple[str, int]]:
    """Files with their bytes: the given ones, or those of a folder whose names end in ``suffix``."""
    found = []
    for one in [path] if isinstance(path, str) else path:
        system, inner = _open(one)
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.Directory:
            inside = system.get_file_info(pafs.FileSelector(inner))
            names = sorted((i.base_name, i.size) for i in inside if i.base_name.endswith(suffix))
            found += [(f"{one.rstrip('/')}/{name}", size) for name, size in names]
        elif info.type == pafs.FileType.File:
            found.append((one, info.size))
        else:
            raise FileNotFoundError(one)
    if not found:
        raise FileNotFoundError(f"no {suffix} file in {path}")
    return found


def header_text(path: str) -> str:
    system, inner = _open(path)
    with system.open_input_file(inner) as source:
        return _Header(source, source.size()).text


def contig_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Contig names and lengths of a file."""
    system, inner = _open(path)
    with system.open_input_file(inner) as source:
        return spark.createDataFrame(_Header(source, source.size()).contigs, "contig string, length bigint")


def record_starts(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``path, begin, block, at`` for each byte range in which a record starts: its block and its offset in the data."""
    cuts = spark.createDataFrame(files(path), "path string, size bigint").selectExpr(
        "path", f"explode(sequence(0L, greatest(size - 1, 0L), {split_bytes}L)) AS begin"
    ).withColumn("end", F.col("begin") + split_bytes)
    return _dealt(cuts).mapInArrow(_starts, _STARTS_DDL)


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges over as many tasks as there are ranges, up to some for each core: a number keeps adaptive execution
    from joining these few bytes in one task."""
    spark = ranges.sparkSession
    return ranges.repartition(8 * spark.sparkContext.defaultParallelism, *ranges.columns[:2])


def raw_records(
    spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES, skip_flags: int = 0
) -> DataFrame:
    """``flag, contig, start, mapq, cigar, seq, qual, md, rg`` of every record, 0-based starts.

    ``skip_flags`` is a mask: records with any of its bits are passed over without being decoded.
    """
    by_file = Window.partitionBy("path").orderBy("block", "at")
    ranges = record_starts(spark, path, split_bytes).select(
        "path", "block", "at", F.lead("block").over(by_file).alias("next_block"), F.lead("at").over(by_file).alias("next_at")
    )
    return _dealt(ranges).mapInArrow(_records(skip_flags), _FIELDS_DDL)


def load_reads(
    spark: SparkSession, path: str | list[str], token: int = 0, mapped: bool = True, non_duplicate: bool = True,
    passed_quality_checks: bool = True, split_bytes: int = SPLIT_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Reads and contig dictionary, as :func:`lociforge.sources.sam.load_reads` gives them for text.

    Read groups and the dictionary are those of the first file. Filters on flags are applied before records are decoded.
    """
    first = files(path)[0][0]
    lines = spark.createDataFrame([(line,) for line in header_text(first).splitlines()] or [("",)], "value string")
    skip = sam.FLAG_UNMAPPED * mapped | sam.FLAG_DUPLICATE * non_duplicate | sam.FLAG_FAIL * passed_quality_checks
    raw = raw_records(spark, path, split_bytes, skip).withColumn("seq", to_bases("seq")).withColumn("token", F.lit(token))
    reads = sam.typed_reads(raw, sam.read_groups(lines))
    return sam.select_reads(reads, mapped, non_duplicate, passed_quality_checks), contig_dictionary(spark, first)


# --- writing ---------------------------------------------------------------------------------


def _block(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    head = BLOCK_MAGIC + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(packed) + 25)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data))


def _bin(start: int, end: int) -> int:
    """The smallest bin of the format's six levels that holds ``[start, end)``."""
    for level in range(5, 0, -1):
        shift = 29 - 3 * level
        if start >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


class _BaseToHex(dict):
    """The hexadecimal digit of each base's code, 15 for unknown ones."""

    def __missing__(self, c: int) -> str:
        return "f"


_BASE_TO_HEX = _BaseToHex({ord(c): f"{i:x}" for i, c in enumerate(BASE_CODES)})


@lru_cache(1 << 12)
def _cigar_codes(cigar: str) -> tuple[int, ...]:
    ops, length = [], ""
    for c in cigar if cigar != "*" else "":
        if c.isdigit():
            length += c
        else:
            ops.append(int(length) << 4 | CIGAR_CODES.index(c))
            length = ""
    return tuple(ops)


@lru_cache(1 << 12)
def _cigar_text(codes: bytes) -> str:
    return "".join(f"{c >> 4}{CIGAR_CODES[c & 15]}" for (c,) in struct.iter_unpack("<I", codes)) or "*"


def _encode(row: dict, numbers: dict[str, int]) -> bytes:
    ops = _cigar_codes(row["cigar"] or "*")
    seq, start = row["seq"] or "", -1 if row["start"] is None else row["start"]
    digits = seq.upper().translate(_BASE_TO_HEX)
    packed = bytes.fromhex(digits + "0" * (len(digits) % 2))
    qual = row["qual"] or ""
    if not qual:
        qual = b"\xff" * len(seq)
    elif qual.isascii() and min(qual) >= "!":
        qual = qual.encode().translate(_FROM_PHRED)
    else:
        qual = bytes(ord(c) - 33 for c in qual)
    if len(qual) != len(seq):
        raise ValueError("sequence and qualities of a read differ in length")
    tags = b"".join(
        name + b"Z" + row[column].encode() + b"\0" for name, column in ((b"RG", "sample"), (b"MD", "md")) if row[column]
    )
    end = max(row["end"] or 0, start + 1)
    body = FIXED.pack(
        numbers.get(row["contig"], -1), start, 2, row["mapq"] or 0, _bin(start, end) if start >= 0 else 4680, len(ops),
        row["flag"], len(seq), -1, -1, 0,
    ) + b"r\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def write_reads(
    reads: DataFrame, path: str, contigs: list[tuple[str, int]], samples: list[str], block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Write reads as a folder of files, one a partition, each whole in itself; returns ``file, reads``.

    ``contigs`` and ``samples`` become the header. Reads of other contigs lose their contig. Records may lie across
    blocks of ``block_bytes`` bytes. A file gets its name when it is complete, so a task that runs again does no harm.
    """
    text = "@HD\tVN:1.6\tSO:unknown\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs)
    text += "".join(f"@RG\tID:{s}\tSM:{s}\n" for s in samples)
    head = MAGIC + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(contigs))
    for name, length in contigs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    numbers = {name: n for n, (name, _) in enumerate(contigs)}
    system, inner = _open(path)
    system.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, n = TaskContext.get(), 0
        name = f"part-{context.partitionId():06d}.bam"
        system, inner = _open(path)
        draft = f"{inner}/_{name}.{context.taskAttemptId()}"
        with system.open_output_stream(draft) as out:
            held = bytearray(head)
            for batch in batches:
                for row in batch.to_pylist():
                    held += _encode(row, numbers)
                    n += 1
                    while len(held) >= block_bytes:
                        out.write(_block(bytes(held[:block_bytes])))
                        del held[:block_bytes]
            if held:
                out.write(_block(bytes(held)))
            out.write(LAST_BLOCK)
        system.move(draft, f"{inner}/{name}")
        yield pa.RecordBatch.from_pylist([{"file": name, "reads": n}])

    rows = reads.select("contig", "start", "end", "cigar", "md", "seq", "qual", "mapq", "sample", _flag().alias("flag"))
    done = rows.mapInArrow(write, "file string, reads bigint").collect()
    if not done:
        # No partition at all: a file without reads, so that the header is there.
        done = [("part-000000.bam", 0)]
        with system.open_output_stream(f"{inner}/{done[0][0]}") as out:
            for at in range(0, len(head), block_bytes):
                out.write(_block(head[at:at + block_bytes]))
            out.write(LAST_BLOCK)
    return reads.sparkSession.createDataFrame(done, "file string, reads bigint")


def _flag() -> Column:
    bits = [("is_mapped", sam.FLAG_UNMAPPED, False), ("fwd", sam.FLAG_REVERSE, False),
            ("fail_qc", sam.FLAG_FAIL, True), ("is_dup", sam.FLAG_DUPLICATE, True)]
    total = F.lit(0)
    for name, mask, when in bits:
        total = total + F.when(F.coalesce(F.col(name), F.lit(not when)) == when, mask).otherwise(0)
    return total
