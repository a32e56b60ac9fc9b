"""WARC records in ZIP packages, written and range-read.

A package is a ZIP file with stored members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdxj``, a line per record with its place in the archive. Stored members are read in
place: a reader takes the end of the file, the central directory it points to (ZIP64 where sizes or counts
demand it), the index, and then the byte ranges of records. Nothing is unpacked to disk and no file is read whole.

Files are opened by URI with Arrow's file systems, so they can lie on any store these reach. A
writing task names its files anew on every attempt and returns them; only files of finished tasks are listed.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.llm.store import materialise, new_path, tasks_for

ARCHIVE = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
PACKAGE_BYTES = 16 << 20
READ_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
MASK16, MASK32 = 0xFFFF, 0xFFFFFFFF
#: Signatures and layouts of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
LOCAL_ROW = struct.Struct("<4sHHHHHIIIHH")
CENTRAL_ROW = struct.Struct("<4sHHHHHHIIIHHHHHII")
END_ROW = struct.Struct("<4sHHHHIIH")
END64_ROW = struct.Struct("<4sQHHIIQQQQ")
LOCATOR_ROW = struct.Struct("<4sIQI")


# --- ZIP ------------------------------------------------------------------------------------------

def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> Iterator[bytes]:
    """A ZIP file of stored members, part by part; ``zip64`` uses the large layouts whatever the sizes."""
    at, rows = 0, []
    for name, data in members:
        path, crc, big = name.encode(), zlib.crc32(data), zip64 or len(data) >= MASK32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = MASK32 if big else len(data)
        head = LOCAL_ROW.pack(LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(path), len(extra)) + path + extra
        rows.append((path, crc, len(data), at))
        yield head
        yield data
        at += len(head) + len(data)
    begin = at
    for path, crc, size, where in rows:
        big = zip64 or size >= MASK32 or where >= MASK32
        extra = struct.pack("<HHQQQ", 1, 24, size, size, where) if big else b""
        row = CENTRAL_ROW.pack(
            CENTRAL, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, MASK32 if big else size, MASK32 if big else size,
            len(path), len(extra), 0, 0, 0, 0, MASK32 if big else where,
        ) + path + extra
        at += len(row)
        yield row
    if zip64 or at >= MASK32 or len(rows) >= MASK16:
        yield END64_ROW.pack(END64, END64_ROW.size - 12, 45, 45, 0, 0, len(rows), len(rows), at - begin, begin)
        yield LOCATOR_ROW.pack(LOCATOR, 0, at, 1)
        yield END_ROW.pack(END, 0, 0, MASK16, MASK16, MASK32, MASK32, 0)
    else:
        yield END_ROW.pack(END, 0, 0, len(rows), len(rows), at - begin, begin, 0)


class RangeReader:
    """Byte ranges of a file."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, begin: int, size: int) -> bytes:
        return self.file.read_at(size, begin)

    def __enter__(self) -> RangeReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def directory(reader: RangeReader) -> dict[str, tuple[int, int]]:
    """Begin and size of the data of each stored member. Raises ``ValueError`` for files that are no ZIP."""
    tail_size = min(reader.size, END_ROW.size + MASK16)
    tail_at = reader.size - tail_size
    tail = reader.read(tail_at, tail_size)
    at = tail.rfind(END)
    if at < 0 or len(tail) - at < END_ROW.size:
        raise ValueError("no end of a central directory")
    _, _, _, _, count, size, begin, _ = END_ROW.unpack_from(tail, at)
    if MASK16 == count or MASK32 in (size, begin):
        signature, _, where, _ = LOCATOR_ROW.unpack(reader.read(tail_at + at - LOCATOR_ROW.size, LOCATOR_ROW.size))
        if signature == LOCATOR:
            *_, count, size, begin = END64_ROW.unpack(reader.read(where, END64_ROW.size))
    rows, at, members = reader.read(begin, size), 0, {}
    for _ in range(count):
        row = CENTRAL_ROW.unpack_from(rows, at)
        if row[0] != CENTRAL:
            raise ValueError("damaged central directory")
        method, packed, whole, where = row[4], row[8], row[9], row[16]
        names, extras, comments = row[10], row[11], row[12]
        name = rows[at + CENTRAL_ROW.size :][:names].decode()
        extra = rows[at + CENTRAL_ROW.size + names :][:extras]
        at += CENTRAL_ROW.size + names + extras + comments
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:  # large values, those marked above in this order
                values = list(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                whole = values.pop(0) if whole == MASK32 else whole
                packed = values.pop(0) if packed == MASK32 else packed
                where = values.pop(0) if where == MASK32 else where
            extra = extra[4 + length :]
        if method == 0:
            local = LOCAL_ROW.unpack(reader.read(where, LOCAL_ROW.size))
            members[name] = (where + LOCAL_ROW.size + local[9] + local[10], whole)
    return members


# --- records --------------------------------------------------------------------------------------

def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, key: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the response's header but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{_number(page_id)}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{key}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=-._~"))
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def _number(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def _page(uri: str | None) -> int | None:
    value = (uri or "").rpartition(":")[2].rstrip(">")
    return int(value) if value.lstrip("-").isdigit() else None


def headers(lines: bytes) -> dict[str, str]:
    rows = (line.partition(":") for line in lines.decode(errors="replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in rows}


def parse(data: bytes) -> dict:
    """The fields of one unpacked record; of a revisit, length and digest are those of the full payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = headers(head)
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    stated = fields["warc-payload-digest"].partition(":")[2]
    if not revisit and digest(payload) != stated:
        raise ValueError(f"record {fields['warc-record-id']} has another payload than its digest says")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "refers_to": _page(fields["warc-refers-to"]) if revisit else None, "payload_digest": stated,
        "payload_bytes": int(headers(http)["content-length"]) if revisit else len(payload), "payload": None if revisit else payload,
    }


# --- Spark ----------------------------------------------------------------------------------------

def base32_sha1(text: Column) -> Column:
    """Upper-case base32 SHA-1 of a text in UTF-8."""

    @F.arrow_udf("string")
    def values(texts: pa.Array) -> pa.Array:
        return pa.array([digest((t.as_py() or "").encode()) for t in texts], pa.string())

    return values(text)


def decisions(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``page_id, url, html, key, refers_to``: refers_to is the smallest page of the same payload, where that is another.

    Pages are grouped by digest with a map-side minimum. Payloads that stand once have nothing to join, and
    the join on a common digest is one that adaptive execution can split.
    """
    rows = pages.withColumn("key", base32_sha1(F.col("html")))
    first = (
        rows.filter(F.octet_length("html") >= least_bytes).groupBy("key")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    )
    joined = rows.join(first, "key", "left")
    return joined.select(
        "page_id", "url", "html", "key", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to")
    )


def write_packages(
    pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
    zip64: bool = False,
) -> DataFrame:
    """``uri, records, bytes`` of the packages written, one row a package.

    A record a page, its payload the text in UTF-8. Of pages with equal payloads of at least
    ``least_bytes`` bytes that of the smallest id is a response and the others revisit it; shorter
    ones are all responses. Null text is empty, a null url is left out, null ids are larger than all others; pages
    that share payload and smallest id, or all have null ids, are all responses. No pages, no packages.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(text_col), F.lit("")).alias("html"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, index = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            nonlocal archive, index
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            system, path = fs.FileSystem.from_uri(uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            members = [(ARCHIVE, archive.getvalue()), (INDEX, "\n".join([*index, ""]).encode())]
            with system.open_output_stream(path) as out:
                size = sum(out.write(part) for part in zip_stored(members, zip64))
            row = pa.record_batch([pa.array([uri]), pa.array([len(index)]), pa.array([size])], ["uri", "records", "bytes"])
            archive, index = io.BytesIO(), []
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, key, refers = (batch.column(c)[i].as_py() for c in range(5))
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = packer.compress(record(page, url, html.encode(), key, refers)) + packer.flush()
                place = {"offset": archive.tell(), "length": len(data), "digest": f"sha1:{key}"}
                index.append(f"{_number(page)} {DATE[:4]} {json.dumps(place)}")
                archive.write(data)
                if archive.tell() >= PACKAGE_BYTES:
                    yield close()
        if index:
            yield close()

    return materialise(decisions(rows, least_bytes).mapInArrow(write, "uri string, records long, bytes long"), "packages")


RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
)


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of the packages at ``uri``, a row a record (see ``RECORD``).

    The first step reads directories and indexes and gives ranges of neighbouring records, of about
    4 MB; these are dealt out to tasks anew, so a large package is read by many of them. The number of
    tasks follows the bytes of the packages: rows of ranges are too small for adaptive execution to tell.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with RangeReader(uri) as reader:
                    members = directory(reader)
                    base = members[ARCHIVE][0]
                    lines = reader.read(*members[INDEX]).decode().splitlines()
                places = [json.loads(line.split(" ", 2)[2]) for line in lines]
                begin, lengths = 0, []
                for place in places:
                    if lengths and (place["offset"] != begin + sum(lengths) or sum(lengths) >= READ_BYTES):
                        yield made(uri, base + begin, lengths)
                        lengths = []
                    begin = begin if lengths else place["offset"]
                    lengths.append(place["length"])
                if lengths:
                    yield made(uri, base + begin, lengths)

    def made(uri: str, begin: int, lengths: list[int]) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([uri]), pa.array([begin]), pa.array([lengths], pa.list_(pa.int64()))], ["uri", "begin", "lengths"]
        )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        types = dict(zip(names, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]))
        for batch in batches:
            for row in batch.to_pylist():
                with RangeReader(row["uri"]) as reader:
                    data, at, found = reader.read(row["begin"], sum(row["lengths"])), 0, []
                    for length in row["lengths"]:
                        found.append(parse(zlib.decompress(data[at : at + length], 31)))
                        at += length
                yield pa.record_batch([pa.array([f[n] for f in found], types[n]) for n in names], names)

    places = materialise(packages.select("uri").mapInArrow(ranges, "uri string, begin long, lengths array<long>"), "ranges")
    size = places.agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n")).first()["n"]
    return places.repartition(tasks_for(places.sparkSession, size), "uri", "begin").mapInArrow(records, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """All pages written to packages in the shared folder and read back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder, least_bytes))
