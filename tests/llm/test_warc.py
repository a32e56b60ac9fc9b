import base64
import gzip
import hashlib
import io
import zipfile

import pytest

from lociforge.llm import warc


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(tmp_path, zip64):
    members = [("archive/a", b"xyz" * 100), ("empty", b""), ("é/b", b"1")]
    data = b"".join(warc.zip_stored(members, zip64))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    path = tmp_path / "x.zip"
    path.write_bytes(data)
    with warc.RangeReader(f"file://{path}") as reader:
        assert [(n, reader.read(*at)) for n, at in warc.directory(reader).items()] == members


def test_other_writers_packages_are_read(tmp_path):
    path = tmp_path / "y.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("stored", b"data")
        z.writestr("packed", b"data" * 100, zipfile.ZIP_DEFLATED)
        with z.open("large", "w", force_zip64=True) as out:
            out.write(b"more")
        z.comment = b"a comment"
    with warc.RangeReader(f"file://{path}") as reader:
        members = warc.directory(reader)
        assert {n: reader.read(*at) for n, at in members.items()} == {"stored": b"data", "large": b"more"}


def test_a_file_that_is_no_package(tmp_path):
    path = tmp_path / "z"
    path.write_bytes(b"nothing")
    with warc.RangeReader(f"file://{path}") as reader, pytest.raises(ValueError):
        warc.directory(reader)


def test_records_round_trip_and_damage_is_seen():
    payload = "é\r\n\r\nx".encode()
    row = warc.parse(warc.record(5, "http://a.b/ü x", payload, warc.digest(payload), None))
    assert row["payload"] == payload and row["page_id"] == 5 and row["refers_to"] is None
    row = warc.parse(warc.record(6, None, payload, warc.digest(payload), 5))
    assert row["record_type"] == "revisit" and row["refers_to"] == 5 and row["payload_bytes"] == len(payload) and row["payload"] is None
    with pytest.raises(ValueError):
        warc.parse(warc.record(5, None, payload, warc.digest(b"other"), None))


def rows_of(found):
    return sorted(
        ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()), key=repr
    )


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        refers = first.get(data) if first.get(data) != page else None
        key = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), key, "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


ROWS = [(i, f"http://h/{i}\n é" if i % 3 else None, ["same", "", None, f"own {i}", "é" * i][i % 5]) for i in range(200)]
ROWS += [(None, "http://n", "same"), (None, "http://n", "only null ids"), (7, "http://r", "long " * 100_000), (7, "http://r", "long " * 100_000)]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(llm, monkeypatch, least):
    pages = llm.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, key string, first int").repartition(3)
    assert rows_of(warc.round_trip(pages, least)) == expected(ROWS, least)


def test_payloads_come_back(llm, tmp_path):
    pages = llm.createDataFrame(ROWS, "page_id long, url string, html string")
    packages = warc.write_packages(pages, f"file://{tmp_path}", zip64=True)
    files = sorted(tmp_path.glob("*.wacz"))
    assert sorted(r.uri for r in packages.collect()) == [f"file://{f}" for f in files]
    assert packages.groupBy().sum("records").first()[0] == len(ROWS)
    with zipfile.ZipFile(files[0]) as z:
        assert z.namelist() == [warc.ARCHIVE, warc.INDEX]
        assert gzip.decompress(z.read(warc.ARCHIVE)).startswith(b"WARC/1.1\r\n")
    html = {(p, len((h or "").encode())): (h or "").encode() for p, _, h in ROWS}
    for r in warc.read_packages(packages).collect():
        if r.record_type == "response":
            assert bytes(r.payload) == html[r.page_id, r.payload_bytes]


def test_empty_table(llm):
    assert warc.round_trip(llm.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_ranges_are_read_by_many_tasks(llm, monkeypatch):
    """Adaptive execution may not join the few rows of ranges into one task."""
    monkeypatch.setattr(warc, "READ_BYTES", 1_000)
    pages = llm.createDataFrame([(i, None, f"page {i} " * 40) for i in range(400)], "page_id long, url string, html string").coalesce(1)
    records = warc.round_trip(pages)
    tasks = {r.p for r in records.selectExpr("spark_partition_id() p").distinct().collect()}
    assert records.count() == 400 and len(tasks) >= llm.sparkContext.defaultParallelism // 2
