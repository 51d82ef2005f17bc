"""The archive: an exact round trip, one copy of each payload, and faults that are noticed."""

from __future__ import annotations

import hashlib

import pytest

from jobscope.llm import warc
from jobscope.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import connect, difference


def test_sql(spark):
    con = connect(f"{DATA}/sf0.01")
    assert difference(QUERIES["op6_warc"](spark, f"{DATA}/sf0.01"), con, ORACLES["op6_warc"]) is None


LONG = "<p>é\r\n\r\nWARC/1.1\r\n" * 20
ROWS = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (3, None, LONG), (9, "http://a/\r\nX: 1\x7f", LONG), (None, "http://a/n", LONG),
    (1, "http://a/1", "short"), (2, "", "short"), (4, "http://a/4", None), (6, "http://a/6", ""), (7, "u", "x" * 100),
    (8, "u", "x" * 99), (10, "u", "x" * 99), (11, "u", "x" * 100), (12, "u", "y" * 3_000_000), (None, "u", "z" * 200), (None, "u", "z" * 200),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 1, "d") for r in ROWS], "page_id long, url string, html string, first int, digest string")
    headers, payloads = warc.records(df)
    held = payloads.collect()
    assert sorted(r["digest"] for r in held) == sorted({hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in ROWS})
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["digest"] for r in held)
    records = warc.reconstruct(headers, payloads)
    for r in records.collect():
        assert bytes(r["record"]).endswith(b"\r\n\r\n")
        top, _, block = bytes(r["record"])[:-4].partition(b"\r\n\r\n")
        assert top.startswith(b"WARC/1.1\r\nWARC-Type: ") and f"Content-Length: {len(block)}".encode() in top
    got = sorted(map(tuple, warc.read_records(records).collect()), key=str)
    want = []
    for i, url, body in ROWS:
        raw = (body or "").encode()
        ids = [j for j, _, b in ROWS if (b or "").encode() == raw and j is not None]
        least = min(ids, default=None)
        again = len(raw) >= 100 and least is not None and i != least
        kept = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A").replace("\x7f", "%7F")
        digest = hashlib.sha256(raw).hexdigest()
        want.append((i, kept, len(raw), digest, "revisit" if again else "response", least if again else None, None if again else raw))
    assert got == sorted(want, key=str)


def test_records_in_a_row_are_an_archive(spark):
    """Read as one stream of bytes: head, as many bytes as it names, two line ends, the next record."""
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    stream = b"".join(bytes(r["record"]) for r in warc.reconstruct(*warc.records(df)).collect())
    ids = []
    while stream:
        top, _, rest = stream.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in top.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        assert top.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        ids.append(fields[b"WARC-Record-ID"].decode())
        stream = rest[size + 4 :]
    assert sorted(ids) == sorted(f"<urn:page:{'none' if i is None else i}>" for i, _, _ in ROWS)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.reconstruct(*warc.records(df))).collect() == []


def test_faults_are_noticed(spark):
    headers, payloads = warc.records(spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string"))
    record = bytes(warc.reconstruct(headers, payloads).first()["record"])
    assert warc.parse_record(record)["payload"] == b"hello"
    for broken in (record[:-1], record + b"!", record.replace(b"hello", b"jello"), b"", b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse_record(broken)
