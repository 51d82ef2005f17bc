"""A content-addressed web archive: payloads once by digest, record headers apart, joins to read it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import bounded_batches, stored

MIN_REVISIT_BYTES = 100
CAPTURED = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"  # closes every record
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("none")), F.lit(">"))


def _clean(url: Column) -> Column:
    """A URL as one header value: control characters are percent-encoded."""
    for code in [*range(0x20), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def records(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    captured: str = CAPTURED,
) -> tuple[DataFrame, DataFrame]:
    """The two tables of an archive, stored: ``headers`` and ``payloads``.

    ``headers`` has one row per page: the exact bytes of the WARC record up to its payload
    (``head``), the payload's ``digest`` and whether the payload follows in the record (``whole``).
    ``payloads`` has each payload's bytes once, under their SHA-256.  Of records with equal
    payloads of at least ``min_revisit_bytes`` bytes, those with the smallest id are responses
    and all others revisit it.  A page without id revisits but is never revisited, unless no page
    with that payload has an id: then all are responses.  NULL html is empty.
    """
    payload = F.coalesce(F.col(html_column).cast("binary"), F.lit(b""))
    read = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), payload.alias("payload"))
    digests = stored(
        read.select(
            "id",
            "url",
            F.octet_length("payload").cast("bigint").alias("bytes"),
            F.sha2("payload", 256).alias("digest"),
        ),
        "digests",
    )
    first = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # Only copies need to know of each other, and they are few beside the pages.
    copied = stored(first.where("n > 1").select("digest", "first"), "copied")
    joined = digests.join(copied, "digest", "left")
    again = (F.col("bytes") >= min_revisit_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    length = F.when(again, 0).otherwise(F.col("bytes"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        _record_id(F.col("id")),
        F.lit(f"\r\nWARC-Date: {captured}\r\n"),
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url")), F.lit("\r\n"))),
        F.lit("WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(
            again,
            F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("first"))),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + length).cast("string"),
        F.lit("\r\n\r\n"),
        http,
    )
    headers = stored(joined.select("digest", (~again).alias("whole"), head.cast("binary").alias("head")), "headers")

    # One row holds each payload: the first of those with the smallest id.
    unique = F.sha2("payload", 256)
    addressed = read.select(unique.alias("digest"), "id", "payload")
    several = addressed.join(copied, "digest", "left_semi")
    held = several.groupBy("digest").agg(F.first("payload").alias("payload"))
    single = addressed.join(copied, "digest", "left_anti").select("digest", "payload")
    return headers, stored(single.unionByName(held), "payloads")


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """``record``: the original bytes of every record, put together by a join on the digest.

    Records put one after another are an archive.
    """
    end = F.lit(_END)
    whole = headers.where("whole").join(payloads, "digest").select(F.concat("head", "payload", end).alias("record"))
    return whole.unionByName(headers.where("NOT whole").select(F.concat("head", end).alias("record")))


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
_PAGE = re.compile(rb"<urn:page:(-?\d+)>")


def parse_record(record: bytes) -> dict:
    """Fields of one WARC record; its lengths and digest are verified, and a fault raises ValueError."""
    top, gap, block = record.partition(_END)
    lines = top.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = {m[1].lower(): m[2] for m in map(_FIELD.fullmatch, lines[1:]) if m}
    if not block.endswith(_END) or int(fields[b"content-length"]) != len(block) - len(_END):
        raise ValueError("a record's length is wrong")
    http, _, payload = block[: -len(_END)].partition(_END)
    sizes = {m[1].lower(): m[2] for m in map(_FIELD.fullmatch, http.split(b"\r\n")[1:]) if m}
    size, kind = int(sizes[b"content-length"]), fields[b"warc-type"].decode()
    digest = fields[b"warc-payload-digest"].removeprefix(b"sha256:").decode()
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload does not match its digest")
    own, refers = _PAGE.fullmatch(fields[b"warc-record-id"]), _PAGE.fullmatch(fields.get(b"warc-refers-to", b""))
    return {
        "id": int(own[1]) if own else None,
        "url": fields[b"warc-target-uri"].decode() if b"warc-target-uri" in fields else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(refers[1]) if refers else None,
        "payload": payload if kind == "response" else None,
    }


_FIELDS = "id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_records(records_: DataFrame, with_payload: bool = True) -> DataFrame:
    """The fields of every ``record``, and its payload (NULL for a revisit) if wanted."""
    bounded_batches(records_.sparkSession)
    names = _FIELDS.replace(" bigint", "").replace(" string", "").split(", ") + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_record(r.as_py()) for r in batch.column(0)]
            yield pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

    return records_.select("record").mapInArrow(run, _FIELDS + ", payload binary" * with_payload)
