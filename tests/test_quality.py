from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobscope import jobs
from jobscope.functions.casts import try_double, try_ts
from jobscope.operators import quality
from jobscope.sources.files import read_raw_csv
from tests.conftest import rows

# A quoted comma, a word for a number, a word for a time, a short row, an empty row, a day that
# does not exist.
MALFORMED = """event_id,customer_id,amount,event_ts,country
r1,"c,9",12.5,2027-03-04T05:06:07Z,"N,Z"
r2,c2,twelve,2027-03-04T05:06:08Z,NZ
r3,c3,-3,yesterday,NZ
r4,c4
r5,,,,
r6,c6,1e2,2027-02-30T00:00:00Z,NZ
"""
BROKEN = {
    "r1": [], "r2": ["amount"], "r3": ["event_ts"], "r4": ["amount", "event_ts"],
    "r5": ["amount", "event_ts"], "r6": ["event_ts"],
}
REASONS = [("amount", 3), ("event_ts", 4)]


@pytest.fixture
def raw(spark, tmp_path):
    (tmp_path / "events.csv").write_text(MALFORMED)
    return read_raw_csv(spark, str(tmp_path / "events.csv"))


def rules():
    return {
        "amount": try_double(F.col("amount")).isNull(),
        "event_ts": try_ts(F.col("event_ts")).isNull(),
    }


def test_malformed_records(raw):
    marked = quality.quarantine(raw, rules())
    got = {r["event_id"]: list(r["reasons"]) for r in marked.collect()}
    assert got == BROKEN
    good, bad = quality.split_valid(raw, rules())
    assert (good.count(), bad.count()) == (1, 5)
    assert good.columns == raw.columns
    assert rows(quality.reason_counts(marked)) == REASONS
    assert [r["event_id"] for r in quality.sample_bad(marked, "event_id", 1).collect()] == ["r2"]


def test_record_that_breaks_two_rules(spark):
    df = spark.createDataFrame([("x", None), (None, "2026-01-01T00:00:00+01")], "amount string, event_ts string")
    got = [r["reasons"] for r in quality.quarantine(df, rules()).collect()]
    assert got == [["amount", "event_ts"], ["amount"]]


def test_a_rule_that_is_unknown_is_not_broken(spark):
    df = spark.createDataFrame([(None,), (5,)], "v int")
    marked = quality.quarantine(df, {"big": F.col("v") > 3})
    assert sorted(r["is_bad"] for r in marked.collect()) == [False, True]


def test_cast_audit_tells_missing_from_malformed(spark):
    df = spark.createDataFrame([("not-a-number",), ("also-bad",), (None,), ("1.5",)], "amount string")
    assert rows(quality.cast_audit(df, {"amount": "double"})) == [("amount", "double", 1, 2, 1)]


def test_schema_impact(spark):
    df = spark.createDataFrame([(1, "not-a-number"), (2, "also-bad")], "id int, amount string")
    want = StructType.fromDDL("id int, amount double, country string")
    got = {r["column_name"]: r for r in quality.schema_impact(df, want).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "amount": "type_changed",
        "country": "missing",
        "id": "match",
    }
    assert got["amount"]["cast_failed"] == 2 and got["id"]["ok"] == 2


def test_payload_budget(spark):
    df = spark.range(25_000).selectExpr("'all' AS g", "repeat(id, 2048) AS oversized")
    row = quality.payload_budget(df, "g", ["oversized"], 16 * 2**20).first()
    assert row["payload_bytes"] == 233_246_720 and row["over_limit"]


def test_payload_counts_bytes_not_characters(spark):
    df = spark.createDataFrame([("g", "é", None)], "g string, a string, b string")
    assert quality.payload_budget(df, "g", ["a", "b"], 2).first()["payload_bytes"] == 2


def test_quarantine_job(spark, tmp_path):
    (tmp_path / "in.csv").write_text(MALFORMED)
    counts = jobs.quarantine_events(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    assert rows(counts) == REASONS
    good = spark.read.parquet(str(tmp_path / "out" / "is_bad=false"))
    assert [(r["event_id"], r["customer_id"], r["country"]) for r in good.collect()] == [("r1", "c,9", "N,Z")]
