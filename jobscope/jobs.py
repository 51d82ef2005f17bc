"""Ready-made jobs: read, run operators, write.

``python -m jobscope.jobs <job> --help`` lists the arguments of a job.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobscope.functions.casts import try_double, try_ts
from jobscope.operators import joins, quality, ranges, rollups, skew
from jobscope.session import build_session
from jobscope.sinks import files as sinks
from jobscope.sources import files as sources
from jobscope.sources.generators import synth_range, synth_skewed


def summarise_events(
    spark: SparkSession, source: str, output: str, run_id: str, files: int | None = None
) -> DataFrame:
    """Event CSV to ``daily_country`` and ``event_type_summary``; returns the run metrics.

    The CSV is parsed once: both summaries are computed together and staged, and the outputs
    and counts are taken from there.
    """
    events = rollups.with_event_date(sources.read_events_csv(spark, source))
    staged = sinks.child_path(output, "_staging")
    sinks.write_parquet(rollups.both(events), staged)
    summaries = sources.read_parquet(spark, staged)
    now = F.current_timestamp()
    daily_path = sinks.child_path(output, "daily_country")
    type_path = sinks.child_path(output, "event_type_summary")
    daily = rollups.stamp(rollups.daily_part(summaries), run_id, now)
    sinks.write_partitioned(daily, daily_path, "event_date", files)
    sinks.write_parquet(rollups.stamp(rollups.type_part(summaries), run_id, now), type_path)
    stored = {
        "daily_country": sources.read_parquet(spark, daily_path),
        "event_type": sources.read_parquet(spark, type_path),
    }
    total = F.sum("event_count")
    return sinks.run_metrics(spark, run_id, stored["daily_country"], stored, total)


def quarantine_events(spark: SparkSession, source: str, output: str) -> DataFrame:
    """Untyped event CSV to ``is_bad=false`` and ``is_bad=true`` folders; returns reason counts."""
    raw = sources.read_raw_csv(spark, source)
    rules = {
        "amount": try_double(F.col("amount")).isNull(),
        "event_ts": try_ts(F.col("event_ts")).isNull(),
    }
    quality.quarantine(raw, rules).write.mode("overwrite").partitionBy("is_bad").parquet(output)
    return quality.reason_counts(sources.read_parquet(spark, output))


def check_schema(spark: SparkSession, source: str, expected: str) -> DataFrame:
    """Fields of a Parquet table against a DDL string, with the rows each change would lose."""
    return quality.schema_impact(sources.read_parquet(spark, source), StructType.fromDDL(expected))


def count_skewed(
    spark: SparkSession,
    output: str,
    run_id: str,
    partitions: int = 24,
    hot_rows: int = 100_000,
    cold_rows: int = 1_000,
) -> DataFrame:
    """Rows per key of a skewed table as JSON; returns the skew ratio."""
    counts = skew.key_counts(synth_skewed(spark, partitions, hot_rows, cold_rows), "customer_key")
    sinks.write_json(rollups.stamp(counts, run_id), output)
    ddl = "customer_key string, row_count bigint"
    return skew.skew_ratio(sources.read_docs(spark, output, ddl, one_per_file=False))


def count_shuffled(
    spark: SparkSession, output: str, run_id: str, rows: int = 50_000, keys: int = 64
) -> DataFrame:
    """Rows per key of a wide table as JSON; returns rows and keys per shuffle partition."""
    wide = synth_range(
        spark, rows, f"CAST(id % {keys} AS STRING) AS shuffle_key", "repeat('x', 256) AS payload"
    )
    counts = skew.partitioned_count(wide, "shuffle_key", 8)
    sinks.write_json(rollups.stamp(counts, run_id), output)
    return skew.partition_load(wide, "shuffle_key", 8)


def count_joined(
    spark: SparkSession,
    output: str,
    run_id: str,
    fact_rows: int = 100_000,
    dim_rows: int = 20_000,
    keys: int = 100,
) -> DataFrame:
    """Rows per key of a many-to-many join as JSON; returns the size of both sides per key."""
    key = f"CAST(id % {keys} AS INT) AS join_key"
    fact, dim = synth_range(spark, fact_rows, key), synth_range(spark, dim_rows, key)
    sinks.write_json(rollups.stamp(joins.join_volume(fact, dim, "join_key"), run_id), output)
    return joins.join_report(fact, dim, "join_key")


def count_hotspot(
    spark: SparkSession, output: str, run_id: str, rows: int = 250_000, pivot: int = 240_000
) -> DataFrame:
    """Rows per range bucket as JSON; returns better bounds for the same rows."""
    ids = synth_range(spark, rows, "id AS row_id")
    bucketed = ids.select(ranges.case_bucket(F.col("row_id"), pivot).alias("jdbc_partition"))
    counts = skew.key_counts(bucketed, "jdbc_partition")
    sinks.write_json(rollups.stamp(counts, run_id), output)
    return ranges.suggest_bounds(ids, "row_id", 8)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    with_input = {
        "summarise-events": "event CSV to daily and per-type summaries",
        "quarantine-events": "event CSV to good and bad records",
    }
    for name, text in with_input.items():
        job = jobs.add_parser(name, help=text)
        job.add_argument("--input", required=True)
        job.add_argument("--output", required=True)
        job.add_argument("--run-id", default=sinks.default_run_id())
        job.add_argument("--coalesce", type=int)
    check = jobs.add_parser("check-schema", help="Parquet table against an expected schema")
    check.add_argument("--input", required=True)
    check.add_argument("--expected", required=True, help="such as 'id int, amount double'")
    generated = {
        "count-skewed": count_skewed,
        "count-shuffled": count_shuffled,
        "count-joined": count_joined,
        "count-hotspot": count_hotspot,
    }
    for name in generated:
        job = jobs.add_parser(name)
        job.add_argument("--output", required=True)
        job.add_argument("--run-id", default=sinks.default_run_id())
    args = parser.parse_args(argv)
    spark = build_session(f"jobscope-{args.job}")
    if args.job == "summarise-events":
        result = summarise_events(spark, args.input, args.output, args.run_id, args.coalesce)
    elif args.job == "quarantine-events":
        result = quarantine_events(spark, args.input, args.output)
    elif args.job == "check-schema":
        result = check_schema(spark, args.input, args.expected)
    else:
        result = generated[args.job](spark, args.output, args.run_id)
    result.show(truncate=False)


if __name__ == "__main__":
    main()
