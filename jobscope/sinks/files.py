"""File sinks: partitioned, write-once and staged outputs, run metrics."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.operators.quality import reasons


def default_run_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def child_path(parent: str, *children: str) -> str:
    """Parent without trailing slashes, then every non-empty child without outer slashes."""
    return "/".join([parent.rstrip("/"), *[c.strip("/") for c in children if c]])


def write_partitioned(df: DataFrame, path: str, by: str, files: int | None = None) -> None:
    """Overwrite a Parquet folder with one sub-folder per value of ``by``.

    Rows are first rebalanced by the partition column: small values share few files and a value
    with much of the data is split over several tasks.  ``files`` sets the number of writing
    tasks instead and is for small results only.
    """
    laid_out = df.repartition(files) if files else df.hint("rebalance", by)
    laid_out.write.mode("overwrite").partitionBy(by).parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Validation reports as JSON lines, one folder per scenario."""
    reports.hint("rebalance", "scenario").write.mode("overwrite").partitionBy("scenario").json(path)


def write_once(
    df: DataFrame, path: str, on_conflict: str = "error", run_id: str | None = None
) -> str:
    """Write Parquet to a path that should not exist yet; returns the path written.

    On a conflict: fail (``error``), replace (``overwrite``), or avoid it by writing below a
    folder of the run's own (``new_run_prefix``).
    """
    if on_conflict == "overwrite":
        df.write.mode("overwrite").parquet(path)
        return path
    if on_conflict == "new_run_prefix":
        path = child_path(path, f"run_id={run_id or default_run_id()}")
    elif on_conflict != "error":
        raise ValueError("on_conflict must be error, overwrite or new_run_prefix")
    df.write.mode("errorifexists").parquet(path)
    return path


def stage_and_validate(
    df: DataFrame, path: str, rules: dict[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Write to ``path/_staging``, read it back and count the rows that break each rule.

    Returns the staged table and one row per rule.  The rules run on what was stored, so the
    source is computed once and type drift in the files shows up.
    """
    staging = child_path(path, "_staging")
    df.write.mode("overwrite").parquet(staging)
    stored = df.sparkSession.read.parquet(staging)
    broken = stored.withColumn("_broken", reasons(rules))
    counts = broken.agg(
        *[
            F.count_if(F.array_contains("_broken", n)).alias(f"r{i}")
            for i, n in enumerate(rules)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("row_count"))
            for i, n in enumerate(rules)
        ]
    )
    return stored, counts.select(F.inline(rows))


def run_metrics(
    spark: SparkSession,
    run_id: str,
    inputs: DataFrame,
    outputs: dict[str, DataFrame],
    input_count: Column | None = None,
) -> DataFrame:
    """One row: input rows, rows of every output, and the same as JSON with sorted keys.

    Pass outputs as read back from where they were written: their counts then come from file
    metadata and the plans that made them do not run again.  Where an output holds counts of the
    input, pass it as ``inputs`` with their sum as ``input_count``, and the input is not read
    again either.  Counting what was stored is also exact when a lost executor makes tasks run
    twice.
    """

    def cell(df: DataFrame, count: Column) -> Column:
        return F.coalesce(df.agg(count.alias("n")).scalar(), F.lit(0))

    rows = F.count(F.lit(1))
    cells = {
        "input_rows": cell(inputs, rows if input_count is None else input_count),
        **{f"{name}_rows": cell(df, rows) for name, df in outputs.items()},
    }
    row = spark.range(1).select(
        F.lit(run_id).alias("run_id"), *[c.alias(n) for n, c in cells.items()]
    )
    names = sorted(["run_id", *cells])
    return row.select("*", F.to_json(F.struct(*names)).alias("metrics"))
