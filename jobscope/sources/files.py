"""Files and catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobscope.session import use_utc
from jobscope.vocab import EVENT_COLUMNS_DDL


def read_events_csv(spark: SparkSession, path: str, schema: str | StructType = EVENT_COLUMNS_DDL):
    """Event CSV with a header; a malformed amount becomes NULL and the row stays."""
    use_utc(spark)
    return spark.read.option("header", True).schema(schema).csv(path)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column text, so that casts can be audited afterwards."""
    return spark.read.option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_table(spark: SparkSession, table: str, database: str | None = None) -> DataFrame:
    return spark.table(f"{database}.{table}" if database else table)


def read_docs(
    spark: SparkSession, path: str, schema: str | StructType, one_per_file: bool = False
) -> DataFrame:
    """JSON documents, one per line or one per file.

    The schema is given: nothing is scanned to infer it.  One document per line is the form to
    store many in, as a whole-file document cannot be split.
    """
    return spark.read.schema(schema).option("multiLine", one_per_file).json(path)


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """Log lines below a folder, plain or gzipped, with their file and their order in it.

    ``line_no`` grows within a file but has gaps: a large plain file is read in several
    splits, each numbered on its own and ordered by where it starts.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(root)
    return lines.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.struct(
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("row_in_split"),
        ).alias("line_no"),
    )


_TASK_EVENTS = (
    "Event string, `Stage ID` bigint, `Task End Reason` struct<`Reason`: string>, "
    "`Task Info` struct<`Task ID`: bigint, `Launch Time`: bigint, `Finish Time`: bigint>, "
    "`Task Metrics` struct<`Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint, "
    "`Input Metrics`: struct<`Bytes Read`: bigint>>"
)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Tasks from Spark event logs, single files or rolled ones.

    A task's start and end are separate events, possibly in separate files of a rolled log; a
    task that has only started has no finish time.  The run id is the application's, taken from
    the file name: ``<id>`` or ``events_<n>_<id>``, packed (``.gz``, ``.lz4``) or not.
    """
    events = spark.read.schema(_TASK_EVENTS).option("recursiveFileLookup", True).json(path)
    file_name = F.col("_metadata.file_name")
    info, metrics = F.col("Task Info"), F.col("Task Metrics")
    finish = info["Finish Time"]
    return (
        events.where(F.col("Event").isin("SparkListenerTaskStart", "SparkListenerTaskEnd"))
        .where(info["Task ID"].isNotNull())
        .groupBy(
            F.regexp_replace(file_name, r"^events_\d+_|(\.inprogress|\.gz|\.lz4)+$", "").alias("run_id"),
            F.col("Stage ID").alias("stage_id"),
            info["Task ID"].alias("task_id"),
        )
        .agg(
            F.min(info["Launch Time"]).alias("launch_ms"),
            F.max(F.when(finish > 0, finish)).alias("finish_ms"),
            F.coalesce(F.max(metrics["Memory Bytes Spilled"]), F.lit(0)).alias("memory_spilled"),
            F.coalesce(F.max(metrics["Disk Bytes Spilled"]), F.lit(0)).alias("disk_spilled"),
            F.max(metrics["Input Metrics"]["Bytes Read"]).alias("input_bytes"),
            F.bool_or(F.coalesce(F.col("Task End Reason.Reason") == "ExecutorLostFailure", F.lit(False)))
            .alias("executor_lost"),
        )
    )


def stream_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's files as a stream, with the schema of the table as it stands now.

    The braces make the path a pattern: only as a pattern may it also name a single file.
    """
    use_utc(spark)
    folder = folder.rstrip("/")
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{table}}}.parquet")


def stream_folder(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A folder another stream appends Parquet files to."""
    return spark.readStream.schema(schema).parquet(path)
