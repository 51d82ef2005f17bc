"""Run a stream to the end of its present input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobscope.session import scratch


def start_files(
    stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None
):
    """Append to Parquet files, exactly once, until the input available now is used up."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (
        writer.option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drain_to(stream: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Process all input now available; returns the folder that holds the result."""
    query = start_files(stream, f"{path}/data", f"{path}/checkpoint", partition_by)
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return f"{path}/data"


def drain(
    spark: SparkSession, stream: DataFrame, label: str, partition_by: list[str] | None = None
) -> DataFrame:
    """``drain_to`` a folder of its own, read back as a table."""
    return spark.read.schema(stream.schema).parquet(
        drain_to(stream, scratch(spark, label), partition_by)
    )
