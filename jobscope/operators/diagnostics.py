"""Database activity and index listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions.text import excerpt
from jobscope.functions.times import age_seconds
from jobscope.vocab import SYSTEM_SCHEMAS


def active_queries(
    activity: DataFrame, as_of: Column, database: str, n_chars: int = 1000
) -> DataFrame:
    """Sessions of one database, longest-running query first, idle sessions last.

    The process id breaks ties: without it all idle sessions would sort in one task.
    """
    return (
        activity.where(F.col("datname") == database)
        .select(
            "pid",
            "state",
            "wait_event_type",
            "wait_event",
            age_seconds(as_of, F.col("query_start")).alias("query_age"),
            excerpt(F.col("query"), n_chars).alias("query_excerpt"),
        )
        .orderBy(F.desc_nulls_last("query_age"), "pid")
    )


def index_inventory(indexes: DataFrame) -> DataFrame:
    """User indexes in schema, table and name order."""
    return (
        indexes.where(~F.col("schemaname").isin(*SYSTEM_SCHEMAS))
        .select("schemaname", "tablename", "indexname", "indexdef")
        .orderBy("schemaname", "tablename", "indexname")
    )
