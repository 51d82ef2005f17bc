"""JDBC relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    *,
    query: str | None = None,
    table: str | None = None,
    fetchsize: int = 10_000,
    props: dict[str, str] | None = None,
) -> dict[str, str]:
    """Reader options; a query is read as a named sub-query so that filters are pushed into it."""
    if (query is None) == (table is None):
        raise ValueError("give either a query or a table")
    if fetchsize < 1:
        raise ValueError("fetchsize must be at least 1")
    source = table if table is not None else f"({query.strip().rstrip(';')}) source"
    return {**(props or {}), "url": url, "dbtable": source, "fetchsize": str(fetchsize)}


def partition_options(column: str, lower: int, upper: int, partitions: int) -> dict[str, str]:
    """Range options; ``operators.ranges`` shows beforehand how rows fall into the partitions."""
    if lower > upper or partitions < 1:
        raise ValueError("need lower <= upper and at least one partition")
    return {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    fetchsize: int = 10_000,
    props: dict[str, str] | None = None,
) -> DataFrame:
    """A query's result through one connection: for small results only."""
    options = jdbc_options(url, query=query, fetchsize=fetchsize, props=props)
    return spark.read.format("jdbc").options(**options).load()


def read_jdbc_partitioned(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower: int,
    upper: int,
    partitions: int,
    fetchsize: int = 10_000,
    props: dict[str, str] | None = None,
) -> DataFrame:
    """A table through one connection per range of ``column``."""
    options = jdbc_options(url, table=table, fetchsize=fetchsize, props=props)
    ranges = partition_options(column, lower, upper, partitions)
    return spark.read.format("jdbc").options(**options, **ranges).load()
