"""Join size, pre-filtering and index coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.operators import joins
from jobscope.plans.registry import query
from jobscope.session import load

VOLUME_SQL = """
SELECT o_custkey % 100 AS join_key, count(*) AS joined_rows
FROM orders JOIN customer ON o_custkey % 100 = c_custkey % 100
GROUP BY 1
"""


def keyed_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    fact = load(spark, folder, "orders").select((F.col("o_custkey") % 100).alias("join_key"))
    dim = load(spark, folder, "customer").select((F.col("c_custkey") % 100).alias("join_key"))
    return fact, dim


@query(VOLUME_SQL)
def join_volume(spark: SparkSession, folder: str) -> DataFrame:
    return joins.join_volume(*keyed_sides(spark, folder), "join_key")


@query(
    f"""
    SELECT join_key, joined_rows,
           (SELECT count(*) FROM orders WHERE o_custkey % 100 = join_key) AS left_rows,
           (SELECT count(*) FROM customer WHERE c_custkey % 100 = join_key) AS right_rows
    FROM ({VOLUME_SQL})
    """
)
def join_volume_preagg(spark: SparkSession, folder: str) -> DataFrame:
    return joins.join_report(*keyed_sides(spark, folder), "join_key")


@query(
    """
    SELECT o_orderkey, o_custkey, c_name, c_mktsegment
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
    """
)
def prefilter_join(spark: SparkSession, folder: str) -> DataFrame:
    fact = load(spark, folder, "orders").select("o_orderkey", "o_custkey")
    dim = load(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"
    )
    return joins.prefilter_join(fact, dim, "o_custkey", F.col("c_mktsegment") == "BUILDING")


@query(
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    """
)
def prefilter_semi(spark: SparkSession, folder: str) -> DataFrame:
    fact = load(spark, folder, "orders").select("o_orderkey", "o_custkey")
    dim = load(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment"
    )
    return joins.prefilter(fact, dim, "o_custkey", F.col("c_mktsegment") == "BUILDING")


@query(
    """
    SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderpriority = '1-URGENT'
    """
)
def bloom_join(spark: SparkSession, folder: str) -> DataFrame:
    """Line items of urgent orders: a filter of the orders' keys meets the lines where they are read."""
    fact = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    dim = load(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return joins.bloom_join(fact, dim, "l_orderkey", F.col("o_orderpriority") == "1-URGENT", broadcast_keys=100)


@query(
    """
    SELECT DISTINCT 't' || l_suppkey AS tablename, 'c' || l_linenumber AS column_name
    FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM orders
                      WHERE o_custkey = l_suppkey AND o_orderkey % 6 = l_linenumber)
    """
)
def missing_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as uses of join keys, orders as index definitions."""
    keys = load(spark, folder, "lineitem").select(
        F.concat(F.lit("t"), "l_suppkey").alias("tablename"),
        F.concat(F.lit("C"), "l_linenumber").alias("column_name"),
    )
    indexes = load(spark, folder, "orders").selectExpr(
        "concat('t', o_custkey) AS tablename",
        "concat('CREATE INDEX i', o_orderkey, ' ON t', o_custkey, ' USING btree ( c', "
        "o_orderkey % 6, ', c99)') AS indexdef",
    )
    return joins.missing_indexes(keys, indexes)
