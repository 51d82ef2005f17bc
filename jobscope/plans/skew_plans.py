"""Key frequency, skew and range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.operators import ranges, skew
from jobscope.plans.registry import query
from jobscope.session import load
from jobscope.sources.generators import skewed_rows


@query("SELECT l_partkey, count(*) AS row_count FROM lineitem GROUP BY l_partkey")
def key_counts(spark: SparkSession, folder: str) -> DataFrame:
    return skew.key_counts(load(spark, folder, "lineitem"), "l_partkey")


@query(
    """
    WITH k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)
    SELECT max(n) AS hot_rows, min(n) AS cold_rows,
           greatest(1, max(n) // greatest(min(n), 1)) AS skew_ratio FROM k
    """
)
def skew_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return skew.skew_ratio(skew.key_counts(load(spark, folder, "lineitem"), "l_partkey"))


@query(
    """
    WITH k AS (SELECT l_partkey, count(*) AS row_count FROM lineitem GROUP BY l_partkey),
    s AS (SELECT sum(row_count)::BIGINT AS total, quantile_cont(row_count, 0.5)::DOUBLE AS med FROM k)
    SELECT l_partkey, row_count, row_count::DOUBLE / total AS share,
           row_count::DOUBLE / med AS ratio_to_median,
           dense_rank() OVER (ORDER BY row_count DESC) AS key_rank,
           row_count::DOUBLE / med >= 1.5 AS is_hot
    FROM k, s
    """
)
def skew_report(spark: SparkSession, folder: str) -> DataFrame:
    return skew.report(load(spark, folder, "lineitem"), "l_partkey", hot_ratio=1.5)


@query(
    """
    SELECT part_key, count(*) AS row_count
    FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_partkey END AS part_key FROM lineitem)
    GROUP BY part_key HAVING count(*) >= 0.01 * (SELECT count(*) FROM lineitem)
    """
)
def hot_keys(spark: SparkSession, folder: str) -> DataFrame:
    return skew.hot_keys(lopsided_lines(spark, folder), "part_key", 0.01)


def lopsided_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All line items, a third of them on one part."""
    hot = F.col("l_orderkey") % 3 == 0
    return load(spark, folder, "lineitem").select(
        F.when(hot, F.lit(1).cast("bigint")).otherwise(F.col("l_partkey")).alias("part_key"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_quantity",
    )


@query("SELECT l_suppkey, count(*) AS row_count FROM lineitem GROUP BY l_suppkey")
def salted_count(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "lineitem")
    return skew.salted_count(lines, "l_suppkey", ["l_orderkey"], salts=8)


@query(
    """
    SELECT p_brand, count(*) AS row_count, sum(l_quantity)::BIGINT AS quantity
    FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_partkey END AS part_key, l_quantity
          FROM lineitem)
    JOIN part ON part_key = p_partkey GROUP BY p_brand
    """
)
def salted_join(spark: SparkSession, folder: str) -> DataFrame:
    parts = load(spark, folder, "part").select(F.col("p_partkey").alias("part_key"), "p_brand")
    joined = skew.salted_join(
        lopsided_lines(spark, folder), parts, "part_key", ["l_orderkey", "l_linenumber"]
    )
    return joined.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
    )


@query("SELECT o_custkey % 64 AS shuffle_key, count(*) AS row_count FROM orders GROUP BY 1")
def partitioned_count(spark: SparkSession, folder: str) -> DataFrame:
    keyed = load(spark, folder, "orders").select((F.col("o_custkey") % 64).alias("shuffle_key"))
    return skew.partitioned_count(keyed, "shuffle_key", 8)


@query(
    """
    SELECT CAST(event_id % 64 AS VARCHAR) AS shuffle_key, count(*) AS row_count
    FROM events GROUP BY 1
    """
)
def synth_shuffle_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Wide rows on few keys: the payload is dropped before anything moves."""
    wide = load(spark, folder, "events").selectExpr(
        "CAST(event_id % 64 AS STRING) AS shuffle_key", "repeat('x', 256) AS payload"
    )
    return skew.partitioned_count(wide, "shuffle_key", 8)


@query(
    """
    SELECT CASE WHEN event_id < 3000 THEN 'hot_customer'
                ELSE 'cold_customer_' || CASE WHEN (event_id - 3000) // 100 + 1 < 1000
                     THEN lpad(CAST((event_id - 3000) // 100 + 1 AS VARCHAR), 3, '0')
                     ELSE CAST((event_id - 3000) // 100 + 1 AS VARCHAR) END END AS customer_key,
           count(*) AS row_count
    FROM events GROUP BY 1
    """
)
def synth_skewed_counts(spark: SparkSession, folder: str) -> DataFrame:
    ids = load(spark, folder, "events").select(F.col("event_id").alias("id"))
    return skew.key_counts(skewed_rows(ids, hot_rows=3000, cold_rows=100), "customer_key")


@query(
    """
    WITH b AS (
      SELECT 'poor' AS bounds, CAST(0 AS BIGINT) AS partition_id, o_custkey AS v FROM orders
      WHERE o_custkey < 250002
      UNION ALL SELECT 'poor', 1, o_custkey FROM orders WHERE o_custkey >= 250002 AND o_custkey < 500001
      UNION ALL SELECT 'poor', 2, o_custkey FROM orders WHERE o_custkey >= 500001 AND o_custkey < 750000
      UNION ALL SELECT 'poor', 3, o_custkey FROM orders WHERE o_custkey >= 750000
      UNION ALL SELECT 'fair', 0, o_custkey FROM orders WHERE o_custkey < 377
      UNION ALL SELECT 'fair', 1, o_custkey FROM orders WHERE o_custkey >= 377 AND o_custkey < 751
      UNION ALL SELECT 'fair', 2, o_custkey FROM orders WHERE o_custkey >= 751 AND o_custkey < 1125
      UNION ALL SELECT 'fair', 3, o_custkey FROM orders WHERE o_custkey >= 1125),
    slots AS (SELECT * FROM (VALUES ('poor'), ('fair')) a(bounds),
              (VALUES (0::BIGINT), (1), (2), (3)) p(partition_id)),
    c AS (SELECT s.bounds, s.partition_id, count(v) AS row_count
          FROM slots s LEFT JOIN b USING (bounds, partition_id) GROUP BY ALL),
    t AS (SELECT count(*) AS total FROM orders)
    SELECT bounds, partition_id, row_count, row_count::DOUBLE / total AS share,
           row_count > 0 AND row_count * 4 >= total * 2 AS is_hotspot
    FROM c, t
    """
)
def range_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """The same key under poor bounds (all in one partition) and fair ones."""
    orders = load(spark, folder, "orders")
    poor = ranges.partition_histogram(orders, "o_custkey", 1, 1_000_000, 4)
    fair = ranges.partition_histogram(orders, "o_custkey", 1, 1_500, 4)
    return poor.withColumn("bounds", F.lit("poor")).unionByName(
        fair.withColumn("bounds", F.lit("fair"))
    )


@query(
    """
    SELECT CASE WHEN o_orderkey < 12000 THEN 1 ELSE o_orderkey END AS jdbc_partition,
           count(*) AS row_count
    FROM orders GROUP BY 1
    """
)
def case_hotspot(spark: SparkSession, folder: str) -> DataFrame:
    bucketed = load(spark, folder, "orders").select(
        ranges.case_bucket(F.col("o_orderkey"), 12000).alias("jdbc_partition")
    )
    return skew.key_counts(bucketed, "jdbc_partition")


@query(
    """
    WITH r AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) AS rn,
                      count(*) OVER () AS n FROM lineitem)
    SELECT k, l_partkey AS bound
    FROM r, (SELECT unnest(range(1, 8)) AS k)
    WHERE rn = (k * n + 7) // 8
    """
)
def suggest_bounds(spark: SparkSession, folder: str) -> DataFrame:
    bounds = ranges.suggest_bounds(load(spark, folder, "lineitem"), "l_partkey", 8)
    return bounds.select(F.col("k").cast("bigint").alias("k"), "bound")
