"""Record checks: reasons, quarantine, cast audits, schema differences, payload budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobscope.session import literal_rows


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules a record breaks; a rule is the condition of a *bad* record."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Every record with its reasons and ``is_bad``: both outputs from one pass."""
    marked = df.withColumn("reasons", reasons(rules))
    return marked.withColumn("is_bad", F.size("reasons") > 0)


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined).

    Each side reads the source again.  To write both, write ``quarantine`` partitioned by
    ``is_bad`` instead: one pass.
    """
    marked = quarantine(df, rules)
    good = marked.where(~F.col("is_bad")).drop("reasons", "is_bad")
    return good, marked.where("is_bad").drop("is_bad")


def reason_counts(marked: DataFrame) -> DataFrame:
    return (
        marked.select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def sample_bad(df: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The first ``n`` bad records by ``order``: a per-task top-n, not a sort of the table."""
    return df.where("is_bad").orderBy(order).limit(n)


def cast_audit(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Per column: NULL before the cast, failed by the cast, and fine.  One pass."""
    aggs, rows = [F.count(F.lit(1)).alias("total")], []
    for i, (name, target) in enumerate(targets.items()):
        source = F.col(name)
        failed = source.isNotNull() & source.try_cast(target).isNull()
        aggs += [
            F.count_if(source.isNull()).alias(f"null_{i}"),
            F.count_if(failed).alias(f"failed_{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(target).alias("target_type"),
                F.col(f"null_{i}").alias("null_in"),
                F.col(f"failed_{i}").alias("cast_failed"),
                (F.col("total") - F.col(f"null_{i}") - F.col(f"failed_{i}")).alias("ok"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def schema_diff(spark: SparkSession, actual: StructType, expected: StructType) -> DataFrame:
    """One row per field of either schema."""
    have = {f.name: f.dataType.simpleString() for f in actual.fields}
    want = {f.name: f.dataType.simpleString() for f in expected.fields}
    rows = []
    for name in sorted(have.keys() | want.keys()):
        if name not in have:
            status = "missing"
        elif name not in want:
            status = "unexpected"
        else:
            status = "match" if have[name] == want[name] else "type_changed"
        rows.append((name, want.get(name), have.get(name), status))
    ddl = "column_name string, expected_type string, actual_type string, status string"
    return literal_rows(spark, rows, ddl)


def schema_impact(df: DataFrame, expected: StructType) -> DataFrame:
    """``schema_diff`` of a table with the rows whose value the expected type cannot hold."""
    diff = schema_diff(df.sparkSession, df.schema, expected)
    shared = {f.name: f.dataType.simpleString() for f in expected if f.name in df.columns}
    audit = cast_audit(df, shared).select("column_name", "null_in", "cast_failed", "ok")
    return diff.join(audit, "column_name", "left")


def payload_budget(df: DataFrame, group: str, columns: list[str], limit_bytes: int) -> DataFrame:
    """Rows and text bytes per group that a collect would bring to the driver."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(size.cast("bigint")).alias("payload_bytes"),
        (F.sum(size.cast("bigint")) > limit_bytes).alias("over_limit"),
    )
