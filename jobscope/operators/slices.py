"""Running counts over all values of a column, or of each group, without one task for all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType
from pyspark.sql.window import Window

from jobscope.session import scratch

# Distinct values one window task walks, and the most slices a column is cut into.  Beyond their
# product a slice grows, in a sort that can spill.
VALUES_PER_SLICE = 1_000_000
MOST_SLICES = 1024
# Items a quantile sketch keeps: its ranks are then off by less than a thousandth.
_SKETCH_ITEMS = 4096


def _cuts(counts: DataFrame, value: str, per_slice: int, most: int) -> Column:
    """As many approximate quantiles of the distinct values as their number asks for."""
    at = [i / most for i in range(1, most)]
    if isinstance(counts.schema[value].dataType, IntegralType):
        sketch = F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(_SKETCH_ITEMS))
        every = F.kll_sketch_get_quantile_bigint(sketch, F.array(*map(F.lit, at)))
    else:
        every = F.percentile_approx(value, at, 10 * most)
    step = F.greatest(F.lit(1), F.floor(most / F.ceil(F.count(F.lit(1)) / per_slice)))
    return F.filter(every, lambda _, i: (i + 1) % step == 0).cast(ArrayType(counts.schema[value].dataType))


def _same(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return same


def _counted_in(part: Sequence[str], value: str, n: str, before: Column, values_before: Column) -> list[Column]:
    """``before`` and ``values_before`` by a window over a part, whose own offsets are given."""
    inside = Window.partitionBy(*part).orderBy(value)
    smaller = inside.rowsBetween(Window.unboundedPreceding, -1)
    return [
        (before + F.coalesce(F.sum(n).over(smaller), F.lit(0))).alias("before"),
        (values_before + F.row_number().over(inside) - 1).alias("values_before"),
    ]


def running_counts(
    counts: DataFrame,
    value: str,
    n: str,
    groups: Sequence[str] = (),
    per_slice: int = VALUES_PER_SLICE,
    most: int = MOST_SLICES,
    wanted: Column | None = None,
) -> DataFrame:
    """``counts`` (one row per group and value) with where each value stands in its group.

    Adds ``before`` and ``total`` (sums of ``n`` over smaller and over all values), and
    ``values_before`` and ``values`` (how many smaller and how many distinct values there are).
    NULL values are left out.  With ``wanted``, a test on ``before``, ``n`` and ``total`` that holds
    for a range of values whenever it holds for one of them (as "covers the median" does), only
    the values that pass are given.

    ``counts`` is written once, and how many values its largest group has is looked up.  Where
    that is no more than ``per_slice``, a window per group does.  Otherwise quantile sketches cut
    the large groups into slices, more of them the more values they have; the slices' totals, at
    most ``most`` rows per group, give each slice its offset, and the running count is taken
    inside the slices in parallel: with ``wanted``, inside the few slices that can hold an answer.
    The cuts decide balance, not the answer.
    """
    spark = counts.sparkSession
    keys = list(groups)
    path = scratch(spark, "counts")
    counts.where(F.col(value).isNotNull()).write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values")).agg(F.max("_values")).first()[0]
    if (sizes or 0) <= per_slice:
        whole = Window.partitionBy(*keys)
        walked = counts.select(
            *counts.columns,
            *_counted_in(keys, value, n, F.lit(0), F.lit(0)),
            F.sum(n).over(whole).alias("total"),
            F.count(F.lit(1)).over(whole).alias("values"),
        )
    else:
        walked = _in_slices(counts, value, n, keys, per_slice, most, wanted)
    return walked if wanted is None else walked.where(wanted)


def _in_slices(
    counts: DataFrame, value: str, n: str, keys: list[str], per_slice: int, most: int, wanted: Column | None
) -> DataFrame:
    cuts = (
        counts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys])
        .agg(_cuts(counts, value, per_slice, most).alias("_cuts"), F.count(F.lit(1)).alias("_values"))
        .where(F.col("_values") > per_slice)
        .drop("_values")
    )
    if keys:
        known = counts.join(cuts, _same(keys), "left").drop(*[f"_{k}" for k in keys])
        limits = F.col("_cuts")
    else:
        known = counts
        limits = cuts.scalar()
    # 1 + the number of cuts below the value
    with_value = F.array_append(F.coalesce(limits, F.array()), F.col(value))
    place = F.array_position(F.sort_array(with_value), F.col(value))
    # Never NULL: a nullable slice would make Spark test it on every row of the scan.
    sliced = known.withColumn("_slice", F.coalesce(place, F.lit(0))).drop("_cuts")
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum(n).alias(n), F.count(F.lit(1)).alias("_v"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        F.col("_slice").alias("_of"),
        n,
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_v_before"),
        F.sum(n).over(whole).alias("total"),
        F.sum("_v").over(whole).alias("values"),
    )
    if wanted is not None:
        offsets = offsets.where(wanted)
    offsets = offsets.select(
        *[F.col(k).alias(f"_{k}") for k in keys], "_of", F.col("before").alias("_n_before"), "_v_before", "total", "values"
    )
    at = (F.col("_slice") == F.col("_of")) & _same(keys)
    return sliced.join(offsets, at).select(
        *counts.columns,
        *_counted_in([*keys, "_slice"], value, n, F.col("_n_before"), F.col("_v_before")),
        "total",
        "values",
    )
