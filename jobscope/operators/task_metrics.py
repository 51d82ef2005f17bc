"""Running-job signals from task records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.functions.medians import covers_median
from jobscope.operators.slices import running_counts

_MB = 1024 * 1024
_GB = 1024 * _MB
_UNTIMED = -(2**62)  # stands before all durations, for tasks that have none


def task_signals(tasks: DataFrame, stage: Sequence[str] = ("run_id", "stage_id")) -> DataFrame:
    """Signals per stage: task minutes (longest, median, their ratio), spill, input, activity.

    Durations are whole milliseconds; a task without a finish time is still active, and a stage
    with such a task counts as one active stage.  ``elapsed_minutes`` runs from the first launch to
    the last launch or finish.  ``input_bytes`` and ``executor_lost`` may be missing.

    Tasks are read once: one aggregate per stage and duration carries all sums; maximum, median
    and totals follow from it.
    """
    keys = list(stage)
    given = tasks.columns
    read = F.col("input_bytes") if "input_bytes" in given else F.lit(0).cast("bigint")
    lost = F.col("executor_lost") if "executor_lost" in given else F.lit(False)
    took = F.col("finish_ms") - F.col("launch_ms")
    per_duration = tasks.groupBy(
        *keys, F.coalesce(took, F.lit(_UNTIMED).cast("bigint")).alias("task_ms")
    ).agg(
        F.count(took).alias("n"),
        F.coalesce(F.sum(F.col("memory_spilled") + F.col("disk_spilled")), F.lit(0)).alias("spilled"),
        F.coalesce(F.sum(read), F.lit(0)).alias("read"),
        F.count_if(F.col("finish_ms").isNull()).alias("active"),
        F.count_if(lost).alias("lost"),
        F.min("launch_ms").alias("first_ms"),
        F.max(F.greatest("launch_ms", "finish_ms")).alias("last_ms"),
    )
    at_median = F.when(covers_median("n") & (F.col("n") > 0), F.col("task_ms"))
    totals = running_counts(per_duration, "task_ms", "n", keys).groupBy(*keys).agg(
        F.max(F.when(F.col("n") > 0, F.col("task_ms"))).alias("max_ms"),
        ((F.min(at_median) + F.max(at_median)) / 2).cast("double").alias("median_ms"),
        F.sum("spilled").alias("spilled"),
        F.sum("read").alias("read"),
        F.sum("active").alias("active_task_count"),
        F.sum("lost").alias("executor_failures"),
        (F.max("last_ms") - F.min("first_ms")).alias("elapsed_ms"),
    )
    ratio = F.floor(F.try_divide(F.col("max_ms"), F.greatest(F.col("median_ms"), F.lit(1.0))))
    return totals.select(
        *keys,
        F.round(F.col("max_ms") / 60000, 2).alias("max_task_runtime_minutes"),
        F.round(F.col("median_ms") / 60000, 2).alias("median_task_runtime_minutes"),
        F.greatest(F.lit(1).cast("bigint"), ratio).alias("skew_ratio"),
        F.expr(f"spilled div {_MB}").alias("shuffle_spill_mb"),
        "active_task_count",
        F.round(F.col("read") / _GB, 2).alias("input_gb"),
        F.round(F.col("elapsed_ms") / 60000, 2).alias("elapsed_minutes"),
        (F.col("active_task_count") > 0).cast("bigint").alias("active_stage_count"),
        "executor_failures",
    )
