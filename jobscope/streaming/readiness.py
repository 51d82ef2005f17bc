"""Log readiness on streams: runs wait for their logs, up to a time limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.operators.logs import needs_application, readiness, with_places


def stream_log_readiness(
    runs: DataFrame,
    entries: DataFrame,
    limit: str = "30 minutes",
    submitted: str = "submitted_at",
    seen: str = "seen_at",
    watermark: str = "10 minutes",
) -> DataFrame:
    """``run_id``, ``submitted`` and ``logs`` of every run once its time limit has passed.

    ``entries`` come from ``log_entries`` with the time each was seen.  An entry counts for a run
    when it lies at one of the run's two places and was seen from the run's submission up to
    ``limit`` after it.  A run whose logs came is ready; one that is still without them at the
    limit is waiting, and runs that nothing is checked for say so.

    The join is a left outer one of two streams with watermarks on both sides and a bound on the
    time between them, so Spark drops entries and runs from its state as the watermarks pass, and
    a run that met nothing comes out at its limit.  What a run met is combined in a second
    stateful step.  Entries of no known kind never enter the state.  Runs without id or time are
    left out: they could never be closed.
    """
    timed = runs.where(F.col("run_id").isNotNull() & F.col(submitted).isNotNull())
    placed = with_places(timed.withWatermark(submitted, watermark)).select(
        "run_id",
        F.col(submitted).alias("_submitted"),
        "_check",
        needs_application().alias("_needs"),
        F.explode(F.array(F.struct(F.col("_main").alias("place"), F.lit(True).alias("main")),
                          F.struct(F.col("_other").alias("place"), F.lit(False).alias("main")))).alias("_at"),
    ).select("run_id", "_submitted", "_check", "_needs", "_at.*")
    kinds = ("is_step", "is_application", "is_job", "is_stream")
    known = entries.where(" OR ".join(kinds)).withWatermark(seen, watermark)
    known = known.select(F.col("place").alias("_place"), F.col(seen).alias("_seen"), *kinds)
    in_time = (F.col("_seen") >= F.col("_submitted")) & (F.col("_seen") <= F.col("_submitted") + F.expr(f"INTERVAL {limit}"))
    met = placed.join(known, (F.col("place") == F.col("_place")) & in_time, "left_outer")

    def any_of(kind: str, main: bool) -> Column:
        return F.bool_or(F.col(kind) & (F.col("main") == main))

    found = met.groupBy("run_id", "_submitted", "_check", "_needs").agg(
        any_of("is_step", True).alias("has_step"),
        any_of("is_job", True).alias("has_job"),
        any_of("is_application", False).alias("has_application"),
        any_of("is_stream", False).alias("has_stream"),
    )
    return found.select("run_id", F.col("_submitted").alias(submitted), readiness(F.col("_needs")).alias("logs"))
