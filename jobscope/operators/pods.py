"""Pod status documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.vocab import IMAGE_PULL_REASONS

POD_DDL = (
    "metadata struct<name string, labels map<string,string>, annotations map<string,string>>, "
    "status struct<phase string, "
    "conditions array<struct<type string, status string, reason string>>, "
    "containerStatuses array<struct<state struct<waiting struct<reason string>>>>>"
)


def _no(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def is_pending(status: Column) -> Column:
    """Pending phase, or a condition that the pod could not be scheduled."""
    unschedulable = F.exists(
        status["conditions"],
        lambda c: _no(
            (c["type"] == "PodScheduled")
            & (F.lower(c["status"]) == "false")
            & (c["reason"] == "Unschedulable")
        ),
    )
    return _no(status["phase"] == "Pending") | _no(unschedulable)


def image_pull_failed(status: Column) -> Column:
    """A container waits because its image cannot be pulled."""
    return _no(
        F.exists(
            status["containerStatuses"],
            lambda c: _no(c["state"]["waiting"]["reason"].isin(*IMAGE_PULL_REASONS)),
        )
    )


def mentions_run(metadata: Column, run_id: Column) -> Column:
    """The run id occurs in the pod's name or in any label or annotation."""
    haystack = F.concat_ws(
        " ",
        metadata["name"],
        F.array_join(F.map_keys(metadata["labels"]), " "),
        F.array_join(F.map_values(metadata["labels"]), " "),
        F.array_join(F.map_keys(metadata["annotations"]), " "),
        F.array_join(F.map_values(metadata["annotations"]), " "),
    )
    return F.contains(haystack, run_id)


def pod_label(metadata: Column, status: Column) -> Column:
    return F.concat(
        F.coalesce(metadata["name"], F.lit("unknown")),
        F.lit(":"),
        F.coalesce(status["phase"], F.lit("unknown")),
    )


def pod_summary(pods: Column) -> Column:
    """``name:phase`` of the pods in one listing document, in listing order."""
    labels = F.transform(pods, lambda p: pod_label(p["metadata"], p["status"]))
    joined = F.array_join(labels, ", ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("no matching pods"))


def pod_signals(pods: DataFrame) -> DataFrame:
    return pods.withColumns(
        {
            "pending": is_pending(F.col("status")),
            "image_pull": image_pull_failed(F.col("status")),
        }
    )


def run_signals(pods: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run, whether any of its pods shows either signal, and its pod count.

    A run none of whose pods mentions it stays, with a count of 0.
    """
    own = mentions_run(F.col("metadata"), F.col(key))

    def any_own(signal: str) -> Column:
        return F.bool_or(F.coalesce(own & F.col(signal), F.lit(False))).alias(f"any_{signal}")

    return pod_signals(pods).groupBy(key).agg(
        F.count_if(own).alias("pod_count"), any_own("pending"), any_own("image_pull")
    )
