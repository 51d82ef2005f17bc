"""Time rules: text timestamps, ages, default windows and derived minutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope.functions.text import present

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def iso_utc(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss[.ffffff]Z`` for a timestamp without time zone."""
    precise = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.replace(precise, F.lit(".000000Z"), F.lit("Z"))


def epoch_ntz(seconds: Column) -> Column:
    return F.expr(_EPOCH) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def normalise_time(text: Column) -> Column:
    """NULL or empty: NULL.  A number: epoch seconds as ISO text.  Text: ``+00:00`` as ``Z``."""
    seconds = text.try_cast("decimal(18,6)")
    return F.when(seconds.isNotNull(), iso_utc(epoch_ntz(seconds))).otherwise(
        F.replace(present(text), F.lit("+00:00"), F.lit("Z"))
    )


def age_seconds(as_of: Column, since: Column) -> Column:
    """Whole seconds from ``since`` to ``as_of``."""
    return F.timestamp_diff("SECOND", since, as_of)


def default_start(as_of: Column) -> Column:
    return as_of - F.expr("INTERVAL 30 MINUTES")


def minutes(seconds: Column) -> Column:
    return F.round(seconds / 60, 2)


def pending_containers(instances: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(instances / 2))
