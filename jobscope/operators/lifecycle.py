"""Retention: which objects are past their class's age."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.vocab import RETENTION_DAYS


def expired(
    objects: DataFrame, as_of: Column, policies: dict[str, int] | None = None
) -> DataFrame:
    """Objects older than their class allows.  Selects only; nothing is deleted.

    The policies are a literal, so the age test runs where the object list is read.
    """
    rules = RETENTION_DAYS if policies is None else policies
    days = F.create_map(*[F.lit(x) for x in chain.from_iterable(rules.items())])[
        F.col("object_class")
    ]
    return objects.withColumn("retention_days", days).where(
        F.col("modified_at") < as_of - F.make_dt_interval(days=F.col("retention_days"))
    )
