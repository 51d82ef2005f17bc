"""Python functions that report errors per row instead of ending the job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(function: Callable[[Any], Any], result_type: str) -> Callable[[Column], Column]:
    """A column function giving ``struct(value, error)``: one of them is NULL.

    Rows travel in Arrow batches; a failing row carries its message, so it can be quarantined.
    """

    @F.pandas_udf(f"value {result_type}, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        def attempt(x):
            try:
                return function(x), None
            except Exception as problem:  # whatever user code raises belongs to the row
                return None, f"{type(problem).__name__}: {problem}"

        outcome = [attempt(x) for x in values]
        return pd.DataFrame(
            {
                "value": pd.Series([v for v, _ in outcome], dtype="object"),
                "error": pd.Series([e for _, e in outcome], dtype="object"),
            }
        )

    return run


def per_partition(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply a function to every Arrow batch of every partition."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(each, schema)
