"""Quarantine on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from jobscope.operators.quality import quarantine
from jobscope.streaming.sink import start_files


def stream_quarantine(stream: DataFrame, rules: dict[str, Column], path: str, checkpoint: str):
    """Start a query that stores every record once, good and bad ones in separate folders.

    ``path/is_bad=false`` and ``path/is_bad=true`` are the two outputs of one pass.  The file
    sink commits each batch once, so a restarted query neither loses nor repeats records.
    """
    return start_files(quarantine(stream, rules), path, checkpoint, ["is_bad"])
