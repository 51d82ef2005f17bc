"""Terminal state per run on a stream: emitted once it is certain, TIMEOUT at the deadline.

Two queries with a table between them.  ``run_slots`` reduces the state history to one row per
run and slot with built-in windows, which combine on the map side; ``terminal_states`` keeps the
small per-run state over those rows.  A run that makes up a third of the history therefore
reaches its state as a few rows, and Python never sees the history itself.

Runs are dealt into buckets by a hash of their id and a bucket's runs are one state row: a call into
Python costs milliseconds whatever it holds, so the calls are bounded by the buckets, not by the runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jobscope.operators.runs import earliest_terminal, terminal_firsts
from jobscope.vocab import RUN_WAIT_SECONDS

_OUT_DDL = "run_id string, submitted_ms bigint, finished_ms bigint, final_state string"
_STATE_DDL = (
    "run_ids array<string>, submitted_ms array<bigint>, terminal_ms array<bigint>, "
    "terminal_states array<string>, done array<boolean>"
)
_SLOT_COLUMNS = ["run_id", "submitted_ms", "terminal_ms", "terminal_state"]
_NEVER = 2**62

# How long after its end a reported run is remembered, so that rows logged later don't report it again.
RETENTION_SECONDS = 7 * 86_400
# State rows at most; a stream keeps the number it began with.
BUCKETS = 1_024


def run_slots(
    history: DataFrame, watermark: str = "10 minutes", slot: str = "5 minutes"
) -> DataFrame:
    """Earliest submission and earliest terminal state per run and slot."""
    return (
        history.withWatermark("ts", watermark)
        .groupBy(F.window("ts", slot).alias("slot"), F.col("run_id").cast("string").alias("run_id"))
        .agg(
            F.min(F.unix_millis("submitted_at")).alias("submitted_ms"),
            *terminal_firsts(F.unix_millis("ts")),
        )
        .withColumn("first", earliest_terminal())
        .select(
            F.col("slot.start").alias("slot_start"),
            "run_id",
            "submitted_ms",
            F.col("first.at").alias("terminal_ms"),
            F.col("first.state").alias("terminal_state"),
        )
    )


def terminal_states(
    slots: DataFrame,
    timeout_s: int = RUN_WAIT_SECONDS,
    watermark: str = "0 seconds",
    retention_s: int = RETENTION_SECONDS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per run as soon as no earlier state can arrive any more.

    Slots arrive closed and in order, so the latest slot start is a safe watermark.  A run without
    submission time has no deadline: whatever state it ends in is in time.  A reported run
    leaves a few bytes of state behind until ``retention_s`` after its end; a row that comes even
    later starts a new run of that name.  ``buckets`` is fixed for the life of a checkpoint.
    """
    timeout_ms, retention_ms = timeout_s * 1000, retention_s * 1000

    def track(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        runs = {run: tuple(known) for run, *known in zip(*state.get)} if state.exists else {}
        seen = set()
        for batch in batches:  # a time-out comes with an empty batch
            for run, sent, ended, name in zip(*(batch[c].tolist() for c in _SLOT_COLUMNS)):
                seen.add(run)
                submitted, at, final, done = runs.get(run, (_NEVER, _NEVER, "", False))
                if not done and not pd.isna(sent):
                    submitted = min(submitted, int(sent))
                if not done and name is not None and (ended, name) < (at, final):
                    at, final = int(ended), name
                runs[run] = submitted, at, final, done
        now = state.getCurrentWatermarkMs()
        held, reported, following = [], [], 2 * _NEVER
        for run, (submitted, at, final, done) in runs.items():
            deadline = _NEVER if submitted == _NEVER else submitted + timeout_ms
            certain = min(at, deadline)
            if done and certain + retention_ms < now and run not in seen:
                continue
            reports = not done and certain <= now
            held.append((run, submitted, at, final, done or reports))
            # a time-out comes once the watermark is past it, and a run is certain when it is there
            following = min(following, certain + retention_ms if done or reports else certain - 1)
            if reports:
                in_time = at < deadline
                sent = None if submitted == _NEVER else submitted
                reported.append((run, sent, at if in_time else None, final if in_time else "TIMEOUT"))
        if held:
            state.update(tuple(map(list, zip(*held))))
            state.setTimeoutTimestamp(max(now + 1, following))
        else:
            state.remove()
        if reported:
            names, sent, ended, finals = zip(*reported)
            yield pd.DataFrame(
                {
                    "run_id": names,
                    "submitted_ms": pd.Series(sent, dtype="Int64"),
                    "finished_ms": pd.Series(ended, dtype="Int64"),
                    "final_state": finals,
                }
            )

    return (
        slots.withWatermark("slot_start", watermark)
        .withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandasWithState(
            track, _OUT_DDL, _STATE_DDL, "append", GroupStateTimeout.EventTimeTimeout
        )
    )
