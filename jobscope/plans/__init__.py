"""Registered queries: each runs operators over the given tables, with SQL for the same answer."""

from __future__ import annotations

from jobscope.plans import (  # noqa: F401  (importing a module registers its queries)
    alarm_plans,
    finding_plans,
    join_plans,
    log_plans,
    quality_plans,
    rollup_plans,
    run_plans,
    skew_plans,
    storage_plans,
    stream_plans,
)
from jobscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
