"""Lookups keyed by runtime: names, run states, terminal states, offered scenarios.

All tables are a few dozen fixed values, so they travel as literals inside the expression and
need no join.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope.vocab import RUN_STATES, RUNTIME_ALIASES, SIGNAL_FIELDS, SUPPORTED, TERMINAL_STATES


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def canonical_runtime(runtime: Column) -> Column:
    """Short names spelled out; missing means the default runtime."""
    named = F.coalesce(F.nullif(runtime, F.lit("")), F.lit("emr_ec2"))
    return F.coalesce(_literal_map(RUNTIME_ALIASES)[named], named)


def run_state(runtime: Column, raw_state: Column, context_state: Column) -> Column:
    """Raw state as running / completed / failed, else the context's state, else unknown."""
    table = {f"{r}|{s}": v for r, states in RUN_STATES.items() for s, v in states.items()}
    known = _literal_map(table)[F.concat(runtime, F.lit("|"), raw_state)]
    return F.coalesce(known, context_state, F.lit("unknown"))


def is_terminal(runtime: Column, state: Column) -> Column:
    hit = F.lit(False)
    for name, states in TERMINAL_STATES.items():
        hit = hit | ((runtime == name) & state.isin(*states))
    return hit


def is_supported(runtime: Column, scenario: Column) -> Column:
    """Whether the runtime offers the scenario; NULL for a runtime nobody knows."""
    answer = F.lit(None).cast("boolean")
    for name, scenarios in SUPPORTED.items():
        answer = F.when(
            runtime == name, F.coalesce(scenario.isin(*scenarios), F.lit(False))
        ).otherwise(answer)
    return answer


def known_signals(signals: Column) -> Column:
    """The signal map without fields nobody accepts; NULL when nothing is left."""
    kept = F.map_filter(signals, lambda k, v: k.isin(*SIGNAL_FIELDS))
    return F.when(F.size(kept) > 0, kept)
