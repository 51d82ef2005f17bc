"""Exact sums and averages of money held as doubles.

A plain ``sum(double)`` depends on the order rows arrive in, so two runs of one job can differ in
the last cent.  Every amount is therefore read as a decimal with six places (rounded half away
from zero) and added exactly, whatever stands beside it in its group.

An amount of 10^20 or more counts as infinite: this leaves room for 10^12 rows in the decimal
sum.  A group with a NaN, or with infinities of both signs, gives NaN; else an infinity wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIMIT = 1e20


def money_parts(amount: Column) -> dict[str, Column]:
    """Aggregates of which ``money_sum`` and ``money_avg`` of any coarser group follow."""
    number = ~F.isnan(amount)
    finite = F.when(F.abs(amount) < _LIMIT, amount)  # NaN is above every number
    return {
        "total": F.sum(finite.cast("decimal(28,6)")),
        "n": F.count(amount),
        "nan": F.coalesce(F.bool_or(F.isnan(amount)), F.lit(False)),
        "above": F.coalesce(F.bool_or(number & (amount >= _LIMIT)), F.lit(False)),
        "below": F.coalesce(F.bool_or(amount <= -_LIMIT), F.lit(False)),
    }


def merged_parts(prefix: str = "") -> dict[str, Column]:
    """The parts of a coarser group, from columns ``<prefix><part>`` of finer ones."""
    sums = {p: F.sum(f"{prefix}{p}") for p in ("total", "n")}
    return sums | {p: F.bool_or(f"{prefix}{p}") for p in ("nan", "above", "below")}


def sum_of_parts(parts: dict[str, Column]) -> Column:
    return F.coalesce(_special(parts), F.round(parts["total"], 2).cast("double"))


def avg_of_parts(parts: dict[str, Column]) -> Column:
    total = parts["total"]
    cent = F.nullif(parts["n"], F.lit(0)).cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")
    rest = F.abs(total) % cent
    cents = ((F.abs(total) - rest) / cent).cast("double") + F.when(rest * 2 >= cent, 1.0).otherwise(0.0)
    return F.coalesce(_special(parts), F.signum(total.cast("double")) * cents / 100)


def _special(parts: dict[str, Column]) -> Column:
    """NaN or an infinity if the group's result is one, else NULL."""
    odd = parts["nan"] | (parts["above"] & parts["below"])
    infinite = F.when(parts["above"], F.lit(float("inf"))).when(parts["below"], F.lit(float("-inf")))
    return F.when(odd, F.lit(float("nan"))).otherwise(infinite)


def money_sum(amount: Column) -> Column:
    """``round(sum(amount), 2)``."""
    return sum_of_parts(money_parts(amount))


def money_avg(amount: Column) -> Column:
    """``round(avg(amount), 2)``, halves away from zero."""
    return avg_of_parts(money_parts(amount))
