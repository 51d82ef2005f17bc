"""Packing a histogram of lengths into bins: configuration LP, multiplicative weights, rounding.

Everything here works on counts per length.  Its cost depends on the capacity, not on how many
pieces there are, so it runs on the driver whatever the size of the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Steps of the price schedule, and how many steps a length's coverage may lead.
STEPS = 40
LEAD = 2.0
# How often a remainder is solved anew before it goes best fit.
ROUNDS = 3
# How strongly a length that lags behind in coverage gains price.
RATE = 0.5
# Lengths that hold most of the ids, for which the LP is also solved exactly; its steps.
HEAVY = 64
EXACT_STEPS = 600


@dataclass(frozen=True)
class Run:
    """``bins`` bins that all hold the lengths in ``items``, longest first."""

    items: tuple[int, ...]
    bins: int


def _pricing(price: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: per capacity, the last length of a best filling.

    0 says that one place stays free.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = price[1 : c + 1] + best[:c][::-1]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], last[c] = value[k], k + 1
        else:
            best[c] = best[c - 1]
    return last


def _filling(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        length = int(last[room])
        room -= length or 1
        if length:
            out.append(length)
    return out


def _fractional(counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], float]:
    """How often to use each configuration: the LP ``min sum x, sum a x >= counts``.

    Multiplicative weights: all lengths are to be covered at the same pace.  A length's price is
    its size, times a factor that grows while its coverage lags behind the schedule and shrinks
    while it leads; beyond a step's lead it is not for sale.  Each step prices all fillings by one
    knapsack table and takes, for the lengths in the order of their lag, the best filling that
    holds them, until one of its lengths has caught up.
    """
    lengths = np.flatnonzero(counts)
    covered = np.zeros(capacity + 1)
    sizes = np.arange(capacity + 1) / capacity
    use: dict[tuple[int, ...], float] = {}
    for step in range(1, STEPS + 1):
        goal = counts * min(1.0, (step + LEAD) / STEPS)
        lag = (goal - covered)[lengths] / counts[lengths] * STEPS
        price = np.full(capacity + 1, -np.inf)
        on_sale = lag > 1e-9
        price[lengths[on_sale]] = sizes[lengths[on_sale]] * np.exp(RATE * np.minimum(lag[on_sale], 20.0))
        last = _pricing(price, capacity)
        for length in lengths[np.lexsort((-lengths, -np.round(lag, 3)))].tolist():
            if goal[length] - covered[length] <= 1e-9:
                continue
            items = (length, *_filling(last, capacity - length))
            kinds, times = np.unique(items, return_counts=True)
            amount = float(((goal - covered)[kinds] / times).min())
            if amount > 1e-9:
                items = tuple(sorted(items, reverse=True))
                use[items] = use.get(items, 0.0) + amount
                covered[kinds] += amount * times
    return use


def _exact(counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], float]:
    """The same LP by column generation, for few lengths.

    The simplex method starts with bins of one length each; a filling worth more than one bin at
    the present prices takes the place of the configuration that runs out first.  Whenever it
    stops, what it holds covers all pieces.
    """
    lengths = np.flatnonzero(counts)
    basis = np.diag((capacity // lengths).astype(float))
    need = counts[lengths].astype(float)
    for _ in range(EXACT_STEPS):
        prices = np.linalg.solve(basis.T, np.ones(len(lengths)))
        price = np.full(capacity + 1, -np.inf)
        price[lengths] = prices
        items = _filling(_pricing(price, capacity), capacity)
        column = np.bincount(np.searchsorted(lengths, items), minlength=len(lengths)).astype(float)
        if prices @ column <= 1 + 1e-9:
            break
        amounts, step = np.linalg.solve(basis, np.stack((need, column), axis=1)).T
        ratio = np.full(len(lengths), np.inf)
        ratio[step > 1e-9] = np.maximum(amounts[step > 1e-9], 0) / step[step > 1e-9]
        basis[:, int(ratio.argmin())] = column
    use: dict[tuple[int, ...], float] = {}
    for column, amount in zip(basis.T.round().astype(int), np.linalg.solve(basis, need)):
        items = tuple(np.repeat(lengths, column)[::-1].tolist())
        use[items] = use.get(items, 0.0) + max(0.0, float(amount))
    return use


def _best_fit(counts: np.ndarray, capacity: int, begun: dict[tuple[int, ...], int] | None = None) -> list[Run]:
    """Best-fit decreasing on counts, for the remainder that rounding leaves, into bins begun and new ones."""
    left = counts.copy()
    runs: list[Run] = []
    bins: dict[int, dict[tuple[int, ...], int]] = {}  # free room -> contents -> bins
    for items, n in (begun or {}).items():
        bins.setdefault(capacity - sum(items), {})[items] = n
    for length in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[length])
        while todo:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                each = min(todo, capacity // length)
                new, items = todo // each, (length,) * each
                bins.setdefault(capacity - each * length, {})
                bins[capacity - each * length][items] = bins[capacity - each * length].get(items, 0) + new
                todo -= new * each
                continue
            items, have = next(iter(bins[room].items()))
            moved = min(have, todo)
            bins[room][items] -= moved
            if not bins[room][items]:
                del bins[room][items]
            if not bins[room]:
                del bins[room]
            after = bins.setdefault(room - length, {})
            longest_first = tuple(sorted((*items, length), reverse=True))
            after[longest_first] = after.get(longest_first, 0) + moved
            todo -= moved
    for groups in bins.values():
        runs += [Run(items, n) for items, n in groups.items()]
    return runs


def pack_histogram(counts: dict[int, int], capacity: int) -> list[Run]:
    """Bins for ``counts[length]`` pieces of each length, as runs of equal bins.

    Two ways, of which the one with fewer bins is returned.  In rounds: the fractional solution
    is rounded down and its nearly full bins taken, as far as pieces are there; what is left is
    solved anew, until rounding gains nothing.  At once: the LP of the ``HEAVY`` lengths that
    hold most is solved exactly and rounded down, whatever its bins hold.  The last pieces go
    best fit into bins with room or new ones.  The number of runs is bounded by the steps and
    the capacity.
    """
    pieces = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        pieces[length] = n
    found = [_in_rounds(pieces, capacity), _at_once(pieces, capacity)]
    return min(found, key=lambda runs: sum(r.bins for r in runs))


def _take(left: np.ndarray, taken: dict[tuple[int, ...], int], items: tuple[int, ...], bins: int) -> None:
    """Move bins with these items from ``left`` to ``taken``, as far as pieces are there."""
    kinds, times = np.unique(items, return_counts=True)
    bins = min(bins, int((left[kinds] // times).min()))
    if bins > 0:
        left[kinds] -= bins * times
        taken[items] = taken.get(items, 0) + bins


def _in_rounds(pieces: np.ndarray, capacity: int) -> list[Run]:
    left, taken = pieces.copy(), {}
    _take(left, taken, (capacity,), int(left[capacity]))
    for _ in range(ROUNDS):
        if not left.any():
            break
        before = int(left.sum())
        use = _fractional(left, capacity)
        # fullest first: what cannot be filled well waits for the next round
        for items, amount in sorted(use.items(), key=lambda u: (-sum(u[0]), -u[0][0], u[0])):
            if sum(items) >= capacity - 2:
                _take(left, taken, items, int(amount))
        if before - int(left.sum()) < 0.02 * before:
            break
    return _best_fit(left, capacity, taken)


def _at_once(pieces: np.ndarray, capacity: int) -> list[Run]:
    left, taken = pieces.copy(), {}
    heavy = np.zeros_like(pieces)
    most = np.argsort(-pieces * np.arange(capacity + 1), kind="stable")[:HEAVY]
    heavy[most] = pieces[most]
    if heavy.any():
        for items, amount in _exact(heavy, capacity).items():
            _take(left, taken, items, int(amount + 1e-6))
    return _best_fit(left, capacity, taken)
