"""Cutting stock by column generation over a histogram of lengths.

Lengths are classes of ``grain`` tokens, rounded up. The linear program picks
patterns (how many pieces of each class one sequence holds) so that all pieces
find room in the fewest sequences. It starts from one pattern for each class;
a knapsack by dynamic programming prices the next column from the duals. The
whole parts of the solution are kept, what remains is packed greedily.
"""

from __future__ import annotations

import numpy as np

#: Stop where the bound proves the linear program this close to its optimum.
GAP = 2e-4


def _knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of classes within ``room``: its value and counts."""
    use = np.flatnonzero(value > 1e-12)
    order = use[np.argsort(size[use], kind="stable")]
    v, s = value[order], size[order]
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    fit = np.searchsorted(s, np.arange(room + 1), side="right")
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        if n := fit[r]:
            total = best[r - s[:n]] + v[:n]
            k = int(total.argmax())
            if total[k] > best[r] + 1e-12:
                best[r], took[r] = total[k], k
    counts, r = np.zeros(len(value)), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            counts[order[took[r]]] += 1
            r -= s[took[r]]
    return float(best[room]), counts


def solve(demand: np.ndarray, size: np.ndarray, room: int, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used; all demand is covered exactly or more. Sizes are in grains."""
    n = len(demand)
    if n == 0:
        return np.zeros((0, 0), int), np.zeros(0, int)
    columns = np.diag(room // size).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand.astype(float)
    cost = np.ones(n)  # surplus columns cost nothing
    for _ in range(rounds):
        dual = cost @ inverse
        if dual.min() < -1e-9:  # a surplus column enters
            entering, price = np.zeros(n), 0.0
            entering[int(dual.argmin())] = -1.0
        else:
            worth, entering = _knapsack(dual, size, room)
            price = 1.0
            if worth <= 1 + GAP:
                break
        step = inverse @ entering
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out], cost[out] = entering, price
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        x -= step * ratio[out]
        x[out] = ratio[out]
    real = (cost > 0) & (x >= 1)
    patterns, times = columns[:, real].T.round().astype(int), np.floor(x[real] + 1e-9).astype(int)
    left = demand - (times @ patterns if len(times) else 0)
    extra = _greedy(np.maximum(left, 0), size, room)
    if extra:
        patterns = np.concatenate([patterns.reshape(-1, n), np.array([p for p, _ in extra])])
        times = np.concatenate([times, [t for _, t in extra]])
    return patterns, times.astype(int)


def _greedy(left: np.ndarray, size: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Largest first into the emptiest fit, for the few pieces that rounding leaves."""
    left, out, order = left.astype(int).copy(), [], np.argsort(-size)
    while left.any():
        pattern, free = np.zeros(len(left), int), room
        for k in order:
            take = min(int(left[k]), free // int(size[k]))
            pattern[k], free = take, free - take * int(size[k])
            if not free:
                break
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= pattern * times
        out.append((pattern, times))
    return out
