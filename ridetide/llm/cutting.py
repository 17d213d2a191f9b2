"""Cutting-stock column generation on a histogram of piece lengths (numpy, bounded by the capacity).

A pattern says how many pieces of each length one sequence holds. The linear program looks for
amounts of patterns that use up the histogram at the least cost; a knapsack program over the dual
prices finds the pattern that would lower the cost most. The matrix has one row per length, at most
``capacity`` of them, whatever the number of documents.
"""

from __future__ import annotations

import numpy as np

Pattern = dict[int, int]


def padded(tokens: int, capacity: int) -> int:
    """Tokens a sequence takes: the capacity, or its own length if that is a power of two."""
    return tokens if tokens and tokens & (tokens - 1) == 0 else capacity


def fill(lengths: np.ndarray, value: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value of every exact total up to ``room``, and the last piece taken."""
    best = np.full(room + 1, -np.inf)
    best[0] = 0
    pick = np.zeros(room + 1, dtype=np.int64)
    fitting = np.searchsorted(lengths, np.arange(room + 1), side="right")
    for total in range(int(lengths[0]), room + 1):
        k = fitting[total]
        values = best[total - lengths[:k]] + value[:k]
        last = int(values.argmax())
        best[total], pick[total] = values[last], last
    return best, pick


def taken(pick: np.ndarray, lengths: np.ndarray, total: int) -> Pattern:
    """The pieces of a filled total: index of the length -> times."""
    pattern: Pattern = {}
    while total > 0:
        last = int(pick[total])
        pattern[last] = pattern.get(last, 0) + 1
        total -= int(lengths[last])
    return pattern


def fullest(lengths: np.ndarray, capacity: int) -> Pattern:
    """The longest piece and what fills its sequence best, longer pieces first."""
    pattern = {len(lengths) - 1: 1}
    room = capacity - int(lengths[-1])
    if room >= lengths[0]:
        best, pick = fill(lengths, lengths * (1 + 1e-3 * lengths / capacity), room)
        for index, times in taken(pick, lengths, int(best.argmax())).items():
            pattern[index] = pattern.get(index, 0) + times
    return pattern


def exhausting(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: each pattern in turn uses up one length, so the matrix is triangular."""
    n = len(lengths)
    matrix, amounts, left = np.zeros((n, n)), np.zeros(n), counts.astype(float)
    live = np.arange(n)
    while len(live):
        pattern = fullest(lengths[live], capacity)
        index = live[list(pattern)]
        times = np.array(list(pattern.values()), dtype=float)
        limit = left[index] / times
        least = int(limit.argmin())
        column, amount = int(index[least]), limit[least]
        left[index] -= amount * times
        left[column] = 0
        matrix[index, column], amounts[column] = times, amount
        live = live[live != column]
    return matrix, amounts


def linear_program(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, tolerance: float = 1e-4, most_columns: int = 2000
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns as columns and their fractional amounts, within ``tolerance`` of the least cost.

    Each sequence costs its padded length plus one, so that of two plans without padding the one
    with fewer sequences wins. ``most_columns`` bounds the work; the amounts are feasible at any time.
    """
    cost = np.array([padded(t, capacity) + 1.0 for t in range(capacity + 1)])
    matrix, amounts = exhausting(lengths, counts, capacity)
    price = cost[(lengths @ matrix).round().astype(int)]
    inverse = np.linalg.inv(matrix)
    least = counts @ lengths * (capacity + 1) / capacity
    for _ in range(most_columns):
        best, pick = fill(lengths, price @ inverse, capacity)
        gain = best[1:] - cost[1:]
        total = int(gain.argmax()) + 1
        objective = price @ amounts
        bound = max(least, objective / max(1.0, (best[1:] / cost[1:]).max()))
        if gain[total - 1] < 1e-7 or objective <= bound * (1 + tolerance):
            break
        pattern = taken(pick, lengths, total)
        column = np.zeros(len(lengths))
        column[list(pattern)] = list(pattern.values())
        step = inverse @ column
        rising = step > 1e-9
        ratio = np.where(rising, amounts / np.where(rising, step, 1), np.inf)
        leaving = int(ratio.argmin())
        amount = ratio[leaving]
        amounts = np.maximum(amounts - amount * step, 0)
        amounts[leaving] = amount
        row = inverse[leaving] / step[leaving]
        step[leaving] -= 1
        inverse -= np.outer(step, row)
        matrix[:, leaving], price[leaving] = column, cost[total]
    return matrix, amounts


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Whole numbers of patterns that use up the histogram exactly: (times, {length: pieces}).

    Amounts of the linear program are rounded down; the few pieces left over, fewer than the
    patterns hold once, are put into fullest patterns of their own.
    """
    lengths = np.array(sorted(n for n, k in counts.items() if k > 0), dtype=np.int64)
    if not len(lengths):
        return []
    left = np.array([counts[int(n)] for n in lengths], dtype=np.int64)
    matrix, amounts = linear_program(lengths, left, capacity)
    whole: list[tuple[int, Pattern]] = []
    for pieces, amount in zip(matrix.round().astype(np.int64).T, np.floor(amounts + 1e-6).astype(np.int64), strict=True):
        used = pieces > 0
        times = int(min(amount, (left[used] // pieces[used]).min()))
        if times:
            left -= times * pieces
            whole.append((times, {int(lengths[i]): int(pieces[i]) for i in np.flatnonzero(used)}))
    while left.any():
        live = np.flatnonzero(left)
        pattern, room = {}, capacity
        for index in live[::-1]:
            fits = int(min(left[index], room // lengths[index]))
            if fits and not pattern:
                fits = 1
                wanted = fullest(lengths[live], capacity)
                if all(left[live[i]] >= k for i, k in wanted.items()):
                    pattern = {int(live[i]): k for i, k in wanted.items()}
                    break
            if fits:
                pattern[int(index)] = fits
                room -= fits * int(lengths[index])
        times = int(min(left[i] // k for i, k in pattern.items()))
        for index, k in pattern.items():
            left[index] -= times * k
        whole.append((times, {int(lengths[i]): k for i, k in pattern.items()}))
    return whole
