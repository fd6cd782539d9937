"""Packings of counted lengths in parts of sequences: a bound that is met almost always, and a guide to whole ones.

A filling may be used any number of times, not only whole ones. The fewest
sequences of such a packing, rounded up, are a lower bound, and the fillings that
it uses most are those that a good whole packing has. It is a linear program with
a row a length and a column a filling; columns are made when they are needed, by a
knapsack over the rows' prices. Its size is that of the lengths, at most capacity,
whatever the number of pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import numpy as np

Filling = tuple[tuple[int, int], ...]

#: Prices are whole multiples of 1 / SCALE in knapsacks and bounds, so that these are exact.
SCALE = 1 << 40


def priced(prices: np.ndarray, x: np.ndarray, n: np.ndarray, capacity: int) -> tuple[int, list[tuple[int, dict[int, int]]]]:
    """(the highest price of a filling, the best fillings around each length with their prices); a filling is counts by row."""
    parts = []
    for i in np.flatnonzero(prices > 0):
        most, k = int(min(n[i], capacity // x[i])), 1
        while most > 0:
            parts.append((i, min(k, most)))
            k, most = 2 * k, most - k
    best, sums = np.zeros(capacity + 1, np.int64), np.empty(capacity + 1, np.int64)
    taken = np.zeros((len(parts), capacity + 1), bool)
    for p, (i, k) in enumerate(parts):
        w = int(k * x[i])
        raised = np.add(best[:-w], k * prices[i], out=sums[w:])
        np.greater(raised, best[w:], out=taken[p, w:])
        np.maximum(raised, best[w:], out=best[w:])
    room, found = capacity - x, [{i: 1} for i in range(len(x))]
    worth = prices + best[room]
    for p in range(len(parts) - 1, -1, -1):
        i, k = int(parts[p][0]), parts[p][1]
        into = taken[p, room]
        for at in np.flatnonzero(into):
            found[at][i] = found[at].get(i, 0) + k
        room = room - into * int(k * x[i])
    return int(best[capacity]), [(int(v), way) for v, way in zip(worth, found, strict=True) if all(m <= n[i] for i, m in way.items())]


class Columns:
    """Fillings as columns of a sparse matrix, counts by row."""

    def __init__(self, rows: int):
        self.rows, self.ways, self.seen = rows, [], set()
        self.at, self.of, self.times, self.pairs, self.products, self.both = ([] for _ in range(6))

    def add(self, ways: Iterable[dict[int, int]]) -> int:
        before = len(self.ways)
        for way in ways:
            key = tuple(sorted(way.items()))
            if key not in self.seen:
                self.seen.add(key)
                j, i, k = len(self.ways), np.array([i for i, _ in key]), np.array([k for _, k in key], float)
                self.ways.append(key)
                self.at.append(i)
                self.times.append(k)
                self.of.append(np.full(len(i), j))
                self.pairs.append((i[:, None] * self.rows + i).ravel())
                self.products.append((k[:, None] * k).ravel())
                self.both.append(np.full(len(i) ** 2, j))
        for name in ("at", "of", "times", "pairs", "products", "both"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        return len(self.ways) - before

    def solve(self, n: np.ndarray, cost: np.ndarray, start: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
        """(how often each filling is used, prices of the rows), by an interior-point method, up to a relative gap.

        `start` are prices under which no filling comes near its cost.
        """
        at, of, times, pairs, products, both = (v[0] for v in (self.at, self.of, self.times, self.pairs, self.products, self.both))
        m, count = self.rows, len(self.ways)
        rows = lambda v: np.bincount(at, times * v[of], m)
        cols = lambda v: np.bincount(of, times * v[at], count)
        y = start
        z = cost - cols(y)
        v = 1 / z
        v *= 1.5 * n.sum() / rows(v).sum()
        s = np.maximum(rows(v) - n, 0.1 * n)
        longest = lambda a, da: min(1.0, 0.98 * float(np.min(np.where(da < 0, -a / np.where(da < 0, da, -1), np.inf))))
        for _ in range(100):  # some 15 to 40 turns
            short = n - rows(v) + s
            mu = (v @ z + s @ y) / (m + count)
            if np.abs(short).sum() <= 1e-6 * n.sum() and v @ z + s @ y <= gap * (cost @ v):
                break
            matrix = np.bincount(pairs, products * (v / z)[both], m * m).reshape(m, m)
            matrix[np.arange(m), np.arange(m)] += s / y
            scale = 1 / np.sqrt(np.diag(matrix))
            matrix *= scale[:, None] * scale
            matrix[np.arange(m), np.arange(m)] += 1e-12
            sides = np.stack([short + rows(v) - s, 1 / y - rows(1 / z)], 1)
            plain, centred = (np.linalg.solve(matrix, sides * scale[:, None]) * scale[:, None]).T

            def step(target: float) -> tuple[np.ndarray, ...]:
                dy = plain + target * centred
                dz = -cols(dy)
                return dy, dz, (target - v * dz) / z - v, (target - s * dy) / y - s

            dy, dz, dv, ds = step(0.0)
            a, b = min(longest(v, dv), longest(s, ds)), min(longest(y, dy), longest(z, dz))
            after = ((v + a * dv) @ (z + b * dz) + (s + a * ds) @ (y + b * dy)) / (m + count)
            dy, dz, dv, ds = step(mu * max((after / mu) ** 2, 0.02))
            a, b = min(longest(v, dv), longest(s, ds)), min(longest(y, dy), longest(z, dz))
            v, s, y, z = v + a * dv, s + a * ds, y + b * dy, z + b * dz
        return v, y


#: Shares of the best prices so far in those that fillings are made by; lengths up to which they are not first grouped by GROUP, and how near these come.
PARTS, FEW, GROUP, NEAR = (0.0, 0.4, 0.8), 100, 4, 2e-3


def solved(x: np.ndarray, n: np.ndarray, capacity: int, goal: int | None, known: Iterable[dict[int, int]] = (), near: float = 0.0) -> tuple[int, Columns, np.ndarray | None, np.ndarray]:
    """(lower bound, columns, how often each is used, prices of the rows) for lengths in falling order.

    Prices under which no filling is over 1 give a bound; the solution's and those
    between them and the best so far make columns, until none is left to make or
    the size is within a share `near` of the bound.
    """
    columns, best, ways = Columns(len(x)), x / capacity, [*known, *({i: int(min(n[i], capacity // x[i]))} for i in range(len(x)))]
    held, lower, gap, trial = float(n @ x) / capacity, -(-int(n @ x) // capacity), 0.1, [best]
    if len(x) > FEW:  # the prices of groups of lengths, each as long as its longest, are near those of lengths
        first = np.arange(0, len(x), GROUP)
        prices = solved(x[first], np.add.reduceat(n, first), capacity, None, (), NEAR)[3]
        trial = [part * best + (1 - part) * np.interp(x, x[first][::-1], prices[::-1]) for part in (0.0, 0.1, 0.3, 0.6, 1.0)]
    size, value = np.inf, None
    while True:
        for prices in trial:
            whole = np.floor(prices * SCALE).astype(np.int64)
            most, found = priced(whole, x, n, capacity)
            ways += [way for v, way in found if v > SCALE or size == np.inf]
            total = sum(int(a) * int(b) for a, b in zip(whole, n, strict=True))
            lower = max(lower, -(-total // max(most, SCALE)))
            if total / max(most, SCALE) > held:
                held, best = total / max(most, SCALE), prices / max(1.0, most / SCALE)
        if goal is not None and (lower > goal or size <= goal) or size <= max(lower + 1e-3, held * (1 + near)):
            break
        fresh, ways = columns.add(ways), []
        if not fresh and gap <= 1e-8:
            break
        gap = gap / 10 if not fresh else 0.02 if size == np.inf else min(gap, max(0.1 * (size - held) / size, 1e-8))
        value, y = columns.solve(n.astype(float), np.ones(len(columns.ways)), 0.9 * best, gap)
        size = float(value.sum())
        trial = [part * best + (1 - part) * y for part in PARTS]
    return lower, columns, value, best


def relaxed(counts: Mapping[int, int], capacity: int, goal: int | None, known: Iterable[Filling] = (), seed: int = 0) -> tuple[int, list[tuple[Filling, float]], list[Filling]]:
    """(a lower bound of the sequences, a packing in parts of sequences, all fillings made so far).

    It ends once the bound is over the goal, or the packing is not; without a
    goal, once the bound is the packing's size rounded up. The bound is exact
    whatever the rounding of doubles. The packing is one of few fillings: costs
    that differ a little, by the seed, leave one corner as the best.
    """
    x = np.array(sorted(counts, reverse=True), np.int64)
    n = np.array([counts[int(v)] for v in x], np.int64)
    row = {int(v): i for i, v in enumerate(x)}
    ways = [{row[v]: k for v, k in way} for way in known if all(k <= counts.get(v, 0) for v, k in way)]
    lower, columns, value, prices = solved(x, n, capacity, goal, ways)
    named = lambda way: tuple((int(x[i]), k) for i, k in way)
    made = list(map(named, columns.ways))
    if value is None or goal is not None and lower > goal:
        return lower, [], made
    cost = 1 + np.random.default_rng(seed).uniform(0, 0.1 / value.sum(), len(columns.ways))
    value, _ = columns.solve(n.astype(float), cost, 0.9 * prices, 1e-9 / len(x))
    used = np.flatnonzero(value > 1e-5)
    if lower < value.sum() - 1e-3:  # the corner's prices are more exact than an inner point's
        matrix = np.zeros((len(used), len(x)))
        for at, j in enumerate(used):
            for i, k in columns.ways[j]:
                matrix[at, i] = k
        whole = np.floor(np.maximum(np.linalg.lstsq(matrix, np.ones(len(used)))[0], 0) * SCALE).astype(np.int64)
        lower = max(lower, -(-sum(int(a) * int(b) for a, b in zip(whole, n, strict=True)) // max(priced(whole, x, n, capacity)[0], SCALE)))
    return lower, [(made[j], float(value[j])) for j in used], made
