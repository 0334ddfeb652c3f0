"""Draws of a dish's tables in a Pitman-Yor restaurant, given all others: one step of a blocked Gibbs sampler.

All customers of a dish leave and are seated anew. With n customers and t tables, the seatings of the dish have the
weight S(n, t) (b + d) (b + 2 d) .. (b + (t - 1) d) p ** (t - 1): S is the generalised Stirling number for discount d,
b the strength and d times the other dishes' tables, p the parent's probability of the dish. This is the distribution
that removing and reseating customers one by one, again and again, comes to. Ratios of S are exact up to ``EXACT``
customers; beyond, they follow from the numbers' generating function (1 - (1 - x) ** d) ** t, and from ``WIDE`` tables
on the draw is normal around the most likely number.
"""

from __future__ import annotations

import numpy as np

EXACT = 256
WIDE = 96
_CELLS = 2_000_000


class Seating:
    def __init__(self, d: float):
        self.d = d
        size = EXACT + 1
        log = np.full((size, size), -np.inf)  # [customers, tables]
        log[0, 0] = 0
        tables = np.arange(size)
        for n in range(1, size):
            # One of the n customers alone at a new table, or at a table of the others.
            log[n, 1:] = np.logaddexp(log[n - 1, :-1], np.log(np.maximum(n - 1 - d * tables[1:], 1e-300)) + log[n - 1, 1:])
        with np.errstate(invalid="ignore"):
            self.steps = log[:, 1:] - log[:, :-1]  # [n, t]: from t to t + 1 tables
        self.steps[~np.isfinite(self.steps)] = -np.inf
        y = np.concatenate((np.logspace(-300, -3, 3000), np.linspace(1e-3, 1 - 1e-9, 4000)[1:]))  # 1 - x
        self.ratio = np.log((1 - y) * d) + (d - 1) * np.log(y) - np.log1p(-(y**d))  # log of customers a table
        self.part = np.log1p(-(y**d))
        order = np.argsort(self.ratio)
        self.ratio, self.part = self.ratio[order], self.part[order]

    def step(self, n: np.ndarray, t: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log of the weight of t + 1 tables over that of t."""
        own = np.full(np.broadcast(n, t).shape, -np.inf)
        n, t = np.broadcast_to(n, own.shape), np.broadcast_to(t, own.shape)
        few, more = n <= EXACT, (n > EXACT) & (t < n)
        own[few] = self.steps[n[few].astype(int), np.minimum(t[few], EXACT - 1).astype(int)]
        own[more] = np.interp(np.log(n[more] / (t[more] + 0.5)), self.ratio, self.part) - np.log(self.d * t[more])
        return own + np.log((b + self.d * t) * p)

    def draw(self, n: np.ndarray, b: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Tables of each dish, from uniform ``u``."""
        out = np.minimum(n, 1).astype(np.int64)
        p = np.maximum(p, 1e-300)
        edges = [2, 3, 4, 6, 9, 13, 19, 28, 41, 64]
        for low, high in zip(edges, edges[1:], strict=False):
            some = np.flatnonzero((n >= low) & (n < high))
            self._count(out, some, high - 1, n, b, p, u)
        some = np.flatnonzero(n >= edges[-1])
        if len(some):
            mode, slope = self._mode(n[some], b[some], p[some])
            near = mode <= WIDE / 3
            self._count(out, some[near], WIDE, n, b, p, u)
            far = some[~near]
            mode, spread = mode[~near], np.sqrt(1 / np.maximum(slope[~near], 1e-12))
            out[far] = np.clip(np.rint(mode + 0.5 + spread * _normal(u[far])), 1, n[far])
        return out

    def _count(self, out: np.ndarray, some: np.ndarray, most: int, n: np.ndarray, b: np.ndarray, p: np.ndarray, u: np.ndarray) -> None:
        """Draws by the sums of the weights of 1 .. ``most`` tables."""
        t = np.arange(1, most)
        for i in range(0, len(some), max(1, _CELLS // most)):
            rows = some[i : i + max(1, _CELLS // most)]
            log = np.zeros((len(rows), most))
            np.cumsum(self.step(n[rows, None], t, b[rows, None], p[rows, None]), axis=1, out=log[:, 1:])
            weight = np.exp(log - log.max(axis=1, keepdims=True))
            total = np.cumsum(weight, axis=1)
            out[rows] = 1 + (total < u[rows, None] * total[:, -1:]).sum(axis=1)

    def _mode(self, n: np.ndarray, b: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most likely numbers of tables, and how fast the log of the steps falls there."""
        low, high = np.ones(len(n)), n.astype(np.float64)
        for _ in range(40):
            middle = np.floor((low + high) / 2)
            up = self.step(n, middle, b, p) > 0
            low, high = np.where(up, middle, low), np.where(up, high, middle)
        by = np.maximum(1, np.floor(low / 16))
        before = np.maximum(low - by, 1)
        after = np.minimum(low + by, n - 1)
        fall = self.step(n, before, b, p) - self.step(n, after, b, p)
        return low, fall / np.maximum(after - before, 1)


def _normal(u: np.ndarray) -> np.ndarray:
    """Normal deviates at the quantiles ``u``, by a logistic-like rational approximation (error under 5e-4)."""
    p = np.clip(np.minimum(u, 1 - u), 1e-12, 0.5)
    t = np.sqrt(-2 * np.log(p))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    return np.where(u < 0.5, -x, x)
