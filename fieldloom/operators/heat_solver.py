"""Heat on a network: the inverse Laplace transform of resolvents, in numpy.

exp(-t M^-1 S) M^-1 s is a sum over a parabolic contour of solutions x of (z M + S) x = s, for some z. Mesh nodes inside edges form chains.
A chain is eliminated on its own, for all z: what is left of it are three numbers for its ends, and what its sources give to the ends. The
system of the ends (junctions) is solved densely if small, else by blocks of breadth-first levels, which only touch their
neighbours. Then each chain gets its own heat back from that of its ends. Short mesh segments cost no steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

POINTS = 28  # of the upper half of the contour: errors near 1e-12 of the largest value
DENSE, HELD = 256, 1 << 18  # junctions solved densely; complex numbers of an array held at once


def contour(t: float, n: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights: f(t) is the real part of the weighted sum of the transform (Weideman and Trefethen, 2007)."""
    step, mu = 3 / n, np.pi * n / (12 * t)
    u = (np.arange(n) + 0.5) * step
    z = mu * (1j * u + 1) ** 2
    return z, step * np.exp(z * t) * 2j * mu * (1j * u + 1) / (np.pi * 1j)


def contours(times: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """The points and weights of all times, one after the other."""
    z, weight = zip(*map(contour, times), strict=True)
    return np.concatenate(z), np.concatenate(weight)


def summed(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(..., points) to (..., times)."""
    return (x * weight).real.reshape(*x.shape[:-1], -1, POINTS).sum(axis=-1)


@dataclass
class Chains:
    """Chains side by side, of up to `most` inner nodes each, eliminated for all z; arrays are (inner node, chain, z)."""

    k: np.ndarray  # (chain, most + 1): conductances, zero beyond the last
    count: np.ndarray  # inner nodes
    along: np.ndarray  # (most - 1, chain, 1)
    f: np.ndarray
    local: np.ndarray  # of the inverse with both ends held at zero
    alpha: np.ndarray  # what a unit at the first end gives to the inner nodes
    beta: np.ndarray

    @classmethod
    def of(cls, sizes: list[np.ndarray], z: np.ndarray) -> Chains:
        """Chains from the lengths of their segments."""
        n, count = len(sizes), np.array([len(x) - 1 for x in sizes])
        most = int(count.max())
        length = np.full((n, most + 1), np.inf)
        for i, x in enumerate(sizes):
            length[i, : len(x)] = x
        k, there = 1 / length, (np.arange(most) < count[:, None]).T
        left, right = k[:, :-1].T, np.where(there, k[:, 1:].T, 0.0)
        mass = np.where(there, (length[:, :-1] + length[:, 1:]).T / 2, 1.0)
        d = np.where(there[..., None], z * mass[..., None] + (left + right)[..., None], 1.0)
        along = np.where(there[1:], k[:, 1:-1].T, 0.0)[..., None]
        f, back, alpha, beta = d.copy(), d.copy(), np.zeros_like(d), np.zeros_like(d)
        for i in range(1, most):
            f[i] -= along[i - 1] ** 2 / f[i - 1]
        for i in range(most - 2, -1, -1):
            back[i] -= along[i] ** 2 / back[i + 1]
        alpha[0] = left[0][:, None] / back[0]
        for i in range(1, most):
            alpha[i] = alpha[i - 1] * along[i - 1] / back[i]
        ends = np.zeros((most, n, 1))
        ends[count - 1, np.arange(n), 0] = k[np.arange(n), count]
        beta[-1] = ends[-1] / f[-1]
        for i in range(most - 2, -1, -1):
            beta[i] = (ends[i] + along[i] * beta[i + 1]) / f[i]
        return cls(k, count, along, f, 1 / (f + back - d), alpha, beta)

    def ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chain, z): what the ends are to themselves and to one another once the inner nodes are gone."""
        every = np.arange(len(self.count))
        first, last = self.k[:, :1], self.k[every, self.count][:, None]
        return first * (1 - self.alpha[0]), -first * self.beta[0], last * (1 - self.beta[self.count - 1, every])

    def driven(self, chain: np.ndarray, given: np.ndarray) -> np.ndarray:
        """(inner node, row, z): heat of inner nodes with both ends held at zero, from sources (inner node, row) of a chain for each row."""
        f, along = self.f[:, chain], self.along[:, chain]
        p = np.repeat(given.astype(complex)[..., None], f.shape[2], axis=2)
        for i in range(1, len(p)):
            p[i] += along[i - 1] / f[i - 1] * p[i - 1]
        p[-1] /= f[-1]
        for i in range(len(p) - 2, -1, -1):
            p[i] = (p[i] + along[i] * p[i + 1]) / f[i]
        return p

    def drives(self, chain: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, z): what driven heat gives to either end."""
        rows = np.arange(len(chain))
        return self.k[chain, :1] * p[0], self.k[chain, self.count[chain]][:, None] * p[self.count[chain] - 1, rows]


def batches(counts: np.ndarray, points: int) -> Iterator[np.ndarray]:
    """Places of chains with about as many inner nodes, by powers of two, few enough to be held at once."""
    grade = np.ceil(np.log2(np.maximum(counts, 1))).astype(int)
    for g in np.unique(grade):
        at = np.flatnonzero(grade == g)
        few = max(1, HELD // (points << int(g)))
        for i in range(0, len(at), few):
            yield at[i : i + few]


def _levels(n: int, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Junctions by breadth-first distance from an end of each piece; edges join equal or neighbouring levels only."""
    order = np.argsort(np.concatenate([a, b]), kind="stable")
    to = np.concatenate([b, a])[order]
    start = np.searchsorted(np.concatenate([a, b])[order], np.arange(n + 1))

    def walk(root: int, seen: np.ndarray) -> list[np.ndarray]:
        found, front = [], np.array([root])
        seen[root] = True
        while len(front):
            found.append(front)
            near = np.unique(np.concatenate([to[start[i] : start[i + 1]] for i in front] or [np.empty(0, int)]))
            front = near[~seen[near]]
            seen[front] = True
        return found

    out, done = [], np.zeros(n, bool)
    for root in range(n):
        if not done[root]:
            far = walk(root, done.copy())[-1][0]  # from a far end levels are narrow
            out += walk(int(far), done)
    return out


class _Junctions:
    """The junction system of one z: solutions, and the inverse at pairs of neighbours."""

    def __init__(self, n: int, levels: list[np.ndarray]):
        self.levels, self.level, self.place = levels, np.zeros(n, int), np.zeros(n, int)
        for i, nodes in enumerate(levels):
            self.level[nodes], self.place[nodes] = i, np.arange(len(nodes))

    def factor(self, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> None:
        sizes = [len(x) for x in self.levels]
        diag = [np.zeros((m, m), complex) for m in sizes]
        self.up = [np.zeros((m, k), complex) for m, k in zip(sizes, sizes[1:])]
        gap = self.level[col] - self.level[row]
        order = np.argsort(self.level[row], kind="stable")
        bounds = np.searchsorted(self.level[row][order], np.arange(len(sizes) + 1))
        for i in range(len(sizes)):
            at = order[bounds[i] : bounds[i + 1]]
            for to, into in ((0, diag[i]), (1, self.up[i] if i + 1 < len(sizes) else None)):
                hit = at[gap[at] == to]
                if len(hit):
                    np.add.at(into, (self.place[row[hit]], self.place[col[hit]]), value[hit])
        self.inverse = []
        for i, d in enumerate(diag):
            if i:
                d = d - self.up[i - 1].T @ self.inverse[-1] @ self.up[i - 1]
            self.inverse.append(np.linalg.inv(d))

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        y = []
        for i, nodes in enumerate(self.levels):
            y.append(rhs[nodes] - (self.up[i - 1].T @ (self.inverse[i - 1] @ y[-1]) if i else 0))
        out = np.zeros_like(rhs)
        for i in range(len(y) - 1, -1, -1):
            right = y[i] - (self.up[i] @ out[self.levels[i + 1]] if i + 1 < len(y) else 0)
            out[self.levels[i]] = self.inverse[i] @ right
        return out

    def selected(self) -> None:
        """Blocks of the inverse on and next to the diagonal."""
        self.on, self.next = list(self.inverse), [None] * len(self.up)
        for i in range(len(self.up) - 1, -1, -1):
            self.next[i] = -self.inverse[i] @ self.up[i] @ self.on[i + 1]
            self.on[i] = self.inverse[i] - self.next[i] @ self.up[i].T @ self.inverse[i]

    def entries(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The inverse at neighbours a and b, after selected()."""
        swap = self.level[a] > self.level[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = np.zeros(len(a), complex)
        for i in np.unique(self.level[a]):
            at = np.flatnonzero(self.level[a] == i)
            same = self.level[b[at]] == i
            for part, block in ((at[same], self.on[i]), (at[~same], self.next[i] if i < len(self.next) else None)):
                if len(part):
                    out[part] = block[self.place[a[part]], self.place[b[part]]]
        return out


def solve(
    a: np.ndarray, b: np.ndarray, ends: tuple[np.ndarray, np.ndarray, np.ndarray], mass: np.ndarray, sources: np.ndarray, z: np.ndarray, own: bool = False
) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Solutions (junctions, keys, z) from sources (junctions, keys, z); if own, the inverse at each junction (junctions, z) and between the
    ends of each chain (chains, z) as well. Chains lead from a to b, with ends (chains, z) each."""
    n = len(mass)
    junctions = _Junctions(n, _levels(n, a, b) if n > DENSE else [np.arange(n)])
    every = np.arange(n)
    row, col = np.concatenate([every, a, b, a, b]), np.concatenate([every, a, b, b, a])
    out = np.zeros(sources.shape, complex)
    self_heat, cross = (np.zeros((n, len(z)), complex), np.zeros((len(a), len(z)), complex)) if own else (None, None)
    for i, at in enumerate(z):
        uu, uv, vv = (e[:, i] for e in ends)
        junctions.factor(row, col, np.concatenate([at * mass, uu, vv, uv, uv]))
        out[:, :, i] = junctions.solve(sources[:, :, i])
        if own:
            junctions.selected()
            self_heat[:, i], cross[:, i] = junctions.entries(every, every), junctions.entries(a, b)
    return out, self_heat, cross
