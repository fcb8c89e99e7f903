"""Unions of polygons, and points against many edges.

Edges are kept by slabs of equal height, so that a point meets only the edges that cross its slab; distances to edges are searched
through the boxes of runs of edges.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

_RUN, _PAIRS = 32, 1 << 20  # edges of a run; pairs of points and edges compared at once
Ring = tuple[tuple[float, float], ...]


class Edges:
    """The edges of several polygons, for questions about many points at once."""

    def __init__(self, polygons: tuple[tuple[Ring, ...], ...]):
        rows = [(*p, *q, i) for i, polygon in enumerate(polygons) for ring in polygon for p, q in zip(ring, (*ring[1:], *ring[:1]), strict=True)]
        self.ax, self.ay, self.bx, self.by = (np.array([float(r[k]) for r in rows]) for k in range(4))
        self.polygon, self.polygons = np.array([r[4] for r in rows]), len(polygons)
        low, high = np.minimum(self.ay, self.by), np.maximum(self.ay, self.by)
        self.y0, n = low.min(), max(1, len(rows))
        self.step = max(high.max() - self.y0, 1e-300) / n
        first, last = self._slab(low, n), self._slab(high, n)
        span = last - first + 1
        edge = np.repeat(np.arange(n), span)
        slab = np.repeat(first, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        order = np.argsort(slab, kind="stable")
        self.held, self.start = edge[order], np.searchsorted(slab[order], np.arange(n + 1))

    def _slab(self, y: np.ndarray, n: int) -> np.ndarray:
        return np.clip(np.floor((y - self.y0) / self.step), 0, n - 1).astype(np.int64)

    def covers(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each point is on an edge, or inside one of the polygons by the parity of its own edges; never where a coordinate is missing."""
        out = np.zeros(len(x), bool)
        known = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        slab = self._slab(y[known], len(self.ax))
        size = self.start[slab + 1] - self.start[slab]
        ends = np.cumsum(size)
        begin = 0
        while begin < len(known):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _PAIRS)))
            n = size[begin:stop]
            at = np.repeat(known[begin:stop], n)
            e = self.held[np.repeat(self.start[slab[begin:stop]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            ax, ay, bx, by, px, py = self.ax[e], self.ay[e], self.bx[e], self.by[e], x[at], y[at]
            cross = (px - ax) * (by - ay) - (py - ay) * (bx - ax)
            inside = (px >= np.minimum(ax, bx)) & (px <= np.maximum(ax, bx)) & (py >= np.minimum(ay, by)) & (py <= np.maximum(ay, by))
            out[at[(cross == 0) & inside]] = True
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
            which, times = np.unique(at[hit] * self.polygons + self.polygon[e[hit]], return_counts=True)
            out[which[times % 2 == 1] // self.polygons] = True
            begin = stop
        return out

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distance of each point to the nearest edge; nan where a coordinate is missing."""
        out = np.full(len(x), np.nan)
        known = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        cuts = np.arange(0, len(self.ax), _RUN)
        low = [np.minimum.reduceat(np.minimum(a, b), cuts) for a, b in ((self.ax, self.bx), (self.ay, self.by))]
        high = [np.maximum.reduceat(np.maximum(a, b), cuts) for a, b in ((self.ax, self.bx), (self.ay, self.by))]
        few = max(1, _PAIRS // (8 * len(cuts)))
        for begin in range(0, len(known), few):
            at = known[begin : begin + few]
            p = x[at][:, None], y[at][:, None]
            nearest = np.hypot(*(np.maximum(0, np.maximum(lo - v, v - hi)) for lo, hi, v in zip(low, high, p, strict=True)))
            ready = np.hypot(p[0] - self.ax[cuts], p[1] - self.ay[cuts]).min(axis=1)  # to the first vertex of a run
            row, run = np.nonzero(nearest <= ready[:, None])
            e = np.minimum(run[:, None] * _RUN + np.arange(_RUN), len(self.ax) - 1)
            px, py = p[0][row], p[1][row]
            dx, dy = self.bx[e] - self.ax[e], self.by[e] - self.ay[e]
            length = dx * dx + dy * dy
            t = np.clip(((px - self.ax[e]) * dx + (py - self.ay[e]) * dy) / np.where(length > 0, length, 1.0), 0, 1)
            d = np.hypot(px - self.ax[e] - t * dx, py - self.ay[e] - t * dy).min(axis=1)
            best = np.full(len(at), np.inf)
            np.minimum.at(best, row, d)
            out[at] = best
        return out


def _meetings(edges: Edges) -> dict[int, dict[float, tuple[float, float]]]:
    """For each edge the places (0 to 1) where edges of other polygons cross, touch or begin, with one point for both."""
    found: dict[int, dict[float, tuple[float, float]]] = defaultdict(dict)
    ax, ay, bx, by = edges.ax, edges.ay, edges.bx, edges.by
    x0, x1, y0, y1 = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
    order = np.argsort(x0, kind="stable")
    sorted_x0 = x0[order]
    for k, i in enumerate(order):
        others = order[k + 1 : np.searchsorted(sorted_x0, x1[i], "right")]
        others = others[(edges.polygon[others] != edges.polygon[i]) & (y0[others] <= y1[i]) & (y1[others] >= y0[i])]
        for j in others.tolist():
            a, b, c, d = (ax[i], ay[i]), (bx[i], by[i]), (ax[j], ay[j]), (bx[j], by[j])
            touched = False
            for e, (p, q), ends in ((i, (a, b), (c, d)), (j, (c, d), (a, b))):
                size = (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2
                for r in ends:  # an end of the other edge on this one
                    cross = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
                    t = ((r[0] - p[0]) * (q[0] - p[0]) + (r[1] - p[1]) * (q[1] - p[1])) / size if size else -1.0
                    if abs(cross) <= 1e-12 * size and 0 <= t <= 1:
                        touched = True
                        if 0 < t < 1:
                            found[e][t] = (float(r[0]), float(r[1]))
            below = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if touched or below == 0:
                continue
            t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / below
            u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / below
            if 0 < t < 1 and 0 < u < 1:
                point = (float(a[0] + t * (b[0] - a[0])), float(a[1] + t * (b[1] - a[1])))
                found[int(i)][t] = found[j][u] = point
    return found


def union(polygons: tuple[tuple[Ring, ...], ...]) -> tuple[tuple[Ring, ...], ...]:
    """Polygons without common area that cover what any of the given ones covers: outer rings run counterclockwise, holes
    follow theirs. Edges are cut where they meet; a piece stays if one of its sides is covered and the other is not."""
    edges = Edges(polygons)
    met, pieces = _meetings(edges), set()
    for i in range(len(edges.ax)):
        points = [(float(edges.ax[i]), float(edges.ay[i])), *(p for _, p in sorted(met[i].items())), (float(edges.bx[i]), float(edges.by[i]))]
        pieces.update((min(p, q), max(p, q)) for p, q in zip(points, points[1:]) if p != q)
    if not pieces:
        return ()
    a, b = (np.array([p[k] for p in pieces]) for k in (0, 1))
    middle, way = (a + b) / 2, b - a
    scale = max(np.ptp(edges.ax), np.ptp(edges.ay))
    off = np.stack([-way[:, 1], way[:, 0]], axis=1) / np.hypot(way[:, 0], way[:, 1])[:, None] * 1e-9 * scale
    left, right = (edges.covers(*(middle + s * off).T) for s in (1, -1))
    leaving: dict[tuple[float, float], list] = defaultdict(list)
    for p, q, l, r in zip(map(tuple, a.tolist()), map(tuple, b.tolist()), left, right, strict=True):
        if l != r:  # the covered side is on the left
            start, end = (p, q) if l else (q, p)
            leaving[start].append(end)
    outer, holes = [], []
    for first in list(leaving):
        while leaving[first]:
            ring, at, to = [first], first, leaving[first].pop()
            while to != first:
                ring.append(to)
                back = math.atan2(at[1] - to[1], at[0] - to[0])
                # the first way on, clockwise from the way back: rings that touch at a point stay apart
                after = max(leaving[to], key=lambda e: (math.atan2(e[1] - to[1], e[0] - to[0]) - back) % (2 * math.pi))
                leaving[to].remove(after)
                at, to = to, after
            area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
            (outer if area > 0 else holes).append((abs(area), tuple(ring)))
    outer.sort()
    made = [[ring] for _, ring in outer]
    for _, hole in holes:  # in the smallest outer ring around it
        p, q = hole[0], hole[1]
        x, y = np.array([(p[0] + q[0]) / 2]), np.array([(p[1] + q[1]) / 2])
        home = next((i for i, (_, ring) in enumerate(outer) if Edges(((ring,),)).covers(x, y)[0]), None)
        if home is not None:
            made[home].append(hole)
    return tuple(tuple(rings) for rings in made)
