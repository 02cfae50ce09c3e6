"""Boundaries of combined polygons, cell by cell of a plane that is cut until few edges are left in a cell.

Sides (two layers) are unions of owners (polygons, even-odd over their rings).  A cell needs an owner's edges in it and to the
right of it, where a ray from the cell meets them; an owner without an edge in the cell covers it or misses it as a whole, and
a covered side has no edges there.  The pieces of original edges along which the rule changes are the boundary: cells add no
edges of their own, so neighbours' pieces join where a cell's border cuts an edge.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from tessera.functions.kernels import simplify_ring

Cell = tuple[float, float, float, float]
Rule = Callable[[np.ndarray], np.ndarray]
DIGITS, FEW, PAD, TOLERANCE = 9, 48, 1e-6, 1e-9


def oriented(rings: list[np.ndarray]) -> np.ndarray:
    """Edges (x1, y1, x2, y2) on the grid of ``DIGITS``, from the smaller end to the larger, none without length."""
    e = np.concatenate([np.zeros((0, 4)), *(np.concatenate([r[:-1], r[1:]], axis=1) for r in rings)]).round(DIGITS) + 0.0
    swap = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    e[swap] = e[swap][:, [2, 3, 0, 1]]
    return e[(e[:, :2] != e[:, 2:]).any(axis=1)]


def in_reach(edges: np.ndarray, cell: Cell) -> tuple[np.ndarray, np.ndarray]:
    """Which edges a ray to the right from in the cell may meet, and which of those may touch the cell."""
    w, s, e, n = cell
    near = (edges[:, 2] >= w - PAD) & (np.maximum(edges[:, 1], edges[:, 3]) >= s - PAD) & (np.minimum(edges[:, 1], edges[:, 3]) <= n + PAD)
    return near, near & (edges[:, 0] <= e + PAD)


def _right_of(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(points, edges): does a ray to the right from the point cross the edge?"""
    x, y = points[:, :1], points[:, 1:]
    x1, y1, x2, y2 = edges.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def covers(edges: np.ndarray, cell: Cell) -> bool:
    """Of a polygon without an edge in the cell: does it cover the cell?"""
    return bool(_right_of(np.array([[(cell[0] + cell[2]) / 2, (cell[1] + cell[3]) / 2]]), edges).sum() % 2)


def _meetings(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, point): where different edges cross, touch or overlap; both edges of a pair get the very same point."""
    at, found = [], []
    d = edges[:, 2:] - edges[:, :2]
    size = np.sqrt((d * d).sum(axis=1))
    for low in range(0, len(edges), 256):
        i, j = np.nonzero(np.arange(len(edges))[None] > np.arange(low, min(low + 256, len(edges)))[:, None])
        i += low
        apart = (edges[i, 0] > edges[j, 2]) | (edges[j, 0] > edges[i, 2])
        for a, b in ((i, j), (j, i)):
            apart |= np.minimum(edges[a, 1], edges[a, 3]) > np.maximum(edges[b, 1], edges[b, 3])
        i, j = i[~apart], j[~apart]
        gap = edges[j, :2] - edges[i, :2]
        cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        flat = np.abs(cross) <= 1e-12 * size[i] * size[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * d[j, 1] - gap[:, 1] * d[j, 0]) / cross
            u = (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / cross
        hit = ~flat & (t >= -TOLERANCE / size[i]) & (t <= 1 + TOLERANCE / size[i]) & (u >= -TOLERANCE / size[j]) & (u <= 1 + TOLERANCE / size[j])
        p = edges[i[hit], :2] + t[hit, None] * d[i[hit]]
        at += [i[hit], j[hit]]
        found += [p, p]
        # Along one line: the ends of either that lie on the other.
        line = flat & (np.abs(gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) <= TOLERANCE * size[i])
        for a, b in ((i[line], j[line]), (j[line], i[line])):
            for end in (edges[b, :2], edges[b, 2:]):
                s = ((end - edges[a, :2]) * d[a]).sum(axis=1) / size[a] ** 2
                on = (s > 0) & (s < 1)
                at.append(a[on])
                found.append(end[on])
    return np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros((0, 2)), *found]).round(DIGITS)


def _pieces(edges: np.ndarray, cell: Cell) -> np.ndarray:
    """The different edges, split at their meetings and at the cell's border, that have their middle in the half-open cell."""
    edges = np.unique(edges, axis=0)
    at, points = _meetings(edges)
    at, points = [at, *(np.arange(len(edges)),) * 2], [points, edges[:, :2], edges[:, 2:]]
    for axis in (0, 1):
        a, b, other = edges[:, axis], edges[:, axis + 2], 1 - axis
        for c in (cell[axis], cell[axis + 2]):
            cut = np.flatnonzero((np.minimum(a, b) < c) & (np.maximum(a, b) > c))
            p = np.empty((len(cut), 2))
            p[:, axis] = c
            p[:, other] = (edges[cut, other] + (c - a[cut]) * (edges[cut, other + 2] - edges[cut, other]) / (b[cut] - a[cut])).round(DIGITS)
            at.append(cut)
            points.append(p)
    at, points = np.concatenate(at), np.concatenate(points) + 0.0
    d = edges[at, 2:] - edges[at, :2]
    order = np.lexsort((((points - edges[at, :2]) * d).sum(axis=1), at))
    at, points = at[order], points[order]
    cut = np.concatenate([points[:-1], points[1:]], axis=1)[at[:-1] == at[1:]]
    cut = cut[(cut[:, :2] != cut[:, 2:]).any(axis=1)]
    x, y = (cut[:, 0] + cut[:, 2]) / 2, (cut[:, 1] + cut[:, 3]) / 2
    cut = cut[(x >= cell[0]) & (x < cell[2]) & (y >= cell[1]) & (y < cell[3])]
    swap = (cut[:, 0] > cut[:, 2]) | ((cut[:, 0] == cut[:, 2]) & (cut[:, 1] > cut[:, 3]))
    cut[swap] = cut[swap][:, [2, 3, 0, 1]]
    return np.unique(cut, axis=0)


def _directed(edges: np.ndarray, owner: np.ndarray, side: np.ndarray, here: np.ndarray, cell: Cell, covered: np.ndarray, rule: Rule) -> np.ndarray:
    cut = _pieces(edges[here], cell)
    along = cut[:, 2:] - cut[:, :2]
    size = np.sqrt((along**2).sum(axis=1))[:, None]
    step = np.stack([-along[:, 1], along[:, 0]], axis=1) / size * np.minimum(size * 1e-3, 10.0 ** (2 - DIGITS))
    order = np.argsort(owner, kind="stable")
    edges, owner = edges[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    sides = side[owner[first]]
    held = []
    for way in (step, -step):
        member = np.tile(covered, (len(cut), 1))
        for low in range(0, len(cut), 1024):
            odd = np.add.reduceat(_right_of(((cut[:, :2] + cut[:, 2:]) / 2 + way)[low : low + 1024], edges), first, axis=1, dtype=np.int64) % 2 == 1
            for k in (0, 1):
                member[low : low + 1024, k] |= odd[:, sides == k].any(axis=1)
        held.append(rule(member))
    left, right = held
    return np.concatenate([cut[left & ~right], cut[right & ~left][:, [2, 3, 0, 1]]])


def _halves(edges: np.ndarray, here: np.ndarray, cell: Cell) -> tuple[Cell, Cell] | None:
    """The cell cut in two so that either half has clearly fewer edges; None if no cut does that."""
    e = edges[here]
    for axis in sorted((0, 1), key=lambda k: cell[k] - cell[k + 2]):
        cut = round(float(np.median(np.clip(e[:, [axis, axis + 2]], cell[axis], cell[axis + 2]))), DIGITS)
        if not cell[axis] < cut < cell[axis + 2]:
            continue
        low, high = list(cell), list(cell)
        low[axis + 2] = high[axis] = cut
        if max(in_reach(e, c)[1].sum() for c in (low, high)) <= 0.85 * len(e):
            return tuple(low), tuple(high)
    return None


def boundary(edges: np.ndarray, owner: np.ndarray, side: np.ndarray, cell: Cell, rule: Rule, covered: tuple[bool, bool] = (False, False), few: int = FEW) -> np.ndarray:
    """The directed pieces (n, 4) of the result's boundary in the half-open cell, the result on their left.

    ``owner`` numbers the polygon of each edge, ``side`` (0 or 1) the layer of each owner; ``covered``: layers that cover the
    cell by owners that are not given.
    """
    out, todo = [np.zeros((0, 4))], [(edges, owner, cell, np.array(covered))]
    while todo:
        edges, owner, cell, covered = todo.pop()
        near, here = in_reach(edges, cell)
        edges, owner, here = edges[near], owner[near], here[near]
        present = np.zeros(len(side), bool)
        present[owner[here]] = True
        away = ~present[owner]
        if away.any():
            centre = np.array([[(cell[0] + cell[2]) / 2, (cell[1] + cell[3]) / 2]])
            hits = np.bincount(owner[away], _right_of(centre, edges[away])[0], len(side)).astype(np.int64) % 2 == 1
            covered = covered | np.array([hits[side == k].any() for k in (0, 1)])
        stay = ~away & ~covered[side[owner]]
        edges, owner, here = edges[stay], owner[stay], here[stay]
        states = [[True] if covered[k] else [False, True] if (side[owner] == k).any() else [False] for k in (0, 1)]
        if len(set(rule(np.array([(p, q) for p in states[0] for q in states[1]])).tolist())) < 2:
            continue
        halves = _halves(edges, here, cell) if here.sum() > few else None
        if halves:
            todo += [(edges, owner, c, covered) for c in halves]
        else:
            out.append(_directed(edges, owner, side, here, cell, covered, rule))
    return np.concatenate(out)


def corners(ring: np.ndarray) -> np.ndarray:
    """The ring from its smallest corner on, without the places where cells cut its edges (which rounding moved a little)."""
    p = ring[:-1]
    ring = np.roll(p, -np.lexsort((p[:, 1], p[:, 0]))[0], axis=0)
    return simplify_ring(np.concatenate([ring, ring[:1]]), 2 * TOLERANCE)


def joined(lines: list[np.ndarray], cell: Cell) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(closed rings, open lines) that directed lines form in a cell; lines go on outside it where they end on its border.

    At a place that several rings touch, the sharpest turn to the left keeps them apart.
    """
    w, s, e, n = cell
    edge = lambda p: p[0] in (w, e) or p[1] in (s, n)
    ways: dict[tuple, list[np.ndarray]] = {}
    for line in lines:
        ways.setdefault(tuple(line[0].tolist()), []).append(line)
    rings, open_ = [], []
    for start in sorted(ways, key=lambda p: not edge(p)):  # what comes in over the border first
        while ways.get(start):
            path, at = [], start
            while ways.get(at):
                k = 0
                if path and len(ways[at]) > 1:
                    came = path[-1][-2] - path[-1][-1]
                    back = math.atan2(came[1], came[0])
                    k = max(range(len(ways[at])), key=lambda j: (math.atan2(*(ways[at][j][1] - ways[at][j][0])[::-1]) - back) % (2 * math.pi))
                path.append(ways[at].pop(k))
                at = tuple(path[-1][-1].tolist())
                if at == start or edge(at):
                    break
            line = np.concatenate([path[0], *(p[1:] for p in path[1:])])
            if edge(start) or edge(at):
                open_.append(line)
            elif at == start and len(line) > 3:
                rings.append(line)
    return rings, open_
