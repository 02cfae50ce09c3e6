"""Relations of many pairs of geometries at once: ``kernels.relate`` over arrays, for pairs of plain rings with few corners."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.functions.kernels import EPS, relate, signed_area

#: Corners up to which a ring is compared with others in arrays, and numbers in such an array.
CORNERS, NUMBERS = 33, 1 << 20


def _plain(geoms: pa.ChunkedArray, used: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(of each row the corners of its one ring, with the closing one, 0 for any other geometry; the rows' rings by that number)."""
    all_ = geoms.combine_chunks() if isinstance(geoms, pa.ChunkedArray) else geoms
    all_ = all_.chunk(0) if isinstance(all_, pa.ChunkedArray) else all_
    size, rings = np.zeros(len(all_), np.int64), {}
    parts = all_.field("parts")
    starts, ends = (np.asarray(parts.offsets)[k : len(all_) + k] for k in (0, 1))
    pts = parts.values.field("pts")
    at = np.asarray(pts.offsets)
    kind = np.asarray(all_.field("kind").to_pylist(), object) == "Polygon"
    whole = kind & (ends - starts == 1) & used
    one = np.flatnonzero(whole)
    size[one] = at[starts[one] + 1] - at[starts[one]]
    size[(size < 4) | (size > CORNERS)] = 0
    x, y = (np.asarray(pts.values.field(c)) for c in "xy")
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        places = at[starts[rows]][:, None] + np.arange(n)
        ring = np.stack([x[places], y[places]], axis=2)
        fit = np.isfinite(ring).all(axis=(1, 2)) & (ring[:, 0] == ring[:, -1]).all(axis=1) & ((ring[:, 1:] != ring[:, :-1]).any(axis=2)).all(axis=1)
        size[rows[~fit]] = 0
        rings[n] = (rows[fit], ring[fit])
    return size, rings


def _touch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of rings (n, corners, 2): do their edges share a point?  As ``kernels._touch``."""
    p, r = a[:, :-1, None], (a[:, 1:] - a[:, :-1])[:, :, None]
    q, s = b[:, None, :-1], (b[:, 1:] - b[:, :-1])[:, None]
    side = lambda o, v, w: v[..., 0] * (w - o)[..., 1] - v[..., 1] * (w - o)[..., 0]
    box = (np.minimum(p, p + r) <= np.maximum(q, q + s) + EPS).all(axis=-1) & (np.maximum(p, p + r) + EPS >= np.minimum(q, q + s)).all(axis=-1)
    return (box & (side(p, r, q) * side(p, r, q + s) <= EPS) & (side(q, s, p) * side(q, s, p + r) <= EPS)).any(axis=(1, 2))


def _inside(point: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Of pairs of a point and a ring, the even-odd rule; as ``kernels.inside``."""
    x, y = point[:, :1], point[:, 1:]
    x1, y1, x2, y2 = ring[:, :-1, 0], ring[:, :-1, 1], ring[:, 1:, 0], ring[:, 1:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return hit.sum(axis=1) % 2 == 1


def _convex(rings: np.ndarray) -> np.ndarray:
    """1 for convex rings that turn to the left, -1 to the right, 0 for others."""
    d = rings[:, 1:] - rings[:, :-1]
    e = np.roll(d, -1, axis=1)
    cross, dot = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0], (d * e).sum(axis=2)
    once = np.abs(np.abs(np.arctan2(cross, dot).sum(axis=1)) - 2 * np.pi) < 1e-6
    return np.where(once & (cross > 0).all(axis=1), 1, np.where(once & (cross < 0).all(axis=1), -1, 0))


def _holds(turn: np.ndarray, outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Does a convex ring hold a ring that encloses something?  1 yes, 0 no, -1 too close to tell here."""
    d = (outer[:, 1:] - outer[:, :-1])[:, :, None]
    gap = inner[:, None] - outer[:, :-1, None]
    off = (d[..., 0] * gap[..., 1] - d[..., 1] * gap[..., 0]) * turn[:, None, None]
    least = (off / np.sqrt((d * d).sum(axis=-1))).min(axis=(1, 2))
    return np.where((off >= 0).all(axis=(1, 2)), 1, np.where(least < -1e-9, 0, -1))


def relate_pairs(a: pa.ChunkedArray, b: pa.ChunkedArray, i: np.ndarray, j: np.ndarray, relation: str) -> np.ndarray:
    """Of the pairs of row i of ``a`` and row j of ``b``: ``kernels.relate``.

    Pairs of plain rings are tested in arrays; containing only where the outer ring is convex and no corner is closer to its
    edge than 1e-9 on the outside.  All others go one by one.
    """
    if relation == "within":
        return relate_pairs(b, a, j, i, "contains")
    out = np.zeros(len(i), bool)
    if not len(i):
        return out
    sizes, rings, place = [], [], []
    for g, at in ((a, i), (b, j)):
        used = np.zeros(len(g), bool)
        used[at] = True
        size, by = _plain(g, used)
        where = np.zeros(len(g), np.int64)
        for rows, _ in by.values():
            where[rows] = np.arange(len(rows))
        sizes.append(size)
        rings.append({n: r for n, (_, r) in by.items()})
        place.append(where)
    turns = {n: _convex(r) for n, r in rings[0].items()} if relation == "contains" else {}
    solid = {n: np.array([abs(signed_area(x)) > 1e-9 for x in r], bool) for n, r in rings[1].items()} if relation == "contains" else {}
    pair = sizes[0][i] * (CORNERS + 1) + sizes[1][j]
    alone = [np.flatnonzero((sizes[0][i] == 0) | (sizes[1][j] == 0))]
    for code in np.unique(pair).tolist():
        m, n = divmod(code, CORNERS + 1)
        if not m or not n:
            continue
        rows, step = np.flatnonzero(pair == code), max(1, NUMBERS // (m * n))
        for t in (rows[s : s + step] for s in range(0, len(rows), step)):
            p, q = place[0][i[t]], place[1][j[t]]
            x, y = rings[0][m][p], rings[1][n][q]
            if relation == "intersects":
                out[t] = _touch(x, y) | _inside(y[:, 0], x) | _inside(x[:, 0], y)
            else:
                turn = turns[m][p]
                told = np.where((turn != 0) & solid[n][q], _holds(turn, x, y), -1)
                out[t] = told == 1
                alone.append(t[told < 0])
    rest = np.concatenate(alone)
    if len(rest):
        both = [dict(zip(u.tolist(), g.take(pa.array(u)).to_pylist(), strict=True)) for g, u in ((a, np.unique(i[rest])), (b, np.unique(j[rest])))]
        out[rest] = [relate(both[0][x], both[1][y], relation) for x, y in zip(i[rest].tolist(), j[rest].tolist(), strict=True)]
    return out
