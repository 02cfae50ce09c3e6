"""Geometry kernels in numpy: rings are (n, 2) arrays, closed; a region is a list of rings under the even-odd rule."""

from __future__ import annotations

import json
import math

import numpy as np

EPS = 1e-12


KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")


def rings_of(geom: dict) -> list[np.ndarray]:
    return [np.array([(p["x"], p["y"]) for p in part["pts"]], float).reshape(-1, 2) for part in geom["parts"]]


def geom_of(kind: str, parts: list[list[np.ndarray]]) -> dict:
    """A geometry from the rings (or single line, or point) of each part; several parts make a Multi* kind."""
    return {"kind": kind if len(parts) == 1 else f"Multi{kind}", "parts": [{"part": i, "ring": j, "pts": [{"x": float(x), "y": float(y)} for x, y in r]} for i, rings in enumerate(parts) for j, r in enumerate(rings)]}


def convex_hull(points: np.ndarray) -> np.ndarray | None:
    """The closed hull, counter-clockwise, by monotone chains; None for fewer than three points off one line."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return None

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    ring = chain(p)[:-1] + chain(p[::-1])[:-1]
    return np.array([*ring, ring[0]]) if len(ring) > 2 else None


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: a stretch is cut at its farthest vertex until none is farther than the tolerance."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = line[a + 1 : b] - line[a], line[b] - line[a]
        n = float(d @ d)
        t = np.clip(p @ d / n, 0, 1) if n else np.zeros(len(p))
        far = ((p - t[:, None] * d) ** 2).sum(axis=1)
        i = int(far.argmax())
        if far[i] > tolerance**2:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return line[keep]


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """As ``simplify``, from the vertex that is farthest from the first; a ring keeps at least three corners."""
    far = int(((ring - ring[0]) ** 2).sum(axis=1).argmax())
    out = np.concatenate([simplify(ring[: far + 1], tolerance)[:-1], simplify(ring[far:], tolerance)])
    return out if len(out) >= 4 else ring


def simplify_all(xy: np.ndarray, sizes: np.ndarray, closed: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices ``simplify`` (``simplify_ring`` where ``closed``) keeps of many lines, one after the other in ``xy``.

    A round measures all vertices of the stretches that the round before left and cuts each stretch once.
    """
    stops = np.cumsum(sizes)
    starts = stops - sizes
    keep, line = np.zeros(len(xy), bool), np.flatnonzero(sizes)
    keep[starts[line]] = keep[stops[line] - 1] = True
    ring = line[closed[line]]
    a, b = starts[line[~closed[line]]], stops[line[~closed[line]]] - 1
    if len(ring):
        first, n = starts[ring], sizes[ring]
        of, at = _stretched(first, n)
        far = _first_largest(((xy[at] - xy[first[of]]) ** 2).sum(axis=1), at, n)
        keep[far] = True
        a, b = np.concatenate([a, first, far]), np.concatenate([b, far, stops[ring] - 1])
    while True:
        long = b - a > 1
        a, b = a[long], b[long]
        if not len(a):
            break
        of, at = _stretched(a + 1, b - a - 1)
        p, d = xy[at] - xy[a[of]], (xy[b] - xy[a])[of]
        n = (d * d).sum(axis=1)
        t = np.clip((p * d).sum(axis=1) / np.where(n, n, 1), 0, 1)
        away = ((p - t[:, None] * d) ** 2).sum(axis=1)
        cut = _first_largest(away, at, b - a - 1)
        first = np.cumsum(b - a - 1) - (b - a - 1)
        on = np.maximum.reduceat(away, first) > tolerance**2
        a, b, cut = a[on], b[on], cut[on]
        keep[cut] = True
        a, b = np.concatenate([a, cut]), np.concatenate([cut, b])
    kept = np.concatenate(([0], np.cumsum(keep)))
    few = ring[kept[stops[ring]] - kept[starts[ring]] < 4]
    keep[_stretched(starts[few], sizes[few])[1]] = True
    return keep


def _stretched(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, place) of each place of the stretches."""
    of = np.repeat(np.arange(len(starts)), sizes)
    return of, np.arange(len(of)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _first_largest(x: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The place of the first largest number of each stretch, none of which is empty."""
    first = np.cumsum(sizes) - sizes
    top = np.repeat(np.maximum.reduceat(x, first), sizes)
    hit = np.where(x == top, np.arange(len(x)), len(x))
    return at[np.minimum.reduceat(hit, first)]


def smooth(line: np.ndarray, iterations: int, closed: bool) -> np.ndarray:
    """Chaikin's corner cutting at a quarter and three quarters of each edge; open lines keep their ends."""
    for _ in range(iterations):
        if len(line) < 3:
            break
        a, b = line[:-1], line[1:]
        cut = np.stack([0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b], axis=1).reshape(-1, 2)
        line = np.concatenate([cut, cut[:1]]) if closed else np.concatenate([line[:1], cut, line[-1:]])
    return line


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    parts = [np.concatenate([r[:-1], r[1:]], axis=1) for r in rings if len(r) > 3]
    e = np.concatenate(parts) if parts else np.zeros((0, 4))
    return e[(e[:, :2] != e[:, 2:]).any(axis=1)]


def inside(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Even-odd membership of points in the region that the edges bound."""
    out = np.zeros(len(points), bool)
    for at in range(0, len(points), 1024):
        x, y = points[at : at + 1024, :1], points[at : at + 1024, 1:]
        x1, y1, x2, y2 = edges.T
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        out[at : at + 1024] = hit.sum(axis=1) % 2 == 1
    return out


def _cuts(edges: np.ndarray, digits: int) -> np.ndarray:
    """The edges, split where they cross, touch or overlap one another, on a grid of so many digits, each once."""
    d = edges[:, 2:] - edges[:, :2]
    pieces = []
    for i, e in enumerate(edges):
        near = np.flatnonzero((np.minimum(edges[:, 0], edges[:, 2]) <= max(e[0], e[2]) + EPS) & (np.maximum(edges[:, 0], edges[:, 2]) >= min(e[0], e[2]) - EPS) & (np.minimum(edges[:, 1], edges[:, 3]) <= max(e[1], e[3]) + EPS) & (np.maximum(edges[:, 1], edges[:, 3]) >= min(e[1], e[3]) - EPS))
        o, p = edges[near], e[:2]
        q, n2 = d[near], float(d[i] @ d[i])
        cross = d[i][0] * q[:, 1] - d[i][1] * q[:, 0]
        gap = o[:, :2] - p
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * q[:, 1] - gap[:, 1] * q[:, 0]) / cross
            u = (gap[:, 0] * d[i][1] - gap[:, 1] * d[i][0]) / cross
        at = [t[(np.abs(cross) > EPS) & (u >= -EPS) & (u <= 1 + EPS) & (t > 0) & (t < 1)]]
        flat = (np.abs(cross) <= EPS) & (np.abs(gap[:, 0] * d[i][1] - gap[:, 1] * d[i][0]) <= EPS * max(1.0, math.sqrt(n2)))
        for ends in (gap[flat], gap[flat] + q[flat]):
            s = ends @ d[i] / n2
            at.append(s[(s > 0) & (s < 1)])
        ts = np.unique(np.concatenate([[0.0, 1.0], *at]))
        pts = np.round(p + ts[:, None] * d[i], digits)
        pieces.append(np.concatenate([pts[:-1], pts[1:]], axis=1))
    all_ = np.concatenate(pieces)
    all_ = all_[(all_[:, :2] != all_[:, 2:]).any(axis=1)]
    swap = (all_[:, 0] > all_[:, 2]) | ((all_[:, 0] == all_[:, 2]) & (all_[:, 1] > all_[:, 3]))
    all_[swap] = all_[swap][:, [2, 3, 0, 1]]
    return np.unique(all_, axis=0)


def overlay(regions: list[list[np.ndarray]], rule, digits: int = 9) -> list[list[np.ndarray]]:
    """The region where ``rule`` holds of the memberships in ``regions`` (a boolean matrix, a column each), as polygons.

    All boundaries are split at their meetings.  A piece is on the result's boundary if the rule differs between its two
    sides; such pieces are directed to have the result on their left and are walked into rings, shells and holes.
    """
    bounds = [_edges(r) for r in regions]
    if not sum(map(len, bounds)):
        return []
    cut = _cuts(np.concatenate(bounds), digits)
    middle, along = (cut[:, :2] + cut[:, 2:]) / 2, cut[:, 2:] - cut[:, :2]
    length = np.sqrt((along**2).sum(axis=1))
    normal = np.stack([-along[:, 1], along[:, 0]], axis=1) / length[:, None]
    step = np.minimum(length * 1e-3, 10.0 ** (2 - digits))[:, None]
    sides = [rule(np.stack([inside(middle + s * normal * step, e) for e in bounds], axis=1)) for s in (1, -1)]
    left, right = sides
    directed = np.concatenate([cut[left & ~right], cut[right & ~left][:, [2, 3, 0, 1]]])
    after: dict[tuple, list[tuple]] = {}
    for x1, y1, x2, y2 in directed.tolist():
        after.setdefault((x1, y1), []).append((x2, y2))
    rings = []
    while after:
        start = next(iter(after))
        path, at, came = [start], start, None
        while True:
            ways = after[at]
            if came is None or len(ways) == 1:
                k = 0
            else:  # the sharpest turn to the left keeps touching rings apart
                back = math.atan2(came[1] - at[1], came[0] - at[0])
                k = max(range(len(ways)), key=lambda j: (math.atan2(ways[j][1] - at[1], ways[j][0] - at[0]) - back) % (2 * math.pi))
            to = ways.pop(k)
            if not ways:
                del after[at]
            came, at = at, to
            path.append(at)
            if at == start or at not in after:
                break
        if path[-1] == start and len(path) > 3:
            rings.append(np.array(path))
    area = [signed_area(r) for r in rings]
    shells = [[r] for r, a in zip(rings, area, strict=True) if a > 0]
    for r, a in zip(rings, area, strict=True):
        if a < 0:
            probe = (r[0] + r[1]) / 2
            owner = min((s for s in shells if inside(probe[None], _edges([s[0]]))[0] or (s[0] == r[0]).all(axis=1).any()), key=lambda s: abs(signed_area(s[0])), default=None)
            if owner:
                owner.append(r)
    return [[_straight(r) for r in s] for s in shells]


def _straight(ring: np.ndarray) -> np.ndarray:
    """Without vertices that lie on the line between their neighbours."""
    p = ring[:-1]
    a, b = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    keep = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > EPS
    p = p[keep] if keep.sum() > 2 else p
    return np.concatenate([p, p[:1]])


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def union(regions: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    return overlay(regions, lambda m: m.any(axis=1))


def intersection(a: list[np.ndarray], b: list[np.ndarray]) -> list[list[np.ndarray]]:
    return overlay([a, b], lambda m: m.all(axis=1))


def difference(a: list[np.ndarray], b: list[np.ndarray]) -> list[list[np.ndarray]]:
    return overlay([a, b], lambda m: m[:, 0] & ~m[:, 1])


def _touch(a: np.ndarray, b: np.ndarray) -> bool:
    """Do two sets of segments share a point?"""
    p, r = a[:, None, :2], (a[:, 2:] - a[:, :2])[:, None]
    q, s = b[None, :, :2], (b[:, 2:] - b[:, :2])[None]
    side = lambda o, v, w: v[..., 0] * (w - o)[..., 1] - v[..., 1] * (w - o)[..., 0]
    d1, d2, d3, d4 = side(p, r, q), side(p, r, q + s), side(q, s, p), side(q, s, p + r)
    box = (np.minimum(p, p + r) <= np.maximum(q, q + s) + EPS).all(axis=-1) & (np.maximum(p, p + r) + EPS >= np.minimum(q, q + s)).all(axis=-1)
    return bool((box & (d1 * d2 <= EPS) & (d3 * d4 <= EPS)).any())


def _segments(rings: list[np.ndarray]) -> np.ndarray:
    """All segments; a lone point is a segment without length."""
    return np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) if len(r) > 1 else np.concatenate([r, r], axis=1) for r in rings])


def _near(segments: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """The segments whose bounds meet those of the rings."""
    pts = np.concatenate(rings)
    low, high = pts.min(axis=0) - EPS, pts.max(axis=0) + EPS
    return segments[(np.minimum(segments[:, :2], segments[:, 2:]) <= high).all(axis=1) & (np.maximum(segments[:, :2], segments[:, 2:]) >= low).all(axis=1)]


def intersects(a: str | dict, b: str | dict) -> bool:
    """Do two geometries (structs, or their JSON) share a point?"""
    a, b = (json.loads(g) if isinstance(g, str) else g for g in (a, b))
    p, q = rings_of(a), rings_of(b)
    s, t = _near(_segments(p), q), _near(_segments(q), p)
    if len(s) and any(_touch(s[at : at + 512], t[to : to + 512]) for at in range(0, len(s), 512) for to in range(0, len(t), 512)):
        return True
    # Without a shared boundary point, a part lies inside the other geometry as a whole or not at all.
    return any(g["kind"].endswith("Polygon") and bool(inside(np.array([r[0] for r in other]), _edges(rings)).any()) for g, rings, other in ((a, p, q), (b, q, p)))


def _on(points: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Which points lie on some segment, to ``EPS``?"""
    out = np.zeros(len(points), bool)
    start, d = segments[:, :2], segments[:, 2:] - segments[:, :2]
    n2 = (d * d).sum(axis=1)
    for at in range(0, len(points), 256):
        gap = points[at : at + 256, None] - start
        share = np.clip((gap * d).sum(axis=2) / np.where(n2 > 0, n2, 1.0), 0.0, 1.0)
        out[at : at + 256] = (np.abs(gap - share[..., None] * d).max(axis=2) <= EPS).any(axis=1)
    return out


def _middles(segments: np.ndarray, cutters: np.ndarray) -> np.ndarray:
    """Middles of the pieces into which the cutters divide the segments."""
    out = []
    for e in segments:
        p, d = e[:2], e[2:] - e[:2]
        n2 = float(d @ d)
        if not n2:
            out.append(p[None])
            continue
        q = cutters[:, 2:] - cutters[:, :2]
        cross, gap = d[0] * q[:, 1] - d[1] * q[:, 0], cutters[:, :2] - p
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * q[:, 1] - gap[:, 1] * q[:, 0]) / cross
        # Ends of cutters along the segment count as cuts too, for those that run along it.
        ts = np.concatenate([[0.0, 1.0], t[np.abs(cross) > EPS], gap @ d / n2, (gap + q) @ d / n2])
        ts = np.unique(ts[(ts >= 0) & (ts <= 1)])
        out.append(p + ((ts[:-1] + ts[1:]) / 2)[:, None] * d)
    return np.concatenate(out)


def contains(a: dict, b: dict) -> bool:
    """Does no point of ``b`` lie outside ``a``, and do their interiors meet?"""
    p, q = rings_of(a), rings_of(b)
    dims = [("Point", "LineString", "Polygon").index(g["kind"].removeprefix("Multi")) for g in (a, b)]
    if dims[0] < dims[1]:
        return False
    edges, segments = _segments(p), _segments(q)
    if dims[0] == 0:
        return bool(_on(segments[:, :2], edges).all())
    if dims[1] == 2:
        # No part of b's boundary is outside a and none of a's (its holes) inside b; where b's whole boundary is a's too,
        # a place just inside b tells whether b is a part of a or fills its hole.
        mine, theirs = _edges(p), _edges(q)
        if not len(mine) or not len(theirs):
            return False
        outline = _middles(theirs, mine)
        on = _on(outline, mine)
        if not (inside(outline, mine) | on).all():
            return False
        own = _middles(mine, theirs)
        if (inside(own, theirs) & ~_on(own, theirs)).any():
            return False
        if not on.all():
            return True
        d = theirs[:, 2:] - theirs[:, :2]
        off = d[:, ::-1] * np.array([1e-6, -1e-6])
        beside = np.concatenate([(theirs[:, :2] + theirs[:, 2:]) / 2 + off, (theirs[:, :2] + theirs[:, 2:]) / 2 - off])
        return bool(inside(beside[inside(beside, theirs)], mine).any())
    middles = segments[:, :2] if dims[1] == 0 else _middles(segments, edges)
    on = _on(middles, edges)
    if dims[0] == 2:
        within = inside(middles, _edges(p))
        return bool((within | on).all() and (within & ~on).any())
    if not on.all():
        return False
    if dims[1] == 1:
        return True
    # A point is in a line's interior unless it is an end of it that no other part shares.
    ends, times = np.unique(np.array([r[k] for r in p for k in (0, -1)]), axis=0, return_counts=True)
    free = ends[times % 2 == 1]
    return not all((np.abs(free - m).max(axis=1) <= EPS).any() if len(free) else False for m in middles)


def relate(a: dict | None, b: dict | None, relation: str) -> bool:
    """``a`` intersects, contains or is within ``b``; geometries without a part, and collections, are related to none."""
    if not a or not b or not a["parts"] or not b["parts"] or any(g["kind"] not in KINDS for g in (a, b)):
        return False
    return intersects(a, b) if relation == "intersects" else contains(a, b) if relation == "contains" else contains(b, a)


def capsule(a: np.ndarray, b: np.ndarray, radius: float, steps: int) -> np.ndarray:
    """The closed outline of all places within the radius of a segment, each half circle in so many steps."""
    turn = math.atan2(*(b - a)[::-1])
    t = np.linspace(-math.pi / 2, math.pi / 2, steps + 1) + turn
    far = np.concatenate([b + radius * np.stack([np.cos(t), np.sin(t)], axis=1), a - radius * np.stack([np.cos(t), np.sin(t)], axis=1)])
    return np.concatenate([far, far[:1]])


def buffer(geom: dict, metres: float, steps: int = 8) -> dict:
    """All places within a distance, in the local equirectangular plane around the geometry's middle, as a polygon."""
    rings = rings_of(geom)
    middle = np.concatenate(rings).mean(axis=0)
    # In degrees of latitude, so that the overlay's tolerances fit the coordinates.
    scale = np.array([max(1e-6, math.cos(math.radians(middle[1]))), 1.0])
    plane = [(r - middle) * scale for r in rings]
    regions = [[capsule(r[max(0, i - 1)], r[i], metres / 111_194.92664, steps)] for r in plane for i in range(1 if len(r) > 1 else 0, len(r))]
    if geom["kind"].endswith("Polygon"):
        regions.append(plane)
    out = union([[np.round(x, 9) for x in r] for r in regions]) if len(regions) > 1 else [regions[0]]
    return geom_of("Polygon", [[r / scale + middle for r in p] for p in out])


def half_plane(ring: np.ndarray, point: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A convex closed ring cut to the places no farther from ``point`` than from ``other``."""
    n = other - point
    d = (ring[:-1] - (point + other) / 2) @ n
    out = []
    for i in range(len(d)):
        j = (i + 1) % len(d)
        if d[i] <= 0:
            out.append(ring[i])
        if d[i] < 0 < d[j] or d[j] < 0 < d[i]:
            out.append(ring[i] + (ring[j] - ring[i]) * d[i] / (d[i] - d[j]))
    return np.array([*out, out[0]]) if len(out) > 2 else np.zeros((0, 2))


def voronoi_cell(point: np.ndarray, others: np.ndarray, box: np.ndarray) -> np.ndarray:
    """The box cut by the bisectors with all others, nearest first, until the rest are too far to matter."""
    ring, away = box, ((others - point) ** 2).sum(axis=1)
    for i in np.argsort(away, kind="stable"):
        if not len(ring) or away[i] > 4 * ((ring - point) ** 2).sum(axis=1).max():
            break
        if away[i] > 0:
            ring = half_plane(ring, point, others[i])
    return ring


def ring_fault(ring: np.ndarray) -> str | None:
    """Why a ring cannot be a polygon's: too few corners, no area, repeated vertices or a crossing with itself."""
    if len(np.unique(ring[:-1], axis=0)) < 3:
        return "too few corners"
    if len(np.unique(ring[:-1], axis=0)) < len(ring) - 1:
        return "repeated vertex"
    e = np.concatenate([ring[:-1], ring[1:]], axis=1)
    for i in range(len(e) - 2):
        rest = e[i + 2 : len(e) - (i == 0)]
        if len(rest) and _touch(e[i : i + 1], rest):
            return "crosses itself"
    return None if abs(signed_area(ring)) > EPS else "no area"
