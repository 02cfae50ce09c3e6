"""Geometry text and binary: WKT, (E)WKB and GeoJSON into and out of geometry structs."""

from __future__ import annotations

import json
import re
import struct

import numpy as np

from tessera.functions.kernels import geom_of, rings_of

KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")
_BY_UPPER = {k.upper(): k for k in KINDS}
_WKT = re.compile(r"^\s*(?:SRID=(\d+);)?\s*([A-Za-z]+)\s*(?:Z|M|ZM)?\s*(\(.*\))\s*$", re.S)


def _structured(kind: str, coords) -> dict | None:
    """A geometry from coordinates nested as GeoJSON nests them."""
    base = kind.removeprefix("Multi")
    parts = coords if kind.startswith("Multi") else [coords]
    if not parts:
        return None
    xy = lambda c: [(float(p[0]), float(p[1])) for p in c]
    shaped = [[xy([p])] if base == "Point" else [xy(p)] if base == "LineString" else [xy(r) for r in p] for p in parts]
    out = geom_of(base, shaped)
    out["kind"] = kind
    return out


def from_geojson(text: str | dict | None) -> dict | None:
    """A geometry, a Feature's geometry, or None; unreadable text is None."""
    try:
        g = json.loads(text) if isinstance(text, str) else text
        if g and g.get("type") == "Feature":
            g = g.get("geometry")
        return _structured(g["type"], g["coordinates"]) if g and g.get("type") in KINDS else None
    except (ValueError, KeyError, TypeError, IndexError, AttributeError):
        return None


def _nested(geom: dict):
    parts: dict[int, list] = {}
    for p, r in zip(geom["parts"], rings_of(geom), strict=True):
        parts.setdefault(p["part"], []).append(r.tolist())
    base = geom["kind"].removeprefix("Multi")
    out = [p[0][0] if base == "Point" else p[0] if base == "LineString" else p for _, p in sorted(parts.items())]
    return out if geom["kind"].startswith("Multi") else out[0]


def to_geojson(geom: dict) -> dict:
    return {"type": geom["kind"], "coordinates": _nested(geom)}


def from_wkt(text: str | None) -> tuple[dict | None, int | None]:
    """(geometry, SRID); unreadable text is (None, None)."""
    m = _WKT.match(text or "")
    kind = m and _BY_UPPER.get(m[2].upper())
    if not kind:
        return None, None
    body = re.sub(r"[-+0-9.eE]+(?:[ \t]+[-+0-9.eE]+)+", lambda n: "[" + ",".join(n[0].split()) + "]", m[3])
    try:
        coords = json.loads(body.replace("(", "[").replace(")", "]"))
        if kind == "Point":
            coords = coords[0]
        elif kind == "MultiPoint":
            coords = [c[0] if isinstance(c[0], list) else c for c in coords]
        return _structured(kind, coords), int(m[1]) if m[1] else None
    except (ValueError, TypeError, IndexError):
        return None, None


def to_wkt(geom: dict) -> str:
    def text(c) -> str:
        return " ".join(f"{x:.15g}" for x in c) if not isinstance(c[0], (list, tuple)) else ", ".join(f"({text(x)})" if isinstance(x[0], (list, tuple)) else text(x) for x in c)

    coords = _nested(geom)
    coords = [coords] if geom["kind"] == "Point" else [[c] for c in coords] if geom["kind"] == "MultiPoint" else coords
    return f"{geom['kind'].upper()} ({text(coords)})"


def from_wkb(data: bytes | str | None) -> tuple[dict | None, int | None]:
    """(geometry, SRID) of WKB or EWKB, as bytes or hex; SRID 0 is none, Z and M are dropped."""
    try:
        data = bytes.fromhex(data) if isinstance(data, str) else bytes(data)
        geom, srid, _ = _read_wkb(data, 0)
        return geom, srid or None
    except (ValueError, TypeError, IndexError, struct.error):
        return None, None


def _read_wkb(data: bytes, at: int) -> tuple[dict | None, int, int]:
    order = "<" if data[at] == 1 else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at, srid = at + 5, 0
    if code & 0x20000000:
        srid, at = struct.unpack_from(order + "I", data, at)[0], at + 4
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    base = code & 0x0FFFFFFF
    dims, base = dims + (base // 1000 in (1, 2)) + 2 * (base // 1000 == 3), base % 1000
    kind = KINDS[base - 1] if 1 <= base <= 6 else None
    if kind is None:
        raise ValueError("unsupported geometry")

    def run(at: int, n: int) -> tuple[list, int]:
        v = np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)[:, :2].tolist()
        return v, at + 8 * n * dims

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if kind == "Point":
        c, at = run(at, 1)
        return (None if c[0][0] != c[0][0] else _structured(kind, c[0])), srid, at
    n, at = count(at)
    if kind == "LineString":
        c, at = run(at, n)
    elif kind == "Polygon":
        c = []
        for _ in range(n):
            k, at = count(at)
            r, at = run(at, k)
            c.append(r)
    else:
        c = []
        for _ in range(n):
            g, _, at = _read_wkb(data, at)
            if g:
                c.append(_nested(g))
    return _structured(kind, c) if c else None, srid, at


def to_wkb(geom: dict) -> bytes:
    def one(kind: str, c) -> bytes:
        head = struct.pack("<BI", 1, KINDS.index(kind) + 1)
        if kind == "Point":
            return head + struct.pack("<2d", *c)
        if kind == "LineString":
            return head + struct.pack("<I", len(c)) + np.array(c, "<f8").tobytes()
        if kind == "Polygon":
            return head + struct.pack("<I", len(c)) + b"".join(struct.pack("<I", len(r)) + np.array(r, "<f8").tobytes() for r in c)
        return head + struct.pack("<I", len(c)) + b"".join(one(kind.removeprefix("Multi"), x) for x in c)

    return one(geom["kind"], _nested(geom))
