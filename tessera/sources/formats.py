"""Shapes and attribute tables of shapefiles, byte by byte."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa

from tessera.functions import kernels
from tessera.functions.values import NUMERAL


def geometry_type() -> pa.DataType:
    xy = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    return pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.struct([("part", pa.int32()), ("ring", pa.int32()), ("pts", pa.list_(xy))])))])


def dbf_fields(data: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type, width, decimals) of each field."""
    out, at = [], 32
    while data[at] != 0x0D:
        out.append((data[at : at + 11].split(b"\0")[0].decode("utf-8", "replace"), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    return out


def dbf_records(data: bytes) -> list[tuple]:
    n, head, width = struct.unpack_from("<IHH", data, 4)
    fields, out = dbf_fields(data), []
    for k in range(n):
        at, row = head + k * width + 1, []
        for _, kind, size, _ in fields:
            raw = data[at : at + size].decode("utf-8", "replace").strip("\0 ")
            row.append((float(raw) if re.match(NUMERAL, raw) else None) if kind in "NF" else ({"T": True, "Y": True, "F": False, "N": False}.get(raw.upper())) if kind == "L" else raw or None)
            at += size
        out.append(tuple(row))
    return out


def shape(body: bytes) -> dict | None:
    """The geometry of a record: points, multipoints, lines and polygons (also Z and M, whose extra values are dropped)."""
    kind = struct.unpack_from("<I", body)[0] % 10
    if kind == 1:
        return kernels.geom_of("Point", [[np.frombuffer(body, "<f8", 2, 4)[None]]])
    elif kind == 8:
        n = struct.unpack_from("<I", body, 36)[0]
        xy = np.frombuffer(body, "<f8", 2 * n, 40).reshape(-1, 2)
        g = kernels.geom_of("Point", [[p[None]] for p in xy])
        return g | {"kind": "MultiPoint"}
    elif kind in (3, 5):
        parts, n = struct.unpack_from("<II", body, 36)
        cuts = [*struct.unpack_from(f"<{parts}I", body, 44), n]
        xy = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2)
        rings = [xy[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        if kind == 3:
            return kernels.geom_of("LineString", [[r] for r in rings])
        else:  # shells run clockwise, and a hole follows its shell
            shells: list[list[np.ndarray]] = []
            for r in rings:
                if kernels.signed_area(r) < 0 or not shells:
                    shells.append([r[::-1]])
                else:
                    shells[-1].append(r[::-1])
            return kernels.geom_of("Polygon", shells)
    return None


def shp_records(data: bytes) -> list[dict | None]:
    """The shapes of a whole .shp; null shapes are None."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">I", data, at + 4)[0] * 2
        out.append(shape(data[at + 8 : at + 8 + size]))
        at += 8 + size
    return out
