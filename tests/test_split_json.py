"""Large GeoJSON by splits: the rows of the whole-file reader, wherever the cuts fall."""

import json
import random

import numpy as np
import pytest

from tessera.sources import readers, split_json

ODD = ['}{"', "\\", '\\"', '"}]}', "{[", "é漢😀}", "\n\t", '","type":"Feature"', "\\\\", ""]


def collection(n, indent=None, first="type"):
    rng, out = random.Random(5), []
    for k in range(n):
        props = {"n": k, "s": rng.choice(ODD) + rng.choice(ODD), "deep": {"a": [{"b": rng.choice(ODD)}]}}
        f = {"type": "Feature", "properties": props, "geometry": {"type": "Point", "coordinates": [k / 10, 1.5]}}
        out.append(f if first == "type" else dict(reversed(f.items())))
    return json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x}"}}, "features": out, "bbox": [0, 0, 1, 1]}, indent=indent, ensure_ascii=n % 2 == 0)


def plain(data, state):
    """The scanner, byte by byte."""
    inside, escaped, at = state != 0, state == 2, []
    for i, c in enumerate(data):
        c = chr(c)
        if inside:
            escaped, inside = (False, True) if escaped else (c == "\\", c != '"')
        elif c == '"':
            inside = True
        elif c in "{[}]":
            at.append((i, 1 if c in "{[" else -1))
    return (2 if escaped else 1) if inside else 0, at


def test_scanner_is_the_plain_one():
    rng = random.Random(1)
    for _ in range(3000):
        inner = "".join(rng.choice('a"\\{}[]') for _ in range(rng.randrange(12)))
        state = rng.randrange(3)
        # Backslashes stand in strings only.
        if "\\" in inner and plain(inner.encode(), state)[0] == 0 and state == 0 and inner.find("\\") < (inner.find('"') if '"' in inner else 99):
            continue
        ok, inside, escaped = True, state != 0, state == 2
        for c in inner:
            if inside:
                escaped, inside = (False, True) if escaped else (c == "\\", c != '"')
            elif c == "\\":
                ok = False
            elif c == '"':
                inside = True
        if ok:
            end, at, steps = split_json.scan(inner.encode(), state)
            assert (end, list(zip(at.tolist(), steps.tolist(), strict=True))) == plain(inner.encode(), state), (inner, state)


@pytest.mark.parametrize("size", [61, 200, 1000, 100_000])
@pytest.mark.parametrize("shape", [(40, None, "type"), (41, 1, "geometry")])
def test_same_rows_whatever_the_cuts(spark, tmp_path, size, shape):
    (tmp_path / "a.geojson").write_text("﻿" + collection(*shape), encoding="utf-8")
    (tmp_path / "b.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    rows = lambda df: sorted(((r["n"], r["s"], str(r["deep"]), r["geom"]["parts"][0]["pts"][0]["x"]) for r in df.collect()))
    whole = rows(readers.read_geojson(spark, str(tmp_path / "a.geojson"), split=False))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        df = split_json.features(spark, str(tmp_path))
        assert df.where("f like '%Feature%'").count() == shape[0]
        assert rows(readers.read_geojson(spark, str(tmp_path / "*.geojson"), split=True)) == whole and len(whole) == shape[0]
        if size < 1000:
            assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.geojson")).rdd.getNumPartitions() > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_maps_hold_for_any_cut():
    data = collection(7).encode()
    for cut in np.random.default_rng(3).integers(1, len(data) - 1, 60).tolist():
        middle, _, a = split_json.scan(data[:cut], 0)
        end, _, b = split_json.scan(data[cut:], middle)
        assert (end, a.sum() + b.sum()) == (0, 0)
