"""Python data sources over files with an index: shapefiles by record ranges of the .shx, GeoPackages by row-id ranges.

A partition is a range of records, so a large file is many tasks, each of which reads its own bytes only.  Only asked-for columns
are parsed.  Files are opened through ``pyarrow.fs``, local paths and the stores it knows alike; a GeoPackage, which is a
database, needs a path that the tasks can open.
"""

from __future__ import annotations

import re
import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions import codecs
from tessera.functions.shapes import GEOM
from tessera.functions.values import NUMERAL
from tessera.sources.formats import dbf_fields, geometry_type, shape

BATCH = 2000


class Range(InputPartition):
    """Records ``start`` to ``stop`` - 1."""

    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def _bytes(path: str, start: int, size: int) -> bytes:
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        return f.read_at(max(0, size), start)


def _size(path: str) -> int:
    fs, at = _open(path)
    return fs.get_file_info(at).size or 0


def _sibling(path: str, extension: str) -> str:
    """The file of the same name with another extension, in the case of its own."""
    for one in (extension, extension.upper()):
        fs, at = _open(path[:-3] + one)
        if fs.get_file_info(at).type == pafs.FileType.File:
            return path[:-3] + one
    raise FileNotFoundError(f"{path} has no .{extension} beside it")


def _ranges(n: int, rows: int) -> list[Range]:
    return [Range(a, min(n, a + rows)) for a in range(0, n, rows)] or [Range(0, 0)]


def _wanted(columns: str | None, names: list[str]) -> list[str]:
    if columns is None:
        return names
    wanted = [c.strip() for c in columns.split(",") if c.strip()]
    if missing := [c for c in wanted if c not in names]:
        raise ValueError(f"no columns {missing}; there are {names}")
    return wanted


class ShapefileSource(DataSource):
    """``path``: the .shp, with .shx and .dbf beside it; ``columns``: those wanted; ``rows``: records a task."""

    @classmethod
    def name(cls) -> str:
        return "tessera_shapefile"

    def _fields(self) -> list[tuple[str, str, int, int]]:
        dbf = _sibling(self.options["path"], "dbf")
        return dbf_fields(_bytes(dbf, 0, struct.unpack("<H", _bytes(dbf, 8, 2))[0]))

    def schema(self) -> str:
        kinds = {n: "double" if t in "NF" else "boolean" if t == "L" else "string" for n, t, _, _ in self._fields()} | {"geom": GEOM}
        return ", ".join(f"`{c}` {kinds[c]}" for c in _wanted(self.options.get("columns"), list(kinds)))

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.options["path"], self._fields(), schema.names, int(self.options.get("rows", 50_000)))


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, fields: list[tuple[str, str, int, int]], columns: list[str], rows: int):
        self.path, self.fields, self.columns, self.rows = path, fields, columns, rows
        self.shx, self.dbf = _sibling(path, "shx"), _sibling(path, "dbf")

    def partitions(self) -> list[Range]:
        return _ranges((_size(self.shx) - 100) // 8, self.rows)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        head, width = struct.unpack("<HH", _bytes(self.dbf, 8, 4))
        for a in range(part.start, part.stop, BATCH):
            z = min(part.stop, a + BATCH)
            index = np.frombuffer(_bytes(self.shx, 100 + 8 * a, 8 * (z - a)), ">i4").reshape(-1, 2).astype(np.int64) * 2
            first = int(index[0, 0])
            data = _bytes(self.path, first, int(index[-1].sum()) + 8 - first)
            geoms = [shape(data[at - first + 8 : at - first + 8 + size]) for at, size in index.tolist()]
            kept = [i for i, g in enumerate(geoms) if g]
            table = _bytes(self.dbf, head + a * width, (z - a) * width)
            out, at = {"geom": pa.array([geoms[i] for i in kept], geometry_type())}, 1
            for name, kind, size, _ in self.fields:
                if name in self.columns:
                    raw = [table[i * width + at : i * width + at + size].decode("utf-8", "replace").strip("\0 ") for i in kept]
                    if kind in "NF":
                        out[name] = pa.array([float(r) if re.match(NUMERAL, r) else None for r in raw], pa.float64())
                    elif kind == "L":
                        out[name] = pa.array([{"T": True, "Y": True, "F": False, "N": False}.get(r.upper()) for r in raw], pa.bool_())
                    else:
                        out[name] = pa.array([r or None for r in raw], pa.string())
                at += size
            yield pa.RecordBatch.from_arrays([out[c] for c in self.columns], names=self.columns)


def _database(path: str) -> sqlite3.Connection:
    place = re.sub(r"^file:/+", "/", path)
    return sqlite3.connect(f"file:{place.replace('?', '%3f').replace('#', '%23')}?mode=ro&immutable=1", uri=True)


def _name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def geopackage_layers(path: str) -> list[tuple[str, str, int]]:
    """(table, geometry column, SRID) of each feature layer."""
    with _database(path) as db:
        return db.execute("select g.table_name, g.column_name, g.srs_id from gpkg_geometry_columns g join gpkg_contents c using (table_name) where c.data_type = 'features' order by g.table_name").fetchall()


def geopackage_geometry(blob: bytes | None) -> dict | None:
    """The geometry of a GeoPackage blob; None if it is empty or cannot be read."""
    if not blob or len(blob) < 8 or blob[:2] != b"GP":
        return None
    flags = blob[3]
    envelope = (0, 32, 48, 48, 64)
    if flags & 0x10 or (flags >> 1) & 7 > 4:
        return None
    return codecs.from_wkb(blob[8 + envelope[(flags >> 1) & 7] :])[0]


class GeoPackageSource(DataSource):
    """``path``; ``layer``: a table, needed where there are several; ``columns``: those wanted; ``rows``: row ids a task."""

    @classmethod
    def name(cls) -> str:
        return "tessera_geopackage"

    def _layer(self) -> tuple[str, str, int]:
        layers, wanted = geopackage_layers(self.options["path"]), self.options.get("layer")
        found = [x for x in layers if wanted in (None, x[0])]
        if len(found) != 1:
            raise ValueError(f"name one layer of {[x[0] for x in layers]}")
        return found[0]

    def _columns(self) -> dict[str, str]:
        table, geom, _ = self._layer()
        kinds = {}
        with _database(self.options["path"]) as db:
            for _, name, kind, *_ in db.execute(f"pragma table_info({_name(table)})"):
                k = kind.upper().split("(")[0]
                kinds[name] = GEOM if name == geom else "boolean" if k == "BOOLEAN" else "long" if "INT" in k else "double" if k in ("REAL", "DOUBLE", "FLOAT") else "binary" if k == "BLOB" else "string"
        return kinds

    def schema(self) -> str:
        kinds = self._columns()
        return ", ".join(f"`{c}` {kinds[c]}" for c in _wanted(self.options.get("columns"), list(kinds)))

    def reader(self, schema) -> DataSourceReader:
        table, geom, _ = self._layer()
        return GeoPackageReader(self.options["path"], table, geom, {c: self._columns()[c] for c in schema.names}, int(self.options.get("rows", 50_000)))


class GeoPackageReader(DataSourceReader):
    def __init__(self, path: str, table: str, geom: str, columns: dict[str, str], rows: int):
        self.path, self.table, self.geom, self.columns, self.rows = path, table, geom, columns, rows

    def partitions(self) -> list[Range]:
        with _database(self.path) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_name(self.table)}").fetchone()
        return [Range(0, 0)] if low is None else [Range(low + r.start, low + r.stop) for r in _ranges(high - low + 1, self.rows)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), GEOM: geometry_type()}
        as_kind = {
            "long": lambda v: v if isinstance(v, int) else None, "double": lambda v: float(v) if isinstance(v, int | float) else None,
            "boolean": lambda v: None if v is None else bool(v), "string": lambda v: v if v is None or isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v), "binary": lambda v: v if isinstance(v, bytes) else None, GEOM: geopackage_geometry,
        }
        own = f"{_name(self.geom)} is not null"
        with _database(self.path) as db:
            rows = db.execute(f"select {', '.join(map(_name, self.columns)) or 'null'} from {_name(self.table)} where rowid between ? and ? and {own} order by rowid", (part.start, part.stop - 1))
            while got := rows.fetchmany(BATCH):
                cols = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(map(as_kind[k], c), kinds[k]) for c, k in zip(cols, self.columns.values(), strict=False)], names=list(self.columns))


def _read(spark: SparkSession, source: type[DataSource], path: str, columns: list[str] | None, **options) -> DataFrame:
    spark.dataSource.register(source)
    given = {k: str(v) for k, v in options.items() if v is not None} | ({"columns": ",".join(columns)} if columns else {})
    return spark.read.format(source.name()).options(path=path, **given).load()


def read_shp(spark: SparkSession, path: str, *, columns: list[str] | None = None, rows: int = 50_000) -> DataFrame:
    """A bare .shp with its .shx and .dbf: attributes and ``geom``; records without a shape are dropped."""
    return _read(spark, ShapefileSource, path, columns, rows=rows)


def read_geopackage(spark: SparkSession, path: str, *, layer: str | None = None, columns: list[str] | None = None, rows: int = 50_000) -> DataFrame:
    """A feature layer of a GeoPackage, its geometry column as a struct; rows without a geometry are dropped."""
    return _read(spark, GeoPackageSource, path, columns, layer=layer, rows=rows)
