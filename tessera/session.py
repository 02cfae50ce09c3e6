"""Named layers over lazy DataFrames, and the registry that holds them in display order."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.shapes import bounds, family

#: Names of coordinate columns, in order of preference; after them any lon... with any lat...
COORDINATES = (("lon", "lat"), ("longitude", "latitude"), ("lng", "lat"), ("lon_wgs84", "lat_wgs84"), ("lon_gcj02", "lat_gcj02"), ("lon_bd09", "lat_bd09"))
PLAIN_ROWS, ASK_ROWS, CLUSTER_ROWS = 50_000, 100_000, 200_000
MAX_SQL_ROWS = 50_000


def coordinate_columns(columns: list[str], explicit: tuple[str, str] | None = None) -> tuple[str, str] | None:
    """The longitude and latitude columns; of an explicit pair both must exist."""
    if explicit:
        return explicit if set(explicit) <= set(columns) else None
    for pair in COORDINATES:
        if set(pair) <= set(columns):
            return pair
    lon, lat = ([c for c in columns if c.lower().startswith(p)] for p in ("lon", "lat"))
    return (lon[0], lat[0]) if lon and lat else None


def _geometry_format(f: T.StructField) -> str | None:
    if isinstance(f.dataType, T.StructType):
        return "struct" if f.dataType.names == ["kind", "parts"] else None
    if isinstance(f.dataType, T.BinaryType):
        return "wkb"
    return "wkt" if isinstance(f.dataType, T.StringType) and re.search("wkt|geom", f.name, re.IGNORECASE) else None


def geometry_column(schema: T.StructType) -> tuple[str, str] | None:
    """(column, format) of the geometry column; format: struct, wkb or wkt.

    A struct is taken before bytes and bytes before text; within a format a column called geom or geometry before one whose
    name has wkb or wkt, that before any other, and the first of equals.
    """
    found = [(f.name, form) for f in schema.fields if (form := _geometry_format(f))]

    def preference(one: tuple[str, str]) -> tuple[int, int]:
        name = one[0].lower()
        return ("struct", "wkb", "wkt").index(one[1]), 0 if name in ("geom", "geometry") else 1 if re.search("wkb|wkt", name) else 2

    return min(found, key=preference, default=None)


def admission(rows: int, clustered: bool = False) -> str:
    """How a result of so many rows may be shown: plain, ask, cluster or refuse."""
    return "plain" if rows <= PLAIN_ROWS else "cluster" if clustered and rows <= CLUSTER_ROWS else "ask" if rows <= ASK_ROWS else "cluster" if rows <= CLUSTER_ROWS else "refuse"


def check_query(text: str) -> str:
    """The statement if it is one reading query: no further statement, no comment, not even within quotes."""
    query = text.strip()
    if re.search(r";|--|/\*", query):
        raise ValueError("one statement without ; or comments is allowed")
    if not re.match(r"(?i)(select|with)\b", query):
        raise ValueError("only select and with queries are allowed")
    return query


@dataclass
class Layer:
    """A DataFrame with a name, and where its geometry is: coordinate columns or a geometry column."""

    id: str
    name: str
    df: DataFrame
    coords: tuple[str, str] | None = None
    geom: str | None = None
    srid: int | None = None
    visible: bool = True
    style: dict = field(default_factory=dict)
    mode: str = "auto"

    def describe(self) -> dict:
        """The layer without its rows: counts, bounds and families come from one aggregate each."""
        box = None
        if self.coords or self.geom:
            b = bounds(F.col(self.geom)) if self.geom else {"xmin": F.col(self.coords[0]), "ymin": F.col(self.coords[1]), "xmax": F.col(self.coords[0]), "ymax": F.col(self.coords[1])}
            r = self.df.select(*[c.alias(k) for k, c in b.items()]).agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
            box = tuple(r) if r[0] is not None else None
        families = ["point"] if self.coords else sorted(r[0] for r in self.df.select(family(F.col(self.geom))).distinct().collect() if r[0]) if self.geom else []
        return {"id": self.id, "name": self.name, "rows": self.df.count(), "fields": self.df.columns, "bounds": box, "families": families, "srid": self.srid, "visible": self.visible, "style": self.style, "mode": self.mode}

    def preview(self, limit: int = 200, order: str | None = None) -> DataFrame:
        return (self.df.orderBy(order) if order else self.df).limit(limit)

    def render_mode(self) -> str:
        n = self.df.limit(ASK_ROWS + 1).count()
        return "plain" if n <= PLAIN_ROWS else "columnar" if n <= ASK_ROWS else "tiers"


class Session:
    """Layers by id, bottom first."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._layers: dict[str, Layer] = {}
        self._numbers = itertools.count(1)

    def add(self, df: DataFrame, name: str, **about) -> Layer:
        layer = Layer(f"layer_{next(self._numbers)}", name, df, **about)
        if layer.coords is None and layer.geom is None:
            layer.coords = coordinate_columns(df.columns)
            if layer.coords is None and (found := geometry_column(df.schema)) and found[1] == "struct":
                layer.geom = found[0]
        self._layers[layer.id] = layer
        return layer

    def layer(self, key: str) -> Layer:
        """By id, else the topmost of that name."""
        if key in self._layers:
            return self._layers[key]
        named = [x for x in self._layers.values() if x.name == key]
        if not named:
            raise KeyError(f"no layer {key}; there are {[x.name for x in self._layers.values()]}")
        return named[-1]

    def list(self) -> list[Layer]:
        return list(self._layers.values())

    def remove(self, key: str) -> None:
        self._layers.pop(self.layer(key).id).df.unpersist()

    def clear(self) -> int:
        n = len(self._layers)
        for x in self.list():
            self.remove(x.id)
        return n

    def show(self, key: str, visible: bool = True) -> None:
        self.layer(key).visible = visible

    def move(self, key: str, to: int) -> None:
        """Put a layer at a place counted from the bottom."""
        order, layer = self.list(), self.layer(key)
        order.remove(layer)
        order.insert(max(0, min(len(order), to)), layer)
        self._layers = {x.id: x for x in order}

    def sql(self, text: str, key: str | None = None, limit: int = 5000) -> DataFrame:
        """A reading query over the session's layers by name, ``__layer__`` standing for one of them; at most 50,000 rows."""
        query = check_query(text)
        if key:
            query = query.replace("__layer__", f"`{self.layer(key).id}`")
        for x in self.list():
            for name in {x.id, x.name}:
                x.df.createOrReplaceTempView(name)
        return self.spark.sql(query).limit(min(limit, MAX_SQL_ROWS))
