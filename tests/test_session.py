"""Which column is taken for the geometry."""

from pyspark.sql import types as T

from tessera.functions.shapes import GEOM
from tessera.session import geometry_column


def schema(text):
    return T._parse_datatype_string(text)


def test_geometry_column(spark):
    assert geometry_column(schema("id int, name string")) is None
    assert geometry_column(schema("id int, shape binary, geom string")) == ("shape", "wkb")
    assert geometry_column(schema(f"geometry string, raw binary, place {GEOM}")) == ("place", "struct")
    assert geometry_column(schema("blob binary, the_wkb binary, Geom binary")) == ("Geom", "wkb")
    assert geometry_column(schema("blob binary, the_wkb binary")) == ("the_wkb", "wkb")
    assert geometry_column(schema("my_geom string, line_wkt string, wkt2 string")) == ("line_wkt", "wkt")
    assert geometry_column(schema("a struct<x:int>")) is None
