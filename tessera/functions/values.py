"""Missing values, numbers and text of attribute columns: one set of rules for filters, statistics and classes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that counts as a number once trimmed; Spark's own cast would also take 12d, 1f or Infinity.
NUMERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def kind_of(df: DataFrame, field: str) -> str:
    """``number`` for numeric columns; dates, times and booleans are ``text``."""
    return "number" if isinstance(df.schema[field].dataType, T.NumericType) else "text"


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def text_of(c: Column, kind: str) -> Column:
    """The value as text: text as it is, whole numbers below 1e15 without a fraction."""
    if kind == "text":
        return c.cast("string")
    x = c.cast("double")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(c.cast("string"))


def missing(c: Column) -> Column:
    """Null and the empty string are the same absence."""
    return c.isNull() | (c.cast("string") == "")


def number_of(c: Column, kind: str, blank: float | None = None) -> Column:
    """The value as a finite double, else null; text of blanks only is ``blank``."""
    if kind == "number":
        return finite(c.cast("double"))
    t = F.trim(c.cast("string"))
    x = F.when(t.rlike(NUMERAL), finite(t.try_cast("double")))
    return x if blank is None else F.when((t == "") & (c.cast("string") != ""), F.lit(blank)).otherwise(x)


def literal_number(value: str | None) -> float | None:
    """A filter value as a number: blanks around it are ignored, the empty value is none."""
    if value is None or value == "":
        return None
    t = value.strip()
    return 0.0 if not t else float(t) if re.match(NUMERAL, t) and abs(float(t)) != float("inf") else None
