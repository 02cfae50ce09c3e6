"""What each statistic needs of a layer, and which of a layer's fields meet it, without computing any."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessera.operators.aggregates import inspect_fields


@dataclass(frozen=True)
class Need:
    geometry: str | None  # point, any (of one family), or None
    number: bool
    least: int
    positive: bool = False
    complete: bool = True  # missing values are refused, not decided


CATALOG: dict[str, Need] = {
    "gini": Need(None, True, 3, positive=True, complete=False),
    "shannon": Need(None, False, 3, complete=False),
    "getis_ord": Need("any", True, 6),
    "kernel_density": Need("point", False, 3),
    "moran_i": Need("any", True, 3),
    "local_moran": Need("any", True, 3),
    "average_nearest_neighbor": Need("point", False, 3),
}


def inspect(df: DataFrame, families: list[str]) -> list[dict]:
    """A verdict for each statistic: feasible or not, why not, and the fields that would do."""
    fields = [r.asDict() for r in inspect_fields(df, kinds=False).collect()]
    n = df.count()
    out = []
    for name, need in CATALOG.items():
        why = []
        if n < need.least:
            why.append(f"{n} of {need.least} features")
        if need.geometry == "point" and families != ["point"] or need.geometry == "any" and len(families) != 1:
            why.append(f"geometry is {families or 'absent'}")
        fit = [f["field"] for f in fields if f["reason"] is None and f["valid"] >= need.least and (not need.positive or f["least"] >= 0) and (not need.complete or not f["missing"])]
        if need.number and not fit:
            why.append("no numeric field that fits")
        out.append({"index": name, "feasible": not why, "why": why, "fields": fit if need.number else []})
    return out
