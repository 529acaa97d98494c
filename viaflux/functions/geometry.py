"""Geometries as struct<type, parts: array<array<struct<x, y>>>> with built-in functions only.

Well-known text and GeoJSON are read to this form; null stands for what cannot be read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
GEOMETRY = f"struct<type:string,parts:array<{POINTS}>>"


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, what, ""))


def from_wkt(wkt: Column) -> Column:
    """LINESTRING and MULTILINESTRING, also with Z (dropped). A cut-off or empty text gives null."""
    t = F.upper(F.trim(wkt))
    whole = (_count(t, r"\(") == _count(t, r"\)")) & t.rlike(r"^(MULTI)?LINESTRING *Z? *\(.*\)$")
    lists = F.regexp_extract_all(t, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda p: F.struct(
        F.element_at(F.split(F.trim(p), r"\s+"), 1).try_cast("double").alias("x"),
        F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(2)).try_cast("double").alias("y"),
    )
    parts = F.transform(lists, lambda s: F.transform(F.split(s, ","), point))
    sound = F.forall(parts, lambda a: (F.size(a) >= 2) & F.forall(a, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    kind = F.when(t.startswith("MULTI"), "MultiLineString").otherwise("LineString")
    return F.when(whole & (F.size(parts) > 0) & sound & ((kind != "LineString") | (F.size(parts) == 1)), F.struct(kind.alias("type"), parts.alias("parts")))


def from_geojson(text: Column) -> Column:
    """A GeoJSON LineString, MultiLineString or Point as text; further coordinates are dropped."""
    kind = F.get_json_object(text, "$.type")
    points = lambda a: F.transform(a, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    line = F.from_json(text, "coordinates array<array<double>>")["coordinates"]
    multi = F.from_json(text, "coordinates array<array<array<double>>>")["coordinates"]
    single = F.from_json(text, "coordinates array<double>")["coordinates"]
    parts = F.when(kind == "LineString", F.array(points(line))).when(kind == "MultiLineString", F.transform(multi, points)).when(kind == "Point", F.array(points(F.array(single))))
    return F.when(parts.isNotNull() & (F.size(parts) > 0) & F.exists(parts, lambda a: F.size(a) > 0), F.struct(kind.alias("type"), parts.alias("parts")))


def is_empty(g: Column) -> Column:
    return g.isNull() | (F.size(g["parts"]) == 0) | F.forall(g["parts"], lambda a: F.size(a) == 0)


def first_point(g: Column) -> Column:
    return g["parts"][0][0]


def last_point(g: Column) -> Column:
    return F.element_at(F.element_at(g["parts"], -1), -1)


def middle_vertex(g: Column) -> Column:
    """The vertex halfway through the first part's list."""
    a = g["parts"][0]
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def centroid(g: Column) -> Column:
    """Mean of segment middles weighted by length in degrees; mean of vertices where the length is zero."""
    zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        n = F.sqrt(F.pow(a["x"] - b["x"], F.lit(2.0)) + F.pow(a["y"] - b["y"], F.lit(2.0)))
        return F.struct((acc["l"] + n).alias("l"), (acc["x"] + n * (a["x"] + b["x"]) / 2).alias("x"), (acc["y"] + n * (a["y"] + b["y"]) / 2).alias("y"))

    pairs = F.flatten(F.transform(g["parts"], lambda p: F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    s = F.aggregate(pairs, zero, add)
    flat = F.flatten(g["parts"])
    mean = lambda c: F.aggregate(flat, F.lit(0.0), lambda acc, p: acc + p[c]) / F.size(flat)
    return F.when(s["l"] > 0, F.struct((s["x"] / s["l"]).alias("x"), (s["y"] / s["l"]).alias("y"))).otherwise(F.struct(mean("x").alias("x"), mean("y").alias("y")))


def rounded(g: Column, digits: int = 6) -> Column:
    """All coordinates rounded."""
    parts = F.transform(g["parts"], lambda p: F.transform(p, lambda c: F.struct(F.bround(c["x"], digits).alias("x"), F.bround(c["y"], digits).alias("y"))))
    return F.struct(g["type"].alias("type"), parts.alias("parts"))


def to_geojson(g: Column) -> Column:
    """GeoJSON text of a line, multi-line or point."""
    pair = lambda p: F.transform(p, lambda c: F.array(c["x"], c["y"]))
    line = F.to_json(F.struct(g["type"].alias("type"), pair(g["parts"][0]).alias("coordinates")))
    multi = F.to_json(F.struct(g["type"].alias("type"), F.transform(g["parts"], pair).alias("coordinates")))
    point = F.to_json(F.struct(g["type"].alias("type"), F.array(g["parts"][0][0]["x"], g["parts"][0][0]["y"]).alias("coordinates")))
    return F.when(g["type"] == "LineString", line).when(g["type"] == "MultiLineString", multi).otherwise(point)


def simplified(geometry: Column, tolerance: float = 0.0005) -> Column:
    """Douglas-Peucker on every part, in a pandas UDF (no built-in function can express it)."""

    @F.pandas_udf(GEOMETRY)
    def run(g: pd.DataFrame) -> pd.DataFrame:
        parts = [None if p is None else [_douglas_peucker([(c["x"], c["y"]) for c in part], tolerance) for part in p] for p in g["parts"]]
        return pd.DataFrame({"type": g["type"], "parts": [None if p is None else [[{"x": x, "y": y} for x, y in part] for part in p] for p in parts]})

    return run(geometry)


def _douglas_peucker(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (x1, y1), (x2, y2) = points[a], points[b]
        dx, dy, far, at = x2 - x1, y2 - y1, -1.0, None
        n2 = dx * dx + dy * dy
        for i in range(a + 1, b):
            px, py = points[i][0] - x1, points[i][1] - y1
            t = 0.0 if n2 == 0 else max(0.0, min(1.0, (px * dx + py * dy) / n2))
            d = ((px - t * dx) ** 2 + (py - t * dy) ** 2) ** 0.5
            if d > far:
                far, at = d, i
        if at is not None and far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]
