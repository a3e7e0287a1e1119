"""Planar and spherical geometry as Column expressions; points are structs (x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0  # sphere used for areas
MERCATOR_M = 6_378_137.0  # EPSG:3857
SQUARE_METRES_A_PERSON = 30.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857 in closed form."""
    return F.radians(lon) * MERCATOR_M, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_M


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_M), F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - math.pi / 2)


def projector(crs: str | None):
    """(project, unproject) for a CRS name; identity for geographic ones. Others raise: no projection library here."""
    name = (crs or "EPSG:4326").upper().removeprefix("EPSG:")
    if name in ("4326", "WGS84", "CRS84"):
        return (lambda x, y: (x, y)), (lambda x, y: (x, y))
    if name in ("3857", "900913", "102100"):
        return to_mercator, from_mercator
    raise ValueError(f"unsupported CRS: {crs}")


def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Struct (distance, x, y, fraction) of the point of segment a-b that is closest to p."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(square, F.lit(0.0)))))
    x, y = ax + t * dx, ay + t * dy
    return F.struct(distance(px, py, x, y).alias("distance"), x.alias("x"), y.alias("y"), t.alias("fraction"))


def _edges(points: Column) -> Column:
    """Structs (a, b) of consecutive points."""
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.size(points)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def polyline_length(points: Column) -> Column:
    return _sum(F.transform(_edges(points), lambda e: distance(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))


def close_ring(points: Column) -> Column:
    first, last = F.get(points, F.lit(0)), F.element_at(points, -1)
    return F.when((F.size(points) > 0) & (first != last), F.concat(points, F.array(first))).otherwise(points)


def signed_area(ring: Column) -> Column:
    return _sum(F.transform(_edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule over the edges of a closed ring."""
    crosses = lambda e: ((e["a"]["y"] > py) != (e["b"]["y"] > py)) & (px < (e["b"]["x"] - e["a"]["x"]) * (py - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    return F.size(F.filter(_edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def _side(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Proper crossing of segments a-b and c-d."""
    return (_side(a, b, c) * _side(a, b, d) < 0) & (_side(c, d, a) * _side(c, d, b) < 0)


def crosses_ring(a: Column, b: Column, ring: Column) -> Column:
    return F.exists(_edges(ring), lambda e: segments_cross(a, b, e["a"], e["b"]))


def self_intersects(ring: Column) -> Column:
    edges = _edges(ring)
    return F.exists(F.transform(edges, lambda e, i: F.exists(F.slice(edges, i + 3, F.size(edges)), lambda o: segments_cross(e["a"], e["b"], o["a"], o["b"]))), lambda x: x)


def spherical_area(ring: Column) -> Column:
    """Square metres of a (lon, lat) ring on the sphere, by trapezoids in longitude."""
    part = lambda e: F.radians(e["b"]["x"] - e["a"]["x"]) * (2 + F.sin(F.radians(e["a"]["y"])) + F.sin(F.radians(e["b"]["y"])))
    return F.abs(_sum(F.transform(_edges(close_ring(ring)), part)) * EARTH_M * EARTH_M / 2)


def centroid(ring: Column) -> Column:
    """Area-weighted centroid of a ring in a local plane; the vertices' mean if it has no area or under three points."""
    closed = close_ring(ring)
    n = F.size(ring)
    mean = point(_sum(F.transform(ring, lambda p: p["x"])) / n, _sum(F.transform(ring, lambda p: p["y"])) / n)
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    area = signed_area(closed)
    weighted = lambda c: _sum(F.transform(_edges(closed), lambda e: (e["a"][c] + e["b"][c]) * cross(e))) / F.nullif(6 * area, F.lit(0.0))
    return F.when((n < 3) | (F.abs(area) < 1e-12), mean).otherwise(point(weighted("x"), weighted("y")))


def household_capacity(area_m2: Column, levels: Column) -> Column:
    """Persons a building holds: floor space over SQUARE_METRES_A_PERSON, at least one level."""
    return F.floor(area_m2 * F.greatest(F.lit(1), F.coalesce(levels, F.lit(1))) / SQUARE_METRES_A_PERSON)


def bend_angle(ax, ay, bx, by, cx, cy) -> Column:
    """Degrees between b-a and b-c; 180 is straight on."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    return F.degrees(F.atan2(F.abs(ux * vy - uy * vx), ux * vx + uy * vy))


def turn_class(in_x: Column, in_y: Column, out_x: Column, out_y: Column) -> Column:
    """Turn from one heading into another. Limits in degrees: 20 through, 45 slight, 120 sharp, 150 reverse."""
    delta = F.degrees(F.atan2(in_x * out_y - in_y * out_x, in_x * out_x + in_y * out_y))
    size, side = F.abs(delta), F.when(delta > 0, "left").otherwise("right")
    none = (F.hypot(in_x, in_y) < 1e-9) | (F.hypot(out_x, out_y) < 1e-9)
    return F.when(none | size.isNull(), "unknown").when(size < 20, "through").when(size > 150, "reverse").when(size < 45, F.concat(F.lit("slight_"), side)).when(size > 120, F.concat(F.lit("sharp_"), side)).otherwise(side)


def movement_type(in_x: Column, in_y: Column, out_x: Column, out_y: Column) -> Column:
    """Coarse movement: u_turn below cosine -0.98, through below cross product 0.2, else left or right."""
    size = F.nullif(F.hypot(in_x, in_y) * F.hypot(out_x, out_y), F.lit(0.0))
    cosine, cross = (in_x * out_x + in_y * out_y) / size, (in_x * out_y - in_y * out_x) / size
    return F.when(cosine.isNull(), "unknown").when(cosine < -0.98, "u_turn").when(F.abs(cross) < 0.2, "through").when(cross > 0, "left").otherwise("right")


def to_wkt(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def from_wkt(text: Column) -> Column:
    """Points of a LINESTRING; anything else is an empty array."""
    pairs = F.split(F.regexp_extract(text, r"^\s*LINESTRING\s*\((.*)\)\s*$", 1), r"\s*,\s*")
    got = F.transform(pairs, lambda p: point(F.get(F.split(F.trim(p), r"\s+"), F.lit(0)).try_cast("double"), F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double")))
    bad = text.isNull() | F.exists(got, lambda p: p["x"].isNull() | p["y"].isNull())
    return F.when(bad, F.array().cast("array<struct<x:double,y:double>>")).otherwise(got)
