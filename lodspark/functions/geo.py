"""Well-known text, centroids, bounds and the national grid, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fixed

_POINT = "struct<x:double,y:double>"

# Transverse Mercator grid EPSG:31170 on the International 1924 ellipsoid, and its shift to WGS 84: fixed values.
_A, _F = 6378388.0, 1 / 297.0
_K0, _LON0, _X0 = 0.9996, -55.68333333333, 500000.0
_SHIFT = (-265.0, 120.0, -358.0)
_WGS_A, _WGS_F = 6378137.0, 1 / 298.257223563


def _series() -> tuple[float, list[float], list[float]]:
    """Radius of the rectifying sphere, and the series of the inverse projection, from the third flattening."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return radius, beta, delta


def reproject_all(points: Column) -> Column:
    """Points (x, y) in grid metres to WGS 84: structs of lng and lat. Krueger series, then a three-parameter shift.

    Each step is a transformation of its own, so what a later one uses several times is computed once.
    """
    radius, beta, delta = _series()
    e2, w2 = _F * (2 - _F), _WGS_F * (2 - _WGS_F)
    terms = lambda of, factors: sum((f * of(2 * j) for j, f in enumerate(factors, 1)), F.lit(0.0))

    def scaled(p: Column) -> Column:
        return F.struct((p["y"] / (_K0 * radius)).alias("xi"), ((p["x"] - _X0) / (_K0 * radius)).alias("eta"))

    def straightened(p: Column) -> Column:
        xi = p["xi"] - terms(lambda k: F.sin(k * p["xi"]) * F.cosh(k * p["eta"]), beta)
        eta = p["eta"] - terms(lambda k: F.cos(k * p["xi"]) * F.sinh(k * p["eta"]), beta)
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def on_sphere(p: Column) -> Column:
        return F.struct(F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])).alias("chi"), (F.lit(math.radians(_LON0)) + F.atan2(F.sinh(p["eta"]), F.cos(p["xi"]))).alias("lam"))

    def on_ellipsoid(p: Column) -> Column:
        return F.struct((p["chi"] + terms(lambda k: F.sin(k * p["chi"]), delta)).alias("phi"), p["lam"].alias("lam"))

    def shifted(p: Column) -> Column:
        v = _A / F.sqrt(1 - e2 * F.sin(p["phi"]) * F.sin(p["phi"]))
        return F.struct((v * F.cos(p["phi"]) * F.cos(p["lam"]) + _SHIFT[0]).alias("x"), (v * F.cos(p["phi"]) * F.sin(p["lam"]) + _SHIFT[1]).alias("y"), (v * (1 - e2) * F.sin(p["phi"]) + _SHIFT[2]).alias("z"))

    def geodetic(q: Column) -> Column:
        b = _WGS_A * (1 - _WGS_F)
        p = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"])
        theta = F.atan2(q["z"] * _WGS_A, p * b)
        lat = F.atan2(q["z"] + w2 / (1 - w2) * b * F.pow(F.sin(theta), F.lit(3.0)), p - w2 * _WGS_A * F.pow(F.cos(theta), F.lit(3.0)))
        return F.struct(F.degrees(F.atan2(q["y"], q["x"])).alias("lng"), F.degrees(lat).alias("lat"))

    for step in (scaled, straightened, on_sphere, on_ellipsoid, shifted, geodetic):
        points = F.transform(points, step)
    return points


def reproject(x: Column, y: Column) -> Column:
    """One point of `reproject_all`."""
    return reproject_all(F.array(F.struct(x.alias("x"), y.alias("y"))))[0]


def in_bounds(lng: Column, lat: Column) -> Column:
    """Whether a point lies in the country's window."""
    return (lng > -58) & (lng < -53) & (lat > 1) & (lat < 7)


def pairs(body: Column) -> Column:
    """Points of `x y, x y, ...`; pairs that are not numbers are dropped."""
    made = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda p: F.struct(F.get(F.split(F.trim(p), r"\s+"), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double").alias("y")))
    return F.filter(made, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def polygon_ring(wkt: Column) -> Column:
    """The first ring of a polygon, null with fewer than four points."""
    ring = pairs(F.regexp_extract(wkt, r"(?i)polygon\s*\(+([^()]+)\)", 1))
    return F.when(F.size(ring) >= 4, ring)


def line_points(wkt: Column) -> Column:
    """The points of a line, null with fewer than two."""
    line = pairs(F.regexp_extract(wkt, r"(?i)^\s*linestring\s*\(([^()]+)\)", 1))
    return F.when(F.size(line) >= 2, line)


def segments(wkt: Column) -> Column:
    """The segments of a line or multi-line, those of fewer than two points dropped."""
    return F.filter(F.transform(F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)")), pairs), lambda s: F.size(s) >= 2)


def geometry_kind(parts: Column) -> Column:
    """GeoJSON type of line segments: one is a line."""
    return F.when(F.size(parts) == 1, "LineString").when(F.size(parts) > 1, "MultiLineString")


def _pair(p: Column, digits: int | None) -> Column:
    show = (lambda c: fixed(c, digits)) if digits is not None else (lambda c: c.cast("string"))
    return F.concat(show(p["x"]), F.lit(" "), show(p["y"]))


def write_line(points: Column, digits: int | None = None) -> Column:
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(points, lambda p: _pair(p, digits)), ", "), F.lit(")"))


def write_multiline(parts: Column, digits: int | None = None) -> Column:
    """Multi-line text of segments of two points or more; null if there are none."""
    kept = F.filter(parts, lambda s: F.size(s) >= 2)
    text = F.transform(kept, lambda s: F.concat(F.lit("("), F.array_join(F.transform(s, lambda p: _pair(p, digits)), ", "), F.lit(")")))
    return F.when(F.size(kept) > 0, F.concat(F.lit("MULTILINESTRING("), F.array_join(text, ", "), F.lit(")")))


def mean_point(points: Column) -> Column:
    """The mean of the vertices (a closing vertex counts twice), null without any."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(points, zero, lambda a, p: F.struct((a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y")))
    n = F.size(points)
    return F.when(n > 0, F.struct((total["x"] / n).alias("x"), (total["y"] / n).alias("y")))


def swap(points: Column) -> Column:
    """Points with latitude first, as maps want them."""
    return F.transform(points, lambda p: F.struct(p["y"].alias("lat"), p["x"].alias("lng")))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    return 2 * 6371.0 * F.asin(F.least(F.sqrt(h), F.lit(1.0)))
