import math
import random

from pyspark.sql import functions as F

from lodspark.functions import geo
from lodspark.operators import polygons

RINGS = "rings array<array<struct<x:double,y:double>>>"


def cast(rings, x, y):
    """Even-odd rule over the edges of all rings."""
    odd = False
    for ring in rings:
        pts = [p for p in ring if None not in p]
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def shapes(rng):
    out = {}
    for k in range(14):
        cx, cy, n, r = rng.uniform(-3, 3), rng.uniform(-3, 3), rng.randint(3, 25), rng.choice([0.05, 0.6, 2.5])
        ring = [(cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        hole = [(cx + 0.2 * r * math.cos(i), cy + 0.2 * r * math.sin(i)) for i in range(6)]
        out[k] = [ring + ring[:1]] + ([hole] if k % 3 == 0 else [])
    out[20] = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]  # sides on the grid
    out[21] = [[(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]]  # the neighbour
    out[22] = [[(0.0, 0.0), (1.0, 1.0)]]
    out[23] = []
    out[24] = [[(-3.0, -3.0), (3.0, -2.9), (None, 1.0), (3.0, 3.0), (-2.9, 3.0)], [(2.0, 2.0), (2.5, 2.0), (2.5, 2.5)]]
    return out


def test_points_equal_a_cast_over_all_pairs(spark):
    rng = random.Random(1)
    of = shapes(rng)
    points = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(500)]
    points += [(1000 + i, x / 2, y / 2) for i, (x, y) in enumerate((x, y) for x in range(-6, 7) for y in range(-6, 7))]
    df = spark.createDataFrame([*points, (5000, None, 1.0), (5001, float("nan"), 1.0)], "p long, x double, y double")
    shape = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, rings in of.items()], f"s long, {RINGS}").select("s", polygons.edges(F.col("rings")).alias("edges"))
    want = sorted((p, s) for p, x, y in points for s, rings in of.items() if s != 22 and cast(rings, x, y))
    for size in (0.07, 0.5, 3.0):
        assert sorted((r.p, r.s) for r in polygons.located(df, shape, size).collect()) == want, size
    shared = [p for p, s in want if s in (20, 21)]
    assert len(shared) == len(set(shared)), "neighbours share no point"


def test_inner_cells_need_no_edges(spark):
    square = spark.createDataFrame([(1, "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))")], "s long, wkt string")
    shape = square.select("s", polygons.edges(F.array(geo.polygon_ring(F.col("wkt")))).alias("edges"))
    rows = polygons.cells(shape, 0.5).collect()
    assert len([r for r in rows if not r.border]) >= 18 * 18 and all(r.edges is None for r in rows if not r.border)
    assert max(len(r.edges) for r in rows if r.border) <= 4 and len(rows) <= 22 * 22
    assert polygons.located(spark.createDataFrame([], "x double, y double"), shape, 0.5).count() == 0
