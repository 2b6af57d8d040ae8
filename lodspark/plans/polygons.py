"""Queries on points in polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodspark.operators import polygons

from .tables import table

#: Corners of the drawn polygons, in steps from their middle.
_CORNERS = [(4, 0), (3, 3), (0, 4), (-3, 3), (-4, 0), (-3, -3), (0, -4), (3, -3)]


def _located(s, d):
    """Customers as points in suppliers' estates: uneven stars, every third with a hole."""
    key = F.col("s_suppkey")

    def ring(step: float):
        at = [(F.col("mx") + (step * x) * (1 + (key + i) % 3), F.col("my") + (step * y) * (1 + (key + i) % 3)) for i, (x, y) in enumerate(_CORNERS)]
        return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in at])

    sup = table(s, d, "supplier").select("s_suppkey", (-58 + F.col("s_acctbal") / 2500.0).alias("mx"), (1.5 + (key % 50) / 10.0).alias("my"))
    rings = F.when(key % 3 == 0, F.array(ring(0.04), ring(0.01))).otherwise(F.array(ring(0.04)))
    estates = sup.select("s_suppkey", polygons.edges(rings).alias("edges"))
    points = table(s, d, "customer").select("c_custkey", (-58 + F.col("c_acctbal") / 2500.0).alias("x"), (1.5 + (F.col("c_custkey") % 500) / 100.0).alias("y"))
    return polygons.located(points, estates, 0.1).select("c_custkey", "s_suppkey")


QUERIES = {"points_in_polygons": _located}


def _sql() -> str:
    at = lambda step, i: f"{{'x': mx + ({step} * {_CORNERS[i][0]}) * (1 + (s_suppkey + {i}) % 3), 'y': my + ({step} * {_CORNERS[i][1]}) * (1 + (s_suppkey + {i}) % 3)}}"
    edge = lambda step: ", ".join(f"{{'p': {at(step, i)}, 'q': {at(step, (i + 1) % 8)}}}" for i in range(8))
    return f"""WITH m AS (SELECT s_suppkey, -58 + s_acctbal / 2500.0::DOUBLE AS mx, 1.5::DOUBLE + (s_suppkey % 50) / 10.0::DOUBLE AS my FROM supplier),
        e AS (SELECT s_suppkey, unnest([{edge('0.04::DOUBLE')}]) AS e FROM m UNION ALL SELECT s_suppkey, unnest([{edge('0.01::DOUBLE')}]) FROM m WHERE s_suppkey % 3 = 0),
        f AS (SELECT s_suppkey, e.p.x AS x1, e.p.y AS y1, e.q.x AS x2, e.q.y AS y2 FROM e),
        c AS (SELECT c_custkey, -58 + c_acctbal / 2500.0::DOUBLE AS x, 1.5::DOUBLE + (c_custkey % 500) / 100.0::DOUBLE AS y FROM customer)
        SELECT c_custkey, s_suppkey FROM c JOIN f ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        GROUP BY c_custkey, s_suppkey HAVING count(*) % 2 = 1"""


SQL = {"points_in_polygons": _sql()}
