"""Which polygons points lie in: polygons as grid cells, equal cells joined, rays cast in border cells only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Border cells of up to so many edges have them as plain columns, so pairs are tested in compiled code.
FEW = 8


def edges(rings: Column) -> Column:
    """The edges (x1, y1, x2, y2) of rings (arrays of points x, y), closed where they are not; holes and parts are further rings. Points without coordinates are left out."""
    def of(ring: Column) -> Column:
        known = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        after = F.concat(F.slice(known, F.lit(2), F.size(known)), F.slice(known, 1, 1))
        pairs = F.zip_with(known, after, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
        return F.filter(pairs, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))

    return F.flatten(F.transform(rings, of))


def _crossing(e: Column | dict[str, Column], y: Column) -> Column:
    """Where an edge meets a level."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]


def _crossed(e: Column | dict[str, Column], x: Column, y: Column) -> Column:
    """Whether a ray to the right meets an edge; it counts with its lower end, without its upper one."""
    return ((e["y1"] > y) != (e["y2"] > y)) & (x < _crossing(e, y))


def inside(of: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right meets an odd number of edges."""
    return F.size(F.filter(of, lambda e: _crossed(e, x, y))) % 2 == 1


def cells(polygons: DataFrame, size: float) -> DataFrame:
    """`cell_y, cell_x, border` beside each polygon's columns but `edges`: the grid cells that it covers; a border cell has `edges`, those that a ray from it may meet, others lie within and have null.

    A polygon becomes rows of cells and these become cells, so neither a large polygon nor one of many
    edges is ever more than a row at a time; a row keeps only the edges that pass through it.
    """
    keep = [c for c in polygons.columns if c != "edges"]
    floor = lambda v: F.floor(v / size).cast("long")
    ys = F.flatten(F.transform("edges", lambda e: F.array(e["y1"], e["y2"])))
    rows = polygons.filter(F.size("edges") > 2).withColumn("cell_y", F.explode(F.sequence(floor(F.array_min(ys)), floor(F.array_max(ys)))))
    bottom, top = F.col("cell_y") * size, (F.col("cell_y") + 1) * size
    rows = rows.withColumn("edges", F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= bottom) & (F.least(e["y1"], e["y2"]) <= top)))

    def reach(e: Column) -> Column:
        """First and last column that an edge passes in this row, with some room for rounding."""
        at = lambda y: F.when(e["y1"] == e["y2"], e["x1"]).otherwise(_crossing(e, F.least(F.greatest(y, F.least(e["y1"], e["y2"])), F.greatest(e["y1"], e["y2"]))))
        one, two = F.when(e["y1"] == e["y2"], e["x1"]).otherwise(at(bottom)), F.when(e["y1"] == e["y2"], e["x2"]).otherwise(at(top))
        room = size * 1e-6
        return F.struct(floor(F.least(one, two) - room).alias("first"), floor(F.greatest(one, two) + room).alias("last"))

    rows = rows.withColumn("reach", F.transform("edges", reach)).filter(F.size("edges") > 0)
    columns = F.sequence(F.array_min(F.col("reach")["first"]), F.array_max(F.col("reach")["last"]))
    out = rows.withColumn("cell_x", F.explode(columns))
    out = out.withColumn("border", F.exists("reach", lambda r: F.col("cell_x").between(r["first"], r["last"])))
    out = out.filter(F.col("border") | inside(F.col("edges"), (F.col("cell_x") + 0.5) * size, (F.col("cell_y") + 0.5) * size))
    left = F.col("cell_x") * size
    ahead = F.when(F.col("border"), F.filter("edges", lambda e: F.greatest(e["x1"], e["x2"]) >= left))
    return out.select(*keep, "cell_y", "cell_x", "border", ahead.alias("edges"))


def located(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Columns of `points` (with x, y) and of `polygons` (but `edges`), for each point in each polygon; names of the two have to differ.

    A point on an edge that has the polygon to its right is inside, so polygons that share an edge share no
    point. Points without coordinates, and polygons without edges, meet nothing. `size` is a cell's side:
    about that of the smaller polygons.

    A few points and polygons can have very many pairs, so both are dealt over tasks by their cells:
    neither the size of their files nor that of the shuffle decides how many tasks make the pairs. Cells
    of more than `FEW` edges are met in a join of their own.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = ["cell_y", "cell_x"]
    floor = lambda c: F.floor(F.col(c) / size).cast("long")
    p = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)").withColumns({"cell_y": floor("y"), "cell_x": floor("x")})
    p = p.repartition(tasks, *at)
    all_cells = cells(polygons.repartition(points.sparkSession.sparkContext.defaultParallelism), size)
    out = [*points.columns, *[c for c in polygons.columns if c != "edges"]]

    # Edges that a cell lacks are level, so no ray meets them. They become columns after the shuffle: before it, each would make the list again.
    level = lambda i, c: F.coalesce(F.get("edges", F.lit(i))[c], F.lit(0.0))
    few = all_cells.filter(~F.col("border") | (F.size("edges") <= FEW)).repartition(tasks, *at).withColumns({f"edge{i}_{c}": level(i, c) for i in range(FEW) for c in ("x1", "y1", "x2", "y2")}).drop("edges")
    odd = F.lit(False)
    for i in range(FEW):
        odd = odd != _crossed({c: F.col(f"edge{i}_{c}") for c in ("x1", "y1", "x2", "y2")}, F.col("x"), F.col("y"))
    met = few.hint("merge").join(p, at).filter(~F.col("border") | odd).select(*out)

    many = all_cells.filter(F.col("border") & (F.size("edges") > FEW))
    return met.unionByName(many.repartition(tasks, *at).hint("merge").join(p, at).filter(inside(F.col("edges"), F.col("x"), F.col("y"))).select(*out))
