"""Checks over a built graph: classes, link coverage, bounds, dangling links and provenance depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodspark.functions.geo import in_bounds


def retired_class(graph: DataFrame, code: str = "E24") -> DataFrame:
    """`n`: entities of a class that must not occur any more."""
    return graph.agg(F.count_if(F.exists("types", lambda t: t.contains(code))).alias("n"))


def link_coverage(tables: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """`entity, link, linked, total`: how many rows of each table have each link; one aggregation a table."""
    out = None
    for name, (table, links) in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in links.items()])
        listed = row.select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("link"), F.col(k).alias("linked")) for k in links])).alias("x"))
        part = listed.select(F.lit(name).alias("entity"), "x.link", "x.linked", "total")
        out = part if out is None else out.unionByName(part)
    return out


#: The checks on a graph: name, class, and the property that its entities should have. Fixed values.
LINKS = [
    ("E25 with location", "E25", "place"), ("E26 with location", "E26", "place"), ("E41 with content", "E41", "content"), ("E13 with organization", "E13", "about"), ("E13 with class", "E13", None),
    ("E13 with year", "E13", "year"), ("E22 carrying something", "E22", "carries"), ("E25 with representation", "E25", "depicted_on"), ("E25 with type", "E25", "status"), ("E22 with production", "E22", "produced_by"),
    ("E12 with product", "E12", "produced"), ("E12 with maker", "E12", "maker"), ("E12 with place", "E12", "place"), ("E36 with content", "E36", "content_url"), ("E36 with keeper", "E36", "keeper"),
]


def report(graph: DataFrame) -> DataFrame:
    """`check, linked, total` of a graph (id, class, body): all checks in one aggregation over its rows, each body parsed once.

    A property counts if it is there and is neither blank nor an empty list. Besides LINKS: entities of
    the class that was given up (both numbers should be 0), and polygons and lines, linked those whose
    first point lies in the country's window - of every geometry, not of the first alone.
    """
    rows = graph.select("class", F.from_json("body", "map<string,string>").alias("m"))
    has = lambda k: F.coalesce(F.trim(F.col("m")[k]), F.lit("")).isin("", "[]") == F.lit(False)
    shape = F.upper(F.col("m")["geometry"])
    point = lambda n: F.regexp_extract(F.col("m")["geometry"], r"\(+\s*(-?[\d.]+)\s+(-?[\d.]+)", n).try_cast("double")
    checks = [("retired class E24", F.col("class") == "E24", F.lit(True))]
    checks += [(name, F.col("class") == code, has(key) if key else F.lit(True)) for name, code, key in LINKS]
    checks += [(f"{kind.title()}s in the country", F.coalesce(shape.startswith(kind), F.lit(False)), F.coalesce(in_bounds(point(1), point(2)), F.lit(False))) for kind in ("POLYGON", "LINESTRING")]
    sums = rows.agg(*[F.struct(F.count_if(of & ok).alias("linked"), F.count_if(of).alias("total")).alias(f"c{n}") for n, (_, of, ok) in enumerate(checks)])
    listed = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{n}.linked").alias("linked"), F.col(f"c{n}.total").alias("total")) for n, (name, _, _) in enumerate(checks)]))
    return sums.select(listed.alias("x")).select("x.*")


def ends(graph: DataFrame, keys: list[str]) -> DataFrame:
    """`src, key, dst`: the links of a graph's bodies, under the given keys; lists give a link each."""
    value = F.col("m")[F.col("key")]
    listed = F.coalesce(F.from_json(F.when(value.startswith("["), value), "array<string>"), F.array(value))
    rows = graph.select("id", F.from_json("body", "map<string,string>").alias("m")).withColumn("key", F.explode(F.array(*[F.lit(k) for k in keys])))
    return rows.filter(value.isNotNull()).select(F.col("id").alias("src"), "key", F.explode(listed).alias("dst"))


def outside(points: DataFrame, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """Rows whose point lies outside the country's window: a wrong grid shows in any row, not just the first."""
    return points.filter(~F.coalesce(in_bounds(F.col(lng), F.col(lat)), F.lit(True)))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`dst, n`: targets of links (src, dst) that no node (id) has."""
    return edges.join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti").groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def provenance_level(source: Column, file: Column, row: Column, original: Column) -> Column:
    """Depth of a claim's evidence: D1 a source, D2 its file, D3 the row, D4 a picture of the original."""
    return F.when(original.isNotNull() & row.isNotNull(), "D4").when(row.isNotNull(), "D3").when(file.isNotNull(), "D2").when(source.isNotNull(), "D1")


def chain(*steps: tuple[str, Column]) -> Column:
    """The steps of a provenance chain that have a value, in order."""
    return F.filter(F.array(*[F.struct(F.lit(k).alias("step"), v.alias("value")) for k, v in steps]), lambda s: F.coalesce(F.trim(s["value"]), F.lit("")) != "")
