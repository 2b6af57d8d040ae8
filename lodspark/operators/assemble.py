"""The graph: entity tables of all sources as rows of id, class and JSON body; map features; link coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodspark.functions import geo
from lodspark.functions.uri import BASE

from .dedupe import first_wins, in_sequence
from .entities import MAP_1860, MAP_1930
from .graph import collected, entity, union_all

#: The two maps: id, link, label, year, holding archive. Fixed values.
MAPS = [
    ("MAP_1930", MAP_1930, "Kaart van Suriname (1930)", "1930", "UB Leiden"),
    ("MAP_1860-79", MAP_1860, "Kaart van Suriname (1860-1879)", "1870", "UB Leiden"),
]
#: Types of the vocabulary: id and label. Fixed values.
TYPES = [
    ("plantation-status/built", "Built"),
    ("plantation-status/planned", "Planned"),
    ("plantation-status/abandoned", "Abandoned"),
    ("plantation-status/unknown", "Unknown"),
    ("source-type/map", "Map"),
    ("source-type/almanac", "Almanac"),
    ("source-type/register", "Register"),
    ("product/sugar", "Sugar"),
    ("product/coffee", "Coffee"),
    ("product/cacao", "Cacao"),
    ("product/cotton", "Cotton"),
    ("product/wood", "Wood"),
]


def _base(path: str, part: Column) -> Column:
    return F.concat(F.lit(BASE + path), part)


def sources(spark: SparkSession, almanac: dict[str, DataFrame]) -> DataFrame:
    """`id, uri, label, year, kind, keeper`: both maps and the almanac's years."""
    maps = spark.createDataFrame(MAPS, "id string, uri string, label string, year string, keeper string").withColumn("kind", F.lit("map"))
    years = almanac["e22"].select("id", "uri", "label", "year", F.lit(None).cast("string").alias("keeper"), F.lit("almanac").alias("kind"))
    return maps.unionByName(years)


def time_spans(almanac: dict[str, DataFrame]) -> DataFrame:
    """`id, year`: a span for each observed year; the maps' years have one only if they were observed."""
    return almanac["e22"].select(_base("timespan/", F.col("year")).alias("id"), "year")


def source_years(spark: SparkSession, almanac: dict[str, DataFrame]) -> DataFrame:
    """`src, dst`: the spans that productions of sources point to."""
    return sources(spark, almanac).select(F.col("uri").alias("src"), _base("timespan/", F.col("year")).alias("dst"))


def _names(e41: DataFrame) -> DataFrame:
    """Names with their place: rows in file order, and the names of a row in theirs."""
    return e41.withColumn("place", F.col("pos") * 16 + F.col("nth"))


def graph(spark: SparkSession, plantation: dict[str, DataFrame], river: dict[str, DataFrame], almanac: dict[str, DataFrame]) -> DataFrame:
    """All entities (id, class, body, and pos where a file's row gives one): features with their names and depictions, organizations, places, names, sources, productions, spans, types and observations."""
    p_names = collected(_names(plantation["e41"]), "identifies", "uri", "place", "names")
    r_names = collected(_names(river["e41"]), "identifies", "uri", "place", "names")
    shown = collected(plantation["map_links"], "feature_uri", "map_uri", "pos", "maps")
    e25 = plantation["e25"].join(p_names, F.col("uri") == F.col("identifies"), "left").join(shown, F.col("uri") == F.col("feature_uri"), "left")
    owner = lambda c: F.concat(F.lit("http://www.wikidata.org/entity/"), c)
    src = sources(spark, almanac)
    carried = plantation["e41"].select("carried_by", "uri").unionByName(river["e41"].select("carried_by", "uri")).unionByName(almanac["e41"].select("carried_by", "uri"))
    carried = carried.filter("carried_by <> ''").groupBy("carried_by").agg(F.sort_array(F.collect_set("uri")).alias("carries"))
    src = src.join(carried, F.col("uri") == F.col("carried_by"), "left")
    production = _base("production/", F.lower("id"))
    visual = plantation["map_links"].withColumn("item", _base("visual-item/", F.concat_ws("-", F.regexp_extract("map_uri", r"([^/]+)$", 1), F.regexp_extract("feature_uri", r"([^/]+)$", 1))))
    obs = first_wins(almanac["observations"], ["uri"], "pos")
    names = lambda t: t.select("pos", *entity("E41", F.col("uri"), content=F.col("text"), identifies=F.col("identifies"), carried_by=F.nullif("carried_by", F.lit("")), alternative_of=F.col("alt_form_of")))
    places = lambda t: t.select("pos", *entity("E53", F.col("uri"), fid=F.col("fid").try_cast("int"), label=F.col("observed_label"), geometry=F.col("wkt"), source=F.col("source_uri")))
    types = spark.createDataFrame(TYPES, "id string, label string")
    broader = F.when(F.col("id").startswith("plantation-status/"), F.lit(BASE + "type/plantation-status"))
    return union_all([
        src.select(*entity("E22", F.col("uri"), label=F.col("label"), type=_base("type/source-type/", F.col("kind")), carries=F.col("carries"), produced_by=production)),
        e25.select("pos", *entity("E25", F.col("uri"), label=F.col("label"), status=F.col("status"), owner=owner(F.col("qid")), former_owner=owner(F.col("qid_alt")), place=F.col("place_uri"), identified_by=F.col("names"), depicted_on=F.array_distinct("maps"))),
        river["e26"].join(r_names, F.col("uri") == F.col("identifies"), "left").select("pos", *entity("E26", F.col("uri"), label=F.col("label"), type=F.col("feature_type"), main_body_water=F.col("main_body_water"), place=F.col("place_uri"), identified_by=F.col("names"))),
        plantation["e74"].select("pos", *entity("E74", F.col("uri"), label=F.col("label"), psur=F.array_compact(F.array("psur_id", "psur_id2", "psur_id3")), absorbed_into=owner(F.col("absorbed_into")))),
        places(plantation["e53"]), places(river["e53"]),
        names(plantation["e41"]), names(river["e41"]), names(almanac["e41"]),
        visual.groupBy("item").agg(F.min("feature_uri").alias("f"), F.min("map_uri").alias("m")).select(*entity("E36", F.col("item"), represents=F.col("f"), carried_by=F.col("m"))),
        types.select(*entity("E55", _base("type/", F.col("id")), label=F.col("label"), broader=broader)),
        time_spans(almanac).select(*entity("E52", F.col("id"), label=F.col("year"), begin=F.concat("year", F.lit("-01-01")), end=F.concat("year", F.lit("-12-31")))),
        src.select(*entity("E12", production, label=F.concat(F.lit("Production of "), "label"), produced=F.col("uri"), time_span=_base("timespan/", F.col("year")))),
        obs.select("pos", *entity("E13", F.col("uri"), about=F.col("org_uri"), year=F.col("year"), name=F.col("observed_name"), product=F.col("product"), deserted=F.col("is_deserted"), source=F.col("source_uri"), size=F.nullif("size_akkers", F.lit("")).try_cast("int"))),
    ])


def features(plantation: dict[str, DataFrame], river: dict[str, DataFrame], path: str | None = None) -> DataFrame:
    """`pos, body` of the map's features: polygons with their plantation's name, status and Q-ID (status unknown without one), then rivers. With `path` they are made once and written there before they are numbered."""
    from lodspark.sources.sinks import feature

    from .graph import names_of

    p_names = collected(_names(plantation["e41"]), "identifies", "text", "place", "names")
    first = plantation["e25"].filter("place_uri is not null").groupBy("place_uri").agg(F.min_by(F.struct("label", "status", "qid", "uri"), "pos").alias("f"))
    p = plantation["e53"].join(first, F.col("uri") == F.col("place_uri"), "left").join(p_names, F.col("feature_uri") == F.col("identifies"), "left")
    ring = F.transform(geo.polygon_ring(F.col("wkt")), lambda q: F.array(q["x"], q["y"]))
    polygons = p.filter(ring.isNotNull()).select(F.col("pos"), feature(F.lit("Polygon"), F.array(ring), id=F.col("feature_uri"), fid=F.nullif(F.col("fid").try_cast("int"), F.lit(0)), name=F.coalesce("f.label", "observed_label"), names=names_of(F.col("f.label"), F.col("names")), status=F.coalesce("f.status", F.lit("unknown")), qid=F.col("f.qid")).alias("body"))
    r_names = collected(_names(river["e41"]), "identifies", "text", "place", "names")
    r = river["e53"].join(river["e26"].select(F.col("uri").alias("feature_uri"), "feature_type", "label"), "feature_uri", "left").join(r_names, F.col("feature_uri") == F.col("identifies"), "left")
    line = F.transform(geo.line_points(F.col("wkt")), lambda q: F.array(q["x"], q["y"]))
    rivers = r.filter(line.isNotNull()).select("pos", feature(F.lit("LineString"), line, id=F.col("feature_uri"), fid=F.nullif(F.col("fid").try_cast("int"), F.lit(0)), name=F.col("label"), names=names_of(F.col("label"), F.col("names")), type=F.col("feature_type")).alias("body"))
    # Numbered anew: positions of two files say nothing about each other.
    return in_sequence([polygons, rivers], path=path).select(F.col("seq").alias("pos"), "body")


def coverage(plantation: dict[str, DataFrame], river: dict[str, DataFrame], almanac: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, dict[str, Column]]]:
    """Tables and the links that the coverage check counts."""
    return {
        "E25": (plantation["e25"], {"owner": F.col("qid").isNotNull(), "former_owner": F.col("qid_alt").isNotNull(), "place": F.col("place_uri").isNotNull()}),
        "E26": (river["e26"], {"place": F.col("place_uri").isNotNull()}),
        "E41": (plantation["e41"], {"source": F.col("carried_by") != "", "alternative": F.col("alt_form_of").isNotNull()}),
        "E13": (almanac["observations"], {"organization": F.col("org_uri").isNotNull(), "source": F.col("source_uri").isNotNull(), "product": F.col("product").isNotNull()}),
    }

