"""Readers: delimited files, JSON-LD graphs, GeoJSON, thesaurus and source registry.

Every raw table is all text, in typed columns only after `functions.text` has read them, and carries
`pos`, the row's place in its file.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodspark.functions import lang
from lodspark.functions.text import blank_to_null, int_prefix

# Columns of the archive's files: fixed values.
POLYGON_COLUMNS = ["fid", "psur_id", "psur_id2", "psur_id3", "label_1930", "label_1860-79", "qid", "qid_alt", "plantation_label", "coords"]
RIVER_COLUMNS = ["fid", "label1930", "main_body_water", "label1882", "alt_label", "wkt_geometry"]
ALMANAC_COLUMNS = [
    "recordid", "year", "page", "plantation_id", "plantation_org", "plantation_std", "psur_id", "eigenaren", "administrateurs", "directeuren", "product_std", "slaven", "deserted", "loc_std", "loc_org",
    "size_std", "split1_id", "split1_lab", "split2_id", "split3_id", "split4_id", "split5_id", "part of_id", "partof_lab", "reference_std_id", "vrije_bewoners", "administrateurs_in_Europa", "administrateurs_in_suriname", "district_of_divisie",
]
PLACE_COLUMNS = ["fid", "id", "label1930", "type1930", "remark1930", "label1882", "type1882", "remark1882", "X_coord", "Y_coord"]
MILITARY_COLUMNS = ["fid", "label1882", "X_coord", "Y_coord"]
ROAD_COLUMNS = ["fid", "1930", "WKT_geometry"]


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",", encoding: str = "UTF-8", trim: bool = False, position: str | None = None) -> DataFrame:
    """The named columns of a file with a header, as text (blank is null), and `pos`.

    `position` names a column that numbers the rows: for a register in several files, which are read by
    several tasks, as places in files say nothing of the order between them.

    Rows may be short (the rest is null) or long (the rest is dropped); columns that the file lacks are
    null. Quoted values may span lines, so one file is one task and keeps its order.
    """
    raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, mode="PERMISSIVE", quote='"', escape='"', ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim)
    raw = raw.withColumn("pos", F.monotonically_increasing_id())
    names = {c.strip(): c for c in raw.columns}
    found = [(blank_to_null(F.col(f"`{names[c]}`")) if c in names else F.lit(None).cast("string")).alias(c) for c in columns]
    rows = raw.select("pos", *found)
    return rows if position is None else rows.withColumn("pos", int_prefix(position).cast("long"))


def read_polygons(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    return read_delimited(spark, path, POLYGON_COLUMNS, sep=";", position=position)


def read_rivers(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    return read_delimited(spark, path, RIVER_COLUMNS, position=position)


def read_almanac(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    """The almanac, Latin-1 and ragged. `part of_id` is also accepted as `part_of_id`."""
    rows = read_delimited(spark, path, [*ALMANAC_COLUMNS, "part_of_id"], encoding="ISO-8859-1", position=position)
    return rows.withColumn("part of_id", F.coalesce("`part of_id`", "part_of_id")).drop("part_of_id")


def read_layer(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A map layer: places, military posts, roads or railways; values are trimmed."""
    return read_delimited(spark, path, columns, trim=True)


def almanac_observations(almanac: DataFrame) -> DataFrame:
    """`org, year, product, abandoned, pos` of the rows that name a plantation and a year: what spans are derived from."""
    return almanac.select(
        F.col("plantation_id").alias("org"), int_prefix("year").cast("int").alias("year"), F.col("product_std").alias("product"),
        F.coalesce(F.lower("deserted") == "verlaten", F.lit(False)).alias("abandoned"), "pos",
    ).filter("org is not null and year is not null")


@dataclass(frozen=True)
class PresenceSource:
    """A dated file whose rows name places by Q-ID."""

    source_id: str
    year: int
    path: str
    qid_column: str = "qid"
    sep: str = ","
    encoding: str = "UTF-8"


def read_presence(spark: SparkSession, sources: list[PresenceSource]) -> DataFrame:
    """`qid, source_id, year` of all sources; values that do not begin with Q are dropped."""
    parts = [read_delimited(spark, s.path, [s.qid_column], s.sep, s.encoding).select(F.col(s.qid_column).alias("qid"), F.lit(s.source_id).alias("source_id"), F.lit(s.year).alias("year")) for s in sources]
    return reduce(DataFrame.unionByName, parts).filter(F.col("qid").startswith("Q")).distinct()


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """`pos, id, types, body` of the entities of a JSON-LD document; `body` is a VARIANT, types always a list."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = doc.select(F.posexplode(F.try_variant_get("v", "$['@graph']", "array<variant>")).alias("pos", "body"))
    return rows.select("pos", F.try_variant_get("body", "$['@id']", "string").alias("id"), lang.as_array(F.try_variant_get("body", "$['@type']", "variant")).alias("types"), "body")


def read_graph_lines(spark: SparkSession, path: str) -> DataFrame:
    """As `read_graph`, from files of one entity a line (`sinks.lines`): any number of tasks, no document in one row."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.parse_json("value").alias("body"))
    return rows.select("pos", F.try_variant_get("body", "$['@id']", "string").alias("id"), lang.as_array(F.try_variant_get("body", "$['@type']", "variant")).alias("types"), "body")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """`pos, name, id, kind, segments` of a feature collection's lines; anything else than a collection fails. Other geometries have null segments."""
    schema = "type string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:variant>>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    doc = doc.filter(F.when(F.col("type") == "FeatureCollection", F.lit(True)).otherwise(F.raise_error(F.lit("not a FeatureCollection"))))
    rows = doc.select(F.posexplode("features").alias("pos", "f"))
    kind, at = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    line = F.try_variant_get(at, "$", "array<array<double>>")
    many = F.try_variant_get(at, "$", "array<array<array<double>>>")
    parts = F.when(kind == "LineString", F.array(line)).when(kind == "MultiLineString", many)
    points = F.transform(parts, lambda s: F.transform(s, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.select("pos", F.trim(F.col("f.properties")["Name"]).alias("name"), F.col("f.properties")["ID"].try_cast("double").try_cast("long").alias("id"), kind.alias("kind"), points.alias("segments"))


def concepts(graph: DataFrame) -> DataFrame:
    """Thesaurus entries with a `typeId`, in sort order (99 without): labels, parents and display settings."""
    get = lambda path, kind="string": F.try_variant_get("body", f"$['{path}']", kind)
    rows = graph.select(
        "id", get("typeId").alias("type_id"), lang.as_lang_map(get("prefLabel", "variant")).alias("label"), get("broader").alias("broader"), get("color").alias("color"),
        get("crmClass").alias("crm_class"), lang.crm_badge(F.coalesce(get("crmClass"), F.lit(""))).alias("crm_badge"), F.coalesce(get("sortOrder", "int"), F.lit(99)).alias("sort_order"),
        F.coalesce(get("deprecated", "boolean"), F.lit(False)).alias("deprecated"),
    )
    return rows.filter("type_id is not null").withColumn("label_en", lang.lang_en(F.col("label"))).orderBy("sort_order", "type_id")


def registry(graph: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Categories and sources of a registry: entries of class E55, and of class E22. A source's category is its type without the namespace."""
    get = lambda path, kind="string": F.try_variant_get("body", f"$['{path}']", kind)
    is_a = lambda code: F.exists("types", lambda t: t.contains(code))
    cats = graph.filter(is_a("E55")).select("pos", F.replace("id", F.lit(base), F.lit("")).alias("category"), lang.lang_en(lang.as_lang_map(get("prefLabel", "variant"))).alias("label"))
    year = lang.source_year(get("mapYear", "int"), F.coalesce(get("timeSpan"), F.lit("")))
    sources = graph.filter(is_a("E22")).select(
        "pos", get("sourceId").alias("source_id"), F.replace(F.coalesce(get("P2_has_type"), F.lit("")), F.lit(base), F.lit("")).alias("category"), lang.lang_en(lang.as_lang_map(get("prefLabel", "variant"))).alias("label"),
        year.alias("year"), F.coalesce(get("linkedToGazetteer", "boolean"), F.lit(False)).alias("active"), F.coalesce(get("deprecated", "boolean"), F.lit(False)).alias("deprecated"),
    )
    return cats, sources


def by_category(categories: DataFrame, sources: DataFrame, fixed_order: list[str], with_deprecated: bool = True) -> DataFrame:
    """Categories in a fixed order (unknown ones last) with their sources by year (missing and 0 last) and label; empty categories stay, sources of unknown categories go."""
    if not with_deprecated:
        sources = sources.filter(~F.col("deprecated"))
    rank = F.nullif(F.array_position(F.array(*[F.lit(c) for c in fixed_order]), F.col("category")), F.lit(0))
    joined = categories.select("category", F.col("label").alias("category_label")).join(sources.drop("pos"), "category", "left")
    return joined.withColumn("place", F.coalesce(rank, F.lit(99))).orderBy("place", "category", F.asc_nulls_last(F.nullif("year", F.lit(0))), "label")


def category_stats(categories: DataFrame, sources: DataFrame) -> DataFrame:
    """`category, total, active, future` for every category."""
    counts = sources.groupBy("category").agg(F.count("source_id").alias("total"), F.count_if("active").alias("active"))
    zero: Column = F.lit(0)
    out = categories.select("category").join(counts, "category", "left")
    return out.select("category", F.coalesce("total", zero).alias("total"), F.coalesce("active", zero).alias("active"), (F.coalesce("total", zero) - F.coalesce("active", zero)).alias("future"))
