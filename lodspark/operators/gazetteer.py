"""The gazetteer: one record for each place, seeded from districts, locations, rivers, polygons and the almanac."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodspark.functions import geo
from lodspark.functions.text import float_prefix, int_prefix, normalize_label, numbered

from .dedupe import in_sequence
from .entities import reprojected
from .matching import drop_if_known
from .scratch import shared_path, workspace, written

#: Order of types in lists; others come last.
SORT_ORDER = {"district": 1, "plantation": 2, "river": 3, "creek": 4, "road": 5, "military-post": 6, "railroad": 7}
_MODES = {"district": "district", "location": "loc_std", "location_original": "loc_org", "product": "product", "label": "standard_name"}


def organization_profile(obs: DataFrame) -> DataFrame:
    """Per Q-ID the most frequent district, location, product and name (ties: met first), and its PSUR ids."""
    o = obs.filter("qid is not null")
    # All fields as rows of one table: values are counted in one aggregation, and their modes taken in the next.
    said = F.array(*[F.struct(F.lit(name).alias("field"), F.col(column).cast("string").alias("value")) for name, column in {**_MODES, "psur": "psur_id"}.items()])
    counts = o.select("qid", "pos", F.explode(said).alias("s")).groupBy("qid", "s.field", "s.value").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("at"))
    rank = F.struct("n", (-F.col("at")).alias("late"))
    told = lambda name: (F.col("field") == name) & (F.coalesce("value", F.lit("")) != "")
    modes = [F.max_by("value", F.when(told(name), rank)).alias(name) for name in _MODES]
    psur = F.sort_array(F.collect_set(F.when(F.col("field") == "psur", F.col("value")))).alias("psur_ids")
    return counts.groupBy("qid").agg(psur, F.min("at").alias("first_pos"), *modes)


def location_note(name: Column) -> Column:
    """Waterways by their usual words, case as written; all else is a road."""
    return F.when(name.rlike("Kreek|rivier|Kanaal|kust"), "River, creek, or waterway from Surinaamse Almanakken").otherwise("Road or path from Surinaamse Almanakken")


#: Descriptions, labels and tags here are fixed values of the archive's records. Types of the codes on the 1930 layer; all other codes are settlements.
PLACE_CODES = {"Astronomisch station": "station", "Kabelstation": "station", "District Commissaris": "town", "B": "maroon-village", "I": "indigenous-village"}


def place_type(code: Column) -> Column:
    """Type of a place on the 1930 layer."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in PLACE_CODES.items() for x in pair])[code], F.lit("settlement"))


def crm_class(kind: Column) -> Column:
    """Class of a record's type: waters are natural features, districts places, all else made by people."""
    return F.when(kind.isin("river", "creek"), "E26_Physical_Feature").when(kind == "district", "E53_Place").otherwise("E25_Human-Made_Feature")


def place_description(remark: Column, old_type: Column, old_remark: Column) -> Column:
    """The remark, and what the 1882 map says; '' without either. Blank texts are null here."""
    old = F.concat_ws(" -- ", old_type, old_remark)
    return F.concat_ws("; ", remark, F.when(old != "", F.concat(F.lit("1882: "), old)))


def map_year(sources: Column) -> Column:
    """The map year of a record's sources: 1916 before 1882 before 1930."""
    return F.when(F.array_contains(sources, "map-1916"), 1916).when(F.array_contains(sources, "map-1882"), 1882).when(F.array_contains(sources, "map-1930"), 1930)


_COLUMNS = "type string, label string, alt_labels array<string>, broader_name string, description string, lat double, lng double, wkt string, sources array<string>, qid string, fid int, psur_ids array<string>, location string, product string, pos long"


def _stage(rows: DataFrame, **fields: Column) -> DataFrame:
    """Rows in the gazetteer's columns; what a stage does not give is null or empty."""
    out = []
    for name, kind in (c.strip().split(" ", 1) for c in _COLUMNS.split(", ")):
        value = fields.get(name)
        if value is None:
            value = F.array() if kind.startswith("array") else F.lit(None)
        out.append(value.cast(kind).alias(name))
    return rows.select(*out)


def layers(places: DataFrame, military: DataFrame, roads: DataFrame, railroads: DataFrame, plantation_labels: DataFrame) -> list[DataFrame]:
    """The stages of the point and line layers: places, military posts, roads, railways.

    A place that its remark calls a plantation is left out if a plantation record (`label`) has its
    name; places without a name get one from type and number; posts without a name, and lines without
    geometry, are left out.
    """
    at = geo.reproject(float_prefix("X_coord"), float_prefix("Y_coord"))
    kind = place_type(F.col("type1930"))
    made = F.when(kind == "indigenous-village", "Indigenous village (fid-").when(kind == "maroon-village", "Maroon village (fid-").otherwise("Place (fid-")
    number = int_prefix("fid").cast("int")
    p = places.withColumn("label", F.coalesce("label1930", "label1882", F.concat(made, number.cast("string"), F.lit(")")))).withColumn("at", at)
    p = drop_if_known(p, F.coalesce(F.col("remark1930") == "plantation", F.lit(False)), "label", plantation_labels)
    new, old = F.col("label1930").isNotNull() | F.col("type1930").isNotNull(), F.col("label1882").isNotNull() | F.col("type1882").isNotNull()
    tags = F.array_compact(F.array(F.when(new | ~old, F.lit("map-1930")), F.when(old, F.lit("map-1882"))))
    others = F.array_compact(F.array(F.when(F.col("label1882") != F.col("label"), F.col("label1882")), F.when(F.col("label1930") != F.col("label"), F.col("label1930"))))
    points = _stage(p, type=kind, label=F.col("label"), alt_labels=others, description=place_description(F.col("remark1930"), F.col("type1882"), F.col("remark1882")), lat=F.col("at.lat"), lng=F.col("at.lng"), sources=tags, fid=number, pos=F.col("pos"))
    m = military.filter("label1882 is not null").withColumn("at", at)
    posts = _stage(m, type=F.lit("military-post"), label=F.col("label1882"), description=F.lit("Military post from 1882 map"), lat=F.col("at.lat"), lng=F.col("at.lng"), sources=F.array(F.lit("map-1882")), fid=number, pos=F.col("pos"))

    def lines(rows: DataFrame, kind: str, label: Column, others: Column, note: str) -> DataFrame:
        rows = rows.filter("WKT_geometry is not null").withColumn("wkt", reprojected(F.col("WKT_geometry")))
        c = geo.mean_point(geo.line_points(F.col("wkt")))
        return _stage(rows, type=F.lit(kind), label=label, alt_labels=others, description=F.lit(note), lat=c["y"], lng=c["x"], wkt=F.col("wkt"), sources=F.array(F.lit("map-1930")), fid=number, pos=F.col("pos"))

    none = F.array().cast("array<string>")
    return [
        points, posts, lines(roads, "road", F.concat(F.lit("Road segment "), number.cast("string")), none, "Road segment from 1930 plantation map"),
        lines(railroads, "railroad", F.concat(F.lit("Lawa Railroad (segment "), number.cast("string"), F.lit(")")), F.array(F.lit("Lawaspoorweg")), "Railroad segment from 1930 plantation map (Lawa Railroad / Lawaspoorweg)"),
    ]


def seed(plantation: dict[str, DataFrame], river: dict[str, DataFrame], obs: DataFrame, polygons: DataFrame, more: dict[str, DataFrame] | None = None, folder: str | None = None) -> DataFrame:
    """All records in stage order - districts, locations, rivers, polygons, almanac only, and the layers of `more` - with ids stm-00001 on and `broader` as id.

    `more` has places, military, roads and railroads as the readers give them. What is used twice - the
    profile, the map's places, the rows before and after they are numbered - is written once: to `folder`,
    which the result then reads, or else to a folder that goes when the result is written.
    """
    if folder:
        return _seeded(plantation, river, obs, polygons, more, folder)
    with workspace(obs.sparkSession, "gazetteer") as folder:
        return written(_seeded(plantation, river, obs, polygons, more, folder), shared_path(obs.sparkSession, "gazetteer-table"))


def _seeded(plantation: dict[str, DataFrame], river: dict[str, DataFrame], obs: DataFrame, polygons: DataFrame, more: dict[str, DataFrame] | None, folder: str) -> DataFrame:
    profile = written(organization_profile(obs), f"{folder}/profile")
    ranked = lambda column: obs.filter(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
    from pyspark.sql import Window as W

    # Distinct names of districts and locations are few; their order gives their ids.
    in_order = lambda rows: rows.withColumn("pos", F.row_number().over(W.orderBy("label")))
    almanac = F.array(F.lit("almanakken"))
    districts = _stage(in_order(ranked("district")), type=F.lit("district"), label=F.col("label"), description=F.lit("Administrative district/division from Surinaamse Almanakken"), sources=almanac, pos=F.col("pos"))
    places = _stage(in_order(ranked("loc_std")), type=F.lit("river"), label=F.col("label"), description=location_note(F.col("label")), sources=almanac, pos=F.col("pos"))
    line = river["e26"].join(river["e53"].select(F.col("uri").alias("place_uri"), "wkt"), "place_uri", "left").withColumn("c", geo.mean_point(geo.line_points(F.col("wkt"))))
    kind = F.initcap("feature_type")
    note = F.when(F.col("main_body_water").isNotNull(), F.concat(kind, F.lit(" segment of "), "main_body_water", F.lit(" (QGIS 1930 map)"))).otherwise(F.concat(kind, F.lit(" feature from QGIS 1930 map")))
    waters = _stage(line, type=F.col("feature_type"), label=F.col("label"), description=note, lat=F.col("c.y"), lng=F.col("c.x"), wkt=F.col("wkt"), sources=F.array(F.lit("map-1930")), fid=F.col("fid").try_cast("int"), location=F.col("main_body_water"), product=F.col("feature_type"), pos=F.col("pos"))

    psur = F.array_compact(F.array("psur_id", "psur_id2", "psur_id3"))
    by_fid = polygons.filter("fid is not null").groupBy("fid").agg(F.max_by(psur, "pos").alias("psur"))
    owner = plantation["e25"].filter("place_uri is not null").groupBy("place_uri").agg(F.max_by(F.struct(F.col("qid").alias("qid"), F.col("label").alias("name")), "pos").alias("o"))
    e53 = plantation["e53"].join(owner.select(F.col("place_uri").alias("uri"), "o.*"), "uri", "left").join(by_fid, "fid", "left").join(profile.drop("psur_ids", "label", "first_pos").withColumn("known", F.lit(True)), "qid", "left")
    e53 = written(e53, f"{folder}/mapped")
    seen = F.coalesce("observed_label", F.concat(F.lit("Place "), "fid"))
    name = F.coalesce("name", seen)
    c = geo.mean_point(geo.polygon_ring(F.col("wkt")))
    tags = F.array_compact(F.array(F.lit("map-1930"), F.when(F.col("known"), F.lit("almanakken")), F.when(F.size(F.coalesce("psur", F.array())) > 0, F.lit("slave-registers"))))
    mapped = _stage(e53, type=F.lit("plantation"), label=name, alt_labels=F.when(name != seen, F.array(seen)).otherwise(F.array()), broader_name=F.col("district"), description=F.lit(""), lat=c["y"], lng=c["x"], wkt=F.col("wkt"), sources=tags, qid=F.col("qid"), fid=F.col("fid").try_cast("int"), psur_ids=F.coalesce("psur", F.array()), location=F.col("location"), product=F.col("product"), pos=F.col("pos"))

    on_map = e53.filter("qid is not null").select("qid").distinct()
    only = profile.join(on_map, "qid", "left_anti")
    own_tags = F.array_compact(F.array(F.lit("almanakken"), F.when(F.size("psur_ids") > 0, F.lit("slave-registers"))))
    rest = _stage(only, type=F.lit("plantation"), label=F.coalesce("label", "qid"), broader_name=F.col("district"), description=F.lit("Plantation from Surinaamse Almanakken (no QGIS geometry)"), sources=own_tags, qid=F.col("qid"), psur_ids=F.col("psur_ids"), location=F.col("location"), product=F.col("product"), pos=F.col("first_pos"))

    rest_of_map = layers(**more, plantation_labels=mapped.select("label").union(rest.select("label"))) if more else []
    staged = [districts, places, waters, mapped, rest, *rest_of_map]
    rows = written(in_sequence(staged, path=f"{folder}/staged").withColumn("id", numbered("stm-", F.col("seq"))), f"{folder}/rows")
    ids = rows.filter("stage = 0").select(F.col("label").alias("broader_name"), F.col("id").alias("broader"))
    return rows.join(ids, "broader_name", "left").drop("stage", "pos").withColumnRenamed("broader_name", "district")


def in_list_order(rows: DataFrame) -> DataFrame:
    """Retired records last, then by type and name as readers expect them."""
    rank = F.coalesce(F.create_map(*[x for k, v in SORT_ORDER.items() for x in (F.lit(k), F.lit(v))])[F.col("type")], F.lit(99))
    retired = F.col("merged_into").isNotNull() if "merged_into" in rows.columns else F.lit(False)
    return rows.orderBy(retired, rank, F.collate("label", "UNICODE_CI"))


def feature_ids(features: DataFrame, places: DataFrame, by_layer: bool = True) -> DataFrame:
    """`features` with the record id by (layer and) fid, else by place link; of several records the last wins."""
    keys = ["layer", "fid"] if by_layer else ["fid"]
    one = places.filter("fid is not null").groupBy(*keys).agg(F.max_by("id", "pos").alias("by_fid"))
    two = places.filter("place_uri is not null").groupBy("place_uri").agg(F.max_by("id", "pos").alias("by_uri"))
    return features.join(one, keys, "left").join(two, "place_uri", "left").withColumn("stm_id", F.coalesce("by_fid", "by_uri")).drop("by_fid", "by_uri")


def label_key(label: Column) -> Column:
    """The key by which records are matched to other lists; blank labels have none."""
    return F.nullif(normalize_label(label), F.lit(""))
