"""Importing a street layer into the gazetteer: features become streets, streets meet records or become new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodspark.functions import geo
from lodspark.functions.text import last_number, normalize_label, padded

from .dedupe import in_sequence, next_number


UNNAMED, UNNAMED_LABEL = "[naamloos]", "Unnamed street 1916"


def aggregate(features: DataFrame) -> DataFrame:
    """`key, pos, label, ids, segments` of each street: features of one normalised name together; features without a line are left out, each unnamed one is a street of its own."""
    lines = features.filter("segments is not null")
    nameless = (F.coalesce("name", F.lit("")) == "") | (F.col("name") == UNNAMED)
    number = F.coalesce("id", F.lit(-1)).cast("string")
    label = F.when(nameless, F.concat(F.lit(f"{UNNAMED_LABEL} #"), number)).otherwise(F.col("name"))
    key = F.when(nameless, F.concat(F.lit("unnamed:"), number)).otherwise(normalize_label("name"))
    rows = lines.withColumn("label", label).withColumn("key", key)
    listed = F.sort_array(F.collect_list(F.struct("pos", "id", "segments")))
    g = rows.groupBy("key").agg(F.min("pos").alias("pos"), F.min_by("label", "pos").alias("label"), listed.alias("parts"))
    ids = F.filter(F.transform("parts", lambda p: p["id"]), lambda i: i >= 0)
    return g.select("key", "pos", "label", ids.alias("ids"), F.flatten(F.transform("parts", lambda p: p["segments"])).alias("segments"))


def counters(features: DataFrame) -> DataFrame:
    """`skipped, unnamed`: features without a line, and lines without a name."""
    nameless = (F.coalesce("name", F.lit("")) == "") | (F.col("name") == UNNAMED)
    return features.agg(F.count_if(F.col("segments").isNull()).alias("skipped"), F.count_if(F.col("segments").isNotNull() & nameless).alias("unnamed"))


def without_repeats(places: DataFrame, tag: str) -> DataFrame:
    """Records of a source that share a fid: the one of the lowest number stays; all others are untouched."""
    own = F.array_contains("sources", tag) & F.col("fid").isNotNull()
    lowest = places.filter(own).groupBy("fid").agg(F.min(F.struct(last_number("id").alias("n"), "id")).alias("best"))
    marked = places.join(lowest.select("fid", F.col("best.id").alias("keep_id")), "fid", "left")
    return marked.filter(~F.coalesce(own, F.lit(False)) | (F.col("id") == F.col("keep_id"))).select(places.columns)


def plan(streets: DataFrame, places: DataFrame, tag: str) -> DataFrame:
    """Streets with `outcome` (update, insert, conflict or no geometry), the record they update, text and centre.

    One record of the normalised name is a match; else one record of this source with the street's
    first id. Several of a name without such a record are a conflict. Two streets of one key cannot
    occur but for unnamed labels, of which the later updates what the earlier made.
    """
    known = places.select(F.nullif(normalize_label("label"), F.lit("")).alias("name_key"), F.when(F.array_contains("sources", tag), F.col("fid")).cast("long").alias("first_id"), F.col("id").alias("target"))
    wkt = geo.write_multiline(F.col("segments"))
    kept = F.filter("segments", lambda s: F.size(s) >= 2)
    made = streets.withColumn("wkt", wkt).withColumn("centre", geo.mean_point(F.flatten(kept))).withColumn("name_key", normalize_label("label")).withColumn("first_id", F.get("ids", F.lit(0)).cast("long"))
    names = known.filter("name_key is not null").groupBy("name_key").agg(F.count("target").alias("n_name"), F.min("target").alias("by_name"))
    fids = known.filter("first_id is not null").groupBy("first_id").agg(F.count("target").alias("n_fid"), F.min("target").alias("by_fid"))
    met = made.join(names, "name_key", "left").join(fids, "first_id", "left")
    match = F.when(F.col("n_name") == 1, F.col("by_name")).when(F.col("n_fid") == 1, F.col("by_fid"))
    outcome = F.when(F.col("wkt").isNull(), "no geometry").when(match.isNotNull(), "update").when(F.col("n_name") > 1, "conflict").otherwise("insert")
    return met.withColumn("outcome", outcome).withColumn("target", F.when(F.col("outcome") == "update", match)).drop("n_name", "by_name", "n_fid", "by_fid", "name_key")


def apply(planned: DataFrame, places: DataFrame, tag: str) -> DataFrame:
    """`places` (id, label, type, lat, lng, wkt, fid, sources) with the plan's updates in place and its inserts under new numbers."""
    updates = planned.filter("outcome = 'update'").groupBy("target").agg(F.max_by(F.struct("label", "wkt", "centre", "first_id"), "pos").alias("u"))
    new = places.join(updates, places["id"] == F.col("target"), "left")
    hit = F.col("u").isNotNull()
    pick = lambda column, value: F.when(hit, value).otherwise(F.col(column)).alias(column)
    new = new.select("id", pick("label", F.col("u.label")), pick("type", F.lit("road")), pick("lat", F.col("u.centre.y")), pick("lng", F.col("u.centre.x")), pick("wkt", F.col("u.wkt")), pick("fid", F.col("u.first_id").cast("int")), pick("sources", F.array_union("sources", F.array(F.lit(tag)))))
    last = next_number(places, "id").first().next_id - 1
    added = in_sequence([planned.filter("outcome = 'insert'")]).withColumnRenamed("seq", "n")
    added = added.select(F.concat(F.lit("stm-"), padded(F.col("n") + last)).alias("id"), "label", F.lit("road").alias("type"), F.col("centre.y").alias("lat"), F.col("centre.x").alias("lng"), "wkt", F.col("first_id").cast("int").alias("fid"), F.array(F.lit(tag)).alias("sources"))
    return new.unionByName(added)
