"""From raw tables to entities: plantations, rivers and almanac rows with their places, owners, names and depictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodspark.functions import geo
from lodspark.functions.text import int_prefix, safe_int, slugify
from lodspark.functions.uri import ONTOLOGY

WIKIDATA = "http://www.wikidata.org/entity/"
MAP_1930, MAP_1860 = ONTOLOGY + "source/map-1930", ONTOLOGY + "source/map-1860-79"


def _uri(path: str, *parts: Column) -> Column:
    return F.concat(F.lit(ONTOLOGY + path), *parts)


def _name(text: Column, suffix: str, keep: Column, source: str, year: str, alternative: Column | None = None) -> Column:
    """One candidate name of a row, null where it is not to be kept."""
    uri = _uri("appellation/", slugify(text), F.lit(f"-{suffix}"))
    return F.when(keep, F.struct(uri.alias("uri"), text.alias("text"), F.lit(source).alias("carried_by"), F.lit(year).alias("source_year"), (alternative if alternative is not None else F.lit(None).cast("string")).alias("alt_form_of")))


def with_slugs(rows: DataFrame, slug: Column) -> DataFrame:
    """`slug`, unique: the first row of a slug keeps it, later ones add their fid."""
    rows = rows.withColumn("slug", slug)
    again = F.row_number().over(W.partitionBy("slug").orderBy("pos")) > 1
    return rows.withColumn("slug", F.when(again, F.concat_ws("-fid-", "slug", "fid")).otherwise(F.col("slug")))


def reprojected(wkt: Column, digits: int = 8) -> Column:
    """A polygon's or line's text on the national grid as WGS 84."""
    points = geo.pairs(F.regexp_extract(wkt, r"\(+([^()]+)\)", 1))
    body = F.array_join(F.transform(geo.reproject_all(points), lambda p: F.concat_ws(" ", F.format_string(f"%.{digits}f", p["lng"]), F.format_string(f"%.{digits}f", p["lat"]))), ", ")
    return F.when(F.lower(wkt).startswith("polygon"), F.concat(F.lit("POLYGON(("), body, F.lit("))"))).otherwise(F.concat(F.lit("LINESTRING("), body, F.lit(")")))


def plantations(polygons: DataFrame) -> dict[str, DataFrame]:
    """Features (E25), organizations (E74), places (E53), names (E41) and map depictions of the polygon layer.

    A feature's status is unknown only if it has neither Q-ID, PSUR id nor label. Organizations are
    unique by Q-ID, the first mention wins; a row's own Q-ID comes before its alternative, which it
    names as what it was absorbed into. Names come from both maps and, if different, the standard label.
    """
    label, old = F.col("plantation_label"), F.col("`label_1860-79`")
    p = with_slugs(polygons, F.coalesce(slugify(label), F.concat(F.lit("fid-"), "fid")))
    p = p.withColumn("uri", _uri("plantation/", F.col("slug")))
    bare = F.col("qid").isNull() & F.col("psur_id").isNull() & label.isNull()
    place = F.when(F.col("coords").isNotNull(), _uri("place/1930/fid-", F.col("fid")))
    e25 = p.select("pos", "uri", "slug", "fid", label.alias("label"), F.when(bare, "unknown").otherwise("built").alias("status"), "qid", "qid_alt", place.alias("place_uri"))
    none = F.lit(None).cast("string")
    both = F.array_compact(F.array(
        F.when(F.col("qid").isNotNull(), F.struct(F.lit(0).alias("nth"), F.col("qid").alias("qid"), label.alias("label"), "psur_id", "psur_id2", "psur_id3", F.col("qid_alt").alias("absorbed_into"))),
        F.when(F.col("qid_alt").isNotNull(), F.struct(F.lit(1).alias("nth"), F.col("qid_alt").alias("qid"), none.alias("label"), none.alias("psur_id"), none.alias("psur_id2"), none.alias("psur_id3"), none.alias("absorbed_into"))),
    ))
    orgs = p.select("pos", F.explode(both).alias("o")).select("pos", "o.*")
    first = orgs.groupBy("qid").agg(F.min_by(F.struct("pos", "label", "psur_id", "psur_id2", "psur_id3", "absorbed_into"), F.struct("pos", "nth")).alias("o"))
    e74 = first.select("qid", F.concat(F.lit(WIKIDATA), "qid").alias("uri"), "o.*")
    e53 = p.filter("coords is not null").select("pos", place.alias("uri"), "fid", F.coalesce("label_1930", label).alias("observed_label"), reprojected(F.col("coords")).alias("wkt"), F.col("coords").alias("wkt_grid"), F.lit(MAP_1930).alias("source_uri"), F.col("uri").alias("feature_uri"))
    new = F.col("label_1930")
    map_name = F.when(new.isNotNull(), _uri("appellation/", slugify(new), F.lit("-map1930")))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    names = F.array_compact(F.array(
        _name(new, "map1930", new.isNotNull(), MAP_1930, "1930"),
        _name(old, "map1860", old.isNotNull(), MAP_1860, "1870", map_name),
        _name(label, "canonical", label.isNotNull() & ~same(label, new) & ~same(label, old), "", "", map_name),
    ))
    e41 = p.select("pos", F.col("uri").alias("identifies"), F.posexplode(names).alias("nth", "n")).select("pos", "nth", "identifies", F.lit("E25").alias("identifies_type"), "n.*")
    shown = F.array_compact(F.array(
        F.when(new.isNotNull(), F.struct(F.lit(MAP_1930).alias("map_uri"), new.alias("label_on_map"), F.lit(True).alias("has_polygon"))),
        F.when(old.isNotNull(), F.struct(F.lit(MAP_1860).alias("map_uri"), old.alias("label_on_map"), F.lit(False).alias("has_polygon"))),
    ))
    links = p.select("pos", F.col("uri").alias("feature_uri"), "qid", F.explode(shown).alias("m")).select("pos", "feature_uri", "qid", "m.*")
    return {"e25": e25, "e74": e74, "e53": e53, "e41": e41, "map_links": links}


def rivers(raw: DataFrame) -> dict[str, DataFrame]:
    """Features (E26), places and names of the river layer. `kreek` in any label makes a creek."""
    a, b, c, water = F.col("label1930"), F.col("label1882"), F.col("alt_label"), F.col("main_body_water")
    label = F.coalesce(a, b, c, F.when(water.isNotNull(), F.concat(water, F.lit(" (segment "), "fid", F.lit(")"))), F.concat(F.lit("River segment "), "fid"))
    kind = F.when(F.lower(F.concat_ws(" ", a, b, c)).contains("kreek"), "creek").otherwise("river")
    r = with_slugs(raw, F.coalesce(slugify(a), slugify(b), F.concat(F.lit("fid-"), "fid"))).withColumn("uri", _uri("feature/river/", F.col("slug")))
    place = F.when(F.col("wkt_geometry").isNotNull(), _uri("place/1930/river-fid-", F.col("fid")))
    e26 = r.select("pos", "uri", "slug", "fid", label.alias("label"), kind.alias("feature_type"), water.alias("main_body_water"), place.alias("place_uri"))
    e53 = r.filter("wkt_geometry is not null").select("pos", place.alias("uri"), "fid", label.alias("observed_label"), reprojected(F.col("wkt_geometry")).alias("wkt"), F.col("wkt_geometry").alias("wkt_grid"), F.lit(MAP_1930).alias("source_uri"), F.col("uri").alias("feature_uri"))
    map_name = F.when(a.isNotNull(), _uri("appellation/", slugify(a), F.lit("-river-map1930")))
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    names = F.array_compact(F.array(_name(a, "river-map1930", a.isNotNull(), MAP_1930, "1930"), _name(b, "river-map1882", b.isNotNull(), MAP_1860, "1882", map_name), _name(c, "river-alt", c.isNotNull() & ~same(c, a) & ~same(c, b), "", "", map_name)))
    e41 = r.select("pos", F.col("uri").alias("identifies"), F.posexplode(names).alias("nth", "n")).select("pos", "nth", "identifies", F.lit("E26").alias("identifies_type"), "n.*")
    return {"e26": e26, "e53": e53, "e41": e41}


def almanac(raw: DataFrame) -> dict[str, DataFrame]:
    """Observations (E13), names (E41) and yearly sources (E22) of the almanac; rows without record id are left out.

    Names need an organization; the name as printed is unique by (text, organization), and so is the
    standard one, which is only met beside a new printed name that differs from it.
    """
    rows = raw.filter("recordid is not null")
    org = F.when(F.col("plantation_id").isNotNull(), F.concat(F.lit(WIKIDATA), "plantation_id"))
    source = F.when(F.col("year").isNotNull(), _uri("source/almanac-", F.col("year")))
    obs = rows.select(
        "pos", _uri("obs/", F.col("recordid")).alias("uri"), F.col("recordid").alias("record_id"), F.col("plantation_id").alias("qid"), org.alias("org_uri"), "year", int_prefix("year").cast("int").alias("year_number"),
        F.col("plantation_org").alias("observed_name"), F.col("plantation_std").alias("standard_name"), F.col("eigenaren").alias("owner"), F.col("administrateurs").alias("administrator"), F.col("directeuren").alias("director"),
        F.col("product_std").alias("product"), safe_int("slaven").alias("enslaved"), F.col("deserted").isNotNull().alias("is_deserted"), F.coalesce(F.lower("deserted") == "verlaten", F.lit(False)).alias("is_abandoned"),
        "loc_std", "loc_org", safe_int("size_std").alias("size_akkers"), F.col("page").alias("page"), "psur_id", source.alias("source_uri"),
        F.array_compact(F.array("split1_id", "split2_id", "split3_id", "split4_id", "split5_id")).alias("split_ids"), F.col("`part of_id`").alias("part_of_id"), F.col("reference_std_id").alias("reference_id"), safe_int("vrije_bewoners").alias("free_residents"),
        F.col("district_of_divisie").alias("district"),
    )
    named = rows.filter("plantation_org is not null and plantation_id is not null")
    printed = named.groupBy("plantation_org", "plantation_id").agg(F.min_by(F.struct("pos", "year", F.col("plantation_std").alias("std")), "pos").alias("r")).select("plantation_org", "plantation_id", "r.*")
    differs = printed.filter("std is not null and std <> plantation_org")
    standard = differs.groupBy("std", "plantation_id").agg(F.min_by(F.struct("pos", "year", "plantation_org"), "pos").alias("r")).select("std", "plantation_id", "r.*")
    own = lambda year: F.when(year.isNotNull(), _uri("source/almanac-", year))
    new_std = standard.select(F.col("pos").alias("s_pos"), F.col("std").alias("s_std"))
    printed = printed.join(new_std, F.col("pos") == F.col("s_pos"), "left")
    org_uri, std_uri = (lambda c: _uri("appellation/", slugify(c), F.lit("-almanac-org"))), (lambda c: _uri("appellation/", slugify(c), F.lit("-almanac-std")))
    one = printed.select("pos", org_uri(F.col("plantation_org")).alias("uri"), F.col("plantation_org").alias("text"), own(F.col("year")).alias("carried_by"), F.concat(F.lit(WIKIDATA), "plantation_id").alias("identifies"), F.col("year").alias("source_year"), F.when(F.col("s_std").isNotNull(), std_uri(F.col("s_std"))).alias("alt_form_of"))
    two = standard.select("pos", std_uri(F.col("std")).alias("uri"), F.col("std").alias("text"), own(F.col("year")).alias("carried_by"), F.concat(F.lit(WIKIDATA), "plantation_id").alias("identifies"), F.col("year").alias("source_year"), org_uri(F.col("plantation_org")).alias("alt_form_of"))
    years = rows.filter("year is not null").select("year").distinct()
    e22 = years.select(_uri("source/almanac-", F.col("year")).alias("uri"), F.concat(F.lit("ALMANAC_"), "year").alias("id"), F.format_string("Surinaamsche Almanak (%s)", F.col("year")).alias("label"), "year").orderBy("year")
    return {"observations": obs, "e41": one.unionByName(two).withColumn("identifies_type", F.lit("E74")), "e22": e22}


def observation_provenance(observations: DataFrame) -> DataFrame:
    """One provenance row a year: which file and rows the year's observations come from."""
    first = observations.filter("year is not null").groupBy("year").agg(F.min("pos").alias("first_row"), F.max("pos").alias("last_row"), F.count("pos").alias("rows"))
    return first.select(F.concat(F.lit("provenance/obs-"), "year").alias("id"), "year", "first_row", "last_row", "rows")


def merger_edges(observations: DataFrame) -> DataFrame:
    """`src, dst, kind` between organizations: splits (all five columns), parts and references."""
    kinds = [observations.select(F.col("qid").alias("src"), F.explode("split_ids").alias("dst"), F.lit("split").alias("kind"))]
    kinds += [observations.select(F.col("qid").alias("src"), F.col(c).alias("dst"), F.lit(k).alias("kind")) for c, k in (("part_of_id", "part_of"), ("reference_id", "reference"))]
    return reduce(DataFrame.unionByName, kinds).filter("src is not null and dst is not null and src <> dst").distinct()
