"""The archive's path on the driver's tables: written as the archive's files, read back, and turned into entities, gazetteer and graph.

Parts are the polygon layer, suppliers the river layer, and orders the almanac. Files come in as many
parts as Spark writes; a column of each numbers its rows. Each file is parsed once: the entities that a
query needs are written as tables, and all these go again when its result is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodspark.operators import assemble, checks, entities, gazetteer, graph, jsonld, streets
from lodspark.operators.scratch import shared_path, workspace, written
from lodspark.sources import readers, sinks

from .tables import table

_POLYGON = "Polygon((558964 644095, 558999 644095, 558999 644195, 558964 644095))"
_LINE = "LineString(558964 644095, 559964 645095)"


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _csv(rows: DataFrame, path: str, **options: str) -> str:
    """Rows as files for all cores: a file is read by one task, and a table of one small file would be one task up to its end."""
    rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism).write.csv(path, header=True, quote='"', escape='"', **options)
    return path


def _kept(make: Callable[[SparkSession, str, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose files and tables lie in one folder (its last argument) that goes when the result is written."""

    def run(s: SparkSession, d: str) -> DataFrame:
        with workspace(s, "archive") as folder:
            return written(make(s, d, folder), shared_path(s, "archive-result"))

    return run


def _tables(of: dict[str, DataFrame], folder: str, name: str) -> dict[str, DataFrame]:
    """The entities of one source, each written once."""
    return {k: written(t, f"{folder}/{name}-{k}") for k, t in of.items()}


def polygons(s: SparkSession, d: str, folder: str) -> DataFrame:
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    rows = table(s, d, "part").select(
        k.alias("fid"), F.when(k % 3 == 0, _text("P", F.col("p_size"))).alias("psur_id"), F.when(k % 9 == 0, _text("X", k)).alias("psur_id3"), F.when(k % 4 != 0, name).alias("label_1930"),
        F.when(k % 5 == 0, F.upper(name)).alias("label_1860-79"), F.when(k % 3 != 1, _text("Q", k % 300)).alias("qid"), F.when(k % 7 == 0, _text("Q", k % 300 + 1000)).alias("qid_alt"),
        F.when(k % 2 == 0, _text(name, "; ", brand)).alias("plantation_label"), F.when(k % 6 != 0, F.lit(_POLYGON)).alias("coords"),
    )
    return written(readers.read_polygons(s, _csv(rows, f"{folder}/polygons.csv", sep=";"), position="fid"), f"{folder}/polygons")


def rivers(s: SparkSession, d: str, folder: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.col("s_name")
    rows = table(s, d, "supplier").select(
        k.alias("fid"), F.when(k % 3 == 0, _text(name, " Kreek")).when(k % 3 == 2, name).alias("label1930"), F.when(k % 2 == 0, F.lit("Cottica")).alias("main_body_water"),
        F.when(k % 6 == 1, _text("Oud ", name)).alias("label1882"), F.when(k % 10 == 0, _text("Alt ", name)).alias("alt_label"), F.when(k % 4 != 0, F.lit(_LINE)).alias("wkt_geometry"),
    )
    return written(readers.read_rivers(s, _csv(rows, f"{folder}/rivers.csv"), position="fid"), f"{folder}/rivers")


def almanac(s: SparkSession, d: str, folder: str) -> DataFrame:
    k, org = F.col("o_orderkey"), F.col("o_custkey") % 300
    rows = table(s, d, "orders").select(
        k.alias("recordid"), _text(F.year("o_orderdate"), F.when(k % 50 == 0, "a").otherwise("")).alias("year"), F.when(k % 11 != 0, _text("Q", org)).alias("plantation_id"),
        F.when(k % 13 != 0, _text("Org \u00e9 ", org, "-", k % 3)).alias("plantation_org"), F.when(k % 2 == 0, _text("Std ", org)).alias("plantation_std"), F.col("o_orderpriority").alias("product_std"),
        _text(k % 97, ".7").alias("slaven"), F.when(F.col("o_orderstatus") == "P", "Verlaten").when(k % 5 == 0, "ja").alias("deserted"), F.when(k % 4 == 0, "Para Kreek").when(k % 4 == 1, _text("Weg ", k % 8)).alias("loc_std"),
        F.when(k % 3 != 0, _text("D", F.col("o_custkey") % 9)).alias("district_of_divisie"), F.when(k % 17 == 0, _text("P", k % 40)).alias("psur_id"), F.when(k % 101 == 0, _text("Q", k % 300)).alias("split1_id"), F.when(k % 103 == 0, _text("Q", k % 299)).alias("part of_id"),
    )
    return written(readers.read_almanac(s, _csv(rows, f"{folder}/almanac.csv", encoding="ISO-8859-1"), position="recordid"), f"{folder}/almanac")


def _all(s, d, folder):
    return (
        _tables(entities.plantations(polygons(s, d, folder)), folder, "plantation"),
        _tables(entities.rivers(rivers(s, d, folder)), folder, "river"),
        _tables(entities.almanac(almanac(s, d, folder)), folder, "almanac"),
    )


def _features(s, d, folder):
    return entities.plantations(polygons(s, d, folder))["e25"].select(F.col("fid").cast("long").alias("fid"), "slug", "label", "status", "qid", "qid_alt", F.col("place_uri").isNotNull().alias("placed"))


def _organizations(s, d, folder):
    return entities.plantations(polygons(s, d, folder))["e74"].select("qid", "label", "psur_id", "psur_id3", "absorbed_into")


def _names(s, d, folder):
    return entities.plantations(polygons(s, d, folder))["e41"].select("pos", "nth", "text", "source_year", F.col("alt_form_of").isNotNull().alias("alternative"))


def _rivers(s, d, folder):
    return entities.rivers(rivers(s, d, folder))["e26"].select("pos", "slug", "label", "feature_type", "main_body_water", F.col("place_uri").isNotNull().alias("placed"))


def _observations(s, d, folder):
    o = entities.almanac(almanac(s, d, folder))["observations"]
    return o.select(F.col("record_id").cast("long").alias("record_id"), "qid", "year_number", "observed_name", "standard_name", "product", "enslaved", "is_deserted", "is_abandoned", "loc_std", "district", "psur_id")


def _printed(s, d, folder):
    t = entities.almanac(almanac(s, d, folder))["e41"]
    return t.select("text", F.regexp_extract("identifies", r"([^/]+)$", 1).alias("qid"), "source_year", F.regexp_extract("uri", "-(org|std)$", 1).alias("kind"), F.col("alt_form_of").isNotNull().alias("alternative"))


def _profile(s, d, folder):
    t = gazetteer.organization_profile(entities.almanac(almanac(s, d, folder))["observations"])
    return t.select("qid", "district", "location", "product", "label", F.array_join("psur_ids", ",").alias("psur_ids"), "first_pos")


def _gazetteer(s, d, folder):
    raw = polygons(s, d, folder)
    rows = gazetteer.seed(entities.plantations(raw), entities.rivers(rivers(s, d, folder)), entities.almanac(almanac(s, d, folder))["observations"], raw, folder=f"{folder}/seed")
    return rows.select("id", "type", "label", "district", "broader", "qid", "fid", "product", F.array_join("psur_ids", ",").alias("psur_ids"), F.array_join("sources", ",").alias("sources"), F.col("lat").isNotNull().alias("placed"))


def _graph(s, d, folder):
    return graph.class_counts(assemble.graph(s, *_all(s, d, folder)))


def _index(s, d, folder):
    p, r, a = _all(s, d, folder)
    traces = entities.observation_provenance(a["observations"]).select("id", F.to_json(F.struct("year", "rows")).alias("body"))
    index = sinks.index_set(assemble.graph(s, p, r, a), traces)
    path = f"{folder}/index"
    sinks.indexes(index, path)
    parts = [s.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_keys")) for name in index]
    return graph.union_all(parts)


def _report(s, d, folder):
    return checks.report(assemble.graph(s, *_all(s, d, folder)))


def _unmet(s, d, folder):
    """Links of the graph that end at no entity, by key."""
    g = written(assemble.graph(s, *_all(s, d, folder)), f"{folder}/graph")
    links = checks.ends(g, ["place", "identifies", "owner", "former_owner", "carried_by", "source", "about", "represents", "produced_by"])
    return links.join(g.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("n_ends"))


def _triples(s, d, folder):
    """What the graph's documents say, by property and kind of value."""
    docs = written(jsonld.documents(assemble.graph(s, *_all(s, d, folder)), f"{folder}/graph"), f"{folder}/documents")
    return jsonld.expand(docs).groupBy("property", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_documents"))


def _coverage(s, d, folder):
    return checks.link_coverage(assemble.coverage(*_all(s, d, folder)))


def _mergers(s, d, folder):
    return entities.merger_edges(entities.almanac(almanac(s, d, folder))["observations"])


def _map(s, d, folder):
    """Features of the map as their JSON says."""
    p, r = entities.plantations(polygons(s, d, folder)), entities.rivers(rivers(s, d, folder))
    p = _tables({k: p[k] for k in ("e25", "e53", "e41")}, folder, "plantation")
    r = _tables(r, folder, "river")
    get = lambda path: F.get_json_object("body", f"$.{path}")
    return assemble.features(p, r, f"{folder}/features").select(
        "pos", get("geometry.type").alias("kind"), get("properties.fid").cast("long").alias("fid"), get("properties.name").alias("name"), get("properties.status").alias("status"), get("properties.qid").alias("qid"), F.json_array_length(get("properties.names")).alias("n_names"),
    )


def _presence(s, d, folder):
    k = F.col("p_partkey")
    one = _csv(table(s, d, "part").select(F.when(k % 3 != 1, _text("Q", k % 300)).otherwise(F.lit("none")).alias("qid")), f"{folder}/one.csv", sep=";")
    two = _csv(table(s, d, "customer").select(_text("Q", F.col("c_custkey") % 700).alias("id")), f"{folder}/two.csv")
    found = readers.read_presence(s, [readers.PresenceSource("map-1930", 1930, one, sep=";"), readers.PresenceSource("register-1850", 1850, two, "id")])
    return found.select("qid", "source_id", "year")


def _streets(s, d):
    """Parts as street features, nations as the streets that are known; the outcome of each street and the records after the import."""
    k = F.col("p_partkey")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    line = F.array(F.array(point(k, k + 1), point(k + 2, k + 3)))
    name = F.when(k % 10 == 0, streets.UNNAMED).when(k % 10 != 1, _text(F.col("p_brand"), " ", k % 4))
    features = table(s, d, "part").select(k.alias("pos"), name.alias("name"), k.alias("id"), F.when(k % 8 != 0, line).alias("segments"))
    n = F.col("n_nationkey")
    none = F.lit(None)
    place = lambda label, shift: table(s, d, "nation").select(_text("stm-", F.lpad((n + shift).cast("string"), 5, "0")).alias("id"), label.alias("label"), F.lit("road").alias("type"), none.cast("double").alias("lat"), none.cast("double").alias("lng"), none.cast("string").alias("wkt"), none.cast("int").alias("fid"), F.array(F.lit("x")).alias("sources"))
    places = place(_text("BRAND#", n, " 2"), 1).unionByName(place(_text("brand ", n % 5, " 2"), 101))
    planned = streets.plan(streets.aggregate(features), places, "map-1916")
    after = streets.apply(planned, places, "map-1916")
    made = planned.groupBy(F.lit("planned").alias("step"), F.col("outcome").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("total"))
    known = after.groupBy(F.lit("after").alias("step"), F.array_join("sources", "+").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.regexp_extract("id", r"(\d+)$", 1).cast("long")).alias("total"))
    return made.unionByName(known)


_ARCHIVE = {
    "archive_features": _features,
    "archive_organizations": _organizations,
    "archive_names": _names,
    "archive_rivers": _rivers,
    "archive_observations": _observations,
    "archive_printed_names": _printed,
    "archive_profile": _profile,
    "archive_gazetteer": _gazetteer,
    "archive_graph": _graph,
    "archive_index": _index,
    "archive_coverage": _coverage,
    "archive_report": _report,
    "archive_unmet": _unmet,
    "archive_triples": _triples,
    "archive_mergers": _mergers,
    "archive_map": _map,
    "archive_presence": _presence,
}
QUERIES = {name: _kept(make) for name, make in _ARCHIVE.items()} | {"street_import": _streets}

_SLUG = "trim(regexp_replace(lower(trim({})), '[^a-z0-9]+', '-', 'g'), '-')"
_POLYGONS = """raw AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'P' || p_size END AS psur_id, CASE WHEN p_partkey % 9 = 0 THEN 'X' || p_partkey END AS psur_id3, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS new,
  CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) END AS old, CASE WHEN p_partkey % 3 <> 1 THEN 'Q' || (p_partkey % 300) END AS qid, CASE WHEN p_partkey % 7 = 0 THEN 'Q' || (p_partkey % 300 + 1000) END AS qid_alt,
  CASE WHEN p_partkey % 2 = 0 THEN p_name || '; ' || p_brand END AS label, p_partkey % 6 <> 0 AS placed FROM part)"""
_E25 = f"""{_POLYGONS}, slugged AS (SELECT *, coalesce({_SLUG.format("label")}, 'fid-' || k) AS base FROM raw),
  e25 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY k) > 1 THEN base || '-fid-' || k ELSE base END AS slug, CASE WHEN qid IS NULL AND psur_id IS NULL AND label IS NULL THEN 'unknown' ELSE 'built' END AS status FROM slugged)"""
_E74 = """said AS (SELECT k, 0 AS nth, qid, label, psur_id, psur_id3, qid_alt AS absorbed_into FROM raw WHERE qid IS NOT NULL UNION ALL SELECT k, 1, qid_alt, NULL, NULL, NULL, NULL FROM raw WHERE qid_alt IS NOT NULL),
  e74 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY k, nth) AS rn FROM said) WHERE rn = 1)"""
_E41 = """named AS (SELECT k AS pos, 1 AS o, new AS text, '1930' AS source_year, FALSE AS alternative FROM raw WHERE new IS NOT NULL UNION ALL SELECT k, 2, old, '1870', new IS NOT NULL FROM raw WHERE old IS NOT NULL
    UNION ALL SELECT k, 3, label, '', new IS NOT NULL FROM raw WHERE label IS NOT NULL AND label IS DISTINCT FROM new AND label IS DISTINCT FROM old),
  e41 AS (SELECT pos, (row_number() OVER (PARTITION BY pos ORDER BY o) - 1)::INT AS nth, text, source_year, alternative FROM named)"""
_RIVERS = f"""rraw AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN s_name || ' Kreek' WHEN 2 THEN s_name END AS a, CASE WHEN s_suppkey % 2 = 0 THEN 'Cottica' END AS water, CASE WHEN s_suppkey % 6 = 1 THEN 'Oud ' || s_name END AS b,
    CASE WHEN s_suppkey % 10 = 0 THEN 'Alt ' || s_name END AS c, s_suppkey % 4 <> 0 AS placed FROM supplier),
  rslug AS (SELECT *, coalesce({_SLUG.format("a")}, {_SLUG.format("b")}, 'fid-' || k) AS base, coalesce(a, b, c, water || ' (segment ' || k || ')', 'River segment ' || k) AS label, CASE WHEN lower(concat_ws(' ', a, b, c)) LIKE '%kreek%' THEN 'creek' ELSE 'river' END AS kind FROM rraw),
  e26 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY k) > 1 THEN base || '-fid-' || k ELSE base END AS slug FROM rslug)"""
_ALMANAC = """obs AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN 'Q' || (o_custkey % 300) END AS qid, year(o_orderdate)::INT AS y, year(o_orderdate) || CASE WHEN o_orderkey % 50 = 0 THEN 'a' ELSE '' END AS year,
    CASE WHEN o_orderkey % 13 <> 0 THEN 'Org \u00e9 ' || (o_custkey % 300) || '-' || (o_orderkey % 3) END AS org, CASE WHEN o_orderkey % 2 = 0 THEN 'Std ' || (o_custkey % 300) END AS std, o_orderpriority AS product,
    (o_orderkey % 97)::VARCHAR AS enslaved, o_orderstatus = 'P' OR o_orderkey % 5 = 0 AS is_deserted, o_orderstatus = 'P' AS is_abandoned, CASE o_orderkey % 4 WHEN 0 THEN 'Para Kreek' WHEN 1 THEN 'Weg ' || (o_orderkey % 8) END AS loc_std,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'D' || (o_custkey % 9) END AS district, CASE WHEN o_orderkey % 17 = 0 THEN 'P' || (o_orderkey % 40) END AS psur_id,
    CASE WHEN o_orderkey % 101 = 0 THEN 'Q' || (o_orderkey % 300) END AS split_id, CASE WHEN o_orderkey % 103 = 0 THEN 'Q' || (o_orderkey % 299) END AS part_of FROM orders)"""
_PRINTED = """printed AS (SELECT org, qid, min(k) AS k, arg_min(year, k) AS year, arg_min(coalesce(std, ''), k) AS std FROM obs WHERE org IS NOT NULL AND qid IS NOT NULL GROUP BY org, qid),
  standard AS (SELECT std, qid, min(k) AS k, arg_min(year, k) AS year FROM printed WHERE std <> '' AND std <> org GROUP BY std, qid),
  anames AS (SELECT org AS text, p.qid, p.year AS source_year, 'org' AS kind, s.k IS NOT NULL AS alternative FROM printed p LEFT JOIN standard s ON s.k = p.k UNION ALL SELECT std, qid, year, 'std', TRUE FROM standard)"""


def _mode(column: str) -> str:
    return f"(SELECT qid, arg_max(v, n * 1000000000 - met) AS v FROM (SELECT qid, {column} AS v, count(*) AS n, min(k) AS met FROM obs WHERE qid IS NOT NULL AND coalesce({column}, '') <> '' GROUP BY ALL) GROUP BY qid)"


_PROFILE = f"""profile AS (SELECT o.qid, d.v AS district, l.v AS location, p.v AS product, n.v AS label, o.psur_ids, o.first_pos FROM
  (SELECT qid, coalesce(string_agg(DISTINCT psur_id, ',' ORDER BY psur_id), '') AS psur_ids, min(k) AS first_pos FROM obs WHERE qid IS NOT NULL GROUP BY qid) o
  LEFT JOIN {_mode("district")} d ON d.qid = o.qid LEFT JOIN {_mode("loc_std")} l ON l.qid = o.qid LEFT JOIN {_mode("product")} p ON p.qid = o.qid LEFT JOIN {_mode("std")} n ON n.qid = o.qid)"""
_COUNTS = f"""WITH {_E25}, {_E74}, {_E41}, {_RIVERS}, {_ALMANAC}, {_PRINTED},
  rnamed AS (SELECT k FROM rraw WHERE a IS NOT NULL UNION ALL SELECT k FROM rraw WHERE b IS NOT NULL UNION ALL SELECT k FROM rraw WHERE c IS NOT NULL AND c IS DISTINCT FROM a AND c IS DISTINCT FROM b),
  counts AS (SELECT (SELECT count(*) FROM raw) AS e25, (SELECT count(*) FROM e26) AS e26, (SELECT count(*) FROM e74) AS e74, (SELECT count(*) FROM raw WHERE placed) + (SELECT count(*) FROM rraw WHERE placed) AS e53,
    (SELECT count(*) FROM e41) + (SELECT count(*) FROM rnamed) + (SELECT count(*) FROM anames) AS e41, (SELECT count(DISTINCT year) FROM obs) AS years, (SELECT count(new) + count(old) FROM raw) AS e36, (SELECT count(*) FROM obs) AS e13)"""
SQL = {
    "archive_features": f"WITH {_E25} SELECT k AS fid, slug, label, status, qid, qid_alt, placed FROM e25",
    "archive_organizations": f"WITH {_POLYGONS}, {_E74} SELECT qid, label, psur_id, psur_id3, absorbed_into FROM e74",
    "archive_names": f"WITH {_POLYGONS}, {_E41} SELECT * FROM e41",
    "archive_rivers": f"WITH {_RIVERS} SELECT k AS pos, slug, label, kind AS feature_type, water AS main_body_water, placed FROM e26",
    "archive_observations": f"WITH {_ALMANAC} SELECT k AS record_id, qid, y AS year_number, org AS observed_name, std AS standard_name, product, enslaved, is_deserted, is_abandoned, loc_std, district, psur_id FROM obs",
    "archive_printed_names": f"WITH {_ALMANAC}, {_PRINTED} SELECT * FROM anames",
    "archive_profile": f"WITH {_ALMANAC}, {_PROFILE} SELECT * FROM profile",
    "archive_gazetteer": f"""WITH {_E25}, {_RIVERS}, {_ALMANAC}, {_PROFILE},
      psur AS (SELECT k, concat_ws(',', psur_id, psur_id3) AS ids FROM raw),
      rows AS (
        SELECT 0 AS stage, row_number() OVER (ORDER BY district) AS place, 'district' AS type, district AS label, NULL AS district, NULL AS qid, NULL::INT AS fid, NULL AS product, '' AS psur_ids, 'almanakken' AS sources, FALSE AS placed FROM (SELECT DISTINCT district FROM obs WHERE district IS NOT NULL)
        UNION ALL SELECT 1, row_number() OVER (ORDER BY loc_std), 'river', loc_std, NULL, NULL, NULL, NULL, '', 'almanakken', FALSE FROM (SELECT DISTINCT loc_std FROM obs WHERE loc_std IS NOT NULL)
        UNION ALL SELECT 2, k, kind, label, NULL, NULL, k, kind, '', 'map-1930', placed FROM e26
        UNION ALL SELECT 3, e.k, 'plantation', coalesce(e.label, e.new, 'Place ' || e.k), p.district, e.qid, e.k, p.product, s.ids, concat_ws(',', 'map-1930', CASE WHEN p.qid IS NOT NULL THEN 'almanakken' END, CASE WHEN s.ids <> '' THEN 'slave-registers' END), TRUE
          FROM e25 e LEFT JOIN profile p ON p.qid = e.qid JOIN psur s ON s.k = e.k WHERE e.placed
        UNION ALL SELECT 4, first_pos, 'plantation', coalesce(label, qid), district, qid, NULL, product, psur_ids, concat_ws(',', 'almanakken', CASE WHEN psur_ids <> '' THEN 'slave-registers' END), FALSE
          FROM profile WHERE qid NOT IN (SELECT qid FROM e25 WHERE placed AND qid IS NOT NULL)),
      numbered AS (SELECT *, 'stm-' || lpad((row_number() OVER (ORDER BY stage, place))::VARCHAR, 5, '0') AS id FROM rows)
      SELECT n.id, type, n.label, n.district, b.id AS broader, qid, fid, product, psur_ids, sources, placed FROM numbered n LEFT JOIN (SELECT label, id FROM numbered WHERE stage = 0) b ON b.label = n.district""",
    "archive_graph": f"""{_COUNTS}, long AS (SELECT unnest([{{'c': 'E25', 'n': e25}}, {{'c': 'E26', 'n': e26}}, {{'c': 'E74', 'n': e74}}, {{'c': 'E53', 'n': e53}}, {{'c': 'E41', 'n': e41}}, {{'c': 'E22', 'n': years + 2}}, {{'c': 'E12', 'n': years + 2}},
        {{'c': 'E52', 'n': years}}, {{'c': 'E36', 'n': e36}}, {{'c': 'E55', 'n': 12}}, {{'c': 'E13', 'n': e13}}]) AS x FROM counts)
      SELECT x.c AS class, sum(x.n)::BIGINT AS n FROM long GROUP BY ROLLUP (x.c)""",
    "archive_index": f"""{_COUNTS}, more AS (SELECT (SELECT count(DISTINCT pos) FROM e41) + (SELECT count(DISTINCT k) FROM rnamed) + (SELECT count(DISTINCT qid) FROM anames) AS named, (SELECT count(qid) FROM obs) AS about, (SELECT count(DISTINCT qid) FROM obs) AS orgs FROM counts),
      long AS (SELECT unnest([{{'c': 'plantations', 'n': e25, 'k': e25}}, {{'c': 'physical_features', 'n': e26, 'k': e26}}, {{'c': 'organizations', 'n': e74, 'k': e74}}, {{'c': 'places', 'n': e53, 'k': e53}}, {{'c': 'sources', 'n': years + 2, 'k': years + 2}},
        {{'c': 'appellations_by_entity', 'n': e41, 'k': named}}, {{'c': 'observations_by_org', 'n': about, 'k': orgs}}, {{'c': 'provenance', 'n': years, 'k': years}}]) AS x FROM counts, more)
      SELECT x.c AS name, x.n AS n, x.k AS n_keys FROM long""",
    "archive_report": f"""{_COUNTS}, x AS (SELECT (SELECT count(*) FROM raw WHERE placed) AS p, (SELECT count(*) FROM e26 WHERE placed) AS r, (SELECT count(qid) FROM obs) AS org, (SELECT count(DISTINCT source_year) FROM anames) AS named, (SELECT count(*) FROM raw WHERE new IS NOT NULL OR old IS NOT NULL) AS shown)
      SELECT u.c AS "check", u.l::BIGINT AS linked, u.t::BIGINT AS total FROM (SELECT unnest([{{'c': 'retired class E24', 'l': 0, 't': 0}}, {{'c': 'E25 with location', 'l': p, 't': e25}}, {{'c': 'E26 with location', 'l': r, 't': e26}}, {{'c': 'E41 with content', 'l': e41, 't': e41}},
        {{'c': 'E13 with organization', 'l': org, 't': e13}}, {{'c': 'E13 with class', 'l': e13, 't': e13}}, {{'c': 'E13 with year', 'l': e13, 't': e13}}, {{'c': 'E22 carrying something', 'l': named + 2, 't': years + 2}}, {{'c': 'E25 with representation', 'l': shown, 't': e25}},
        {{'c': 'E25 with type', 'l': e25, 't': e25}}, {{'c': 'E22 with production', 'l': years + 2, 't': years + 2}}, {{'c': 'E12 with product', 'l': years + 2, 't': years + 2}}, {{'c': 'E12 with maker', 'l': 0, 't': years + 2}}, {{'c': 'E12 with place', 'l': 0, 't': years + 2}},
        {{'c': 'E36 with content', 'l': 0, 't': e36}}, {{'c': 'E36 with keeper', 'l': 0, 't': e36}}, {{'c': 'Polygons in the country', 'l': p, 't': p}}, {{'c': 'Linestrings in the country', 'l': r, 't': r}}]) AS u FROM counts, x)""",
    "archive_unmet": f"""WITH {_POLYGONS}, {_E74}, {_ALMANAC}, {_PRINTED}, u AS (SELECT 'about' AS key, qid FROM obs WHERE qid IS NOT NULL UNION ALL SELECT 'identifies', qid FROM anames)
      SELECT key, count(*) AS n, count(DISTINCT qid) AS n_ends FROM u WHERE qid NOT IN (SELECT qid FROM e74) GROUP BY key""",
    "archive_coverage": f"""WITH {_E25}, {_E41}, {_RIVERS}, {_ALMANAC}, {_PRINTED}
      SELECT 'E25' AS entity, 'owner' AS link, count(qid) AS linked, count(*) AS total FROM raw UNION ALL SELECT 'E25', 'former_owner', count(qid_alt), count(*) FROM raw UNION ALL SELECT 'E25', 'place', count(*) FILTER (placed), count(*) FROM raw
      UNION ALL SELECT 'E26', 'place', count(*) FILTER (placed), count(*) FROM e26
      UNION ALL SELECT 'E41', 'source', count(*) FILTER (source_year <> ''), count(*) FROM e41 UNION ALL SELECT 'E41', 'alternative', count(*) FILTER (alternative), count(*) FROM e41
      UNION ALL SELECT 'E13', 'organization', count(qid), count(*) FROM obs UNION ALL SELECT 'E13', 'source', count(*), count(*) FROM obs UNION ALL SELECT 'E13', 'product', count(product), count(*) FROM obs""",
    "archive_mergers": f"""WITH {_ALMANAC} SELECT DISTINCT qid AS src, split_id AS dst, 'split' AS kind FROM obs WHERE qid IS NOT NULL AND split_id <> qid UNION SELECT DISTINCT qid, part_of, 'part_of' FROM obs WHERE qid IS NOT NULL AND part_of <> qid""",
    "archive_map": f"""WITH {_E25}, {_E41}, {_RIVERS}, shown AS (
        SELECT 0 AS stage, k, 'Polygon' AS kind, nullif(k, 0) AS fid, coalesce(label, new) AS name, status, qid, (SELECT count(DISTINCT t) FROM (SELECT text AS t FROM e41 WHERE pos = e.k UNION ALL SELECT e.label) WHERE t IS NOT NULL)::INT AS n_names FROM e25 e WHERE placed
        UNION ALL SELECT 1, k, 'LineString', nullif(k, 0), label, NULL, NULL, (SELECT count(DISTINCT t) FROM (VALUES (e.label), (a), (b), (CASE WHEN c IS DISTINCT FROM a AND c IS DISTINCT FROM b THEN c END)) v(t) WHERE t IS NOT NULL)::INT FROM e26 e WHERE placed)
      SELECT row_number() OVER (ORDER BY stage, k) AS pos, kind, fid, name, status, qid, n_names FROM shown""",
    "archive_presence": """SELECT DISTINCT 'Q' || (p_partkey % 300) AS qid, 'map-1930' AS source_id, 1930 AS year FROM part WHERE p_partkey % 3 <> 1 UNION SELECT DISTINCT 'Q' || (c_custkey % 700), 'register-1850', 1850 FROM customer""",
    "street_import": """WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 IN (0, 1) THEN NULL ELSE lower(replace(p_brand, '#', ' ')) || ' ' || (p_partkey % 4) END AS key FROM part WHERE p_partkey % 8 <> 0),
        st AS (SELECT coalesce(key, 'unnamed:' || k) AS key, min(k) AS k, count(*) AS ids FROM f GROUP BY 1),
        pl AS (SELECT 'brand ' || n_nationkey || ' 2' AS key, n_nationkey + 1 AS id FROM nation UNION ALL SELECT 'brand ' || (n_nationkey % 5) || ' 2', n_nationkey + 101 FROM nation),
        nm AS (SELECT key, count(*) AS n, min(id) AS id FROM pl GROUP BY key),
        o AS (SELECT st.*, nm.id, CASE WHEN n = 1 THEN 'update' WHEN n > 1 THEN 'conflict' ELSE 'insert' END AS outcome FROM st LEFT JOIN nm USING (key)),
        last AS (SELECT max(id) AS id FROM pl), ins AS (SELECT count(*) AS n FROM o WHERE outcome = 'insert'),
        after AS (SELECT id, CASE WHEN id IN (SELECT id FROM o WHERE outcome = 'update') THEN 'x+map-1916' ELSE 'x' END AS kind FROM pl)
        SELECT 'planned' AS step, outcome AS kind, count(*) AS n, sum(ids)::BIGINT AS total FROM o GROUP BY outcome
        UNION ALL SELECT 'after', kind, count(*), sum(id)::BIGINT FROM after GROUP BY kind UNION ALL SELECT 'after', 'map-1916', ins.n, (ins.n * last.id + ins.n * (ins.n + 1) // 2)::BIGINT FROM ins, last WHERE ins.n > 0""",
}
