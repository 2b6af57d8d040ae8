"""Queries on labels, links, JSON, language maps and geometry."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodspark.functions import geo, lang, text, uri
from lodspark.operators import detail
from lodspark.operators import placequery

from .tables import table


def _slugs(s, d):
    return table(s, d, "documents").select("doc_id", text.slugify("text").alias("slug"))


def _labels(s, d):
    labels = table(s, d, "documents").select("doc_id", text.normalize_label("text").alias("label"))
    return labels.select("doc_id", F.sha2("label", 256).alias("label_hash"), F.length("label").alias("label_chars"))


def _variants(s, d):
    p = table(s, d, "part").withColumn("raw", F.concat(F.lit(" "), "p_name", F.lit("'s – "), "p_brand", F.lit("! ")))
    return p.select("p_partkey", text.slug_value("raw").alias("value"), text.slug_capped("raw", 12).alias("capped"), text.slug_term("raw").alias("term"), text.slugify("raw").alias("slug"))


def _unique(s, d):
    from lodspark.operators import dedupe

    p = table(s, d, "part").select("p_partkey", "p_name")
    return dedupe.unique_slugs(p, text.slugify("p_name"), F.concat(F.lit("fid-"), F.col("p_partkey").cast("string")), "p_partkey").select("p_partkey", "slug")


def _ints(s, d):
    p = table(s, d, "part").withColumn("raw", F.concat(F.lit(" "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("a")))
    brand = F.regexp_replace("p_brand", "^[^0-9]*", "")
    return p.select("p_partkey", text.safe_int("raw").alias("safe"), text.int_prefix(brand).alias("number"), text.int_prefix("p_brand").alias("none"), text.nonzero_int(F.concat((F.col("p_size") % 3).cast("string"), F.lit("x"))).alias("nonzero"))


def _url_params(s, d):
    u = table(s, d, "pages")
    return u.select("page_id", uri.number_between(uri.parameter("url", "page"), 0, 5).alias("page"), uri.parameter("url", "utm_source").alias("utm"), F.nullif(F.regexp_extract("url", "#(.*)$", 1), F.lit("")).alias("fragment"))


def _place_ids(s, d):
    u = table(s, d, "pages").select("page_id", F.concat(F.lit("https://x/place/stm-"), F.right(F.concat(F.lit("00000"), F.col("page_id").cast("string")), F.lit(5))).alias("link"), "url")
    return u.select("page_id", uri.place_id("link").alias("place_id"), uri.place_id(F.col("page_id").cast("string")).alias("same"), uri.tail("url").alias("tail"))


def _compact(s, d):
    p = table(s, d, "part")
    base = F.when(F.col("p_partkey") % 3 == 0, "http://www.wikidata.org/entity/Q").when(F.col("p_partkey") % 3 == 1, "http://www.w3.org/2004/02/skos/core#c").otherwise("urn:other:")
    link = F.concat(base, F.col("p_partkey").cast("string"))
    return p.select("p_partkey", uri.compact(link).alias("short"), uri.label_of(link).alias("label"))


def _hosts(s, d):
    return table(s, d, "pages").select("page_id", uri.strip_host("url").alias("path"))


def _explore(s, d):
    c = table(s, d, "customer")
    link = uri.explore_url(F.concat(F.lit("stm-"), F.col("c_custkey").cast("string")), (F.col("c_custkey") % 30).cast("double"), F.when(F.col("c_custkey") % 2 == 0, (F.col("c_custkey") % 100).cast("double")), (F.col("c_custkey") % 200).cast("double"))
    back = uri.explore_parameters(F.col("link"))
    return c.select("c_custkey", link.alias("link")).withColumn("p", back).select("c_custkey", "link", "p.place", "p.z", "p.lat", "p.lng")


def _json(s, d):
    e = table(s, d, "events")
    k = F.from_json("props", "k long")["k"]
    return e.select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("t"), k.alias("k"))).alias("body"))


def _scalar_or_list(s, d):
    e = table(s, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array("event_type", F.lit("x")))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('"'), "event_type", F.lit('"')))
    return e.select("event_id", F.array_join(lang.as_array(F.parse_json(raw)), ",").alias("values"))


def _lang_pick(s, d):
    rows = table(s, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).filter("lang <> 'en' or source <> 'src1'")
    maps = rows.groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", F.col("n").cast("string"))))).alias("m"))
    return maps.select("source", lang.lang_en(F.col("m")).alias("picked"), F.array_join(F.map_keys("m"), ",").alias("langs"))


def _search(s, d):
    return placequery.search(table(s, d, "documents"), "MORON", "text", "doc_id").select("doc_id")


def _search_all(s, d):
    docs = table(s, d, "documents")
    return docs.filter(placequery.contains("idiot", F.col("text"), F.col("source"))).select("doc_id", "lang")


def _lines(s, d):
    e = table(s, d, "embeddings")
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.round(F.get("embedding", (i * 2).cast("int")).cast("double") * 10, 4).alias("x"), F.round(F.get("embedding", (i * 2 + 1).cast("int")).cast("double") * 10, 4).alias("y")))
    return e.select("vec_id", "label", pts.alias("pts"))


def _round_trip(s, d):
    wkt = geo.write_line(F.col("pts"), 4)
    back = _lines(s, d).select("vec_id", geo.line_points(wkt).alias("p"))
    return back.select("vec_id", F.size("p").alias("n"), F.col("p")[0]["x"].alias("first_x"), F.element_at("p", -1)["y"].alias("last_y"))


def _centroid(s, d):
    return _lines(s, d).select("vec_id", geo.mean_point(F.col("pts")).alias("c")).select("vec_id", F.round("c.x", 9).alias("x"), F.round("c.y", 9).alias("y"))


def _multi(s, d):
    """Centroid of all segments of a label: sums of points, so no label's geometry is one row."""
    p = _lines(s, d).filter("label is not null").select("label", F.explode("pts").alias("p"))
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n_points"), F.round(F.avg("p.x"), 7).alias("x"), F.round(F.avg("p.y"), 7).alias("y"))


def _bbox(s, d):
    p = _lines(s, d).select("label", F.explode("pts").alias("p"))
    return detail.bounds(p, "label", F.col("p.x"), F.col("p.y"))


def _grid(s, d):
    sup = table(s, d, "supplier").select("s_suppkey", (500000 + F.col("s_acctbal") * 20).alias("gx"), (600000 + F.col("s_suppkey") * 100.0).alias("gy"))
    return sup.withColumn("p", geo.reproject(F.col("gx"), F.col("gy")))


def _reproject(s, d):
    return _grid(s, d).select("s_suppkey", F.round("p.lng", 6).alias("lng"), F.round("p.lat", 6).alias("lat"), geo.in_bounds(F.col("p.lng"), F.col("p.lat")).alias("inside"))


def _near(s, d):
    lat, lng = 3.0 + (F.col("s_suppkey") % 100) / 50.0, -57.0 + F.col("s_acctbal") / 5000.0
    points = table(s, d, "supplier").select("s_suppkey", lat.alias("lat"), lng.alias("lng"))
    around = table(s, d, "region").select("r_regionkey", (3.2 + F.col("r_regionkey") / 4.0).alias("lat"), (-57.0 + F.col("r_regionkey") / 2.0).alias("lng"))
    return detail.near(points, around, 80.0).select("s_suppkey", "r_regionkey", "km")


def _near_all(s, d):
    """All suppliers around each nation's own point."""
    lat, lng = 3.0 + (F.col("s_suppkey") % 100) / 50.0, -57.0 + F.col("s_acctbal") / 5000.0
    points = table(s, d, "supplier").select("s_suppkey", lat.alias("lat"), lng.alias("lng"))
    around = table(s, d, "nation").select("n_nationkey", (3.0 + F.col("n_nationkey") / 12.0).alias("lat"), (-57.0 + F.col("n_nationkey") / 15.0).alias("lng"))
    return detail.near(points, around, 40.0).select("s_suppkey", "n_nationkey", "km")


_LINES = """pts AS (SELECT vec_id, label, i, round(embedding[2 * i + 1]::DOUBLE * 10, 4) AS x, round(embedding[2 * i + 2]::DOUBLE * 10, 4) AS y
  FROM (SELECT *, unnest(range(0, 32)) AS i FROM embeddings))"""

QUERIES = {
    "slugify_docs": _slugs,
    "normalize_label": _labels,
    "slug_variants": _variants,
    "unique_slugs": _unique,
    "safe_int": _ints,
    "url_params": _url_params,
    "place_id_from_uri": _place_ids,
    "uri_compact": _compact,
    "uri_paths": _hosts,
    "explore_links": _explore,
    "json_props": _json,
    "scalar_or_list": _scalar_or_list,
    "lang_map_pick": _lang_pick,
    "text_search": _search,
    "text_search_all": _search_all,
    "wkt_roundtrip": _round_trip,
    "centroid": _centroid,
    "multiline_centroid": _multi,
    "bbox": _bbox,
    "reproject_points": _reproject,
    "haversine_near": _near,
    "near_pairs": _near_all,
}


def _reproject_sql() -> str:
    # Radius of the rectifying sphere and both series of the International 1924 ellipsoid, written out: nothing here comes from the code that is checked.
    radius = 6367654.500057585
    beta = [0.0008412763388186023, 5.956192977992212e-08, 1.6948520876295087e-10, 2.2047389640659688e-13]
    delta = [0.0033707758815824693, 6.627690803032562e-06, 1.7871860139121646e-08, 5.4926631225221743e-11]
    x1 = " - ".join(["xi", *[f"({b!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(beta, 1)]])
    e1 = " - ".join(["eta", *[f"({b!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(beta, 1)]])
    ph = " + ".join(["chi", *[f"({v!r}) * sin({2 * j} * chi)" for j, v in enumerate(delta, 1)]])
    a, f, wa, wf = 6378388.0, 1 / 297.0, 6378137.0, 1 / 298.257223563
    e2, w2, b = f * (2 - f), wf * (2 - wf), wa * (1 - wf)
    return f"""WITH g AS (SELECT s_suppkey, (600000 + s_suppkey * 100.0) / (0.9996 * {radius!r}) AS xi, (s_acctbal * 20) / (0.9996 * {radius!r}) AS eta FROM supplier),
      g1 AS (SELECT s_suppkey, {x1} AS xi1, {e1} AS eta1 FROM g),
      g2 AS (SELECT s_suppkey, asin(sin(xi1) / cosh(eta1)) AS chi, radians(-55.68333333333) + atan2(sinh(eta1), cos(xi1)) AS lam FROM g1),
      g3 AS (SELECT s_suppkey, lam, {ph} AS phi FROM g2),
      g4 AS (SELECT s_suppkey, lam, phi, {a} / sqrt(1 - {e2!r} * sin(phi) * sin(phi)) AS v FROM g3),
      g5 AS (SELECT s_suppkey, v * cos(phi) * cos(lam) - 265 AS x, v * cos(phi) * sin(lam) + 120 AS y, v * {1 - e2!r} * sin(phi) - 358 AS z FROM g4),
      g6 AS (SELECT *, sqrt(x * x + y * y) AS p FROM g5),
      g7 AS (SELECT *, atan2(z * {wa}, p * {b!r}) AS theta FROM g6),
      g8 AS (SELECT s_suppkey, degrees(atan2(y, x)) AS lng, degrees(atan2(z + {w2 / (1 - w2) * b!r} * pow(sin(theta), 3), p - {w2 * wa!r} * pow(cos(theta), 3))) AS lat FROM g7)
      SELECT s_suppkey, round(lng, 6) AS lng, round(lat, 6) AS lat, lng > -58 AND lng < -53 AND lat > 1 AND lat < 7 AS inside FROM g8"""


_RAW = "(SELECT p_partkey, ' ' || p_name || '''s – ' || p_brand || '! ' AS raw FROM part)"
SQL = {
    "slugify_docs": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(trim(lower(text)), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents""",
    "normalize_label": r"""SELECT doc_id, sha256(l) AS label_hash, length(l)::INT AS label_chars FROM (
        SELECT doc_id, trim(regexp_replace(strip_accents(lower(replace(text, 'ß', ' '))), '[^a-z0-9]+', ' ', 'g')) AS l FROM documents)""",
    "slug_variants": rf"""SELECT p_partkey, v AS value, substr(v, 1, 12) AS capped, regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS term,
        regexp_replace(regexp_replace(regexp_replace(trim(lower(raw)), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
        FROM (SELECT *, regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS v FROM {_RAW})""",
    "unique_slugs": r"""SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY p_partkey) > 1 THEN slug || '-fid-' || p_partkey ELSE slug END AS slug
        FROM (SELECT p_partkey, regexp_replace(regexp_replace(trim(lower(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part)""",
    "safe_int": r"""SELECT p_partkey, floor(p_retailprice)::BIGINT::VARCHAR AS safe, regexp_extract(p_brand, '(\d+)', 1)::BIGINT AS number, NULL::BIGINT AS none, nullif(p_size % 3, 0)::BIGINT AS nonzero FROM part""",
    "url_params": r"""SELECT page_id, CASE WHEN p BETWEEN 0 AND 5 THEN p END AS page, utm, fragment FROM (
        SELECT page_id, try_cast(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS DOUBLE) AS p, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages)""",
    "place_id_from_uri": r"""SELECT page_id, 'stm-' || right('00000' || page_id, 5) AS place_id, page_id::VARCHAR AS same, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1) AS tail FROM pages""",
    "uri_compact": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'wd:Q' WHEN 1 THEN 'skos:c' ELSE 'urn:other:' END || p_partkey AS short, CASE p_partkey % 3 WHEN 0 THEN 'Q' WHEN 1 THEN 'c' ELSE 'urn:other:' END || p_partkey AS label FROM part""",
    "uri_paths": "SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+/', '') AS path FROM pages",
    "explore_links": """SELECT c_custkey, '/explore?place=stm-' || c_custkey || '&z=' || c_custkey % 30 || CASE WHEN c_custkey % 2 = 0 THEN '&lat=' || printf('%.4f', (c_custkey % 100)::DOUBLE) ELSE '' END || '&lng=' || printf('%.4f', (c_custkey % 200)::DOUBLE) AS link,
        'stm-' || c_custkey AS place, CASE WHEN c_custkey % 30 <= 22 THEN (c_custkey % 30)::DOUBLE END AS z, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 100 <= 90 THEN (c_custkey % 100)::DOUBLE END AS lat, CASE WHEN c_custkey % 200 <= 180 THEN (c_custkey % 200)::DOUBLE END AS lng FROM customer""",
    "json_props": """SELECT event_id, (props::JSON->>'k')::BIGINT AS k, '{"t":"' || event_type || '"' || coalesce(',"k":' || (props::JSON->>'k'), '') || '}' AS body FROM events""",
    "scalar_or_list": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || ',x' WHEN 1 THEN event_type ELSE '' END AS values FROM events",
    "lang_map_pick": """SELECT source, coalesce(max(CASE lang WHEN 'en' THEN n::VARCHAR END), arg_min(n::VARCHAR, lang)) AS picked, string_agg(lang, ',' ORDER BY lang) AS langs
        FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang <> 'en' OR source <> 'src1' GROUP BY ALL) GROUP BY source""",
    "text_search": "SELECT doc_id FROM documents WHERE contains(lower(text), 'moron') ORDER BY doc_id LIMIT 20",
    "text_search_all": "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(source), 'idiot')",
    "wkt_roundtrip": f"WITH {_LINES} SELECT vec_id, count(*)::INT AS n, arg_min(x, i) AS first_x, arg_max(y, i) AS last_y FROM pts GROUP BY vec_id",
    "centroid": f"WITH {_LINES} SELECT vec_id, round(avg(x), 9) AS x, round(avg(y), 9) AS y FROM pts GROUP BY vec_id",
    "multiline_centroid": f"WITH {_LINES} SELECT label, count(*) AS n_points, round(avg(x), 7) AS x, round(avg(y), 7) AS y FROM pts WHERE label IS NOT NULL GROUP BY label",
    "bbox": f"WITH {_LINES} SELECT label, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM pts GROUP BY label",
    # Plain decimals would be exact numbers of few digits in this dialect.
    "reproject_points": re.sub(r"(?<![\w.])(\d+\.\d+)(?![\de])", r"\1e0", _reproject_sql()),
    "haversine_near": """SELECT s_suppkey, r_regionkey, km FROM (SELECT s_suppkey, r_regionkey, round(2 * 6371.0 * asin(least(sqrt(pow(sin(radians(lat - b) / 2), 2) + cos(radians(b)) * cos(radians(lat)) * pow(sin(radians(lng - l) / 2), 2)), 1.0)), 3) AS km
        FROM (SELECT s_suppkey, 3.0::DOUBLE + (s_suppkey % 100) / 50.0 AS lat, -57.0::DOUBLE + s_acctbal / 5000.0 AS lng FROM supplier), (SELECT r_regionkey, 3.2::DOUBLE + r_regionkey / 4.0 AS b, -57.0::DOUBLE + r_regionkey / 2.0 AS l FROM region)) WHERE km <= 80""",
    "near_pairs": """SELECT s_suppkey, n_nationkey, km FROM (SELECT s_suppkey, n_nationkey, round(2 * 6371.0 * asin(least(sqrt(pow(sin(radians(lat - b) / 2), 2) + cos(radians(b)) * cos(radians(lat)) * pow(sin(radians(lng - l) / 2), 2)), 1.0)), 3) AS km
        FROM (SELECT s_suppkey, 3.0::DOUBLE + (s_suppkey % 100) / 50.0 AS lat, -57.0::DOUBLE + s_acctbal / 5000.0 AS lng FROM supplier), (SELECT n_nationkey, 3.0::DOUBLE + n_nationkey / 12.0 AS b, -57.0::DOUBLE + n_nationkey / 15.0 AS l FROM nation)) WHERE km <= 40""",
}
