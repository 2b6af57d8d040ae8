"""Queries on registers, links between persons, merged records and graph checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodspark.functions.text import normalize_label
from lodspark.operators import checks, merging, registers

from .tables import table


def _persons(s, d):
    """Names of small parts against names of large ones, by brand: each name once a side, with its least id."""
    side = lambda rows: rows.groupBy("p_brand", F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    p = table(s, d, "part")
    return registers.linked_persons(side(p.filter("p_size <= 25")), side(p.filter("p_size > 25")), ["p_brand"], "name")


def _whole_persons(s, d):
    """All customers against all customers of their nation, by whole names."""
    p = table(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.col("c_name").alias("name"))
    return registers.linked_persons(p, p, ["c_nationkey"], "name")


def _roles(s, d):
    li = table(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), F.col("l_returnflag").alias("wts_flag_1"), F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).alias("wts_flag_2"), F.col("l_linestatus").alias("dec_flag"))
    return registers.roles(li, {"dec": 1, "wts": 2}, ["flag"], "line").groupBy("role", "nth", "flag").agg(F.count(F.lit(1)).alias("n"))


def _attributes(s, d):
    return registers.counts_by(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"])


def _terms(s, d):
    lookup = table(s, d, "nation").select(F.col("n_name").alias("original"), F.concat(F.lit("N:"), "n_name").alias("standard")).filter("original < 'M'")
    rows = table(s, d, "nation").select("n_nationkey", F.concat(F.lit(" "), F.lower("n_name"), F.lit(".")).alias("term"))
    return registers.standard_terms(rows, "term", lookup).select("n_nationkey", "standard")


def _links(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    return checks.link_coverage({
        "E13": (o, {"about": F.col("o_custkey").isNotNull(), "late": F.col("o_orderstatus") == "P"}),
        "E74": (c, {"solvent": F.col("c_acctbal") > 0}),
    })


def _dangling(s, d):
    edges = table(s, d, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") % 130).alias("dst"))
    return checks.dangling(edges, table(s, d, "supplier").select(F.col("s_suppkey").alias("id")))


def _merged(s, d):
    """Pairs of suppliers of one nation as records that are merged."""
    sup = table(s, d, "supplier")
    link = lambda k: F.struct(F.lit("wikidata").alias("authority"), F.concat(F.lit("Q"), (F.col("s_suppkey") % k).cast("string")).alias("identifier"))
    name = F.struct(F.upper("s_name").alias("text"), F.lit("nl").alias("language"), F.lit("official").alias("type"), F.lit(True).alias("is_preferred"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("source_year"))
    record = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_acctbal").alias("size"), F.array(F.concat(F.lit("src"), (F.col("s_suppkey") % 3).cast("string")), F.lit("both")).alias("sources"), F.array(link(4), link(5)).alias("links"), F.array(name).alias("names"), F.array(F.lit("note")).alias("notes"), F.array(F.lit("x")).alias("assertions"))
    rows = sup.select("s_nationkey", record.alias("r"))
    pairs = rows.groupBy("s_nationkey").agg(F.min_by("r", "r.id").alias("a"), F.max_by("r", "r.id").alias("b")).filter("a.id <> b.id")
    pairs = pairs.withColumn("sides", F.create_map(F.lit("size"), F.lit("b")))
    out = merging.resolve(pairs, ["label", "size"])
    return out.select("id", "retired", "label", "size", F.array_join(F.array_sort("sources"), ",").alias("sources"), F.size("links").alias("n_links"), F.size("names").alias("n_names"), F.size("notes").alias("n_notes"), F.size("assertions").alias("n_assertions"))


def _hydrated(s, d):
    p = table(s, d, "part")
    own = p.filter("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("place"), F.col("p_name").alias("text")).agg(F.lit(None).cast("string").alias("language"), F.lit("own").alias("source"), F.lit(None).cast("int").alias("source_year"))
    other = p.filter("p_partkey % 2 = 1").select(F.col("p_brand").alias("place"), F.concat(F.initcap("p_name"), F.lit("!")).alias("text"), F.lit("nl").alias("language"), F.lit("map").alias("source"), F.col("p_size").alias("source_year"))
    return merging.hydrate(own, other).select("place", "key", "text", "language", "source", "source_year")


def _keys(s, d):
    return table(s, d, "nation").select("n_nationkey", normalize_label("n_name").alias("key"))


QUERIES = {
    "person_links": _persons,
    "person_links_whole": _whole_persons,
    "certificate_roles": _roles,
    "attribute_counts": _attributes,
    "standard_terms": _terms,
    "link_coverage": _links,
    "dangling_links": _dangling,
    "merge_resolution": _merged,
    "hydrate_names": _hydrated,
    "label_keys": _keys,
}

_KEY = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g'))"
SQL = {
    "person_links": f"""WITH p AS (SELECT p_brand, p_size <= 25 AS small, {_KEY.format("p_name")} AS k, min(p_partkey) AS id FROM part GROUP BY p_brand, p_name, small)
        SELECT a.id AS id_a, b.id AS id_b, levenshtein(a.k, b.k)::INT AS edits FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.small AND NOT b.small WHERE a.k <> '' AND b.k <> '' AND levenshtein(a.k, b.k) <= 2""",
    "certificate_roles": """SELECT role, nth, flag, count(*) AS n FROM (
        SELECT 'dec' AS role, 1 AS nth, l_linestatus AS flag FROM lineitem UNION ALL SELECT 'wts', 1, l_returnflag FROM lineitem
        UNION ALL SELECT 'wts', 2, l_linestatus FROM lineitem WHERE l_quantity > 25) GROUP BY role, nth, flag""",
    "attribute_counts": """SELECT 'l_returnflag' AS attribute, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2""",
    "standard_terms": "SELECT n_nationkey, CASE WHEN n_name < 'M' THEN 'N:' || n_name ELSE ' ' || lower(n_name) || '.' END AS standard FROM nation",
    "link_coverage": """SELECT 'E13' AS entity, 'about' AS link, count(o_custkey) AS linked, count(*) AS total FROM orders UNION ALL SELECT 'E13', 'late', count(*) FILTER (o_orderstatus = 'P'), count(*) FROM orders
        UNION ALL SELECT 'E74', 'solvent', count(*) FILTER (c_acctbal > 0), count(*) FROM customer""",
    "dangling_links": "SELECT p_partkey % 130 AS dst, count(*) AS n FROM part WHERE p_partkey % 130 NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1",
    "merge_resolution": """WITH p AS (SELECT s_nationkey, min(s_suppkey) AS a, max(s_suppkey) AS b FROM supplier GROUP BY 1 HAVING min(s_suppkey) <> max(s_suppkey))
        SELECT a AS id, b AS retired, x.s_name AS label, y.s_acctbal AS size, CASE WHEN a % 3 = b % 3 THEN 'both,src' || a % 3 ELSE 'both,src' || least(a % 3, b % 3) || ',src' || greatest(a % 3, b % 3) END AS sources,
        len(list_distinct([a % 4, a % 5, b % 4, b % 5]))::INT AS n_links, 2 AS n_names, 1 AS n_notes, 2 AS n_assertions FROM p JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b""",
    "hydrate_names": f"""WITH o AS (SELECT DISTINCT p_brand AS place, {_KEY.format("p_name")} AS key, p_name AS text FROM part WHERE p_partkey % 2 = 0),
        x AS (SELECT p_brand AS place, {_KEY.format("p_name")} AS key, min(p_size) AS source_year, max(length(p_name)) + 1 AS size FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL)
        SELECT coalesce(o.place, x.place) AS place, coalesce(o.key, x.key) AS key, CASE WHEN x.place IS NULL THEN o.text ELSE
          (SELECT string_agg(upper(w[1]) || w[2:], ' ') FROM (SELECT unnest(string_split(x.key, ' ')) AS w)) || '!' END AS text,
        CASE WHEN x.place IS NOT NULL THEN 'nl' END AS language, CASE WHEN o.place IS NOT NULL THEN 'own' ELSE 'map' END AS source, x.source_year AS source_year
        FROM o FULL JOIN x ON o.place = x.place AND o.key = x.key""",
    "label_keys": f"SELECT n_nationkey, {_KEY.format('n_name')} AS key FROM nation",
}
