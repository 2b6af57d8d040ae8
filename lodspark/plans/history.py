"""Queries on spans, assertions, duplicates and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodspark.operators import assertions, dedupe, spans

from .tables import customer_tags, observations, table

_YEARS = """
years AS (SELECT 'Q' || o_custkey AS org, year(o_orderdate)::INT AS year,
                 max(CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 0 END) AS state
          FROM orders GROUP BY ALL),
steps AS (SELECT *, CASE WHEN lag(state) OVER w = state AND year - lag(year) OVER w <= 2 THEN 0 ELSE 1 END AS is_new
          FROM years WHERE state > 0 WINDOW w AS (PARTITION BY org ORDER BY year)),
numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY org ORDER BY year) AS island FROM steps),
runs AS (SELECT org, state, min(year) AS start, max(year) AS stop FROM numbered GROUP BY org, island, state),
flags AS (SELECT *, coalesce(max(CASE WHEN state = 2 THEN 1 ELSE 0 END) OVER b, 0) AS was_abandoned,
                 coalesce(max(CASE WHEN state = 1 THEN 1 ELSE 0 END) OVER b, 0) AS was_active
          FROM runs WINDOW b AS (PARTITION BY org ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
status AS (SELECT org, CASE WHEN state = 2 THEN 'abandoned' WHEN was_abandoned = 1 THEN 'reactivated' WHEN was_active = 0 THEN 'built' END AS status,
                  start AS start_year, CASE WHEN state = 2 AND stop <> start THEN stop END AS end_year
           FROM flags)"""
_STATUS = f"WITH {_YEARS} SELECT * FROM status WHERE status IS NOT NULL"
_PRODUCT = """
first AS (SELECT 'Q' || o_custkey AS org, year(o_orderdate)::INT AS year, arg_min(o_orderpriority, o_orderkey) AS product
          FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
p_steps AS (SELECT *, CASE WHEN lag(product) OVER w = product AND year - lag(year) OVER w <= 2 THEN 0 ELSE 1 END AS is_new
            FROM first WINDOW w AS (PARTITION BY org ORDER BY year)),
p_numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY org ORDER BY year) AS island FROM p_steps),
products AS (SELECT org, product, min(year) AS start_year, CASE WHEN max(year) <> min(year) THEN max(year) END AS end_year
             FROM p_numbered GROUP BY org, island, product)"""
_BOTH = f"""WITH {_YEARS}, {_PRODUCT},
both_kinds AS (SELECT org, 'status' AS kind, status AS value, start_year, end_year FROM status WHERE status IS NOT NULL
               UNION ALL SELECT org, 'product', product, start_year, end_year FROM products)"""


def _status(spark, d):
    obs = observations(spark, d)
    return spans.lifecycle_spans(obs.select("org", "year", F.col("active_product").alias("product"), "abandoned"))


def _products(spark, d):
    return spans.product_spans(observations(spark, d))


def _mentions(spark, d):
    return spans.mention_range(_status(spark, d).select("org", "start_year", "end_year").unionByName(_products(spark, d).select("org", "start_year", "end_year")))


def _presence(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat(F.lit("returns-"), "l_returnflag").alias("source_id"), F.year("l_shipdate").alias("year"))
    return assertions.present_in(table(spark, d, "part"), line, "p_partkey")


def _attached(spark, d, force):
    manual = table(spark, d, "customer").select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("org"), F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("manual"))).alias("existing"))
    listed = _status(spark, d).groupBy("org").agg(F.array_sort(F.collect_list(F.concat_ws(":", "status", "start_year"))).alias("fresh"))
    return assertions.attach(manual, listed, "org", "existing", "fresh", force)


def _attach(spark, d):
    return _attached(spark, d, False).select("org", F.coalesce(F.array_join("existing", ","), F.lit("")).alias("assertions"), "outcome")


def _sql_attached(where: str, select: str) -> str:
    return f"""WITH {_YEARS},
listed AS (SELECT org, string_agg(status || ':' || start_year, ',' ORDER BY status || ':' || start_year) AS fresh FROM status WHERE status IS NOT NULL GROUP BY org),
met AS (SELECT 'Q' || c_custkey AS org, c_mktsegment = 'BUILDING' AS manual, fresh FROM customer LEFT JOIN listed ON listed.org = 'Q' || c_custkey),
judged AS (SELECT org, manual, fresh, CASE WHEN fresh IS NULL THEN 'no match' WHEN manual AND NOT {where} THEN 'skipped' ELSE 'patched' END AS outcome FROM met)
{select}"""


def _district(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("district"), (F.col("o_totalprice") > 400000).alias("current"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("pos"))
    return assertions.effective_district(o, "custkey", "district", "current", "year", "pos")


def _latest_product(spark, d):
    p = _products(spark, d).withColumn("pos", F.col("start_year"))
    return spans.latest(p, "org", "product", "pos")


def _modes(spark, d):
    return dedupe.mode_first(table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"), "o_orderkey"), "custkey", "priority", "o_orderkey")


def _freq(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def _first(spark, d):
    return dedupe.first_wins(table(spark, d, "part").select("p_name", "p_partkey", "p_brand"), ["p_name"], "p_partkey")


def _last(spark, d):
    return dedupe.last_wins(table(spark, d, "part").select("p_name", "p_partkey", "p_brand"), ["p_name"], "p_partkey")


def _sequence(spark, d):
    stages = [
        table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("pos")),
        table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("pos")),
        table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("long").alias("pos")),
    ]
    from lodspark.functions.text import numbered

    return dedupe.in_sequence(stages).select(numbered("stm-", F.col("seq")).alias("id"), "name", "stage")


def _min_id(spark, d):
    return dedupe.first_wins(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name"), ["s_nationkey"], "s_suppkey")


def _series(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return o.withColumn("change", F.round(F.col("total") - F.lag("total").over(W.partitionBy("custkey").orderBy("year")), 2))


def _in_year(spark, d):
    """The product that held in 1998, from the spans' validity."""
    return _products(spark, d).filter("start_year <= 1998 and coalesce(end_year, start_year) >= 1998").select("org", "product")


def _changes(spark, d):
    from pyspark.sql import Window as W

    p = _products(spark, d)
    before = F.lag("product").over(W.partitionBy("org").orderBy("start_year"))
    return p.withColumn("previous", before).filter("previous is not null and previous <> product").select("org", F.col("start_year").alias("year"), "previous", "product")


def _sessions(spark, d):
    from lodspark.streaming.sessions import sessions

    return sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", "6 hours")


QUERIES = {
    "lifecycle_spans": _status,
    "product_spans": _products,
    "lifecycle_timeline": lambda s, d: spans.timeline(_status(s, d), _products(s, d)),
    "mention_range": _mentions,
    "presence_assertions": _presence,
    "attach_assertions": _attach,
    "patch_counters": lambda s, d: assertions.counters(_attached(s, d, False)),
    "patch_counters_forced": lambda s, d: assertions.counters(_attached(s, d, True)),
    "effective_district": _district,
    "latest_product": _latest_product,
    "mode_first_tie": _modes,
    "frequency_maps": _freq,
    "dedupe_first": _first,
    "dedupe_last": _last,
    "sequence_ids": _sequence,
    "next_id": lambda s, d: dedupe.next_number(table(s, d, "customer"), "c_name"),
    "keep_min_id_per_key": _min_id,
    "observation_series": _series,
    "product_in_year": _in_year,
    "product_changes": _changes,
    "event_sessions": _sessions,
    "customer_tags": lambda s, d: customer_tags(s, d).select("custkey", F.array_join("tags", ",").alias("tags")),
}

SQL = {
    "lifecycle_spans": _STATUS,
    "product_spans": f"WITH {_PRODUCT} SELECT * FROM products",
    "lifecycle_timeline": f"{_BOTH} SELECT *, row_number() OVER (PARTITION BY org ORDER BY start_year NULLS LAST, kind, value)::INT AS seq FROM both_kinds",
    "mention_range": f"{_BOTH} SELECT org, min(start_year) AS first_year, max(coalesce(end_year, start_year)) AS last_year FROM both_kinds GROUP BY org",
    "presence_assertions": "SELECT DISTINCT l_partkey AS p_partkey, 'returns-' || l_returnflag AS source_id, year(l_shipdate)::INT AS start_year FROM lineitem SEMI JOIN part ON l_partkey = p_partkey",
    "attach_assertions": _sql_attached("FALSE", "SELECT org, CASE outcome WHEN 'patched' THEN fresh ELSE CASE WHEN manual THEN 'manual' ELSE '' END END AS assertions, outcome FROM judged"),
    "patch_counters": _sql_attached("FALSE", "SELECT outcome, count(*) AS n FROM judged GROUP BY outcome"),
    "patch_counters_forced": _sql_attached("TRUE", "SELECT outcome, count(*) AS n FROM judged GROUP BY outcome"),
    "effective_district": """SELECT o_custkey AS custkey, o_orderpriority AS district FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice > 400000 DESC, year(o_orderdate) DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
    "latest_product": f"WITH {_PRODUCT} SELECT org, arg_max(product, coalesce(end_year, start_year)) AS product FROM products GROUP BY org",
    "mode_first_tie": """SELECT custkey, priority, n FROM (
        SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY n DESC, first_pos) AS rn FROM (
          SELECT o_custkey AS custkey, o_orderpriority AS priority, count(*) AS n, min(o_orderkey) AS first_pos FROM orders GROUP BY ALL)) WHERE rn = 1""",
    "frequency_maps": "SELECT o_custkey AS custkey, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL",
    "dedupe_first": "SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name",
    "dedupe_last": "SELECT p_name, max(p_partkey) AS p_partkey, arg_max(p_brand, p_partkey) AS p_brand, min(p_partkey) AS first_pos FROM part GROUP BY p_name",
    "sequence_ids": """SELECT 'stm-' || lpad(row_number() OVER (ORDER BY stage, pos)::VARCHAR, 5, '0') AS id, name, stage FROM (
        SELECT 0 AS stage, r_regionkey AS pos, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation UNION ALL SELECT 2, s_suppkey, s_name FROM supplier)""",
    "next_id": "SELECT max(regexp_extract(c_name, '(\\d+)$', 1)::BIGINT) + 1 AS next_id FROM customer",
    "keep_min_id_per_key": "SELECT s_nationkey, min(s_suppkey) AS s_suppkey, arg_min(s_name, s_suppkey) AS s_name FROM supplier GROUP BY s_nationkey",
    "observation_series": """SELECT custkey, year, total, round(total - lag(total) OVER (PARTITION BY custkey ORDER BY year), 2) AS change FROM (
        SELECT o_custkey AS custkey, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)""",
    "product_in_year": f"WITH {_PRODUCT} SELECT org, product FROM products WHERE start_year <= 1998 AND coalesce(end_year, start_year) >= 1998",
    "product_changes": f"""WITH {_PRODUCT} SELECT org, year, previous, product FROM (
        SELECT org, start_year AS year, lag(product) OVER (PARTITION BY org ORDER BY start_year) AS previous, product FROM products) WHERE previous <> product""",
    "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS is_new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        n AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e)
        SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM n GROUP BY user_id, k""",
    "customer_tags": "SELECT o_custkey AS custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS tags FROM orders GROUP BY o_custkey",
}
