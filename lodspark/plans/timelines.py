"""Queries on spans that overlap and on series by year."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodspark.operators import detail, timelines

from .tables import table


def _where(s, d):
    """For how many days the lines of customers were under way while the customers held each priority."""
    o = table(s, d, "orders")
    day = lambda c: F.unix_date(F.to_date(c))
    held = detail.validity_of(o.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderpriority").alias("p")), "o_custkey", "p", "o_orderdate")
    held = held.select(F.col("src").alias("custkey"), F.col("dst").alias("priority"), day("valid_from").alias("a_from"), day("valid_to").alias("a_until"))
    lines = table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select(F.col("o_custkey").alias("custkey"), "l_linenumber", day("l_shipdate").alias("b_from"), (day("l_shipdate") + F.col("l_quantity").cast("int")).alias("b_until"))
    met = timelines.overlaps(held, lines, ["custkey"])
    return met.groupBy("custkey", "priority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("until") - F.col("from")).alias("days"), F.min("from").alias("first_day"))


def _counts(s, d):
    """Thousands of a customer's orders in a year, as the number of people that an organization reports."""
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.groupBy(F.col("c_nationkey").alias("place"), F.col("o_custkey").alias("org"), F.year("o_orderdate").alias("year")).agg(F.sum(F.floor(F.col("o_totalprice") / 1000).cast("long")).alias("people"))
    # Some years aren't reported.
    return rows.filter((F.col("org") + F.col("year")) % 3 != 0)


def _by_year(limit):
    return lambda s, d: timelines.by_year(_counts(s, d), "place", ["org"], "year", "people", limit)


def _series(s, d):
    return timelines.carried(_counts(s, d), ["place", "org"], "year", "people", 2, 2001)


QUERIES = {"who_was_where": _where, "enslaved_by_year": _by_year(0), "carried_by_year": _by_year(2), "carried_series": _series}

_COUNTS = """r AS (SELECT c_nationkey AS place, o_custkey AS org, year(o_orderdate)::INT AS year, sum(floor(o_totalprice / 1000)::BIGINT)::BIGINT AS people
          FROM orders JOIN customer ON c_custkey = o_custkey WHERE (o_custkey + year(o_orderdate)) % 3 <> 0 GROUP BY ALL),
        b AS (SELECT min(year) AS low, max(year) AS high FROM r), y AS (SELECT unnest(range(low, high + 1))::INT AS yr FROM b)"""


def _year_sql(limit: int) -> str:
    return f"""WITH {_COUNTS},
        c AS (SELECT place, yr, people, year = yr AS own FROM r JOIN y ON yr BETWEEN year AND year + {limit}
              WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.place = r.place AND x.org = r.org AND x.year > r.year AND x.year <= yr)),
        p AS (SELECT DISTINCT place FROM r), s AS (SELECT p.place, y.yr AS year, coalesce(sum(people), 0)::BIGINT AS total, count(*) FILTER (own) AS n_reported, count(*) FILTER (NOT own) AS n_carried
              FROM p CROSS JOIN y LEFT JOIN c ON c.place = p.place AND c.yr = y.yr GROUP BY ALL)
        SELECT *, total - lag(total) OVER (PARTITION BY place ORDER BY year) AS change FROM s"""


SQL = {
    "who_was_where": """WITH e AS (SELECT o_custkey AS src, o_orderdate AS valid_from, min(o_orderpriority) AS dst FROM orders GROUP BY ALL),
        c AS (SELECT * FROM (SELECT *, lag(dst) OVER (PARTITION BY src ORDER BY valid_from) AS before FROM e) WHERE before IS NULL OR before <> dst),
        v AS (SELECT src, dst, date_diff('day', DATE '1970-01-01', valid_from::DATE) AS f, coalesce(date_diff('day', DATE '1970-01-01', (lead(valid_from) OVER (PARTITION BY src ORDER BY valid_from))::DATE), 1000000) AS u FROM c),
        l AS (SELECT o_custkey, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS f, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::INT AS u FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
        SELECT src AS custkey, dst AS priority, count(*) AS n, sum(least(v.u, l.u) - greatest(v.f, l.f))::BIGINT AS days, min(greatest(v.f, l.f)) AS first_day
        FROM v JOIN l ON src = o_custkey AND v.f < l.u AND l.f < v.u GROUP BY src, dst""",
    "enslaved_by_year": _year_sql(0),
    "carried_by_year": _year_sql(2),
    "carried_series": f"""WITH {_COUNTS} SELECT place, org, yr AS year, people, yr > year AS carried FROM r JOIN (SELECT unnest(range(1900, 2002))::INT AS yr) ON yr BETWEEN year AND year + 2
        WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.place = r.place AND x.org = r.org AND x.year > r.year AND x.year <= yr)""",
}
