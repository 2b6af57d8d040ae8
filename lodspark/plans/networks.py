"""Queries on successors, ancestors and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodspark.operators import neighbourhood, succession

from .tables import table


def _successors(s, d):
    """Customers of low balance as dissolved organizations: each went to the one of half its number, some in equal parts to the next one as well."""
    c = table(s, d, "customer").filter("c_acctbal < 5000 and c_custkey > 2").select(F.col("c_custkey").alias("src"), "c_mktsegment")
    half = F.floor(F.col("src") / 2).cast("long")
    dst = F.when(F.col("c_mktsegment") == "BUILDING", F.array(half, half + 1)).otherwise(F.array(half))
    return succession.final_successors(c.select("src", F.explode(dst).alias("dst")))


def _ancestors(s, d):
    """Customers as persons: one parent has half the number, and every fifth a second one a third of it."""
    c = table(s, d, "customer").filter("c_custkey > 1").select(F.col("c_custkey").alias("child"))
    third = F.when(F.col("child") % 5 == 0, F.floor(F.col("child") / 3).cast("long"))
    pairs = c.select("child", F.explode(F.array_compact(F.array(F.floor(F.col("child") / 2).cast("long"), third))).alias("parent"))
    found = succession.ancestors(pairs)
    return found.select("child", "ancestor", "generation", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def _neighbours(s, d):
    """Around every customer: the four latest orders and the nation, and the three richest suppliers of that nation."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o, c, v = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "supplier")
    relations = {
        "observed": (o.select(text("c", "o_custkey").alias("src"), text("o", "o_orderkey").alias("dst"), (-F.unix_date(F.to_date("o_orderdate")).cast("double")).alias("rank")), 4),
        "at": (c.select(text("c", "c_custkey").alias("src"), text("n", "c_nationkey").alias("dst"), F.lit(0.0).alias("rank")), 1),
        "holds": (v.select(text("n", "s_nationkey").alias("src"), text("s", "s_suppkey").alias("dst"), (-F.col("s_acctbal")).alias("rank")), 3),
    }
    return neighbourhood.expand(c.select(text("c", "c_custkey").alias("id")), relations, [["observed", "at"], ["holds"]])[1]


QUERIES = {"entity_neighbours": _neighbours, "successors": _successors, "ancestors": _ancestors}

SQL = {
    "entity_neighbours": """WITH o AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 'o' || o_orderkey)::INT AS place FROM orders),
        v AS (SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, 's' || s_suppkey)::INT AS place FROM supplier)
        SELECT src AS root, 'observed' AS relation, src, dst, place FROM o WHERE place <= 4 AND src IN (SELECT 'c' || c_custkey FROM customer)
        UNION ALL SELECT 'c' || c_custkey, 'at', 'c' || c_custkey, 'n' || c_nationkey, 1 FROM customer
        UNION ALL SELECT 'c' || c_custkey, 'holds', src, dst, place FROM customer JOIN v ON src = 'n' || c_nationkey WHERE place <= 3""",
    "successors": """WITH RECURSIVE p AS (
          SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_acctbal < 5000 AND c_custkey > 2
          UNION ALL SELECT c_custkey, c_custkey // 2 + 1 FROM customer WHERE c_acctbal < 5000 AND c_custkey > 2 AND c_mktsegment = 'BUILDING'),
        e AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM p),
        w AS (SELECT src, dst, share, 1::BIGINT AS steps FROM e UNION ALL SELECT w.src, e.dst, w.share * e.share, w.steps + 1 FROM w JOIN e ON e.src = w.dst)
        SELECT src, dst, sum(share) AS share, max(steps) AS steps FROM w WHERE dst NOT IN (SELECT src FROM e) GROUP BY src, dst""",
    "ancestors": """WITH RECURSIVE e AS (
          SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 1
          UNION SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey > 1 AND c_custkey % 5 = 0),
        w AS (SELECT child, parent AS ancestor, 1 AS generation, [parent] AS path FROM e UNION ALL SELECT w.child, e.parent, generation + 1, list_append(path, e.parent) FROM w JOIN e ON e.child = w.ancestor)
        SELECT child, ancestor, min(generation) AS generation, array_to_string(min({'g': generation, 'p': path}).p, '>') AS path FROM w GROUP BY child, ancestor""",
}
