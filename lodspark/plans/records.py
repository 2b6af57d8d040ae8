"""Queries on histories of records and on the index to search them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodspark.operators import store
from lodspark.operators.changelog import ChangeLog
from lodspark.operators.scratch import shared_path, workspace, written
from lodspark.operators.searchindex import TrigramIndex

from .tables import table


def _states(s, d):
    """Customers as records: added, relabelled by their orders, some removed; each version's records, and what became of the requests for it."""
    c = table(s, d, "customer")
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    with workspace(s, "records") as folder:
        log = ChangeLog(s, f"{folder}/log", "id long, label string, size long, kind string")
        log.write(c.select(F.col("c_custkey").alias("id"), F.array(F.lit("label"), F.lit("kind")).alias("fields"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("kind")), 0)
        log.write(o.select("id", F.array(F.lit("size"), F.lit("kind")).alias("fields"), F.col("n").alias("size"), F.when(F.col("n") > 9, "busy").alias("kind")), 1)
        log.compact()
        # Written on the first version: fields that the second has set meanwhile are refused.
        third = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, F.lit(None)).when(F.col("c_acctbal") < 5000, F.array(F.lit("label"))).otherwise(F.array(F.lit("kind"))).alias("fields"), F.lit("x").alias("label"), F.lit("y").alias("kind"))
        _, told = log.write(third, 1)
        told = written(told, f"{folder}/told")
        versions = [log.read(v).select(F.lit(v).alias("version"), F.lit("record").alias("what"), "id", "label", "size", "kind") for v in (1, 2, 3)]
        said = told.select(F.lit(3).alias("version"), F.lit("status").alias("what"), "id", F.col("status").alias("label"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("kind"))
        return written(versions[0].unionByName(versions[1]).unionByName(versions[2]).unionByName(said), shared_path(s, "record-states"))


def _search(s, d):
    """Parts in two segments of an index, searched for pieces of their own names, types and brands."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name", F.array("p_type", "p_brand").alias("tags"))
    queries = table(s, d, "part").select(F.explode(F.array(F.substring("p_name", 3, 5), F.concat(F.lit("#"), F.substring("p_brand", 7, 9)), F.substring("p_type", 1, 2), F.upper(F.substring("p_name", 1, 4)))).alias("query"))
    with workspace(s, "search") as folder:
        index = TrigramIndex(s, f"{folder}/index", ["p_name", "tags"])
        index.append(p.filter("id % 3 = 0"), "id")
        index.append(p.filter("id % 3 <> 0"), "id")
        return written(index.search(queries), shared_path(s, "search-result"))


def _patched_sources(s, d):
    """Suppliers as sources, customers as requests to change them; and concepts of brands that parts ask to add."""
    sources = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_nationkey").cast("string").alias("category"), F.lit(None).cast("string").alias("modified_by"))
    c = table(s, d, "customer")
    asked = c.select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("id"), F.when(F.col("c_acctbal") < 0, F.array(F.lit("id"))).otherwise(F.array(F.lit("label"), F.lit("kind"))).alias("has"), F.upper("c_mktsegment").alias("label"), F.lit("z").alias("category"), F.lit("me").alias("actor"), F.lit("t").alias("at"))
    new, told = store.patch_rows(sources, asked, "id", ["label", "category"])
    told = told.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("status")), ",").alias("statuses"))
    return new.join(told, "id", "full").select("id", "label", "category", "modified_by", "statuses")


def _created(s, d):
    """Concepts of segments, and brands and types of parts that are asked for: outcomes by type."""
    concepts = table(s, d, "customer").select(F.col("c_mktsegment").alias("type")).distinct().withColumns({"labels": F.create_map(F.lit("en"), "type"), "sort_order": F.lit(1)})
    p = table(s, d, "part")
    wanted = F.explode(F.array("p_brand", F.when(F.col("p_size") > 40, F.lit("BUILDING")).otherwise(F.col("p_type"))))
    asked = p.select(wanted.alias("type"), F.create_map(F.when(F.col("p_size") > 2, "en").otherwise("nl"), F.col("p_name")).alias("labels"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("at"))
    new, told = store.create_concepts(concepts, asked)
    told = told.groupBy("type").agg(*[F.count_if(F.col("status") == x).alias(f"n_{x}") for x in ("201", "400", "409")])
    return told.join(new.select("type", F.col("labels")["en"].alias("label"), "sort_order"), "type", "full").select("type", "label", "sort_order", "n_201", "n_400", "n_409")


QUERIES = {"patch_sources": _patched_sources, "create_concepts": _created, "record_states": _states, "indexed_search": _search}

SQL = {
    "patch_sources": """WITH a AS (SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS id, c_acctbal >= 0 AS fit, upper(c_mktsegment) AS label FROM customer),
        t AS (SELECT a.id, string_agg(CASE WHEN a.id IS NULL OR NOT fit THEN '400' WHEN s_suppkey IS NULL THEN '404' ELSE '200' END, ',' ORDER BY CASE WHEN a.id IS NULL OR NOT fit THEN '400' WHEN s_suppkey IS NULL THEN '404' ELSE '200' END) AS statuses FROM a LEFT JOIN supplier ON s_suppkey = a.id GROUP BY a.id)
        SELECT coalesce(s_suppkey, t.id) AS id, coalesce((SELECT label FROM a WHERE a.id = s_suppkey AND fit), s_name) AS label, s_nationkey::VARCHAR AS category, CASE WHEN (SELECT count(*) FROM a WHERE a.id = s_suppkey AND fit) > 0 THEN 'me' END AS modified_by, statuses
        FROM supplier FULL JOIN t ON t.id = s_suppkey""",
    "create_concepts": """WITH c AS (SELECT DISTINCT c_mktsegment AS type FROM customer), r AS (SELECT unnest([p_brand, CASE WHEN p_size > 40 THEN 'BUILDING' ELSE p_type END]) AS type, p_size > 2 AS fit, p_name, p_partkey FROM part),
        g AS (SELECT type, count(*) FILTER (fit) AS fits, count(*) FILTER (NOT fit) AS n_400, arg_min(p_name, p_partkey) FILTER (fit) AS name FROM r GROUP BY type)
        SELECT coalesce(g.type, c.type) AS type, CASE WHEN c.type IS NOT NULL THEN c.type WHEN fits > 0 THEN name END AS label, CASE WHEN c.type IS NOT NULL THEN 1 WHEN fits > 0 THEN 99 END::INT AS sort_order,
          CASE WHEN g.type IS NOT NULL THEN (c.type IS NULL AND fits > 0)::BIGINT END AS n_201, n_400, CASE WHEN g.type IS NOT NULL THEN fits - (c.type IS NULL AND fits > 0)::BIGINT END AS n_409
        FROM g FULL JOIN c ON c.type = g.type""",
    "indexed_search": """WITH q AS (SELECT DISTINCT trim(q) AS query FROM (SELECT unnest([p_name[3:7], '#' || p_brand[7:], p_type[1:2], upper(p_name[1:4])]) AS q FROM part) WHERE trim(q) <> '')
        SELECT query, p_partkey AS id FROM part JOIN q ON contains(lower(p_name), lower(query)) OR contains(lower(p_type), lower(query)) OR contains(lower(p_brand), lower(query))""",
    "record_states": """WITH o AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1),
        one AS (SELECT c_custkey AS id, c_name AS label, NULL::BIGINT AS size, c_mktsegment AS kind, c_acctbal AS b FROM customer),
        two AS (SELECT coalesce(one.id, o.id) AS id, label, n AS size, CASE WHEN o.id IS NULL THEN kind WHEN n > 9 THEN 'busy' END AS kind, b, o.id IS NOT NULL AS touched FROM one FULL JOIN o ON o.id = one.id),
        j AS (SELECT two.*, CASE WHEN b IS NULL THEN NULL WHEN touched AND (b < 0 OR b >= 5000) THEN '409' ELSE '200' END AS status FROM two)
        SELECT 1 AS version, 'record' AS what, id, label, size, kind FROM one UNION ALL SELECT 2, 'record', id, label, size, kind FROM two
        UNION ALL SELECT 3, 'record', id, CASE WHEN status = '200' AND b >= 0 AND b < 5000 THEN 'x' ELSE label END, size, CASE WHEN status = '200' AND b >= 5000 THEN 'y' ELSE kind END FROM j WHERE NOT coalesce(status = '200' AND b < 0, FALSE)
        UNION ALL SELECT 3, 'status', id, status, NULL, NULL FROM j WHERE status IS NOT NULL""",
}
