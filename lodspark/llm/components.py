"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, scratch


def _stars(edges: DataFrame, large: bool, path: str) -> DataFrame:
    """Hang each node's larger (or smaller and own) neighbours on the least of its neighbours and itself.

    The least neighbours are written to `path` first: a join of two tables, unlike one with an
    aggregation in the same stage, lets Spark split the rows of a node with very many neighbours.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", path)
    met = both.join(least, "u")
    if large:
        return met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b")
    return met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).filter("a != b")


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """`id, comp`: for each node of `edges` (a, b of one orderable type) the least node of its component.

    Each round is two joins by node; no list of neighbours is ever one row, and nothing but two
    numbers a round reaches the driver. Rounds go on until one changes nothing, however many that
    takes; they grow with the logarithm of the longest chain. Null nodes and edges of a node to
    itself take no part. The edges that the result reads lie in `folder` (a shared one by default).
    """
    spark = edges.sparkSession
    place = lambda: f"{folder}/edges-{uuid.uuid4().hex}" if folder else scratch(spark, "edges")
    path = place()
    now = saved(edges.select("a", "b").filter("a != b").distinct(), "edges", path)
    seen = None
    while True:
        state = now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if state == seen or not state[0]:
            break
        seen = state
        fresh, hung, *least = (place() for _ in range(4))
        stars = saved(_stars(now, True, least[0]).distinct(), "edges", hung)
        now = saved(_stars(stars, False, least[1]).distinct(), "edges", fresh)
        for done in (path, hung, *least):
            discard(spark, done)
        path = fresh
    return now.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(now.select("b", "b")).distinct()
