"""Entity tables, their union as one graph, indexes and checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes in the order in which an entity's types are tested; the others are left out of indexes.
CLASSES = ["E25", "E26", "E74", "E53", "E41", "E22", "E13"]


def entity(cls: str, uri: Column, **fields: Column) -> list[Column]:
    """Columns of an entity row: identifier, class, and the given properties as JSON (nulls are left out)."""
    body = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])) if fields else F.lit("{}")
    return [uri.alias("id"), F.lit(cls).alias("class"), body.alias("body")]


def union_all(tables: list[DataFrame]) -> DataFrame:
    """One table of all entity rows; equal rows stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def classify(types: Column) -> Column:
    """The first known class among an entity's types, null if there is none."""
    out = F.lit(None).cast("string")
    for code in reversed(CLASSES):
        out = F.when(F.exists(types, _holds(code)), F.lit(code)).otherwise(out)
    return out


def _holds(code: str) -> Callable[[Column], Column]:
    return lambda t: t.contains(code)


def class_counts(graph: DataFrame) -> DataFrame:
    """Entities by class and in all (`class` null)."""
    return graph.rollup("class").agg(F.count(F.lit(1)).alias("n"))


def names_of(preferred: Column, others: Column) -> Column:
    """The preferred name and then the others, each once, in order; nulls are left out."""
    return F.array_distinct(F.array_compact(F.concat(F.array(preferred), F.coalesce(others, F.array().cast("array<string>")))))


def collected(rows: DataFrame, key: str, value: str, pos: str, name: str) -> DataFrame:
    """`key, name`: a key's values in order of `pos`."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    return rows.groupBy(key).agg(F.transform(listed, lambda x: x["v"]).alias(name))


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`column_name, present, total, share`: how many values of each column are neither null nor blank."""
    counts = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull()).alias(c) for c in columns])
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("present")) for c in columns]))
    out = counts.select("total", listed.alias("x")).select("x.column_name", "x.present", "total")
    return out.withColumn("share", F.col("present") / F.nullif("total", F.lit(0)))


def walk_counts(edges: DataFrame, depth: int) -> DataFrame:
    """`dst, depth, n`: how many walks of each length up to `depth` end at a node. Walks are counted per node before each join."""
    walk = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    out = walk.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        walk = edges.join(walk.select(F.col("dst").alias("src"), "n"), "src").groupBy("dst").agg(F.sum("n").alias("n"))
        out = out.unionByName(walk.withColumn("depth", F.lit(d)))
    return out.select("dst", "depth", "n")


def hops(edges: DataFrame, depth: int) -> DataFrame:
    """`src, dst, depth`: the ends that walks of each length up to `depth` reach along `edges` (src, dst), each once a length.

    Repeats go after every step, so a cycle or a dense graph costs pairs of nodes, not walks.
    """
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")).distinct()
    walk = edges.select("src", "dst").distinct()
    out = walk.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        walk = walk.join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        out = out.unionByName(walk.withColumn("depth", F.lit(d)))
    return out


def tree(nodes: DataFrame, levels: int = 32) -> DataFrame:
    """`id, top, depth` of every node (id, broader) under its top node (broader null), one join a level until a level is empty.

    Nodes whose chain of broader ones ends nowhere, or in a circle, are not in the tree. A tree deeper
    than `levels` fails rather than being cut.
    """
    child = nodes.select("id", "broader").filter("broader is not null")
    level = nodes.filter("broader is null").select("id", F.col("id").alias("top"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, levels + 1):
        level = child.join(level.select(F.col("id").alias("broader"), "top"), "broader").select("id", "top", F.lit(d).alias("depth"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"a tree of more than {levels} levels")
