"""What stands around entities: nodes and edges by bounded expansion, the best neighbours of each relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts in which a hub's best neighbours are looked for first.
LOTS = 64


def best(rows: DataFrame, keys: list[str], order: list[Column], k: int, lot: Column) -> DataFrame:
    """The first `k` rows of each key by `order`, with `place` from 1.

    In two stages: each of a key's LOTS lots keeps its own first `k`, and only these meet; a hub's rows are
    never one group. `lot` is hashed to deal rows.
    """
    dealt = rows.withColumn("lot", F.pmod(F.xxhash64(lot), F.lit(LOTS)))
    for by in ([*keys, "lot"], keys):
        dealt = dealt.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)
    return dealt.drop("lot")


def expand(start: DataFrame, relations: dict[str, tuple[DataFrame, int]], steps: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around every start node (column `id`), all of them at once.

    Relations: name to a table `src, dst, rank` (least first, ties by dst) and the number of neighbours
    that a node keeps of it. Steps: the relations that are followed from the nodes of the step before.
    Nodes: `root, id, depth` (where a node was met first); edges: `root, relation, src, dst, place`.
    Relations are cut to their best neighbours before anything follows them, so a node has no more
    than the sum of its relations' numbers whatever its degree. Nulls are left out, repeats count once.
    """
    cut = {name: best(t.filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("rank").alias("rank")), ["src"], [F.col("rank").asc_nulls_last(), F.col("dst")], k, F.col("dst")) for name, (t, k) in relations.items()}
    front = start.select(F.col("id").alias("root"), "id").filter("id is not null").distinct()
    nodes, edges = front.withColumn("depth", F.lit(0)), []
    for depth, names in enumerate(steps, 1):
        found = [front.join(cut[n].withColumnRenamed("src", "id"), "id").select("root", F.lit(n).alias("relation"), F.col("id").alias("src"), "dst", "place") for n in names]
        edges += found
        front = reduce(DataFrame.unionByName, found).select("root", F.col("dst").alias("id")).distinct()
        nodes = nodes.unionByName(front.withColumn("depth", F.lit(depth)))
    return nodes.groupBy("root", "id").agg(F.min("depth").alias("depth")), reduce(DataFrame.unionByName, edges).distinct()
