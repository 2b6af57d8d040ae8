"""What became of merged and split organizations, and who descends from whom: walks along edges to their ends."""

from __future__ import annotations

import math
from contextlib import ExitStack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import remove, shared_path, workspace, written

#: Shares of an organization below this are those of rounding in circles that leak.
LEAST_SHARE = 1e-12


def final_successors(edges: DataFrame) -> DataFrame:
    """`src, dst, share, steps`: the organizations that each merged or split one ended up in, what share of it, and over how many steps at most.

    Edges: src, dst and, if there is one, weight (a split's parts; parallel edges add up, and an
    organization's weights are shares of their sum; null, 0 and less count as no edge). An end has no
    edges of its own. What goes round in a circle for ever is a row with null dst and null steps.
    Edges without src or dst are left out; without edges there are no rows.

    Pointers are doubled: a round joins what 2**k steps reach with itself, so chains of n links take
    log2(n) rounds, and after log2 of all organizations only circles are left. Every round is a table.
    """
    spark = edges.sparkSession
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    with workspace(spark, "successors") as folder:
        e = edges.select("src", "dst", weight.alias("w")).filter("src is not null and dst is not null and w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))
        total = e.groupBy("src").agg(F.sum("w").alias("total"))
        e = e.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share"), F.lit(1).cast("long").alias("steps"))
        on = total.select(F.col("src").alias("dst"), F.lit(True).alias("on"))
        reach = written(e.join(on, "dst", "left").select("src", "dst", "share", "steps", F.coalesce("on", F.lit(False)).alias("on")), f"{folder}/0")
        rounds = math.ceil(math.log2(reach.select("src").distinct().count() + 1))
        for k in range(1, rounds + 1):
            if reach.filter("on").isEmpty():
                break
            hop = reach.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("share").alias("part"), F.col("steps").alias("more"), F.col("on").alias("still"))
            further = reach.filter("on").join(hop, F.col("dst") == F.col("mid")).select("src", F.col("to").alias("dst"), (F.col("share") * F.col("part")).alias("share"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("on"))
            both = reach.filter("not on").unionByName(further)
            reach = written(both.groupBy("src", "dst", "on").agg(F.sum("share").alias("share"), F.max("steps").alias("steps")).select("src", "dst", "share", "steps", "on"), f"{folder}/{k}")
        circles = reach.filter("on").groupBy("src").agg(F.sum("share").alias("share")).filter(F.col("share") > LEAST_SHARE)
        ends = reach.filter("not on").select("src", "dst", "share", "steps")
        return written(ends.unionByName(circles, allowMissingColumns=True), shared_path(spark, "successor-table"))


def ancestors(parents: DataFrame, most: int | None = None) -> DataFrame:
    """`child, ancestor, generation, path`: everyone above each child, by the fewest generations, over the least of those paths.

    Parents: child, parent; nulls are left out, repeats count once. `path` names everyone from the
    child's parent to the ancestor. A child that is its own ancestor is in a circle: it has a row with
    itself, and everyone on the circle is named once. `most` stops after so many generations.

    Semi-naive: a round extends only the pairs that the round before found, and keeps those that were not
    known, so it ends in circles too; it costs new pairs, not all paths. Every round is a table, and these
    tables are the result: it is not written again.
    """
    spark = parents.sparkSession
    table = shared_path(spark, "ancestor-table")
    with workspace(spark, "ancestors") as folder, ExitStack() as undo:
        undo.callback(remove, spark, table)
        e = written(parents.select("child", "parent").filter("child is not null and parent is not null").distinct(), f"{folder}/edges")
        new = written(e.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("generation"), F.array("parent").alias("path")), f"{table}/1")
        known, k = new, 1
        up = e.select(F.col("child").alias("ancestor"), "parent")
        while (most is None or k < most) and not new.isEmpty():
            k += 1
            # In a circle nobody is above themselves more than once.
            further = new.filter(F.col("child") != F.col("ancestor")).join(up, "ancestor").groupBy("child", F.col("parent").alias("next")).agg(F.min("path").alias("path"))
            further = further.select("child", F.col("next").alias("ancestor"), F.lit(k).alias("generation"), F.concat("path", F.array("next")).alias("path"))
            new = written(further.join(known.select("child", "ancestor"), ["child", "ancestor"], "left_anti"), f"{table}/{k}")
            known = spark.read.schema(new.schema).parquet(*[f"{table}/{j}" for j in range(1, k + 1)])
        undo.pop_all()
        return known
