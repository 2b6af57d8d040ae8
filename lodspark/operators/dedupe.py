"""First and last wins, modes with ties, sequences and unique keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written


def first_wins(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One row a key: the first by `pos`."""
    packed = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.col(pos)).alias("r"))
    return packed.select("r.*")


def last_wins(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One row a key: the values of the last by `pos` at the place of the first, as a map that is written again keeps it."""
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col(pos)).alias("r"), F.min(pos).alias("first_pos"))
    return packed.select("r.*", "first_pos")


def mode_first(rows: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """`key, value, n`: the most frequent value; of equals the one met first. Nulls and blanks do not count."""
    counts = rows.filter(F.coalesce(F.col(value).cast("string"), F.lit("")) != "").groupBy(key, value).agg(F.count(value).alias("n"), F.min(pos).alias("at"))
    rank = F.struct("n", (-F.col("at")).alias("late"))
    return counts.groupBy(key).agg(F.max_by(value, rank).alias(value), F.max("n").alias("n"))


def unique_slugs(rows: DataFrame, slug: Column, suffix: Column, pos: str) -> DataFrame:
    """`rows` with `slug`: the first of equal slugs keeps it, later ones get the suffix."""
    rows = rows.withColumn("slug", slug)
    again = F.row_number().over(W.partitionBy("slug").orderBy(pos)) > 1
    return rows.withColumn("slug", F.when(again, F.concat_ws("-", "slug", suffix)).otherwise(F.col("slug")))


def in_sequence(stages: list[DataFrame], pos: str = "pos", path: str | None = None) -> DataFrame:
    """The stages' rows, one after the other, with `stage` (from 0) and `seq` from 1 on; columns of these names are replaced, all others stay.

    Numbers come from ranges of (stage, pos): each range is counted, and a row's number is the count of
    the ranges before it plus its place in its own, so no single task holds all rows. Rows without a
    position come first in their stage, and equal positions follow each other, by a hash of the row.
    Rows are read twice: with `path` they are written there first, so what is before them runs once.
    """
    rows = reduce(DataFrame.unionByName, [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)])
    own = [f for f in rows.schema.fields if f.name not in ("stage", "seq")]
    tie = F.xxhash64("stage", *[f.name for f in own if "map<" not in f.dataType.simpleString()])
    # The row is one value from here on, so none of its columns meets one of the numbering's.
    rows = rows.select("stage", F.struct(*[f.name for f in own]).alias("row"), F.col(pos).isNotNull().alias("placed"), tie.alias("tie"))
    part = F.when(F.col("placed"), F.floor(F.col(f"row.{pos}") / 65536)).otherwise(F.shiftright("tie", 54))
    rows = rows.withColumn("part", part)
    rows = rows if path is None else written(rows, path)
    keys = ["stage", "placed", "part"]
    sizes = rows.groupBy(*keys).agg(F.count("stage").alias("size"))
    # One row for 65536 rows.
    sizes = sizes.select(*keys, (F.sum("size").over(W.orderBy(*keys)) - F.col("size")).alias("before"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(f"row.{pos}", "tie"))
    return rows.join(sizes, keys).select("row.*", "stage", (F.col("before") + place).alias("seq"))


def next_number(rows: DataFrame, column: str) -> DataFrame:
    """`next_id`: one more than the largest number that ids end with; 1 without ids."""
    n = F.regexp_extract(column, r"(\d+)$", 1).try_cast("long")
    return rows.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_id"))
