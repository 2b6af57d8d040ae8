"""Lookups with several keys, ambiguity and set operations on keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_keys(rows: DataFrame, lookup: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """`rows` with `value` by the first key, else by the second. `lookup` has both keys, `value` and `pos`; the last row of a key wins."""
    one = lookup.filter(F.col(first).isNotNull()).groupBy(first).agg(F.max_by(value, "pos").alias("v1"))
    two = lookup.filter(F.col(second).isNotNull()).groupBy(second).agg(F.max_by(value, "pos").alias("v2"))
    return rows.join(one, first, "left").join(two, second, "left").withColumn(value, F.coalesce("v1", "v2")).drop("v1", "v2")


def any_key(rows: DataFrame, keys: list[Column], wanted: DataFrame, pos: str) -> DataFrame:
    """`wanted` (key) with the first row, by `pos`, that has the key among its keys. Keys are exploded, so the join stays an equi-join."""
    exploded = rows.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))))
    met = wanted.join(exploded, "key")
    return met.groupBy("key").agg(F.min_by(F.struct(*rows.columns), F.col(pos)).alias("r")).select("key", "r.*")


def ambiguous(items: DataFrame, known: DataFrame, keys: list[str], target: str) -> DataFrame:
    """`items` with `match` and `outcome`: the one known row with an equal key, key by key; several are a conflict, none an insert."""
    out = items.withColumn("match", F.lit(None).cast(dict(known.dtypes)[target])).withColumn("clash", F.lit(False))
    for k in keys:
        found = known.filter(F.col(k).isNotNull()).groupBy(k).agg(F.count(k).alias("n_found"), F.min(target).alias("found"))
        out = out.join(found, k, "left")
        unique = F.col("match").isNull() & ~F.col("clash") & (F.coalesce("n_found", F.lit(0)) == 1)
        many = F.col("match").isNull() & (F.coalesce("n_found", F.lit(0)) > 1)
        out = out.withColumn("clash", F.col("clash") | many).withColumn("match", F.when(unique, F.col("found")).otherwise(F.col("match"))).drop("n_found", "found")
    outcome = F.when(F.col("match").isNotNull(), "update").when(F.col("clash"), "conflict").otherwise("insert")
    return out.withColumn("outcome", outcome).drop("clash")


def keyed_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both tables, each key once; of equals the one of `a` wins."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    return both.groupBy(key).agg(F.min_by(F.struct(*a.columns), F.col("side")).alias("r")).select("r.*")


def origin(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """`key, name, origin`: names of both tables by their trimmed lower-case form, from `a`, `b` or `both`."""
    one = a.groupBy(F.lower(F.trim(name)).alias("key")).agg(F.min(name).alias("a_name"))
    two = b.groupBy(F.lower(F.trim(name)).alias("key")).agg(F.min(name).alias("b_name"))
    side = F.when(F.col("b_name").isNull(), "a").when(F.col("a_name").isNull(), "b").otherwise("both")
    return one.join(two, "key", "full").select("key", F.coalesce("a_name", "b_name").alias(name), side.alias("origin"))


def drop_if_known(rows: DataFrame, condition: Column, label: str, known: DataFrame) -> DataFrame:
    """`rows` without those that meet the condition and whose lower-case label is among `known` (label)."""
    keys = known.select(F.lower(label).alias("known_label")).distinct()
    marked = rows.join(keys, F.lower(rows[label]) == F.col("known_label"), "left")
    return marked.filter(~(condition & F.col("known_label").isNotNull())).drop("known_label")


def union_distinct(a: Column, b: Column, excluded: Column | None = None) -> Column:
    """Values of both lists in order, once, without the excluded."""
    out = F.array_union(a, b)
    return F.array_except(out, excluded) if excluded is not None else out


def default_lookup(rows: DataFrame, lookup: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """`rows` with the looked-up value or a default."""
    return rows.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))
