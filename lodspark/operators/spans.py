"""Dated spans from yearly observations: runs of equal state with small gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Years between two observations of one span at most: one missing year is bridged.
MAX_STEP = 2


def islands(rows: DataFrame, key: str, state: str, year: str, max_step: int = MAX_STEP) -> DataFrame:
    """`key, state, start, stop`: runs of consecutive rows of a key with one state and steps of at most `max_step` years."""
    order = W.partitionBy(key).orderBy(year)
    new = F.coalesce((F.lag(state).over(order) != F.col(state)) | (F.col(year) - F.lag(year).over(order) > max_step), F.lit(True))
    numbered = rows.withColumn("island", F.sum(new.cast("int")).over(order))
    return numbered.groupBy(key, "island", F.col(state)).agg(F.min(year).alias("start"), F.max(year).alias("stop")).drop("island")


def lifecycle_spans(obs: DataFrame, max_step: int = MAX_STEP) -> DataFrame:
    """`org, status, start_year, end_year` from `org, year, product, abandoned`.

    A year is abandoned if any of its rows is, else active if any row has a product, else neutral;
    neutral years are left out. The first active span says `built` once, unless an abandoned span
    came before; every active span after an abandoned one says `reactivated`. Only abandoned spans
    have an end, and only if it is another year. Rows without org or year are left out.
    """
    rank = F.max(F.when(F.col("abandoned"), 2).when(F.coalesce(F.trim("product"), F.lit("")) != "", 1).otherwise(0))
    years = obs.filter("org is not null and year is not null").groupBy("org", "year").agg(rank.alias("state")).filter("state > 0")
    spans = islands(years, "org", "state", "year", max_step)
    before = W.partitionBy("org").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("was_abandoned", F.coalesce(F.max(F.col("state") == 2).over(before), F.lit(False)))
    spans = spans.withColumn("was_active", F.coalesce(F.max(F.col("state") == 1).over(before), F.lit(False)))
    active = F.col("state") == 1
    status = F.when(~active, "abandoned").when(F.col("was_abandoned"), "reactivated").when(~F.col("was_active"), "built")
    end = F.when(~active & (F.col("stop") != F.col("start")), F.col("stop"))
    return spans.select("org", status.alias("status"), F.col("start").alias("start_year"), end.alias("end_year")).filter("status is not null")


def product_spans(obs: DataFrame, max_step: int = MAX_STEP) -> DataFrame:
    """`org, product, start_year, end_year` from `org, year, product, abandoned, pos`.

    A year's product is that of its first row (by `pos`) that has one and is not abandoned; any change
    of product, or a larger gap, ends a span. `end_year` is null for one-year spans.
    """
    used = obs.filter("org is not null and year is not null and not abandoned").filter(F.trim("product") != "")
    first = used.groupBy("org", "year").agg(F.min_by("product", "pos").alias("product"))
    spans = islands(first, "org", "product", "year", max_step)
    return spans.select("org", "product", F.col("start").alias("start_year"), F.when(F.col("stop") != F.col("start"), F.col("stop")).alias("end_year"))


def timeline(status: DataFrame, products: DataFrame) -> DataFrame:
    """`org, kind, value, start_year, end_year, seq`: both kinds of spans in order of start, missing last."""
    both = status.select("org", F.lit("status").alias("kind"), F.col("status").alias("value"), "start_year", "end_year").unionByName(products.select("org", F.lit("product").alias("kind"), F.col("product").alias("value"), "start_year", "end_year"))
    return both.withColumn("seq", F.row_number().over(W.partitionBy("org").orderBy(F.asc_nulls_last("start_year"), "kind", "value")))


def mention_range(spans: DataFrame) -> DataFrame:
    """`org, first_year, last_year` over all spans; 0 counts as missing."""
    start, end = F.nullif("start_year", F.lit(0)), F.nullif("end_year", F.lit(0))
    return spans.groupBy("org").agg(F.min(start).alias("first_year"), F.max(F.coalesce(end, start)).alias("last_year"))


def latest(spans: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """`key, value`: the value of the span with the greatest end (or start, or 0); of equals the first by `pos`."""
    when = F.struct(F.coalesce("end_year", "start_year", F.lit(0)).alias("y"), (-F.col(pos)).alias("p"))
    return spans.groupBy(key).agg(F.max_by(value, when).alias(value))
