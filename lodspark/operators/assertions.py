"""Attaching derived assertions to records without losing manual ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(records: DataFrame, derived: DataFrame, key: str, existing: str, fresh: str, force: bool = False) -> DataFrame:
    """`records` with `existing` replaced by the list `fresh` of `derived`, and `outcome`.

    Manual lists stay unless `force`: outcome is `patched`, `skipped` (a manual list stood in the way)
    or `no match`.
    """
    joined = records.join(derived.select(key, fresh), key, "left")
    manual = F.coalesce(F.size(existing), F.lit(0)) > 0
    has = F.col(fresh).isNotNull()
    outcome = F.when(~has, "no match").when(manual & F.lit(not force), "skipped").otherwise("patched")
    return joined.withColumn("outcome", outcome).withColumn(existing, F.when(F.col("outcome") == "patched", F.col(fresh)).otherwise(F.col(existing))).drop(fresh)


def counters(outcomes: DataFrame, *by: str) -> DataFrame:
    """Records by outcome (and by `by`)."""
    return outcomes.groupBy(*by, "outcome").agg(F.count("outcome").alias("n"))


def present_in(records: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """`key, source_id, start_year`: an assertion for each record that a dated source names. `sources`: key, source_id, year; repeats count once."""
    named = sources.select(key, "source_id", "year").distinct()
    return records.select(key).distinct().join(named, key).select(key, "source_id", F.col("year").alias("start_year"))


def add_presence(assertions: Column, source: Column, year: Column, assertion_id: Column) -> Column:
    """A list with one more `present` assertion in order of start (missing first), unchanged if the source has one."""
    new = F.struct(assertion_id.alias("id"), F.lit("present").alias("status"), source.alias("source"), year.alias("start_year"), F.lit(None).cast("int").alias("end_year"))
    there = F.exists(assertions, lambda a: (a["status"] == "present") & (a["source"] == source))
    at = lambda a: F.coalesce(a["start_year"], F.lit(0))
    kept = F.filter(assertions, lambda a: at(a) <= F.coalesce(year, F.lit(0)))
    rest = F.filter(assertions, lambda a: at(a) > F.coalesce(year, F.lit(0)))
    return F.when(there, assertions).otherwise(F.concat(kept, F.array(new), rest))


def effective_district(rows: DataFrame, key: str, value: str, current: str, year: str, pos: str) -> DataFrame:
    """`key, value`: the assertion marked current, else that of the latest source year, else the first."""
    rank = F.struct(F.coalesce(F.col(current), F.lit(False)).alias("c"), F.coalesce(F.col(year), F.lit(-1)).alias("y"), (-F.col(pos)).alias("p"))
    return rows.groupBy(key).agg(F.max_by(value, rank).alias(value))


def one_current(assertions: Column, chosen: Column) -> Column:
    """Assertions of which only the one with this id is current; without it the first is."""
    known = F.exists(assertions, lambda a: a["id"] == chosen)
    target = F.when(known, chosen).otherwise(F.get(assertions, F.lit(0))["id"])
    return F.transform(assertions, lambda a: a.withField("isCurrent", a["id"] == target))


def normalized_status(assertions: Column) -> Column:
    """Status assertions with blanks dropped and unknown values as `unknown`."""
    known = ["planned", "built", "abandoned", "reactivated", "present", "unknown"]
    kept = F.filter(assertions, lambda a: F.coalesce(F.trim(a["status"]), F.lit("")) != "")
    return F.transform(kept, lambda a: a.withField("status", F.when(a["status"].isin(known), a["status"]).otherwise(F.lit("unknown"))))


def or_legacy(assertions: Column, legacy: Column) -> Column:
    """The list, or one made of legacy fields where it is empty."""
    return F.when(F.coalesce(F.size(assertions), F.lit(0)) == 0, F.array_compact(F.array(legacy))).otherwise(assertions)
