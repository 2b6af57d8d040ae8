"""Resolving two records of one place into one, and completing a record's names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodspark.functions.text import normalize_label

_NAME = "array<struct<text:string,language:string,type:string,is_preferred:boolean,source:string,source_year:int>>"


def _picked(field: str, sides: Column) -> Column:
    """The field of the side that the resolution names; of the first side without a word."""
    b = F.coalesce(F.try_element_at(sides, F.lit(field)), F.lit("a")) == "b"
    return F.when(b, F.col(f"b.{field}")).otherwise(F.col(f"a.{field}"))


def by_key(items: Column, key) -> Column:
    """The list without later items of a key that was there before; items whose key is null stay."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.coalesce(F.array_position(keys, key(x)) == i + 1, F.lit(True)))


def resolve(pairs: DataFrame, scalars: list[str], excluded_sources: Column | None = None) -> DataFrame:
    """One record a pair of structs `a` and `b`, with `sides` (field -> a or b): picked scalars, united sources, links, notes and assertions.

    Links are one an authority and identifier, the first wins; equal notes are one; assertions of both
    sides all stay. Names come from both sides, matched by trimmed lower-case text.
    """
    sources = F.array_union(F.coalesce("a.sources", F.array().cast("array<string>")), F.coalesce("b.sources", F.array().cast("array<string>")))
    if excluded_sources is not None:
        sources = F.array_except(sources, excluded_sources)
    both = lambda f: F.concat(F.coalesce(f"a.{f}", F.slice(F.coalesce(f"b.{f}", f"a.{f}"), 1, 0)), F.coalesce(f"b.{f}", F.slice(F.coalesce(f"a.{f}", f"b.{f}"), 1, 0)))
    links = by_key(both("links"), lambda x: F.concat_ws(":", x["authority"], x["identifier"]))
    names = by_key(both("names"), lambda x: F.lower(F.trim(x["text"])))
    return pairs.select(F.col("a.id").alias("id"), F.col("b.id").alias("retired"), *[_picked(s, F.col("sides")).alias(s) for s in scalars], sources.alias("sources"), links.alias("links"), one_preferred(names).alias("names"), F.array_distinct(both("notes")).alias("notes"), both("assertions").alias("assertions"))


def one_preferred(names: Column, chosen: Column | None = None) -> Column:
    """Names of which exactly one is preferred: the chosen text if it is there, else the first that was, else the first."""
    first = F.coalesce(F.nullif(F.array_position(F.transform(names, lambda n: F.coalesce(n["is_preferred"], F.lit(False))), True), F.lit(0)), F.lit(1))
    if chosen is not None:
        first = F.coalesce(F.nullif(F.array_position(F.transform(names, lambda n: n["text"]), chosen), F.lit(0)), first)
    return F.transform(names, lambda n, i: n.withField("is_preferred", i + 1 == first))


def hydrate(names: DataFrame, appellations: DataFrame) -> DataFrame:
    """`place, key, text, language, source, source_year`: a place's own names completed by its appellations, matched by normalised text.

    Of a matched pair the longer text stays, and the appellation fills language, source and year
    where the name has none; names and appellations without a partner stay as they are. Of names of one
    key the first by `pos` counts (where there is that column, else the least text).
    """
    keyed = lambda t: t.withColumn("key", normalize_label("text"))
    own = keyed(names).groupBy("place", "key").agg(F.min_by(F.struct("text", "language", "source", "source_year"), F.struct(*[c for c in ("pos", "text", "source_year", "source", "language") if c in names.columns])).alias("n"))
    other = keyed(appellations).groupBy("place", "key").agg(F.min(F.struct("source_year", "text", "language", "source")).alias("x"))
    met = own.join(other, ["place", "key"], "full")
    longer = F.when(F.length("x.text") > F.coalesce(F.length("n.text"), F.lit(0)), F.col("x.text")).otherwise(F.col("n.text"))
    return met.select("place", "key", longer.alias("text"), *[F.coalesce(f"n.{c}", f"x.{c}").alias(c) for c in ("language", "source", "source_year")])


def from_legacy(names: Column, label: Column, alternatives: Column, language: str = "nl") -> Column:
    """The list of names, or one made of the older label fields where it is null; `language` is that of alternative labels."""
    made = lambda text, preferred, kind: F.struct(text.alias("text"), F.lit(language if not preferred else "nl").alias("language"), F.lit(kind).alias("type"), F.lit(preferred).alias("is_preferred"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("source_year"))
    first = F.when(F.coalesce(F.trim(label), F.lit("")) != "", made(label, True, "official"))
    rest = F.transform(F.coalesce(alternatives, F.array().cast("array<string>")), lambda t: made(t, False, "historical"))
    return F.coalesce(names, F.concat(F.array_compact(F.array(first)), rest).cast(_NAME))


def summary(sources: Column, most: int = 2) -> Column:
    """Sources in a line: the first few, and how many more."""
    one = F.array_distinct(sources)
    more = F.size(one) - most
    return F.concat(F.array_join(F.slice(one, 1, most), " + "), F.when(more > 0, F.concat(F.lit(" + "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))
