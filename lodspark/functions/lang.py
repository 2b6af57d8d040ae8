"""Language maps, badges and labels of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_array(v: Column) -> Column:
    """A VARIANT that is null, a text or a list of texts, as a list."""
    text = F.try_variant_get(v, "$", "string")
    many = F.try_variant_get(v, "$", "array<string>")
    return F.when(v.isNull(), F.array().cast("array<string>")).when(F.schema_of_variant(v).startswith("ARRAY"), many).otherwise(F.array_compact(F.array(text)))


def as_lang_map(v: Column, default: str = "en") -> Column:
    """A VARIANT that is a text or a map of texts by language, as a map; a bare text is in `default`."""
    many = F.try_variant_get(v, "$", "map<string,string>")
    text = F.try_variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), many).when(F.schema_of_variant(v) == "STRING", F.create_map(F.lit(default), text)).otherwise(F.create_map().cast("map<string,string>"))


def lang_en(m: Column) -> Column:
    """The English value, else the first that is not blank, else ''."""
    first = F.get(F.filter(F.map_values(m), lambda x: x != ""), F.lit(0))
    return F.coalesce(F.nullif(F.try_element_at(m, F.lit("en")), F.lit("")), first, F.lit(""))


def flat_values(m: Column) -> Column:
    """All values of a map of lists."""
    return F.flatten(F.map_values(m))


def set_lang(m: Column, lang: str, value: Column) -> Column:
    """The map with one language set, or removed if the value is blank."""
    rest = F.map_filter(m, lambda k, _: k != lang)
    return F.when(F.trim(value) == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(lang), value)))


def split_list(csv: Column) -> Column:
    """Comma-separated values, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")


def crm_badge(cls: Column) -> Column:
    """The code that a class name begins with: `crm:E25_Human_Made_Feature` gives E25."""
    return F.regexp_extract(F.regexp_replace(cls, "^crm:", ""), r"^([A-Z]\d+)", 1)


def type_badge(types: Column) -> Column:
    """The badge of an entity's types: the first known class in a fixed order."""
    out = F.lit("?")
    for code in reversed(["E25", "E26", "E74", "E53", "E41", "E22", "E13", "E36", "E12", "E55", "E52"]):
        out = F.when(F.exists(types, _holds(code)), F.lit(code)).otherwise(out)
    return out


def _holds(code: str) -> Callable[[Column], Column]:
    return lambda t: t.contains(code)


def source_year(map_year: Column, time_span: Column) -> Column:
    """The year of a source: its map year, else the first four-digit number of its time span."""
    return F.coalesce(map_year, F.regexp_extract(time_span, r"\b(\d{4})\b", 1).try_cast("int"))


def source_label(label: Column, year: Column) -> Column:
    return F.when(year.isNull(), label).otherwise(F.format_string("%s (%d)", label, year))


def preferred_source(sources: Column, preferred: str = "almanakken") -> Column:
    """The preferred source if it is among them, else the first, else ''."""
    return F.when(F.array_contains(sources, preferred), F.lit(preferred)).otherwise(F.coalesce(F.get(sources, F.lit(0)), F.lit("")))
