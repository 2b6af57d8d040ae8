"""Identifiers, links and query parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fixed, float_prefix

#: Namespaces, to be set for a deployment: transforms mint under ONTOLOGY, the assembled graph under BASE.
ONTOLOGY = "https://lod.example.org/ontology/"
BASE = "https://lod.example.org/id/"
PREFIXES = {
    "https://lod.example.org/id/": "id:",
    "https://lod.example.org/ontology/": "onto:",
    "http://www.cidoc-crm.org/cidoc-crm/": "crm:",
    "http://www.w3.org/2004/02/skos/core#": "skos:",
    "http://www.wikidata.org/entity/": "wd:",
}


def place_id(c: Column | str) -> Column:
    """The stm number at the end of a path, else the whole text."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"/(stm-\d+)$", 1), F.lit("")), F.col(c) if isinstance(c, str) else c)


def tail(c: Column | str) -> Column:
    """The last segment of a path, without query and fragment."""
    return F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"([^/]*)/?$", 1)


def strip_host(c: Column | str) -> Column:
    """A link without scheme and host."""
    return F.regexp_replace(c, r"^[a-z]+://[^/]+/", "")


def compact(c: Column | str, prefixes: dict[str, str] = PREFIXES) -> Column:
    """Known namespaces shortened to their prefix."""
    out = F.col(c) if isinstance(c, str) else c
    for long, short in prefixes.items():
        out = F.when(out.startswith(long), F.concat(F.lit(short), F.substr(out, F.lit(len(long) + 1)))).otherwise(out)
    return out


def label_of(c: Column | str, prefixes: dict[str, str] = PREFIXES) -> Column:
    """A link's readable part: namespaces dropped."""
    return compact(c, dict.fromkeys(prefixes, ""))


def source_url(source_id: Column) -> Column:
    return F.concat(F.lit("/sources/"), F.url_encode(source_id))


def vocabulary_url(type_id: Column) -> Column:
    return F.concat(F.lit("/vocabulary/"), F.url_encode(type_id))


def model_url(entity_id: Column) -> Column:
    return F.concat(F.lit("/model#"), F.url_encode(entity_id))


def explore_url(place: Column, zoom: Column, lat: Column, lng: Column) -> Column:
    """A map link with the parameters that are not null: whole zoom, four decimals."""
    parts = F.array_compact(F.array(
        F.concat(F.lit("place="), F.url_encode(place)),
        F.concat(F.lit("z="), F.round(zoom).cast("int").cast("string")),
        F.concat(F.lit("lat="), fixed(lat, 4)),
        F.concat(F.lit("lng="), fixed(lng, 4)),
    ))
    return F.when(F.size(parts) > 0, F.concat(F.lit("/explore?"), F.array_join(parts, "&"))).otherwise(F.lit("/explore"))


def parameter(url: Column | str, name: str) -> Column:
    """A query parameter of a link, null if absent."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def number_between(raw: Column, low: float | None = None, high: float | None = None) -> Column:
    """A finite number in a range, else null."""
    n = float_prefix(raw)
    keep = n.isNotNull()
    if low is not None:
        keep &= n >= low
    if high is not None:
        keep &= n <= high
    return F.when(keep, n)


def explore_parameters(url: Column | str) -> Column:
    """Place, zoom (0-22), latitude and longitude of a map link; bad numbers are null."""
    return F.struct(
        F.url_decode(parameter(url, "place")).alias("place"),
        number_between(parameter(url, "z"), 0, 22).alias("z"),
        number_between(parameter(url, "lat"), -90, 90).alias("lat"),
        number_between(parameter(url, "lng"), -180, 180).alias("lng"),
    )


def category_id(uri: Column | str, base: str = BASE + "source-type/") -> Column:
    return F.replace(F.col(uri) if isinstance(uri, str) else uri, F.lit(base), F.lit(""))


def resolve(template: Column, identifier: Column) -> Column:
    """An authority's link for an identifier."""
    return F.replace(template, F.lit("{id}"), identifier)
