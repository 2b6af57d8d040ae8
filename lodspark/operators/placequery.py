"""Faceted search over place records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(deprecated: Column, merged_into: Column, show_merged: bool = False) -> Column:
    """Retired records are hidden; merged ones too, unless asked for."""
    keep = ~F.coalesce(deprecated, F.lit(False))
    return keep if show_merged else keep & merged_into.isNull()


def facet(tags: Column, selected: list[str], mode: str = "or", exclude: list[str] | None = None) -> Column:
    """Whether tags hold all (`and`) or any (`or`) of the selected values, and none of the excluded."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    chosen = F.array(*[F.lit(s) for s in selected]).cast("array<string>")
    keep = F.lit(True)
    if selected:
        keep = F.size(F.array_except(chosen, tags)) == 0 if mode == "and" else F.arrays_overlap(tags, chosen)
    if exclude:
        keep &= ~F.arrays_overlap(tags, F.array(*[F.lit(s) for s in exclude]))
    return keep


def contains(query: str, *texts: Column, lists: tuple[Column, ...] = ()) -> Column:
    """Whether any text, or any element of a list, holds the query, in any case. A blank query holds everywhere."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    hit = F.lit(False)
    for t in texts:
        hit |= F.coalesce(F.lower(t).contains(q), F.lit(False))
    for many in lists:
        hit |= F.coalesce(F.exists(many, lambda x: F.lower(x).contains(q)), F.lit(False))
    return hit


def search(rows: DataFrame, query: str, text: str, pos: str, least: int = 2, most: int = 20) -> DataFrame:
    """The first `most` rows in file order whose text holds the query; none for a query shorter than `least`."""
    if len(query.strip()) < least:
        return rows.limit(0)
    return rows.filter(contains(query, F.col(text))).orderBy(pos).limit(most)


def order(key: Column, descending: bool = False) -> Column:
    """A sort key whose nulls come last either way; booleans sort as numbers."""
    return key.desc_nulls_last() if descending else key.asc_nulls_last()


@dataclass(frozen=True)
class PlaceQuery:
    """What a search page asks for."""

    types: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    mode: str = "or"
    exclude: list[str] = field(default_factory=list)
    text: str = ""
    show_merged: bool = False
    sort: str = "id"
    descending: bool | None = None

    def run(self, places: DataFrame) -> DataFrame:
        """Places that the query keeps, in its order. Columns: id, type, label, names, sources, documents, deprecated, merged_into and the sort key.

        The text may be in id, label and names, and in district, location, psur_ids and external_links
        (authority, identifier) where places have these. Sorted by `links`, places without any come last.
        """
        have = set(places.columns)
        tags = F.when(F.size(F.coalesce("documents", F.array())) > 0, F.array_append("sources", F.lit("documents"))).otherwise(F.col("sources"))
        keep = visible(F.col("deprecated"), F.col("merged_into"), self.show_merged)
        if self.types:
            keep &= F.col("type").isin(self.types)
        keep &= facet(tags, self.sources, self.mode, self.exclude)
        links = F.coalesce("external_links", F.array()) if "external_links" in have else None
        lists = [F.col(c) for c in ("names", "psur_ids") if c in have] + ([links["authority"], links["identifier"]] if links is not None else [])
        keep &= contains(self.text, *[F.col(c) for c in ("id", "label", "district", "location") if c in have], lists=tuple(lists))
        if self.sort == "links" and links is not None:
            return places.filter(keep).orderBy(order(F.nullif(F.size(links), F.lit(0)), bool(self.descending)), "id")
        boolean = dict(places.dtypes)[self.sort] == "boolean"
        down = boolean if self.descending is None else self.descending
        return places.filter(keep).orderBy(order(F.col(self.sort).cast("int") if boolean else F.col(self.sort), down), "id")


def map_layers(feature_type: Column, enabled: list[str]) -> Column:
    """Map layers: a missing type always shows."""
    return feature_type.isNull() | feature_type.isin(enabled)
