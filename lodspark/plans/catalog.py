"""Queries over the driver's tables and their SQL, in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive, history, linking, lookup, networks, polygons, quality, records, text_geo, timelines

_PARTS = (archive, history, lookup, text_geo, quality, networks, timelines, polygons, linking, records)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for part in _PARTS for name, run in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
