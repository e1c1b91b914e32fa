"""Filters of searches and aggregations as columns.

Comparisons are with literals of the column's own type, so Parquet statistics
apply; a range of instants also bounds the ``day`` partition, where there is one.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketwise.functions.text import contains_text
from bucketwise.functions.time import instant, utc_day
from bucketwise.model import promoted_column
from bucketwise.plans.cursor import Cursor


def in_range(df: DataFrame, column: str, since: int | None, until: int | None) -> list[Column]:
    """since <= column < until, and the days that this leaves."""
    out = []
    if since is not None:
        out.append(F.col(column) >= instant(df, column, since))
        if "day" in df.columns:
            out.append(F.col("day") >= F.lit(utc_day(since)))
    if until is not None:
        out.append(F.col(column) < instant(df, column, until))
        if "day" in df.columns:
            out.append(F.col("day") <= F.lit(utc_day(until - 1)))
    return out


def before_cursor(df: DataFrame, cursor: Cursor) -> list[Column]:
    """(timestamp, id) < cursor, written so that the scan can use it."""
    at = instant(df, "timestamp", cursor.micros)
    ts = F.col("timestamp")
    out = [ts <= at, (ts < at) | (F.col("id") < F.lit(cursor.id))]
    if "day" in df.columns:
        out.append(F.col("day") <= F.lit(utc_day(cursor.micros)))
    return out


def equals(service: str | None, level: str | None) -> list[Column]:
    return [F.col(name) == F.lit(value) for name, value in (("service", service), ("level", level)) if value is not None]


def has_attributes(df: DataFrame, attributes: Mapping[str, str]) -> list[Column]:
    """Values compared as text; a missing key fits nothing.  An attribute with a
    column of its own is looked up there, so that the scan can skip row groups."""

    def value(key: str) -> Column:
        own = promoted_column(key)
        return F.col(own) if own in df.columns else F.col("attributes_text")[F.lit(key)]

    return [value(key) == F.lit(wanted) for key, wanted in attributes.items()]


def mentions(q: str | None) -> list[Column]:
    return [] if q is None else [contains_text(F.col("message"), q)]


def where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.where(reduce(Column.__and__, conditions)) if conditions else df
