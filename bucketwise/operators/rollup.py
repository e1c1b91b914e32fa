"""Minute rollups: building, maintaining by deltas, and answering from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.functions.time import bucket_start
from bucketwise.operators.predicates import equals, in_range, where_all
from bucketwise.plans.query import AggregateQuery
from bucketwise.plans.rollup import Part, plan_parts


def build_rollup(logs: DataFrame) -> DataFrame:
    """(bucket_start, service, level, count) of every minute with rows: the
    backfill of a table and, over one batch, its delta."""
    return logs.groupBy(F.date_trunc("minute", "timestamp").alias("bucket_start"), "service", "level").agg(
        F.count("*").alias("count")
    )


def merge_rollups(deltas: DataFrame) -> DataFrame:
    """Deltas of any number and order as one row per key."""
    keys = [c for c in ("day", "bucket_start", "service", "level") if c in deltas.columns]
    return deltas.groupBy(*keys).agg(F.sum("count").alias("count")).where("count > 0")


def part_weights(logs: DataFrame, rollups: DataFrame, query: AggregateQuery, part: Part) -> DataFrame:
    """(bucket[, group_value], count) of one part: each row's signed weight."""
    source, column = (logs, "timestamp") if part.source == "raw" else (rollups, "bucket_start")
    rows = where_all(source, [*in_range(source, column, part.start, part.end), *equals(query.service, query.level)])
    keys = [bucket_start(F.col(column), query.bucket).alias("bucket")]
    if query.group_by:
        keys.append(F.col(query.group_by).alias("group_value"))
    weight = F.lit(1) if part.source == "raw" else F.col("count")
    return rows.select(*keys, (weight if part.sign > 0 else -weight).cast("bigint").alias("count"))


def rollup_counts(logs: DataFrame, rollups: DataFrame, query: AggregateQuery) -> DataFrame:
    """Exact counts from whole minutes of rollups and the raw rows at the edges:
    all parts meet in one aggregation, partial in each task, with one shuffle."""
    parts = [part_weights(logs, rollups, query, p) for p in plan_parts(query.since, query.until)]
    keys = ["bucket", *(["group_value"] if query.group_by else [])]
    merged = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("count").alias("count"))
    return merged.where("count > 0")
