"""Counts per time bucket, from raw rows or from rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.functions.time import bucket_start, iso_millis
from bucketwise.operators.predicates import equals, has_attributes, in_range, mentions, where_all
from bucketwise.operators.rollup import rollup_counts
from bucketwise.plans.query import AggregateQuery


def raw_counts(logs: DataFrame, query: AggregateQuery) -> DataFrame:
    """Counts straight from rows: one partial and one final aggregation."""
    rows = where_all(
        logs,
        [
            *in_range(logs, "timestamp", query.since, query.until),
            *equals(query.service, query.level),
            *has_attributes(logs, query.attributes),
            *mentions(query.q),
        ],
    )
    keys = [bucket_start(F.col("timestamp"), query.bucket).alias("bucket")]
    if query.group_by:
        keys.append(F.col(query.group_by).alias("group_value"))
    return rows.groupBy(*keys).agg(F.count("*").alias("count"))


def plan_aggregate(logs: DataFrame, query: AggregateQuery, rollups: DataFrame | None = None) -> DataFrame:
    """(bucket[, group_value], count) in ascending order; empty buckets are left out."""
    if rollups is not None and query.rollup_answers:
        counts = rollup_counts(logs, rollups, query)
    else:
        counts = raw_counts(logs, query)
    return counts.orderBy("bucket", *(["group_value"] if query.group_by else []))


def aggregate(logs: DataFrame, query: AggregateQuery, rollups: DataFrame | None = None) -> dict:
    """As the API shows it: ``{"buckets": [{"start", "group", "count"}]}``."""
    rows = plan_aggregate(logs, query, rollups).withColumn("micros", F.unix_micros(F.col("bucket").cast("timestamp")))
    return {
        "buckets": [
            {"start": iso_millis(r.micros), "group": r.group_value if query.group_by else None, "count": int(r["count"])}
            for r in rows.collect()
        ]
    }


def cumulative_histogram(values: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """(le, count): how many values are at most each bound; the last is +Inf.
    One pass, one row per bound."""
    sums = [F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = values.agg(*sums, F.count(column).alias("inf"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("count")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.le", "r.count")
