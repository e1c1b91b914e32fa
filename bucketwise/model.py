"""The data model: event rows, minute rollups and rejected entries."""

from __future__ import annotations

from pyspark.sql import types as T

LEVELS = ("debug", "info", "warn", "error")
GROUPS = ("service", "level")
#: Bucket name to its length in microseconds; every one is whole minutes.
BUCKETS = {"1m": 60_000_000, "5m": 300_000_000, "1h": 3_600_000_000, "1d": 86_400_000_000}
MINUTE = BUCKETS["1m"]
DAY = BUCKETS["1d"]

LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("attributes_text", T.MapType(T.StringType(), T.StringType())),
    ]
)
ROLLUP = T.StructType(
    [
        T.StructField("bucket_start", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)
REJECTED = T.StructType(
    [T.StructField("batch_id", T.StringType()), T.StructField("index", T.LongType()), T.StructField("reason", T.StringType())]
)
#: Attributes with a column of their own in a store, unless it says otherwise.
PROMOTED = ("user_id",)


def promoted_column(name: str) -> str:
    return f"attribute_{name}"


#: What a search returns of a row.
SEARCH_COLUMNS = ("id", "timestamp", "level", "service", "message", "attributes")
