"""The ``events`` table seen as a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: id, timestamp, level, service, message, attributes, attributes_text.
    Columns that a query leaves out are never read."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", "error").when(kind == "purchase", "warn").when(kind == "click", "debug").otherwise("info")
    )
    user = F.col("user_id").cast("string")
    text = F.map_concat(
        F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>")),
        F.create_map(F.lit("user_id"), user),
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        level.alias("level"),
        kind.alias("service"),
        F.concat(F.upper(kind), F.lit(" by user "), user).alias("message"),
        F.col("props").alias("attributes"),
        text.alias("attributes_text"),
    )
