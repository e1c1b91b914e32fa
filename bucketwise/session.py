"""Spark sessions with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _setting(name: str) -> str:
    """``spark_sql_shuffle_partitions`` as Spark spells it."""
    return name.replace("_", ".")


#: Of a key that a JSON object repeats the last value counts, as in JSON parsers.
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def session(master: str | None = None, app: str = "bucketwise", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # a larger method is never compiled by the JVM; smaller ones without whole-stage code are faster
        "spark.sql.codegen.hugeMethodLimit": "8000",
        REPEATED_KEYS: "true",
    }
    settings |= {_setting(k): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
