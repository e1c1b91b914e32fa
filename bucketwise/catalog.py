"""Registered queries of the log engine over the ``events`` table, and their SQL.

Rollup-path queries have SQL over raw rows, so the rewrite itself is checked.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketwise.functions.text import contains_ilike, number_text_column, trimmed
from bucketwise.functions.time import iso_column, parse_instant
from bucketwise.metrics import BOUNDS
from bucketwise.model import BUCKETS, SEARCH_COLUMNS
from bucketwise.operators.aggregate import cumulative_histogram, plan_aggregate, raw_counts
from bucketwise.operators.rollup import build_rollup, merge_rollups
from bucketwise.operators.search import matching, plan_search
from bucketwise.operators.validate import validated
from bucketwise.plans.cursor import Cursor
from bucketwise.plans.query import AggregateQuery, LogQuery
from bucketwise.sources.events import events_as_logs
from bucketwise.sources.files import Files, shared_folder
from bucketwise.sources.store import LogStore, retention_cutoff
from bucketwise.streaming.ingest import ingest_stream, requests_from_files

DAY_1 = parse_instant("2024-01-01T00:00:00Z")
DAY_3, DAY_20 = parse_instant("2024-01-03T00:00:00Z"), parse_instant("2024-01-20T00:00:00Z")
EVERYTHING = (parse_instant("2023-12-01T00:00:00Z"), parse_instant("2024-03-01T00:00:00Z"))

_LOGS = """
  SELECT event_id AS id, ts AS "timestamp",
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'click' THEN 'debug' ELSE 'info' END AS level,
         event_type AS service, upper(event_type) || ' by user ' || user_id AS message,
         props AS attributes, json_extract_string(props, '$.k') AS k, user_id::VARCHAR AS user_id
  FROM events
"""
_INTERVALS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}


def _micros_sql(micros: int) -> str:
    return f"make_timestamp({micros})"


def _count_sql(q: AggregateQuery, where: str = "") -> str:
    """SQL over raw rows for a query; ``where`` has its other filters."""
    group = f", {q.group_by} AS group_value" if q.group_by else ""
    by = ", 2" if q.group_by else ""
    bucket = f"time_bucket(INTERVAL '{_INTERVALS[q.bucket]}', \"timestamp\", TIMESTAMP '1970-01-01')"
    return (
        f"WITH logs AS ({_LOGS}) SELECT {bucket} AS bucket{group}, count(*)::BIGINT AS count FROM logs "
        f"WHERE \"timestamp\" >= {_micros_sql(q.since)} AND \"timestamp\" < {_micros_sql(q.until)} {where} GROUP BY 1{by}"
    )


def _search_sql(where: str, limit: int = 101) -> str:
    columns = ", ".join(f'"{c}"' for c in SEARCH_COLUMNS)
    return f'WITH logs AS ({_LOGS}) SELECT {columns} FROM logs WHERE {where} ORDER BY "timestamp" DESC, id DESC LIMIT {limit}'


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _raw(name: str, q: AggregateQuery, where: str = "") -> None:
    QUERIES[name] = lambda spark, d: plan_aggregate(events_as_logs(spark, d), q)
    ORACLE_SQL[name] = _count_sql(q, where)


def _rollup(name: str, q: AggregateQuery, where: str = "") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        logs = events_as_logs(spark, d)
        return plan_aggregate(logs, q, build_rollup(logs))

    QUERIES[name] = run
    ORACLE_SQL[name] = _count_sql(q, where)


def _search(name: str, q: LogQuery, where: str) -> None:
    QUERIES[name] = lambda spark, d: plan_search(events_as_logs(spark, d), q)
    ORACLE_SQL[name] = _search_sql(where, q.limit + 1)


# -- aggregation ---------------------------------------------------------------------

for _b in BUCKETS:
    _raw(f"agg_{_b}", AggregateQuery(*EVERYTHING, _b))
_raw("agg_5m_by_service", AggregateQuery(*EVERYTHING, "5m", "service"))
_raw("agg_1h_by_level", AggregateQuery(*EVERYTHING, "1h", "level"))
_raw("agg_time_range", AggregateQuery(DAY_3 + 30_500_000, DAY_20 + 90_250_000, "1h"))
_raw("agg_filter_service", AggregateQuery(*EVERYTHING, "1h", service="click"), "AND service = 'click'")
_raw("agg_filter_level", AggregateQuery(*EVERYTHING, "1d", level="info"), "AND level = 'info'")
_raw("agg_attr", AggregateQuery(*EVERYTHING, "1d", attributes={"k": "42"}), "AND k = '42'")
_raw("agg_attr_missing_key", AggregateQuery(*EVERYTHING, "1d", attributes={"no.such": "1"}), "AND FALSE")
_raw("agg_q", AggregateQuery(*EVERYTHING, "1d", q="SER 1"), "AND message ILIKE '%ser 1%'")
_raw("agg_q_empty", AggregateQuery(*EVERYTHING, "1d", q=""))
_raw(
    "agg_all_filters",
    AggregateQuery(DAY_3, DAY_20, "1h", "service", "view", "info", "by USER 1", {"k": "7"}),
    "AND service = 'view' AND level = 'info' AND message ILIKE '%by user 1%' AND k = '7'",
)
_rollup("agg_rollup_aligned", AggregateQuery(DAY_3, DAY_20, "5m", "service"))
_rollup("agg_rollup_1d_by_level", AggregateQuery(DAY_3, DAY_20, "1d", "level"))
_rollup("agg_rollup_filtered", AggregateQuery(DAY_3, DAY_20, "1h", None, "error", "error"), "AND service = 'error' AND level = 'error'")
_rollup("agg_rollup_partial_edges", AggregateQuery(DAY_3 + 45_000_001, DAY_20 + 15_000_001, "1h"))
_rollup("agg_rollup_complement_head", AggregateQuery(DAY_3 + 10_000_000, DAY_20, "1h", "service"))
_rollup("agg_rollup_complement_tail", AggregateQuery(DAY_3, DAY_20 + 50_000_000, "1h", "level"))
_rollup("agg_rollup_complement_both", AggregateQuery(DAY_3 + 3, DAY_20 + 59_999_999, "5m"))
_rollup("agg_rollup_half_minutes", AggregateQuery(DAY_3 + 30_000_000, DAY_20 + 30_000_000, "5m"))
_rollup("agg_rollup_submin", AggregateQuery(DAY_1 + 5_000_000, DAY_1 + 55_000_000, "1m"))
_rollup("agg_rollup_fallback_q", AggregateQuery(DAY_3 + 1, DAY_20, "1d", q="click"), "AND message ILIKE '%click%'")


def rollup_build_1m(spark: SparkSession, d: str) -> DataFrame:
    return build_rollup(events_as_logs(spark, d))


QUERIES["rollup_build_1m"] = rollup_build_1m
ORACLE_SQL["rollup_build_1m"] = (
    f"WITH logs AS ({_LOGS}) SELECT date_trunc('minute', \"timestamp\") AS bucket_start, service, level, "
    "count(*)::BIGINT AS count FROM logs GROUP BY 1, 2, 3"
)


def rollup_merge_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Deltas of ten batches, merged: the same as one build."""
    logs = events_as_logs(spark, d)
    deltas = logs.groupBy((F.col("id") % 10).alias("batch"), F.date_trunc("minute", "timestamp").alias("bucket_start"), "service", "level")
    return merge_rollups(deltas.agg(F.count("*").alias("count")))


QUERIES["rollup_merge_deltas"] = rollup_merge_deltas
ORACLE_SQL["rollup_merge_deltas"] = ORACLE_SQL["rollup_build_1m"]


def service_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals per service over the bucket counts."""
    counts = raw_counts(events_as_logs(spark, d), AggregateQuery(*EVERYTHING, "1m", "service"))
    return counts.groupBy("group_value").agg(F.sum("count").alias("total"), F.count("*").alias("buckets"))


QUERIES["service_totals"] = service_totals
ORACLE_SQL["service_totals"] = (
    "SELECT event_type AS group_value, count(*)::BIGINT AS total, "
    "count(DISTINCT date_trunc('minute', ts))::BIGINT AS buckets FROM events GROUP BY 1"
)

# -- search ------------------------------------------------------------------------------

_TS = '"timestamp"'
_search("search_latest", LogQuery(), "TRUE")
_search("search_limit_1", LogQuery(limit=1), "TRUE")
_search("search_limit_1000", LogQuery(limit=1000), "TRUE")
_search("search_service", LogQuery(service="purchase"), "service = 'purchase'")
_search("search_service_empty", LogQuery(service=""), "service = ''")
_search("search_service_injection", LogQuery(service="x' OR 1=1 --"), "FALSE")
_search("search_level", LogQuery(level="debug"), "level = 'debug'")
_search(
    "search_time_range",
    LogQuery(since=DAY_3, until=DAY_20),
    f"{_TS} >= {_micros_sql(DAY_3)} AND {_TS} < {_micros_sql(DAY_20)}",
)
_search("search_attr", LogQuery(attributes={"k": "42"}), "k = '42'")
_search("search_attr_user_id", LogQuery(attributes={"user_id": "7"}), "user_id = '7'")
_search("search_attr_multi", LogQuery(attributes={"k": "69", "user_id": "8"}), "k = '69' AND user_id = '8'")
_search("search_q", LogQuery(q="Click BY"), "message ILIKE '%click by%'")
_search("search_q_empty", LogQuery(q=""), "TRUE")
_search("search_q_escaped", LogQuery(q="u_er%"), "contains(lower(message), 'u_er%')")
_search(
    "search_all_filters",
    LogQuery("view", "info", DAY_3, DAY_20, "USER 1", 50, None, {"k": "7"}),
    f"service = 'view' AND level = 'info' AND {_TS} >= {_micros_sql(DAY_3)} AND {_TS} < {_micros_sql(DAY_20)} "
    "AND message ILIKE '%user 1%' AND k = '7'",
)
_CURSOR = Cursor(DAY_20 + 123_456, 5_000)
_search(
    "search_keyset",
    LogQuery(cursor=_CURSOR, service="click"),
    f"service = 'click' AND ({_TS}, id) < ({_micros_sql(_CURSOR.micros)}, {_CURSOR.id})",
)


def search_keyset_page2(spark: SparkSession, d: str) -> DataFrame:
    """The page after the first, from the cursor of its last row."""
    logs = events_as_logs(spark, d)
    first = plan_search(logs, LogQuery(), ahead=0).agg(
        F.min(F.struct(F.unix_micros(F.col("timestamp").cast("timestamp")).alias("m"), "id")).alias("last")
    )
    last = first.first().last
    return plan_search(logs, replace(LogQuery(), cursor=Cursor(last.m, last.id)), ahead=0)


QUERIES["search_keyset_page2"] = search_keyset_page2
ORACLE_SQL["search_keyset_page2"] = _search_sql("TRUE", 100) + " OFFSET 100"


def search_all_matching(spark: SparkSession, d: str) -> DataFrame:
    """Every row that a search's filters fit, without a page."""
    return matching(events_as_logs(spark, d), LogQuery(service="error", q="user 2")).select("id", "level", "message")


QUERIES["search_all_matching"] = search_all_matching
ORACLE_SQL["search_all_matching"] = (
    f"WITH logs AS ({_LOGS}) SELECT id, level, message FROM logs WHERE service = 'error' AND message ILIKE '%user 2%'"
)


def search_q_ilike(spark: SparkSession, d: str) -> DataFrame:
    """Substring search through ILIKE with escaping over longer texts."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.where(contains_ilike(F.col("text"), "100%") | contains_ilike(F.col("text"), "License, v")).select("doc_id")


QUERIES["search_q_ilike"] = search_q_ilike
ORACLE_SQL["search_q_ilike"] = (
    "SELECT doc_id FROM documents WHERE contains(lower(text), '100%') OR contains(lower(text), 'license, v')"
)


def result_rendering(spark: SparkSession, d: str) -> DataFrame:
    """Rows as the API renders them: ISO milliseconds, ids as text."""
    logs = events_as_logs(spark, d)
    return logs.select(F.col("id").cast("string").alias("id"), iso_column(F.col("timestamp")).alias("timestamp"), "level")


QUERIES["result_rendering"] = result_rendering
ORACLE_SQL["result_rendering"] = (
    f"WITH logs AS ({_LOGS}) SELECT id::VARCHAR AS id, strftime(date_trunc('millisecond', \"timestamp\"), '%Y-%m-%dT%H:%M:%S.%gZ') "
    "AS \"timestamp\", level FROM logs"
)

# -- validation ------------------------------------------------------------------------------

_NOW = "2024-01-20T00:00:00Z"


def raw_entries(spark: SparkSession, d: str) -> DataFrame:
    """(position, raw): events as ingest entries, many of them spoilt by a rule on their id."""
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.col("event_id")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    level = F.when(n % 11 == 1, "critical").when(n % 5 == 0, "warn").otherwise("info")
    service = F.when(n % 13 == 2, "   ").otherwise(F.concat(F.lit(" "), "event_type", F.lit("\t")))
    attributes = F.when(n % 17 == 3, '{"a":{"b":1}}').when(n % 7 == 4, '{"x":null}').when(n % 3 == 0, F.col("props")).otherwise('{"f":1.0,"ok":true}')
    extra = F.when(n % 19 == 5, ',"more":1').otherwise("")
    when = F.when(n % 23 == 6, F.substring(ts, 1, 10)).otherwise(ts)
    raw = F.concat(
        F.lit('{"timestamp":"'), when, F.lit('","level":"'), level, F.lit('","service":"'), F.replace(service, F.lit("\t"), F.lit("\\t")),
        F.lit('","message":"user '), F.col("user_id").cast("string"), F.lit('","attributes":'), attributes, extra, F.lit("}"),
    )
    return e.select(n.alias("position"), F.when(n % 29 == 7, "[1]").otherwise(raw).alias("raw"))


_REASON_SQL = f"""
  SELECT event_id AS position, event_type AS service, props, ts,
    CASE WHEN event_id % 29 = 7 THEN 'invalid log entry'
         WHEN event_id % 23 = 6 THEN 'invalid timestamp'
         WHEN event_id % 11 = 1 THEN 'invalid level: ''critical'''
         WHEN event_id % 13 = 2 THEN 'service must be a non-empty string'
         WHEN event_id % 17 = 3 OR event_id % 7 = 4 THEN 'attributes must be a flat object with string, number, or boolean values'
         WHEN event_id % 19 = 5 THEN 'invalid log entry'
         WHEN ts > TIMESTAMP '2024-01-20' + INTERVAL 5 MINUTE THEN 'timestamp is more than 5 minutes in the future' END AS reason
  FROM events
"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return validated(raw_entries(spark, d), F.lit(_NOW).cast("timestamp"))


QUERIES["validate_reasons"] = lambda spark, d: _judged(spark, d).select("position", "reason")
ORACLE_SQL["validate_reasons"] = f"SELECT position, reason FROM ({_REASON_SQL})"
QUERIES["validate_accept_reject"] = lambda spark, d: _judged(spark, d).agg(
    F.count_if(F.col("reason").isNull()).alias("accepted"), F.count("reason").alias("rejected")
)
ORACLE_SQL["validate_accept_reject"] = (
    f"SELECT count(*) FILTER (reason IS NULL)::BIGINT AS accepted, count(reason)::BIGINT AS rejected FROM ({_REASON_SQL})"
)
QUERIES["validate_normalised"] = lambda spark, d: (
    _judged(spark, d)
    .where("reason IS NULL")
    .select("position", "service", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("attributes_text")["k"].alias("k"), F.col("attributes_text")["f"].alias("f"))
)
ORACLE_SQL["validate_normalised"] = (
    'SELECT position, service, ts AS "timestamp", CASE WHEN position % 3 = 0 THEN json_extract_string(props, \'$.k\') END AS k, '
    f"CASE WHEN position % 3 <> 0 THEN '1' END AS f FROM ({_REASON_SQL}) WHERE reason IS NULL"
)
QUERIES["trim_white_space"] = lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select(
    "event_id", trimmed(F.concat(F.lit(" \t "), "event_type", F.lit("　\n"))).alias("service")
)
ORACLE_SQL["trim_white_space"] = "SELECT event_id, event_type AS service FROM events"
QUERIES["attribute_number_text"] = lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select(
    "event_id", number_text_column(F.floor("value").cast("double")).alias("whole")
)
ORACLE_SQL["attribute_number_text"] = "SELECT event_id, floor(value)::BIGINT::VARCHAR AS whole FROM events"

# -- lifecycle, metrics, streaming ---------------------------------------------------------------

_CUT = retention_cutoff(10, datetime(2024, 1, 25, 15, 30, tzinfo=timezone.utc))


def _days(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("day", F.to_date(column).cast("string"))


QUERIES["retention_keep"] = lambda spark, d: (
    _days(events_as_logs(spark, d), "timestamp").where(F.col("day") >= F.lit(str(_CUT))).groupBy("day").agg(F.count("*").alias("count"))
)
ORACLE_SQL["retention_keep"] = f"SELECT ts::DATE::VARCHAR AS day, count(*)::BIGINT AS count FROM events WHERE ts::DATE >= DATE '{_CUT}' GROUP BY 1"
QUERIES["retention_rollup_keep"] = lambda spark, d: (
    _days(build_rollup(events_as_logs(spark, d)), "bucket_start")
    .where(F.col("day") >= F.lit(str(_CUT)))
    .groupBy("day", "service")
    .agg(F.sum("count").alias("count"))
)
ORACLE_SQL["retention_rollup_keep"] = (
    f"SELECT ts::DATE::VARCHAR AS day, event_type AS service, count(*)::BIGINT AS count FROM events WHERE ts::DATE >= DATE '{_CUT}' GROUP BY 1, 2"
)
QUERIES["distinct_days"] = lambda spark, d: _days(events_as_logs(spark, d), "timestamp").select("day").distinct()
ORACLE_SQL["distinct_days"] = "SELECT DISTINCT ts::DATE::VARCHAR AS day FROM events"

_BOUNDS = [b * 10 for b in BOUNDS]
QUERIES["histogram_cumulative"] = lambda spark, d: cumulative_histogram(
    spark.read.parquet(f"{d}/events.parquet"), "value", _BOUNDS
)
ORACLE_SQL["histogram_cumulative"] = (
    " UNION ALL ".join(f"SELECT '{b}' AS le, count(*) FILTER (value <= {b})::BIGINT AS count FROM events" for b in _BOUNDS)
    + " UNION ALL SELECT '+Inf', count(value)::BIGINT FROM events"
)


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def _entries_on_disk(spark: SparkSession, d: str, base: str) -> str:
    logs = events_as_logs(spark, d)
    entry = F.to_json(
        F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "level", "service", "message", F.create_map(F.lit("user_id"), F.col("attributes_text")["user_id"]).alias("attributes"))
    )
    logs.select(entry.alias("value")).write.mode("overwrite").text(f"{base}/in")
    return f"{base}/in"


def ingest_stream_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Events through the streaming ingest; the rollup that it maintained."""
    base = _scratch(spark)
    folder = _entries_on_disk(spark, d, base)
    store = LogStore(spark, base)
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", 4).text(folder)
    ingest_stream(store, lines, f"{base}/checkpoint", f"{base}/rejects").awaitTermination()
    return (
        merge_rollups(store.rollups())
        .groupBy("service", "level")
        .agg(F.sum("count").alias("count"), F.count("*").alias("minutes"))
    )


QUERIES["ingest_stream_rollup"] = ingest_stream_rollup
ORACLE_SQL["ingest_stream_rollup"] = (
    f"WITH logs AS ({_LOGS}) SELECT service, level, count(*)::BIGINT AS count, "
    "count(DISTINCT date_trunc('minute', \"timestamp\"))::BIGINT AS minutes FROM logs GROUP BY 1, 2"
)


def ingest_request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Events in request bodies of 200 through the stream of requests; the rollup that it maintained."""
    base = _scratch(spark)
    entries = spark.read.text(_entries_on_disk(spark, d, base)).withColumn("request", F.monotonically_increasing_id() % F.lit(1 << 33))
    bodies = entries.withColumn("request", F.concat(F.spark_partition_id().cast("string"), F.lit("-"), F.floor(F.col("request") / 200).cast("string")))
    body = F.concat(F.lit('{"logs":['), F.concat_ws(",", F.collect_list("value")), F.lit("]}"))
    # a body a line: a file of its own for each would cost more than the ingest, and a folder for each yet more
    bodies.groupBy("request").agg(body.alias("value")).select("value").write.option("maxRecordsPerFile", 100).text(f"{base}/bodies")
    store = LogStore(spark, base)
    ingest_stream(store, requests_from_files(spark, f"{base}/bodies", lines=True), f"{base}/checkpoint", f"{base}/rejects").awaitTermination()
    return (
        merge_rollups(store.rollups())
        .groupBy("service", "level")
        .agg(F.sum("count").alias("count"), F.count("*").alias("minutes"))
    )


QUERIES["ingest_request_bodies"] = ingest_request_bodies
ORACLE_SQL["ingest_request_bodies"] = ORACLE_SQL["ingest_stream_rollup"]


def _filled_store(spark: SparkSession, d: str, batches: int = 2) -> LogStore:
    """A new store with the events, in some batches."""
    store = LogStore(spark, _scratch(spark))
    logs = events_as_logs(spark, d).withColumn("position", F.col("id")).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    for k in range(batches):
        store.append(logs.where(F.col("id") % batches == k), f"events-{k}")
    return store


_stores: dict[tuple[str, str, float], LogStore] = {}


def _stored(spark: SparkSession, d: str) -> LogStore:
    """The session's store with the events of a folder, filled once for each state of the table."""
    key = spark.sparkContext.applicationId, d, Files(spark, d).modified(f"{d}/events.parquet")
    if key not in _stores:
        _stores[key] = _filled_store(spark, d)
    return _stores[key]


def store_search(spark: SparkSession, d: str) -> DataFrame:
    """A search in the partitioned store, after events were committed to it."""
    store = _filled_store(spark, d, 1)
    found = plan_search(store.logs(), LogQuery(service="view", since=DAY_3, until=DAY_20), ahead=0)
    return found.select((F.col("id") - 1).alias("id"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "message")


QUERIES["store_search"] = store_search
ORACLE_SQL["store_search"] = (
    f"WITH logs AS ({_LOGS}) SELECT id, \"timestamp\", message FROM logs WHERE service = 'view' AND {_TS} >= {_micros_sql(DAY_3)} "
    f"AND {_TS} < {_micros_sql(DAY_20)} ORDER BY {_TS} DESC, id DESC LIMIT 100"
)


def _from_store(name: str, q: AggregateQuery) -> None:
    """Counts from the rollup that the store keeps; SQL counts the rows."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        store = _stored(spark, d)
        counts = plan_aggregate(store.logs(), q, store.rollups())
        return counts.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))

    QUERIES[name] = run
    ORACLE_SQL[name] = _count_sql(q)


_from_store("store_rollup_aligned", AggregateQuery(DAY_3, DAY_20, "5m", "service"))
_from_store("store_rollup_1d_by_level", AggregateQuery(DAY_3, DAY_20, "1d", "level"))
_from_store("store_rollup_partial_edges", AggregateQuery(DAY_3 + 45_000_001, DAY_20 + 15_000_001, "1h"))


def store_search_attribute(spark: SparkSession, d: str) -> DataFrame:
    """All rows of one user, by the attribute's own column in the store."""
    found = matching(_stored(spark, d).logs(), LogQuery(attributes={"user_id": "7"}))
    return found.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "level", "message")


QUERIES["store_search_attribute"] = store_search_attribute
ORACLE_SQL["store_search_attribute"] = f"WITH logs AS ({_LOGS}) SELECT \"timestamp\", level, message FROM logs WHERE user_id = '7'"


def _chosen(name: str, q: LogQuery, where: str) -> None:
    """All rows of a search, from the files that zones and signatures leave."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = matching(_stored(spark, d).logs_for(q), q)
        return found.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "level", "service", "message")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH logs AS ({_LOGS}) SELECT {_TS}, level, service, message FROM logs WHERE {where}"


_HOUR = DAY_3 + 10 * BUCKETS["1h"]
_chosen("store_search_q", LogQuery(q="By User 14"), "message ILIKE '%by user 14%'")
_chosen("store_search_q_rare", LogQuery(q="purchase by user 7", since=DAY_3), f"message ILIKE '%purchase by user 7%' AND {_TS} >= {_micros_sql(DAY_3)}")
_chosen("store_search_q_short", LogQuery(q="7", until=DAY_3), f"contains(message, '7') AND {_TS} < {_micros_sql(DAY_3)}")
_chosen("store_search_any_attribute", LogQuery(attributes={"k": "42"}), "k = '42'")
_chosen("store_search_attributes_and_q", LogQuery(attributes={"k": "69", "user_id": "8"}, q="USER 8"), "k = '69' AND user_id = '8' AND message ILIKE '%user 8%'")
_chosen(
    "store_search_hour_level",
    LogQuery("view", "info", _HOUR, _HOUR + BUCKETS["1h"]),
    f"service = 'view' AND level = 'info' AND {_TS} >= {_micros_sql(_HOUR)} AND {_TS} < {_micros_sql(_HOUR + BUCKETS['1h'])}",
)


def _newest(name: str, q: LogQuery, where: str) -> None:
    """A page of a search that stops opening files when no other can hold a row of it."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = [(r.timestamp, r.level, r.message) for r in _stored(spark, d).newest(q)]
        page = spark.createDataFrame(rows, "timestamp timestamp, level string, message string")
        return page.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH logs AS ({_LOGS}) SELECT {_TS}, level, message FROM logs WHERE {where} ORDER BY {_TS} DESC, id DESC LIMIT {q.limit + 1}"


_newest("store_newest", LogQuery(), "TRUE")
_newest("store_newest_service", LogQuery(service="error", limit=250, until=DAY_20), f"service = 'error' AND {_TS} < {_micros_sql(DAY_20)}")
_newest("store_newest_q", LogQuery(q="user 1", limit=40), "message ILIKE '%user 1%'")


def store_agg_q(spark: SparkSession, d: str) -> DataFrame:
    """Counts with a text filter, which rollups cannot answer, from the files that may fit."""
    q = AggregateQuery(DAY_3, DAY_20, "1d", "service", q="user 12")
    return plan_aggregate(_stored(spark, d).logs_for(q), q).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


QUERIES["store_agg_q"] = store_agg_q
ORACLE_SQL["store_agg_q"] = _count_sql(AggregateQuery(DAY_3, DAY_20, "1d", "service"), "AND message ILIKE '%user 12%'")


def store_rebuilt_rollups(spark: SparkSession, d: str) -> DataFrame:
    """The rollups of all days, backfilled from the rows by one job."""
    store = _filled_store(spark, d)
    store.rebuild_all_rollups()
    found = store.rollups().withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))
    return found.select("bucket_start", "service", "level", "count")


QUERIES["store_rebuilt_rollups"] = store_rebuilt_rollups
ORACLE_SQL["store_rebuilt_rollups"] = ORACLE_SQL["rollup_build_1m"]


def store_after_retention(spark: SparkSession, d: str) -> DataFrame:
    """Rows per day in rows and rollup, after one day was compacted and the old days were dropped."""
    store = _filled_store(spark, d)
    store.compact(store.days()[-1])
    store.drop_expired(10, datetime(2024, 1, 25, 15, 30, tzinfo=timezone.utc))
    rows = store.logs().groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("rows"))
    sums = store.rollups().groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("count").alias("counted"))
    return rows.join(sums, "day")


QUERIES["store_after_retention"] = store_after_retention
ORACLE_SQL["store_after_retention"] = (
    f"SELECT ts::DATE::VARCHAR AS day, count(*)::BIGINT AS rows, count(*)::BIGINT AS counted FROM events WHERE ts::DATE >= DATE '{_CUT}' GROUP BY 1"
)
