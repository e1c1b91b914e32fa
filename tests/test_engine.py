"""The engine end to end on hand-made rows."""

import threading
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from bucketwise.engine import Engine
from bucketwise.functions.text import number_text, number_text_column
from bucketwise.functions.time import bucket_start, parse_instant
from bucketwise.operators.aggregate import aggregate, raw_counts
from bucketwise.operators.rollup import build_rollup, rollup_counts
from bucketwise.operators.search import matching, pages, search
from bucketwise.operators.validate import open_envelope
from bucketwise.plans.query import AggregateQuery, LogQuery
from bucketwise.sources import store as store_module
from bucketwise.sources.files import shared_folder
from bucketwise.sources.store import LogStore, Manifest, retention_cutoff, retention_days
from bucketwise.streaming.batcher import BatchConfig
from bucketwise.streaming.ingest import ingest_batch, ingest_stream, numbered

NOW = datetime(2026, 8, 12, 10, 0, tzinfo=timezone.utc)


def entry(at="2026-08-12T10:00:00.000Z", level="info", service="svc", message="hello", **more):
    return {"timestamp": at, "level": level, "service": service, "message": message} | more


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, f"file://{tmp_path}/store")


REJECTS = [
    (entry("not-a-timestamp"), "invalid timestamp"),
    (entry("2026-08-12"), "invalid timestamp"),
    (entry(5), "invalid timestamp"),
    (entry(level="critical"), "invalid level: 'critical'"),
    (entry(level=3), "invalid level"),
    (entry(service="   "), "service must be a non-empty string"),
    (entry(service=5), "service must be a non-empty string"),
    (entry(message="　\t"), "message must be a non-empty string"),
    (entry(attributes={"a": {"b": 1}}), "attributes must be a flat object with string, number, or boolean values"),
    (entry(attributes=[1]), "attributes must be a flat object with string, number, or boolean values"),
    (entry(attributes=None), "attributes must be a flat object with string, number, or boolean values"),
    (entry(attributes={"a": None}), "attributes must be a flat object with string, number, or boolean values"),
    (entry(other=1), "invalid log entry"),
    ([1], "invalid log entry"),
    (None, "invalid log entry"),
    ("text", "invalid log entry"),
    (entry("2026-08-12T10:05:00.001Z"), "timestamp is more than 5 minutes in the future"),
    ({"level": "nope"}, "invalid timestamp"),
]


def test_validation(store):
    good = [
        entry(),
        entry("2026-08-12T10:05:00.000Z"),
        entry("2026-08-12T12:00+02:00", service=" a ", attributes={"n": 1.0, "b": True, "s": "x", "e": 1e3, "dotted.key": "q'\""}),
    ]
    result = ingest_batch(store, {"logs": [e for e, _ in REJECTS] + good}, NOW)
    assert result.status == 200 and result.accepted == 3
    assert [(r["index"], r["reason"]) for r in result.rejected] == [(i, r) for i, (_, r) in enumerate(REJECTS)]
    rows = store.logs().orderBy("id").collect()
    assert [r.id for r in rows] == sorted(r.id for r in rows)
    last = rows[-1]
    assert last.service == "a" and last.attributes_text == {"n": "1", "b": "true", "s": "x", "e": "1000", "dotted.key": "q'\""}
    assert rows[0].attributes_text == {} and rows[0].attributes == "{}"


def test_all_rejected(store):
    result = ingest_batch(store, {"logs": [entry(level="x")]}, NOW)
    assert (result.status, result.body()) == (400, {"accepted": 0, "rejected": [{"index": 0, "reason": "invalid level: 'x'"}]})
    assert store.manifests() == []


@pytest.mark.parametrize(
    "body, error",
    [
        ({"logs": []}, "logs array must not be empty"),
        ({"logs": 5}, "logs must be a non-empty array"),
        ({}, "logs must be a non-empty array"),
        ([], "invalid request body"),
        (None, "invalid request body"),
        ({"logs": [1], "x": 1}, "invalid request body"),
    ],
)
def test_envelope(body, error):
    assert open_envelope(body).error == error


SEARCHED = [
    ("12:00", "error", "A", "Payment FAILED for Alpha", {"user_id": "42", "region": "eu-west"}),
    ("11:00", "info", "A", "Payment accepted for Beta", {"user_id": 42, "region": "us-east"}),
    ("10:00", "warn", "B", "Inventory warning", {"user_id": "7", "region": "eu-west"}),
    ("09:00", "error", "B", "Payment retry scheduled", {"user_id": "42", "region": "eu-west"}),
    ("08:00", "info", "A", "Tie row inserted first", {"tie": "yes"}),
    ("08:00", "info", "A", "Tie row inserted second", {"tie": "yes"}),
    ("07:00", "debug", "x' OR 1=1 --", "Literal", {"source": "test"}),
]


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    store = LogStore(spark, f"file://{tmp_path_factory.mktemp('s')}")
    entries = [entry(f"2020-08-12T{t}:00Z", lv, s, m, attributes=a) for t, lv, s, m, a in SEARCHED]
    assert ingest_batch(store, {"logs": entries}, NOW).accepted == 7
    return store


@pytest.mark.parametrize(
    "params, want",
    [
        ({"service": "B", "since": "2020-08-12T09:00:00Z", "until": "2020-08-12T10:30:00Z"}, [3, 4]),
        ({"service": "B", "attr.user_id": "7"}, [3]),
        ({"attr.user_id": "42", "attr.region": "eu-west"}, [1, 4]),
        ({"attr.user_id": "42"}, [1, 2, 4]),
        ({"service": "A", "q": "failed FOR"}, [1]),
        ({"service": "A", "attr.tie": "yes"}, [6, 5]),
        ({"service": "x' OR 1=1 --"}, [7]),
        ({"service": ""}, []),
        ({"q": "%"}, []),
        ({}, [1, 2, 3, 4, 6, 5, 7]),
    ],
)
def test_search(searched, params, want):
    page = search(searched.logs(), LogQuery.from_params(params))
    assert [int(r["id"]) for r in page["logs"]] == want and page["next_cursor"] is None


def test_pages(searched):
    got = [[int(r["id"]) for r in p["logs"]] for p in pages(searched.logs(), LogQuery(limit=2))]
    assert got == [[1, 2], [3, 4], [6, 5], [7]]
    first = search(searched.logs(), LogQuery(limit=1))["logs"][0]
    assert first == {"id": "1", "timestamp": "2020-08-12T12:00:00.000Z", "level": "error", "service": "A", "message": "Payment FAILED for Alpha", "attributes": {"region": "eu-west", "user_id": "42"}}


def test_newest_days_first(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/days")
    logs = [entry(f"2020-03-{d:02d}T{h:02d}:00:00Z", message="rare" if d == 2 else "common") for d in range(1, 12) for h in (1, 2, 2)]
    ingest_batch(store, {"logs": logs}, NOW)
    for q in (LogQuery(limit=5), LogQuery(limit=7, since=parse_instant("2020-03-04T02:00:00Z")), LogQuery(limit=2, q="RARE"), LogQuery(limit=4, until=parse_instant("2020-03-09T00:00:00Z"))):
        with_days, without = (list(pages(store.logs(), q, d)) for d in (store.days(), None))
        assert with_days == without and len(with_days) > 1
    assert search(store.logs(), LogQuery(service="none"), store.days())["logs"] == []


COUNTED = [
    ("10:00:10", "info", "A", "startup complete", "eu-west"),
    ("10:00:40", "error", "A", "payment needle failure", "us-east"),
    ("10:01:05", "info", "A", "request accepted", "eu-west"),
    ("10:01:20", "info", "B", "request accepted", "eu-west"),
    ("10:02:10", "warn", "A", "latency warning", "eu-west"),
    ("10:02:50", "error", "B", "database failure", "us-east"),
    ("10:03:00", "info", "A", "worker ready", "eu-west"),
    ("10:04:59", "warn", "B", "queue warning", "eu-west"),
    ("10:05:01", "info", "A", "outside range", "eu-west"),
]


@pytest.fixture(scope="module")
def counted(spark, tmp_path_factory):
    store = LogStore(spark, f"file://{tmp_path_factory.mktemp('c')}")
    for part in (COUNTED[:4], COUNTED[4:]):  # two batches: deltas add up
        ingest_batch(store, {"logs": [entry(f"2023-06-15T{t}Z", lv, s, m, attributes={"region": r}) for t, lv, s, m, r in part]}, NOW)
    return store


@pytest.mark.parametrize(
    "since, until, bucket, more, want",
    [
        ("10:00:10", "10:03:00", "1m", {}, {"10:00": 2, "10:01": 2, "10:02": 2}),
        ("10:01:00", "10:04:50", "1m", {}, {"10:01": 2, "10:02": 2, "10:03": 1}),
        ("10:00:00", "10:04:50", "5m", {"group_by": "service"}, {"A": 5, "B": 2}),
        ("10:00:00", "10:05:00", "5m", {}, {"10:00": 8}),
        ("10:00:30", "10:03:00", "1m", {}, {"10:00": 1, "10:01": 2, "10:02": 2}),
        ("10:00:30", "10:03:20", "1m", {}, {"10:00": 1, "10:01": 2, "10:02": 2, "10:03": 1}),
        ("10:00:30", "10:04:30", "5m", {}, {"10:00": 6}),
        ("10:00:00", "10:05:00", "5m", {"group_by": "level"}, {"error": 2, "info": 4, "warn": 2}),
        ("10:00:00", "10:05:00", "5m", {"service": "A"}, {"10:00": 5}),
        ("10:00:00", "10:05:00", "5m", {"level": "info"}, {"10:00": 4}),
        ("10:00:00", "10:05:00", "5m", {"q": "NEEDLE"}, {"10:00": 1}),
        ("10:00:00", "10:05:00", "5m", {"attr.region": "us-east"}, {"10:00": 2}),
    ],
)
def test_aggregate(counted, since, until, bucket, more, want):
    q = AggregateQuery.from_params({"since": f"2023-06-15T{since}Z", "until": f"2023-06-15T{until}Z", "bucket": bucket} | more)
    for rollups in (counted.rollups(), None):
        found = aggregate(counted.logs(), q, rollups)["buckets"]
        assert {b["group"] or b["start"][11:16]: b["count"] for b in found} == want
        assert all(b["group"] is None for b in found) == ("group_by" not in more)


def test_rollup_path_equals_raw_path(spark, sf_dir):
    import random

    from bucketwise.sources.events import events_as_logs

    logs = events_as_logs(spark, sf_dir).cache()
    rollups = build_rollup(logs).cache()
    rng, low = random.Random(5), parse_instant("2024-01-01T00:00:00Z")
    for _ in range(6):
        since = low + rng.randrange(10**12)
        q = AggregateQuery(since, since + rng.choice([10**7, 10**11, 10**12]), rng.choice(["1m", "5m", "1h", "1d"]), rng.choice([None, "service", "level"]), rng.choice([None, "click"]))
        assert sorted(rollup_counts(logs, rollups, q).collect()) == sorted(raw_counts(logs, q).collect())


def test_buckets_before_the_epoch(spark):
    df = spark.createDataFrame([("1969-12-31 23:59:59",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    for bucket, want in (("1m", "1969-12-31 23:59:00"), ("5m", "1969-12-31 23:55:00"), ("1h", "1969-12-31 23:00:00"), ("1d", "1969-12-31 00:00:00")):
        assert str(df.select(bucket_start(F.col("t"), bucket).alias("b")).first().b) == want


def test_number_text_column(spark):
    values = [1.0, 1e3, 1e7, 1e21, -0.0, 0.1, 1e-7, 1.5, float(2**53 + 1), -2.5e10]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", number_text_column(F.col("v")).alias("t"))
    assert all(r.t == number_text(r.v) for r in df.collect())


def test_store_lifecycle(store):
    logs = [entry(f"2020-07-{d}T10:15:00Z", message=f"m{d}{i}") for d in (12, 13, 14, 15) for i in range(2)]
    ingest_batch(store, {"logs": logs}, NOW)
    again = ingest_batch(store, {"logs": logs[:2]}, NOW)
    assert again.accepted == 2 and store.days() == ["2020-07-12", "2020-07-13", "2020-07-14", "2020-07-15"]
    before = sorted((r.id, r.message) for r in store.logs().collect())
    assert len({i for i, _ in before}) == 10
    store.compact("2020-07-12", file_rows=1)
    store.rebuild_rollups("2020-07-13")
    assert {len(d) for d in store.visible("rollups").values()} == {1, 2}
    assert store.rollups().where("day = '2020-07-12'").select("count").first()[0] == 4
    assert sorted((r.id, r.message) for r in store.logs().collect()) == before
    assert store.rollups().groupBy().sum("count").first()[0] == 10
    now = datetime(2020, 8, 13, 12, tzinfo=timezone.utc)
    assert store.drop_expired(30, now) == ["2020-07-12", "2020-07-13"]
    assert store.drop_expired(30, now) == []
    assert store.days() == ["2020-07-14", "2020-07-15"]
    assert {str(r.day) for r in store.rollups().select("day").collect()} == {"2020-07-14", "2020-07-15"}


def test_expired_rows_leave_no_file(store, tmp_path):
    logs = [entry(f"2020-07-{d}T10:15:00Z") for d in (12, 20)]
    ingest_batch(store, {"logs": logs}, NOW)
    ingest_batch(store, {"logs": logs[:1]}, NOW)
    store.compact("2020-07-12")
    store.rebuild_rollups("2020-07-12")
    assert len(list(tmp_path.rglob("day=2020-07-12"))) > 4
    assert store.drop_expired(7, datetime(2020, 7, 21, tzinfo=timezone.utc)) == ["2020-07-12"]
    assert not list(tmp_path.rglob("day=2020-07-12")) and store.days() == ["2020-07-20"]
    ingest_batch(store, {"logs": logs[1:]}, NOW)
    store.compact("2020-07-20")
    before, count = len(list(tmp_path.rglob("day=2020-07-20"))), store.logs().count()
    assert store.vacuum(datetime.now(timezone.utc)) == 0
    assert store.vacuum(datetime.now(timezone.utc) + timedelta(days=2)) == before - 2 and store.logs().count() == count


def test_two_writers(spark, store):
    other = LogStore(spark, store.base)
    state = store.state()
    first = store._commit(Manifest("a", order=state.order + 1))
    assert first and other._commit(Manifest("b", order=state.order + 1)) is None
    with ThreadPoolExecutor(4) as pool:
        results = list(pool.map(lambda s: ingest_batch(s, {"logs": [entry(), entry()]}, NOW).status, [store, other, store, other]))
    assert results == [200] * 4
    assert [m.order for m in other.manifests()] == list(range(5))
    ids = [r.id for r in store.logs().collect()]
    assert len(set(ids)) == 8 and store.rollups().groupBy().sum("count").first()[0] == 8
    # a swap whose day was swapped meanwhile is given up
    day = store.days()[0]
    frames = lambda: (other.compact(day), {"logs": store.logs(), "rollups": store.rollups()})[1]
    assert store._replace("late", day, ["logs", "rollups"], frames) is None
    assert sorted(r.id for r in other.logs().collect()) == sorted(ids)


def test_manifest_checkpoints(spark, store, monkeypatch):
    monkeypatch.setattr(store_module, "CHECKPOINT_EVERY", 3)
    rows = spark.createDataFrame([(0, NOW, "info", "s", "m", "{}", {})], "position long, timestamp timestamp, level string, service string, message string, attributes string, attributes_text map<string,string>")
    for k in [*range(6), 8, *range(6)]:
        store.append(rows, f"stream-{k}")
    assert store.state().numbers == {"stream": [[0, 5], [8, 8]]}
    fresh = LogStore(spark, store.base)
    assert fresh.state() == store.state() and fresh.logs().count() == 7
    assert len(fresh.manifests()) < 7  # those that checkpoints cover go
    assert fresh.append(rows, "stream-8").order == -1 and fresh.append(rows, "stream-7").order == 7


def test_attribute_columns(spark, store):
    ingest_batch(store, {"logs": [entry(attributes={"user_id": 7}), entry(attributes={"user_id": "8", "x": 1}), entry()]}, NOW)
    found = matching(store.logs(), LogQuery(attributes={"user_id": "7"}))
    assert found.count() == 1 and "EqualTo(attribute_user_id,7)" in found._jdf.queryExecution().toString()
    assert LogStore(spark, store.base, promoted=()).promoted == ("user_id",)


def test_dense_numbers(spark):
    lines = spark.createDataFrame([(str(i),) for i in range(50)], "value string").repartition(7).where("value % 3 > 0")
    held, placed = numbered(lines)
    rows = placed.collect()
    assert sorted(r.position for r in rows) == list(range(len(rows))) and len(rows) == 33
    held.unpersist()
    assert numbered(lines.limit(0))[1].collect() == []


def test_requests_coalesce_and_overload(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/engine", BatchConfig(max_logs=7, batch_size=100, delay_ms=300))
    gate = threading.Event()
    write = engine.batcher.write
    engine.batcher.write = lambda requests: (gate.wait(20), write(requests))[1]
    with ThreadPoolExecutor(3) as pool:
        good = pool.submit(engine.ingest, {"logs": [entry()] * 2}, NOW)
        mixed = pool.submit(engine.ingest, {"logs": [entry(level="x"), entry(), entry(), entry()]}, NOW)
        while engine.metrics.gauges["ingestion_in_flight_logs"] < 6:
            time.sleep(0.01)
        refused = engine.ingest({"logs": [entry()] * 2}, NOW)
        assert (refused.status, refused.body(), refused.retry_after) == (503, {"error": "ingestion overloaded"}, 1)
        gate.set()
        assert good.result(60).body() == {"accepted": 2, "rejected": []}
        assert mixed.result(60).accepted == 3 and [r["index"] for r in mixed.result().rejected] == [0]
    engine.close()
    assert engine.ingest({"logs": [entry()]}, NOW).status == 503
    assert engine.store.logs().count() == 5
    text = engine.metrics.render()
    assert "ingestion_in_flight_requests 0" in text and "logs_accepted_total 5" in text and "logs_rejected_total 1" in text


def test_shared_folder():
    fake = lambda master, folder: SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, applicationId="x")
    )
    assert shared_folder(fake("yarn", "hdfs://a/b/")) == "hdfs://a/b"
    assert shared_folder(fake("local[2]", None)).startswith("file://")
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(fake(master, None))


def test_uncommitted_batches_do_not_exist(store, monkeypatch):
    monkeypatch.setattr(store, "_commit", lambda m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ingest_batch(store, {"logs": [entry()]}, NOW)
    assert store.logs().count() == 0 and store.rollups().count() == 0


@pytest.mark.parametrize(
    "now, days, want",
    [("2026-08-13T15:30", 0, "2026-08-13"), ("2026-08-13T15:30", 30, "2026-07-14"), ("2026-03-05T00:00", 10, "2026-02-23"), ("2026-01-10T00:00", 30, "2025-12-11"), ("2024-03-01T00:00", 1, "2024-02-29")],
)
def test_retention_cutoff(now, days, want):
    assert str(retention_cutoff(days, datetime.fromisoformat(now).replace(tzinfo=timezone.utc))) == want


def test_retention_days():
    assert (retention_days(None), retention_days("0"), retention_days("7")) == (30, 0, 7)
    for bad in ("-1", "1.5", "x"):
        with pytest.raises(ValueError):
            retention_days(bad)


def test_stream_ingest_is_idempotent(spark, tmp_path, store):
    import json

    for i in range(3):
        (tmp_path / f"in{i}.json").write_text("\n".join(json.dumps(entry(f"2020-01-0{i + 1}T00:00:{s:02d}Z")) for s in range(5)) + '\n{"level":1}\n')
    lines = lambda: spark.readStream.option("maxFilesPerTrigger", 1).text(f"file://{tmp_path}/in*.json")
    published = []
    ingest_stream(store, lines(), f"file://{tmp_path}/cp", f"file://{tmp_path}/bad", publish=lambda df: published.append(df.count())).awaitTermination()
    assert store.logs().count() == 15 and store.rollups().groupBy().sum("count").first()[0] == 15
    assert published == [5, 5, 5]
    bad = spark.read.parquet(f"file://{tmp_path}/bad")
    assert [r.reason for r in bad.collect()] == ["invalid timestamp"] * 3
    # all batches again, as after a lost checkpoint: nothing is committed twice
    ingest_stream(store, lines(), f"file://{tmp_path}/cp2", f"file://{tmp_path}/bad").awaitTermination()
    assert store.logs().count() == 15


def test_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/engine")
    assert engine.prepare(env={}) == [] and engine.ready
    stream = engine.listen()
    base = datetime.now(timezone.utc).replace(second=0, microsecond=0) - timedelta(minutes=2)
    logs = [entry((base + timedelta(seconds=s)).isoformat(), service="A", message="payment", attributes={"user_id": u}) for s, u in ((5, 42), (20, "42"), (40, 7))]
    assert engine.ingest({"logs": logs}).status == 200
    status, page = engine.search({"service": "A", "attr.user_id": "42", "q": "PAY"})
    assert status == 200 and [r["attributes"]["user_id"] for r in page["logs"]] == ["42", 42]
    status, counts = engine.aggregate({"since": base.isoformat(), "until": (base + timedelta(minutes=1)).isoformat(), "bucket": "1m"})
    assert status == 200 and [(b["count"], b["group"]) for b in counts["buckets"]] == [(3, None)]
    assert engine.search({"limit": "0"}) == (400, {"error": "limit must be at least 1"})
    frames = stream.frames()
    assert next(frames) == ": connected\n\n" and next(frames).startswith('event: logs\ndata: {"logs":[')
    stream.close()
    text = engine.metrics.render()
    assert "logs_accepted_total 3" in text and 'query_duration_seconds_bucket{le="+Inf"} 2' in text
