"""Counts of streams, observed while rows are written, and the tail of a stream."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from bucketwise.engine import Engine
from bucketwise.functions.time import instant_column, parse_instant
from bucketwise.operators.validate import open_envelope
from bucketwise.sources.store import LogStore
from bucketwise.streaming.ingest import BODY_BYTES, TOO_LARGE, BatchCounts, ingest_stream, requests_from_files


def lines_of(spark, folder, entries, per_file):
    folder.mkdir()
    for k in range(0, len(entries), per_file):
        file = folder / f"{k:06d}.json"
        file.write_text("\n".join(map(json.dumps, entries[k : k + per_file])))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # the source takes older files first
    return lambda: spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(f"file://{folder}")


def entry(i):
    return {"timestamp": f"2024-05-01T10:{i % 60:02d}:00Z", "level": "info" if i % 7 else "odd", "service": "s" if i % 5 else " ", "message": f"m{i}"}


def test_counters_equal_what_was_kept_and_rejected(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    entries = [entry(i) for i in range(180)]
    lines = lines_of(spark, tmp_path / "in", entries, 60)
    shown = []
    engine.tail.subscribe(shown.append)
    engine.stream(lines(), f"file://{tmp_path}/cp", f"file://{tmp_path}/bad", tail_rows=10).awaitTermination()
    rejected = sum(i % 7 == 0 or i % 5 == 0 for i in range(180))
    counters = engine.metrics.counters
    assert counters["logs_accepted_total"] == engine.store.logs().count() == 180 - rejected
    assert counters["logs_rejected_total"] == spark.read.parquet(f"{tmp_path}/bad").count() == rejected
    assert counters["ingestion_db_writes_total"] == 3 and counters["ingestion_db_write_logs_total"] == 180 - rejected
    # the tail: the last rows of each batch, in order, after its commit
    kept = [[f"m{i}" for i in range(a, a + 60) if i % 7 and i % 5] for a in (0, 60, 120)]
    assert [[r["message"] for r in batch] for batch in shown] == [k[-10:] for k in kept]
    assert counters["tail_rows_dropped_total"] == sum(len(k) - 10 for k in kept)
    for _ in range(100):  # progress comes from a thread of Spark's
        if counters["stream_batches_total"] >= 3:
            break
        time.sleep(0.1)
    assert (counters["stream_batches_total"], counters["stream_input_rows_total"]) == (3, 180)
    assert engine.metrics.gauges["stream_last_batch"] == 2
    assert "stream_batch_duration_seconds_count 3" in engine.metrics.render()
    # a run that repeats committed batches counts and shows nothing again
    engine.stream(lines(), f"file://{tmp_path}/cp2").awaitTermination()
    assert counters["logs_accepted_total"] == 180 - rejected and len(shown) == 3
    engine.close()
    engine.close()


def test_counts_cost_no_pass(spark, tmp_path, monkeypatch):
    """As many Spark jobs with the report as without."""
    jobs = []
    for k, report in enumerate((None, lambda counts: seen.append(counts))):
        seen = []
        lines = lines_of(spark, tmp_path / f"in{k}", [entry(i) for i in range(40)], 40)
        store = Engine(spark, f"file://{tmp_path}/store{k}").store
        query = ingest_stream(store, lines(), f"file://{tmp_path}/cp{k}", report=report)
        query.awaitTermination()
        tracker = spark.sparkContext.statusTracker()
        jobs.append(len(tracker.getJobIdsForGroup(str(query.runId))))
    assert jobs[0] == jobs[1] and seen == [BatchCounts(28, 12)]


@pytest.mark.parametrize("end", ["\n", "\r", " ", " ", "x", "\n\n"])
def test_nothing_may_follow_a_timestamp(spark, end):
    text = "2024-01-01T00:00:00Z" + end
    with pytest.raises(ValueError):
        parse_instant(text)
    df = spark.createDataFrame([(text,), (text[:20],)], "t string").select(instant_column(F.col("t")).alias("i"))
    assert [r.i is None for r in df.collect()] == [True, False]


def test_of_a_repeated_key_the_last_counts_in_batches_and_streams(spark, tmp_path):
    text = '{"timestamp":"2024-05-01T10:00:00Z","level":"odd","level":"info","service":"s","message":"m","attributes":{"a":1,"a":"2"}}'
    engine = Engine(spark, f"file://{tmp_path}/store")
    assert engine.ingest(json.loads(f'{{"logs": [{text}]}}')).accepted == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(text)
    engine.stream(spark.readStream.text(f"file://{tmp_path}/in"), f"file://{tmp_path}/cp").awaitTermination()
    rows = engine.store.logs().collect()
    assert [(r.level, r.attributes, r.attributes_text) for r in rows] == [("info", '{"a":"2"}', {"a": "2"})] * 2
    engine.close()


def bodies(folder, texts):
    folder.mkdir()
    for k, text in enumerate(texts):
        file = folder / f"{k:04d}.json"
        file.write_text(text)
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))


def test_request_bodies_are_judged_like_requests(spark, tmp_path):
    odd = ["[1]", " ", "{", "null", '{"logs":1}', "{}", '{"logs":[]}', '{"logs":[1],"x":1}', '{"logs":[null,5,"x",[]]}', json.dumps({"logs": [entry(1), entry(5), {"a": {"b": 1.50}}]})]
    large = json.dumps({"logs": [entry(2) | {"message": "x" * BODY_BYTES}]})
    bodies(tmp_path / "in", [*odd, large])
    store = LogStore(spark, f"file://{tmp_path}/s")
    ingest_stream(store, requests_from_files(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/cp", f"file://{tmp_path}/bad").awaitTermination()
    want = [TOO_LARGE]
    for text in odd:
        try:
            envelope = open_envelope(json.loads(text))
        except ValueError:
            envelope = open_envelope(None)
        want += [envelope.error] if envelope.error else []
    want += ["invalid log entry"] * 4 + ["service must be a non-empty string", "invalid timestamp"]
    assert sorted(r.reason for r in spark.read.parquet(f"{tmp_path}/bad").collect()) == sorted(want)
    assert [r.message for r in store.logs().collect()] == ["m1"]


def test_bodies_one_a_line_are_judged_like_files_and_listed_in_few_tasks(spark, tmp_path):
    texts = ["[1]", " ", "{", '{"logs":[]}', '{"logs":[1],"x":1}', *(json.dumps({"logs": [entry(k), entry(5), 7]}) for k in (1, 2, 3))]
    texts.append(json.dumps({"logs": [entry(2) | {"message": "x" * BODY_BYTES}]}))
    bodies(tmp_path / "files", texts)
    bodies(tmp_path / "lines", ["\n\n".join(texts[:4]) + "\n", "", "\n".join(texts[4:])])
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.unset(listing)
    found = []
    for kind in ("files", "lines"):
        at = f"file://{tmp_path}/{kind}"
        store = LogStore(spark, f"{at}-s")
        ingest_stream(store, requests_from_files(spark, at, lines=kind == "lines"), f"{at}-cp", f"{at}-bad").awaitTermination()
        ids = sorted(r.id for r in store.logs().collect())
        assert len(set(ids)) == len(ids)
        found.append((sorted(r.reason for r in spark.read.parquet(f"{at}-bad").collect()), sorted(r.message for r in store.logs().collect())))
    assert found[0] == found[1] and found[0][1] and TOO_LARGE in found[0][0]
    assert int(spark.conf.get(listing)) <= 2 * spark.sparkContext.defaultParallelism


def test_batches_hold_whole_requests_within_their_bytes(spark, tmp_path):
    texts = [json.dumps({"logs": [entry(1) | {"message": f"r{k}-{i}" + "y" * (20_000 if k == 4 else 10)} for i in range(3)]}) for k in range(12)]
    bodies(tmp_path / "in", texts)
    store, bound = LogStore(spark, f"file://{tmp_path}/s"), 2 * len(texts[0]) + 40
    ingest_stream(store, requests_from_files(spark, f"file://{tmp_path}/in", bytes_per_batch=bound), f"file://{tmp_path}/cp").awaitTermination()
    found = [m for m in store.manifests() if m.rows]
    groups = []
    for m in found:
        names = {r.message.split("-")[0] for r in store.logs().where(F.col("id").between(m.next_id - m.rows, m.next_id - 1)).collect()}
        assert m.rows == 3 * len(names)  # no request is split
        groups.append(sorted(int(n[1:]) for n in names))
    assert sorted(k for g in groups for k in g) == list(range(12))
    assert all(len(g) == 1 or sum(len(texts[k]) for k in g) <= bound for g in groups) and [4] in groups and max(map(len, groups)) == 2


@pytest.mark.parametrize("moment", ["before the commit", "after the commit"])
def test_a_restart_in_the_middle_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, moment):
    bodies(tmp_path / "in", [json.dumps({"logs": [entry(1) | {"message": f"r{k}-{i}"} for i in range(2)]}) for k in range(6)])
    store, fails = LogStore(spark, f"file://{tmp_path}/s"), [1]
    run = lambda report: ingest_stream(store, requests_from_files(spark, f"file://{tmp_path}/in", 2, None), f"file://{tmp_path}/cp", report=report)
    append = store.append

    def failing(rows, batch=None):
        if moment == "before the commit" and batch == "ingest-1" and fails:
            append(rows.limit(1).where("false"), None)  # something was done, nothing was kept
            raise OSError(fails.pop())
        return append(rows, batch)

    def report(counts):
        if moment == "after the commit" and store.state().has("ingest-1") and fails:
            raise OSError(fails.pop())

    monkeypatch.setattr(store, "append", failing)
    with pytest.raises(Exception, match="1"):
        run(report).awaitTermination()
    assert not fails and store.logs().count() == (2 if moment == "before the commit" else 4) * 2
    run(report).awaitTermination()
    rows = store.logs().collect()
    assert sorted(r.message for r in rows) == sorted(f"r{k}-{i}" for k in range(6) for i in range(2))
    assert len({r.id for r in rows}) == 12 and store.rollups().groupBy().sum("count").first()[0] == 12
