"""Batching, the tail and metrics, without Spark."""

import threading
import time

import pytest

from bucketwise.metrics import BOUNDS, Metrics
from bucketwise.streaming.batcher import BatchConfig, Batcher, retained_bytes
from bucketwise.streaming.tail import EventStream, LiveTail


def test_requests_coalesce_and_are_never_split():
    batches, gate = [], threading.Event()

    def write(requests):
        gate.wait(5)
        batches.append([x for logs, _ in requests for x in logs])
        return [len(logs) for logs, _ in requests]

    b = Batcher(write, BatchConfig(batch_size=4, delay_ms=5))
    first = b.offer([0], 1)
    time.sleep(0.1)
    jobs = [b.offer([i] * 3, 1) for i in (1, 2)] + [b.offer([9] * 9, 1)]
    gate.set()
    assert first.result(5) == 1 and [j.result(5) for j in jobs] == [3, 3, 9]
    assert batches == [[0], [1] * 3, [2] * 3, [9] * 9]
    b.close()
    b.close()
    assert b.offer([1], 1) is None and b.in_flight == (0, 0, 0)


def test_admission_limits():
    gate = threading.Event()
    seen = []
    write = lambda requests: [gate.wait(5) for _ in requests]
    b = Batcher(write, BatchConfig(max_requests=2, max_logs=5, max_bytes=100, delay_ms=0), lambda *x: seen.append(x))
    assert b.offer([1, 2], 60) is not None
    assert b.offer([1], 41) is None
    assert b.offer([1] * 4, 1) is None
    assert b.offer([1], 40) is not None
    assert b.offer([1], 0) is None
    gate.set()
    b.close()
    assert (2, 3, 100) in seen and seen[-1] == (0, 0, 0)


def test_a_failed_batch_fails_its_requests_only():
    calls = []

    def write(requests):
        calls.append(requests)
        if len(calls) == 1:
            raise OSError("down")
        return [len(logs) for logs, _ in requests]

    b = Batcher(write, BatchConfig(delay_ms=0))
    with pytest.raises(OSError):
        b.offer([1], 1).result(5)
    assert b.offer([2], 1).result(5) == 1
    b.close()


def test_config():
    assert BatchConfig.from_environment({}) == BatchConfig()
    assert BatchConfig.from_environment({"INGESTION_BATCH_DELAY_MS": "0"}).delay_ms == 0
    for name in ("MAX_IN_FLIGHT_INGESTIONS", "INGESTION_BATCH_SIZE"):
        with pytest.raises(ValueError, match=f"{name} must be a positive integer"):
            BatchConfig.from_environment({name: "0"})
    assert (retained_bytes(10), retained_bytes(1000)) == (2048, 8000)


def test_tail():
    tail, got = LiveTail(), []
    leave = tail.subscribe(got.append)
    tail.subscribe(lambda logs: 1 / 0)
    tail.publish([])
    tail.publish([{"m": 1}])
    assert got == [[{"m": 1}]] and tail.subscribers == 1
    leave()
    leave()
    tail.publish([{"m": 2}])
    assert len(got) == 1


def test_event_stream_drops_and_beats():
    tail = LiveTail()
    stream = EventStream(tail, capacity=1, heartbeat=0.05)
    for i in range(3):
        tail.publish([{"i": i}])
    frames = stream.frames()
    assert [next(frames) for _ in range(3)] == [": connected\n\n", 'event: logs\ndata: {"logs":[{"i":0}]}\n\n', ": heartbeat\n\n"]
    assert stream.dropped == 2
    stream.close()
    assert list(frames) == [] and tail.subscribers == 0


def test_histogram_is_cumulative():
    m = Metrics()
    for v in (0.0005, 0.03, 7):
        m.observe("query_duration_seconds", v)
    h = m.histograms["query_duration_seconds"]
    assert h["count"] == 3 and h["buckets"] == [1 if b < 0.03 else 2 for b in BOUNDS]
