"""Counters, gauges and cumulative histograms, rendered as Prometheus text."""

from __future__ import annotations

import resource
import threading
import time

# fixed values: names that dashboards of the API know; those of streams are our own
COUNTERS = (
    "ingestion_requests_total",
    "logs_accepted_total",
    "logs_rejected_total",
    "ingestion_db_writes_total",
    "ingestion_db_write_logs_total",
    "query_requests_total",
    "aggregation_requests_total",
    "stream_batches_total",
    "stream_input_rows_total",
    "tail_rows_dropped_total",
)
GAUGES = ("ingestion_in_flight_requests", "ingestion_in_flight_logs", "ingestion_in_flight_bytes", "stream_last_batch")
HISTOGRAMS = (
    "ingestion_db_write_duration_seconds",
    "query_duration_seconds",
    "aggregation_duration_seconds",
    "stream_batch_duration_seconds",
)
BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5)


class Metrics:
    """A registry of the driver process; safe to use from several threads."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._began = time.monotonic()
        self.counters = dict.fromkeys(COUNTERS, 0)
        self.gauges = dict.fromkeys(GAUGES, 0)
        self.histograms = {name: {"count": 0, "sum": 0.0, "buckets": [0] * len(BOUNDS)} for name in HISTOGRAMS}

    def add(self, counter: str, amount: int = 1) -> None:
        with self._lock:
            self.counters[counter] += amount

    def set(self, gauge: str, value: int) -> None:
        with self._lock:
            self.gauges[gauge] = value

    def observe(self, histogram: str, seconds: float) -> None:
        with self._lock:
            h = self.histograms[histogram]
            h["count"] += 1
            h["sum"] += seconds
            h["buckets"] = [n + (seconds <= bound) for n, bound in zip(h["buckets"], BOUNDS)]

    def timed(self, histogram: str) -> "_Timer":
        return _Timer(self, histogram)

    def render(self) -> str:
        with self._lock:
            out = []
            for name, value in self.counters.items():
                out += [f"# TYPE {name} counter", f"{name} {value}"]
            for name, value in self.gauges.items():
                out += [f"# TYPE {name} gauge", f"{name} {value}"]
            for name, h in self.histograms.items():
                out.append(f"# TYPE {name} histogram")
                out += [f'{name}_bucket{{le="{bound}"}} {n}' for bound, n in zip(BOUNDS, h["buckets"])]
                out += [f'{name}_bucket{{le="+Inf"}} {h["count"]}', f"{name}_sum {h['sum']}", f"{name}_count {h['count']}"]
        used = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
        for name, value in (
            ("process_resident_memory_bytes", used),
            ("process_uptime_seconds", round(time.monotonic() - self._began, 3)),
        ):
            out += [f"# TYPE {name} gauge", f"{name} {value}"]
        return "\n".join(out) + "\n"


class _Timer:
    def __init__(self, metrics: Metrics, histogram: str):
        self.metrics, self.histogram = metrics, histogram

    def __enter__(self) -> None:
        self.start = time.perf_counter()

    def __exit__(self, *_: object) -> None:
        self.metrics.observe(self.histogram, time.perf_counter() - self.start)
