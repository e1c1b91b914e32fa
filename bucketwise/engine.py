"""The engine as one object: ingest, search, aggregate, tail, retention, metrics."""

from __future__ import annotations

import json
import logging
import os
import threading
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bucketwise.metrics import GAUGES, Metrics
from bucketwise.operators.aggregate import aggregate
from bucketwise.operators.search import page_of
from bucketwise.operators.validate import open_envelope
from bucketwise.plans.query import AggregateQuery, LogQuery
from bucketwise.sources.store import LogStore, retention_days
from bucketwise.sources.upkeep import Upkeep, UpkeepConfig
from bucketwise.streaming.batcher import BatchConfig, Batcher, retained_bytes
from bucketwise.streaming.ingest import OVERLOADED, BatchCounts, IngestResult, as_published, ingest_requests, ingest_stream
from bucketwise.streaming.progress import StreamProgress
from bucketwise.streaming.tail import EventStream, LiveTail

log = logging.getLogger(__name__)

#: Rows of a stream's batch that the tail gets, at most: the last ones.
TAIL_ROWS = 1000


class Engine:
    """Methods answer ``(status, body)`` as an HTTP interface would.

    Requests that come at once are coalesced: they are validated and committed
    as one batch, within limits on the requests, entries and bytes in flight.

    After each batch ``upkeep`` merges pieces of days in the background, if due;
    None leaves that to another process."""

    def __init__(self, spark: SparkSession, base: str, batching: BatchConfig | None = None, upkeep: UpkeepConfig | None = UpkeepConfig()):
        self.spark = spark
        self.store = LogStore(spark, base)
        self.tail = LiveTail()
        self.metrics = Metrics()
        self.batcher = Batcher(self._write, batching or BatchConfig.from_environment(), self._in_flight)
        self.progress = StreamProgress(self.metrics)
        self.upkeep = Upkeep(self.store, upkeep) if upkeep else None
        self.ready = False

    def prepare(self, now: datetime | None = None, env: Mapping[str, str] = os.environ) -> list[str]:
        """Check the store, drop expired days; a failure to drop is logged."""
        if not self.healthy():
            raise RuntimeError("the session does not answer")
        dropped: list[str] = []
        try:
            dropped = self.store.drop_expired(retention_days(env.get("RETENTION_DAYS")), now or datetime.now(timezone.utc))
        except Exception:
            log.exception("retention failed")
        self.ready = True
        return dropped

    def healthy(self, seconds: float = 10.0) -> bool:
        """Whether the session runs a trivial job within the time."""
        answer: list[int] = []

        def probe() -> None:
            answer.append(self.spark.range(1).count())

        thread = threading.Thread(target=probe, daemon=True)
        thread.start()
        thread.join(seconds)
        return answer == [1]

    def ingest(self, body: object, now: datetime | None = None, size: int | None = None) -> IngestResult:
        """``size``: bytes of the request's body, if known.  May be called from
        many threads; returns when the request's batch is committed."""
        self.metrics.add("ingestion_requests_total")
        envelope = open_envelope(body)
        if envelope.error:
            return IngestResult(400, error=envelope.error)
        if size is None:
            size = len(json.dumps(body, ensure_ascii=False).encode("utf-8", "surrogatepass"))
        pending = self.batcher.offer(envelope.logs, retained_bytes(size), now)
        if pending is None:
            return IngestResult(503, error=OVERLOADED, retry_after=1)
        result = pending.result()
        self.metrics.add("logs_rejected_total", len(result.rejected))
        self.metrics.add("logs_accepted_total", result.accepted)
        return result

    def _write(self, requests: list) -> list[IngestResult]:
        with self.metrics.timed("ingestion_db_write_duration_seconds"):
            results = ingest_requests(self.store, requests, self.tail.publish)
        self._kept_up()
        accepted = sum(r.accepted for r in results)
        if accepted:
            self.metrics.add("ingestion_db_writes_total")
            self.metrics.add("ingestion_db_write_logs_total", accepted)
        return results

    def _kept_up(self) -> None:
        if self.upkeep:
            self.upkeep.wake()

    def _in_flight(self, requests: int, logs: int, size: int) -> None:
        for name, value in zip(GAUGES, (requests, logs, size)):
            self.metrics.set(name, value)

    def stream(
        self, lines: DataFrame, checkpoint: str, rejects: str | None = None, trigger: dict | None = None, name: str = "ingest", tail_rows: int = TAIL_ROWS
    ) -> StreamingQuery:
        """Ingest a stream of JSON entries.  Its entries are counted like those of
        requests; the tail gets the last ``tail_rows`` rows of each batch once it
        is committed, and the others are counted as dropped."""
        latest = BatchCounts(0, 0)

        def report(counts: BatchCounts) -> None:
            nonlocal latest
            latest = counts
            self._kept_up()
            self.metrics.add("logs_accepted_total", counts.accepted)
            self.metrics.add("logs_rejected_total", counts.rejected)
            if counts.accepted:
                self.metrics.add("ingestion_db_writes_total")
                self.metrics.add("ingestion_db_write_logs_total", counts.accepted)

        def publish(valid: DataFrame) -> None:
            if not self.tail.subscribers:
                return
            rows = as_published(valid.orderBy(F.col("position").desc()).limit(tail_rows))[::-1]
            self.metrics.add("tail_rows_dropped_total", latest.accepted - len(rows))
            self.tail.publish(rows)

        self.progress.watch(self.spark, name)
        return ingest_stream(self.store, lines, checkpoint, rejects, publish, trigger, name, report)

    def close(self) -> None:
        """Take no more requests and commit those that are waiting."""
        self.batcher.close()
        self.progress.close()
        if self.upkeep:
            self.upkeep.close()

    def search(self, params: Mapping[str, object]) -> tuple[int, dict]:
        self.metrics.add("query_requests_total")
        with self.metrics.timed("query_duration_seconds"):
            try:
                query = LogQuery.from_params(params)
            except ValueError as e:
                return 400, {"error": str(e)}
            return 200, page_of(self.store.newest(query), query)

    def aggregate(self, params: Mapping[str, object]) -> tuple[int, dict]:
        self.metrics.add("aggregation_requests_total")
        with self.metrics.timed("aggregation_duration_seconds"):
            try:
                query = AggregateQuery.from_params(params)
            except ValueError as e:
                return 400, {"error": str(e)}
            state = self.store.state()
            if query.rollup_answers:
                return 200, aggregate(self.store.logs(state), query, self.store.rollups(state))
            return 200, aggregate(self.store.logs_for(query, state), query)

    def listen(self, capacity: int = 64) -> EventStream:
        return EventStream(self.tail, capacity)
