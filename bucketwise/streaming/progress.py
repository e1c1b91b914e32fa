"""Progress of streaming queries as metrics."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from bucketwise.metrics import Metrics


class StreamProgress(StreamingQueryListener):
    """Counts batches and input rows of the queries that it watches, by their names.

    Spark calls it from a thread of its own, some time after a batch."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics
        self.names: set[str] = set()
        self._session: SparkSession | None = None

    def watch(self, spark: SparkSession, name: str) -> None:
        self.names.add(name)
        if self._session is None:
            self._session = spark
            spark.streams.addListener(self)

    def close(self) -> None:
        if self._session is not None:
            self._session.streams.removeListener(self)
            self._session = None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name not in self.names:
            return
        self.metrics.add("stream_batches_total")
        self.metrics.add("stream_input_rows_total", p.numInputRows)
        self.metrics.set("stream_last_batch", p.batchId)
        self.metrics.observe("stream_batch_duration_seconds", p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
