"""Ingestion: one path for request batches and for streams of JSON lines."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bucketwise.model import REJECTED
from bucketwise.operators.validate import open_envelope, split, validated
from bucketwise.sources.store import LogStore


OVERLOADED = "ingestion overloaded"
TOO_LARGE = "request body is too large"
#: Bytes of a request's body, and of the bodies of a stream's batch, at most.
BODY_BYTES, BATCH_BYTES = 1 << 20, 64 << 20
#: Tasks that list a batch's files, for each core at most; Spark's own setting is a task a file.
LISTING, LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 2
_ENTRIES = "request long, index long, raw string, received timestamp, position long"


@dataclass(frozen=True)
class BatchCounts:
    """Entries of a batch of a stream that was committed just now."""

    accepted: int
    rejected: int


@dataclass
class IngestResult:
    """What the API answers: 200 if any entry was accepted, 400 if none, 503
    (with a header Retry-After) if the request was not admitted."""

    status: int
    accepted: int = 0
    rejected: list[dict] = field(default_factory=list)
    error: str | None = None
    retry_after: int | None = None

    def body(self) -> dict:
        return {"error": self.error} if self.error else {"accepted": self.accepted, "rejected": self.rejected}


def ingest_requests(
    store: LogStore, requests: list[tuple[list, datetime | None]], publish: Callable[[list[dict]], None] | None = None
) -> list[IngestResult]:
    """Validate the entries of several requests, each with the time that it came
    (by default now), commit what is valid as one batch, then tell the tail."""
    now = datetime.now(timezone.utc)
    rows = [
        (k, i, json.dumps(entry, ensure_ascii=False), at or now) for k, (logs, at) in enumerate(requests) for i, entry in enumerate(logs)
    ]
    # requests are bounded by the batch's limit; one run over them serves all
    frame = store.spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], _ENTRIES)
    judged = validated(frame, F.col("received")).persist()
    try:
        valid, bad = split(judged, ["request", "index", "position"])
        rejected: list[list[dict]] = [[] for _ in requests]
        for r in bad.orderBy("position").collect():
            rejected[r.request].append({"index": r["index"], "reason": r.reason})
        if sum(map(len, rejected)) < len(rows):
            store.append(valid)
            if publish:
                publish(as_published(valid.orderBy("position")))
        counts = [len(logs) - len(gone) for (logs, _), gone in zip(requests, rejected)]
        return [IngestResult(200 if n else 400, n, gone) for n, gone in zip(counts, rejected)]
    finally:
        judged.unpersist()


def as_published(rows: DataFrame) -> list[dict]:
    """Rows as the tail shows them; the caller bounds their number."""
    text = rows.select(F.to_json(F.struct("timestamp", "level", "service", "message")).alias("j"), "attributes")
    return [json.loads(r.j) | {"attributes": json.loads(r.attributes)} for r in text.collect()]


def ingest_batch(
    store: LogStore, body: object, now: datetime | None = None, publish: Callable[[list[dict]], None] | None = None
) -> IngestResult:
    """Validate one request body, commit what is valid, then tell the tail."""
    envelope = open_envelope(body)
    if envelope.error:
        return IngestResult(400, error=envelope.error)
    return ingest_requests(store, [(envelope.logs, now)], publish)[0]


def numbered(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """``lines`` persisted as (raw, error, place), and the same with ``position``
    for ``place`` (see :func:`positioned`).  ``error`` is null where there is none."""
    held = _raw(lines, value).persist()
    return held, positioned(held).select("raw", "error", "position")


def _raw(lines: DataFrame, value: str) -> DataFrame:
    error = F.col("error") if "error" in lines.columns else F.lit(None).cast("string")
    return lines.select(F.col(value).alias("raw"), error.alias("error"), F.monotonically_increasing_id().alias("place"))


def positioned(held: DataFrame) -> DataFrame:
    """Persisted rows with ``position`` for ``place``: dense numbers from 0, by the rows
    of each partition (one number of each partition reaches the driver)."""
    part, inside = F.shiftright("place", 33).cast("int"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("part")).agg(F.max(inside).alias("last")).collect()
    starts, total = [], 0
    for r in sorted(counts, key=lambda r: r.part):
        starts += [F.lit(r.part), F.lit(total)]
        total += r.last + 1
    before = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return held.withColumn("position", (before + inside).cast("long")).drop("place")


def ingest_stream(
    store: LogStore,
    lines: DataFrame,
    checkpoint: str,
    rejects: str | None = None,
    publish: Callable[[DataFrame], None] | None = None,
    trigger: dict | None = None,
    name: str = "ingest",
    report: Callable[[BatchCounts], None] | None = None,
) -> StreamingQuery:
    """Ingest a stream with a string column ``value`` of JSON entries, and if it
    likes ``error``: why there is no entry (see :func:`requests_from_files`).

    Each micro-batch is one store batch named after its number, so a batch that
    is repeated after a failure is committed once.  Rows may be as late as they
    like: rollup deltas add up in any order, so there is no watermark and no
    state.  Rejected entries are written to ``rejects``.

    ``report`` gets the numbers of entries of each batch after it was committed,
    before ``publish`` gets its rows.  The numbers are observed while the rows are
    written, so they cost no pass of their own; a batch that an earlier run has
    committed is neither reported nor published again.
    """

    def commit(batch: DataFrame, number: int) -> None:
        # entries are read, judged and kept by the pass that counts them, without their text
        judged = validated(_raw(batch, "value")).withColumn("reason", F.coalesce("error", "reason")).drop("raw", "error")
        held = judged.persist()
        try:
            judged = positioned(held)
            counts = Observation(f"{name}-{number}")
            accepted, rejected = F.count_if(F.col("reason").isNull()), F.count("reason")
            valid, bad = split(judged, ["position"])
            observed, _ = split(judged.observe(counts, accepted.alias("accepted"), rejected.alias("rejected")), ["position"])
            fresh = store.append(observed, f"{name}-{number}").order >= 0
            if rejects:
                out = bad.select(F.lit(f"{name}-{number}").alias("batch_id"), F.col("position").alias("index"), "reason")
                out.select(*REJECTED.fieldNames()).write.mode("overwrite").parquet(f"{rejects}/batch={name}-{number}")
            if fresh and report:
                report(BatchCounts(**counts.get))
            if fresh and publish:
                publish(valid)
        finally:
            held.unpersist()

    writer = lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def lines_from_files(spark: SparkSession, path: str, per_batch: int | None = None, bytes_per_batch: int | None = None) -> DataFrame:
    """A stream of JSON lines from the files that arrive in a folder, with so many
    files or bytes a batch at most (but one file at least)."""
    return _arriving(spark, per_batch, bytes_per_batch).text(path)


def requests_from_files(spark: SparkSession, path: str, per_batch: int | None = None, bytes_per_batch: int | None = BATCH_BYTES, lines: bool = False) -> DataFrame:
    """A stream of entries from the request bodies that arrive in a folder, one body a file,
    or with ``lines`` one a line of files that hold many (an empty line is no request).

    A batch takes whole files up to ``bytes_per_batch``; a larger one is a batch
    of its own.  The source's log says which files a batch has, so a batch that is
    repeated after a failure has the same ones.  Bodies are taken apart by
    expressions: ``value`` has an entry, or ``error`` the reason why a body has none.
    A file without a byte is no request.

    Batches have thousands of files: the session lists them in few tasks, for the
    driver would start one for each file, about three milliseconds each."""
    few = LISTING_TASKS * spark.sparkContext.defaultParallelism
    spark.conf.set(LISTING, str(min(few, int(spark.conf.get(LISTING)))))
    body = F.try_parse_json(F.col("value"))
    bodies = _arriving(spark, per_batch, bytes_per_batch).option("wholetext", str(not lines).lower()).text(path)
    if lines:
        bodies = bodies.where("value <> ''")
    fields, logs = F.try_variant_get(body, "$", "map<string,variant>"), F.try_variant_get(body, "$.logs", "array<variant>")
    read = bodies.select(F.octet_length("value").alias("bytes"), fields.alias("fields"), logs.alias("logs"))
    error = (
        F.when(F.col("bytes") > BODY_BYTES, TOO_LARGE)
        .when(F.col("fields").isNull(), "invalid request body")
        .when(F.col("logs").isNull(), "logs must be a non-empty array")
        .when(F.size("logs") == 0, "logs array must not be empty")
        .when(F.size("fields") > 1, "invalid request body")
    )
    judged = read.withColumn("error", error)
    # one row without an entry for a body that has an error
    return judged.select("error", F.explode_outer(F.when(F.col("error").isNull(), F.col("logs"))).alias("entry")).select(
        F.coalesce(F.to_json("entry"), F.lit("null")).alias("value"), "error"
    )


def _arriving(spark: SparkSession, per_batch: int | None, bytes_per_batch: int | None):
    reader = spark.readStream
    if per_batch and bytes_per_batch:
        raise ValueError("a batch is bounded by files or by bytes, not by both")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader
