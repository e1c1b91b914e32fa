"""A log store of Parquet batches under manifests.

A batch writes its rows (``logs/batch=.../day=...``) and its minute rollup
(``rollups/batch=.../day=...``) first, in a folder of its own; one manifest,
which exactly one writer can create, then makes both visible at once.  Files
without a manifest do not exist for readers, so a failed batch leaves nothing
behind that counts, and repeating a batch of the same name changes nothing.
Rollups are additive deltas, summed on reading; compaction rewrites days and
swaps them in by a manifest that replaces others.

Manifests are numbered without gaps.  Every ``CHECKPOINT_EVERY`` of them are
summed up in a checkpoint, and those that it covers are deleted in time, so a
reader opens one checkpoint and a bounded number of manifests.

Layout: days are partitions; inside a file rows are sorted by service and time,
so row-group statistics serve both service and time filters.  Attributes named
in ``promoted`` also stand in a column of their own, with a Bloom filter for
each row group, so that a search for a value reads few row groups.

Each day of a batch has an index of its files (``index/batch=.../of=<day>``, see
:mod:`bucketwise.sources.file_index`): zones, which the driver reads, and
signatures of texts and attributes.  :meth:`LogStore.candidates` goes through the
files that a query may need, newest first, a day at a time; :meth:`LogStore.choose`
asks the signatures.  Days without an index (of older stores) are read whole.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.functions.time import EPOCH, utc_day
from bucketwise.model import LOG, PROMOTED, ROLLUP, promoted_column
from bucketwise.operators.rollup import build_rollup, merge_rollups
from bucketwise.operators.search import newest_in_files, plan_search, with_micros
from bucketwise.plans.query import AggregateQuery, LogQuery
from bucketwise.session import REPEATED_KEYS
from bucketwise.sources import file_index
from bucketwise.sources.file_index import Zone
from bucketwise.sources.files import Files

_DAY = T.StructField("day", T.DateType())
_NAME = re.compile(r"[A-Za-z0-9_.-]+")
_NUMBERED = re.compile(r"(.+)-(\d+)")
TABLES = ("logs", "rollups")
#: Rows of a file that compaction writes, about.
FILE_ROWS = 5_000_000
CHECKPOINT_EVERY = 32
#: Days of batches whose zones are kept in memory.
ZONES_KEPT = 20_000
#: How often a writer tries again when others commit before it.
ATTEMPTS = 20


@dataclass(frozen=True)
class Manifest:
    batch: str
    folder: str = ""
    rows: int = 0
    next_id: int = 1
    days: list[str] = field(default_factory=list)
    replaces: dict[str, list[str]] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=lambda: list(TABLES))
    named: bool = False
    order: int = 0


@dataclass
class State:
    """What the manifests up to ``order`` add up to."""

    order: int = -1
    next_id: int = 1
    #: Table -> folder -> days that readers see.
    live: dict[str, dict[str, list[str]]] = field(default_factory=lambda: {t: {} for t in TABLES})
    #: Names of committed batches; of ``name-7`` and the like, ranges of numbers.
    names: list[str] = field(default_factory=list)
    numbers: dict[str, list[list[int]]] = field(default_factory=dict)

    def has(self, batch: str) -> bool:
        m = _NUMBERED.fullmatch(batch)
        if not m:
            return batch in self.names
        return any(low <= int(m[2]) <= high for low, high in self.numbers.get(m[1], []))

    def add(self, m: Manifest) -> None:
        self.order, self.next_id = m.order, max(self.next_id, m.next_id)
        for table in m.tables:
            folders = self.live[table]
            for days in folders.values():
                days[:] = [d for d in days if d not in m.dropped]
            for folder, gone in m.replaces.items():
                if folder in folders:
                    folders[folder] = [d for d in folders[folder] if d not in gone]
            if m.days:
                folders[m.folder] = sorted({*folders.get(m.folder, []), *m.days})
            self.live[table] = {f: d for f, d in folders.items() if d}
        if m.named:
            number = _NUMBERED.fullmatch(m.batch)
            if not number:
                self.names.append(m.batch)
                return
            ranges = sorted([*self.numbers.get(number[1], []), [int(number[2])] * 2])
            merged = ranges[:1]
            for low, high in ranges[1:]:
                if low <= merged[-1][1] + 1:
                    merged[-1] = [merged[-1][0], max(high, merged[-1][1])]
                else:
                    merged.append([low, high])
            self.numbers[number[1]] = merged


class LogStore:
    """Batches of validated rows and their rollups under ``base``.  Several
    writers may work at once: who loses a number tries again with the next."""

    def __init__(self, spark: SparkSession, base: str, promoted: tuple[str, ...] = PROMOTED):
        self.spark, self.base = spark, base.rstrip("/")
        self.files = Files(spark, self.base)
        spark.conf.set(REPEATED_KEYS, "true")  # batches and streams judge entries alike
        self._known = State()
        self._zones: dict[tuple[str, str], list[Zone]] = {}
        for folder in ("manifests", "checkpoints"):
            self.files.make(f"{self.base}/{folder}")
        # fixed when the store is made, so that every file has the columns
        self.files.write(f"{self.base}/promoted.json", json.dumps(list(promoted)))
        self.promoted = tuple(json.loads(self.files.read(f"{self.base}/promoted.json")))

    # -- writing ---------------------------------------------------------------

    def append(self, rows: DataFrame, batch: str | None = None) -> Manifest:
        """Commit rows (with ``position``: their order in the batch) as one batch.

        A batch of that name that is already committed is left as it is."""
        named = batch is not None
        batch = batch or uuid.uuid4().hex
        if not _NAME.fullmatch(batch):
            raise ValueError(f"not a batch name: {batch!r}")
        for _ in range(ATTEMPTS):
            state = self.state()
            if named and state.has(batch):
                return Manifest(batch, order=-1)
            folder, first = f"{batch}.{uuid.uuid4().hex[:12]}", state.next_id
            placed = rows.withColumn("id", F.lit(first) + F.col("position")).withColumn("day", F.to_date("timestamp"))
            self._write(placed.select(*LOG.fieldNames(), "day"), "logs", folder)
            # the delta is counted from what was written, not from a second run of the source
            written = self._read("logs", LOG, [folder])
            total, days, next_id = 0, [], first
            if written is not None:
                rollup = build_rollup(written).withColumn("day", F.to_date("bucket_start"))
                found = self._index(written, folder, lambda: self._write(rollup, "rollups", folder))  # a row a file
                total, days = sum(r.rows for r in found), sorted({r.day for r in found})
                next_id = max(r.last_id for r in found) + 1
            done = self._commit(Manifest(batch, folder, total, next_id, days, named=named, order=state.order + 1))
            if done:
                return done
            for table in (*TABLES, "index"):  # ids and number went to another writer
                self.files.delete(f"{self.base}/{table}/batch={folder}")
        raise RuntimeError(f"batch {batch}: other writers were first {ATTEMPTS} times")

    def _write(self, df: DataFrame, table: str, folder: str, dealt: bool = False) -> None:
        """Rows by day, a day in as few files as their size asks for, or ``dealt`` as they are."""
        keys = ["day", "service", "timestamp"] if table == "logs" else ["day", "service", "bucket_start"]
        df = df if dealt else df.hint("rebalance", "day")
        if table == "logs":
            for name in self.promoted:
                df = df.withColumn(promoted_column(name), F.col("attributes_text")[name])
        writer = df.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("day")
        if table == "logs":
            for name in self.promoted:
                writer = writer.option(f"parquet.bloom.filter.enabled#{promoted_column(name)}", "true")
        writer.parquet(f"{self.base}/{table}/batch={folder}")

    def _index(self, written: DataFrame, folder: str, beside: Callable[[], None] = lambda: None) -> list:
        """Describe the files of a batch that is not yet committed; ``beside`` is
        another pass over them, whose tasks share the cluster with these."""
        base = f"{self.base}/index/batch={folder}"

        def sign() -> None:
            signed = file_index.signatures(written).hint("rebalance", "of").sortWithinPartitions("of", "kind", "block")
            signed.write.mode("overwrite").partitionBy("of").parquet(base)

        with ThreadPoolExecutor(3) as pool:
            passes = [pool.submit(p) for p in (sign, beside, lambda: file_index.zones(written).collect())]
        *_, found = [p.result() for p in passes]
        for day in sorted({r.day for r in found}):
            own = [r.asDict() for r in found if r.day == day]
            self.files.write(f"{base}/of={day}/_zones.json", json.dumps(own))
        return found

    def _commit(self, manifest: Manifest) -> Manifest | None:
        """Claim the manifest's number; None if another writer has it."""
        if not self.files.write(f"{self.base}/manifests/{manifest.order:012d}.json", json.dumps(manifest.__dict__)):
            return None
        if (manifest.order + 1) % CHECKPOINT_EVERY == 0:
            self._checkpoint()
        return manifest

    def _commit_when(self, make: Callable[[State], Manifest | None]) -> Manifest | None:
        """Commit what ``make`` says of the newest state, until the number is won."""
        for _ in range(ATTEMPTS):
            manifest = make(self.state())
            if manifest is None:
                return None
            if done := self._commit(manifest):
                return done
        raise RuntimeError(f"other writers were first {ATTEMPTS} times")

    def _checkpoint(self) -> None:
        state = self.state()
        self.files.write(f"{self.base}/checkpoints/{state.order:012d}.json", json.dumps(state.__dict__))
        for folder, keep in (("manifests", state.order - CHECKPOINT_EVERY), ("checkpoints", state.order - 2 * CHECKPOINT_EVERY)):
            for order in self._numbers(folder):
                if order <= keep:  # slow readers still find the last ones
                    self.files.delete(f"{self.base}/{folder}/{order:012d}.json")

    # -- reading ---------------------------------------------------------------

    def _numbers(self, folder: str) -> list[int]:
        return [int(n[:12]) for n in self.files.list(f"{self.base}/{folder}") if re.fullmatch(r"\d{12}\.json", n)]

    def manifests(self) -> list[Manifest]:
        """Those that no clean-up has deleted."""
        folder = f"{self.base}/manifests"
        return [Manifest(**json.loads(self.files.read(f"{folder}/{n:012d}.json"))) for n in self._numbers(folder.rsplit("/", 1)[1])]

    def state(self) -> State:
        """The newest state; manifests that this store has read are not read again."""
        for attempt in range(ATTEMPTS):
            try:
                state = State(**json.loads(json.dumps(self._known.__dict__)))
                newest = max(self._numbers("checkpoints"), default=-1)
                if newest > state.order:
                    state = State(**json.loads(self.files.read(f"{self.base}/checkpoints/{newest:012d}.json")))
                for order in self._numbers("manifests"):
                    if order == state.order + 1:
                        state.add(Manifest(**json.loads(self.files.read(f"{self.base}/manifests/{order:012d}.json"))))
                self._known = state
                return State(**json.loads(json.dumps(state.__dict__)))
            except Py4JJavaError:
                if attempt + 1 == ATTEMPTS:  # not just a file that went meanwhile
                    raise
        raise AssertionError

    def visible(self, table: str = "logs") -> dict[str, set[str]]:
        """Days of each batch's folder that readers of a table see."""
        return {folder: set(days) for folder, days in self.state().live[table].items()}

    def _read(self, table: str, schema: T.StructType, batches: list[str]) -> DataFrame | None:
        paths = [f"{self.base}/{table}/batch={b}" for b in batches]
        paths = [p for p in paths if any(n.startswith("day=") for n in self.files.list(p))]
        if not paths:
            return None
        full = T.StructType([*schema.fields, _DAY])
        return self.spark.read.schema(full).option("basePath", f"{self.base}/{table}").parquet(*paths)

    def _log_schema(self) -> T.StructType:
        return T.StructType([*LOG.fields, *(T.StructField(promoted_column(name), T.StringType()) for name in self.promoted), _DAY])

    def _table(self, table: str, full: T.StructType, state: State | None) -> DataFrame:
        live = (state or self.state()).live[table]
        paths = [f"{self.base}/{table}/batch={b}/day={d}" for b, days in sorted(live.items()) for d in sorted(days)]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.base}/{table}").parquet(*paths).select(*full.fieldNames())

    def logs(self, state: State | None = None) -> DataFrame:
        return self._table("logs", self._log_schema(), state)

    def rollups(self, state: State | None = None) -> DataFrame:
        """Deltas as they were written; every consumer sums them."""
        return self._table("rollups", T.StructType([*ROLLUP.fields, _DAY]), state)

    def days(self) -> list[str]:
        return sorted(set().union(*self.visible().values()))

    # -- choosing files ------------------------------------------------------------

    def zones(self, folder: str, day: str) -> list[Zone]:
        """The files of a day of a batch."""
        known = self._zones.get((folder, day))
        if known is None:
            path = f"{self.base}/index/batch={folder}/of={day}/_zones.json"
            if self.files.exists(path):
                rows = json.loads(self.files.read(path))
                known = [Zone(folder, day, r["name"], r["rows"], r["first"], r["last"], tuple(r["levels"]), tuple(r["services"]), r["size"]) for r in rows]
            else:
                midnight = datetime.combine(date.fromisoformat(day), datetime.min.time(), timezone.utc)
                known = [Zone.unknown(folder, day, (midnight - EPOCH) // timedelta(microseconds=1))]
            while len(self._zones) >= ZONES_KEPT:
                self._zones.pop(next(iter(self._zones)), None)
            self._zones[folder, day] = known
        return known

    def candidates(self, query: LogQuery | AggregateQuery, state: State | None = None) -> Iterator[Zone]:
        """Files that by their zones may hold rows of a query, by last instant, newest
        first.  A day's zones are read when the files of later days are used up."""
        live = (state or self.state()).live["logs"]
        cursor = getattr(query, "cursor", None)
        upper = min((m for m in (query.until, cursor and cursor.micros + 1) if m is not None), default=None)
        low = None if query.since is None else str(utc_day(query.since))
        high = None if upper is None else str(utc_day(upper - 1))
        folders: dict[str, list[str]] = {}
        for folder, days in live.items():
            for day in days:
                if (low is None or day >= low) and (high is None or day <= high):
                    folders.setdefault(day, []).append(folder)
        for day in sorted(folders, reverse=True):
            own = [z for folder in folders[day] for z in self.zones(folder, day) if z.may_fit(query)]
            yield from sorted(own, key=lambda z: (z.last, z.folder, z.name or ""), reverse=True)

    def choose(self, files: list[Zone], query: LogQuery | AggregateQuery) -> list[Zone]:
        """Those of ``files`` whose signatures do not rule the query's text and attributes out."""
        if not files or not file_index.uses_signatures(query):
            return files
        signed = sorted({(z.folder, z.day) for z in files if z.name is not None})
        if not signed:
            return files
        base = f"{self.base}/index"
        paths = [f"{base}/batch={folder}/of={day}" for folder, day in signed]
        table = self.spark.read.schema(file_index.SIGNATURES).option("basePath", base).parquet(*paths)
        fit = {tuple(r) for r in file_index.fitting(table, query.q, query.attributes).collect()}  # names of files
        return [z for z in files if z.name is None or (z.folder, z.day, z.name) in fit]

    def read(self, files: list[Zone]) -> DataFrame:
        """Rows of some files, with the columns of :meth:`logs`."""
        schema = self._log_schema()
        paths = sorted(f"{self.base}/logs/batch={z.folder}/day={z.day}" + (f"/{z.name}" if z.name else "") for z in files)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.base}/logs").parquet(*paths).select(*schema.fieldNames())

    def logs_for(self, query: LogQuery | AggregateQuery, state: State | None = None) -> DataFrame:
        """Rows of all files that may fit; the query's filters are still to be applied."""
        return self.read(self.choose(list(self.candidates(query, state)), query))

    def newest(self, query: LogQuery, state: State | None = None, opened: list[Zone] | None = None) -> list:
        """The newest rows of a search, one more than its limit: files are opened
        from the newest on, until no other can hold a row of the page.  ``opened``
        gets the files that were read."""

        def rows_of(files: list[Zone], since: int | None, wanted: int) -> list:
            chosen = self.choose(files, query)
            if opened is not None:
                opened.extend(chosen)
            if not chosen:
                return []
            narrowed = query if since is None or query.since is not None and query.since > since else replace(query, since=since)
            return with_micros(plan_search(self.read(chosen), narrowed, ahead=wanted - query.limit)).collect()

        return newest_in_files(self.candidates(query, state), query.limit + 1, lambda z: z.last, rows_of)

    # -- lifecycle ---------------------------------------------------------------

    def _replace(
        self, kind: str, day: str, tables: list[str], frames: Callable[[], dict[str, DataFrame]], state: State | None = None, folders: list[str] | None = None
    ) -> Manifest | None:
        """Write a day's tables anew and swap them in by one manifest; None if
        another writer replaced or dropped the day meanwhile.

        ``frames`` reads the day as ``state`` has it, or some ``folders`` of it;
        batches that are committed meanwhile stay as they are."""
        folder = f"{kind}-{day}-{uuid.uuid4().hex[:12]}"
        before = state or self.state()
        old = {t: sorted(f for f, days in before.live[t].items() if day in days and (folders is None or f in folders)) for t in tables}
        for table, frame in frames().items():
            self._write(frame, table, folder, dealt=kind == "compact")
            if table == "logs":
                written = self._read("logs", LOG, [folder])
                if written is not None:
                    self._index(written, folder)

        def swap(state: State) -> Manifest | None:
            if any(day not in state.live[t].get(f, []) for t in tables for f in old[t]):
                return None
            every = sorted({f for fs in old.values() for f in fs})
            return Manifest(folder, folder, 0, 1, [day], {f: [day] for f in every}, tables=tables, order=state.order + 1)

        done = self._commit_when(swap)
        if done is None:
            for table in (*tables, "index"):
                self.files.delete(f"{self.base}/{table}/batch={folder}")
        return done

    def _day(self, table: str, day: str, state: State, folders: list[str] | None = None) -> DataFrame:
        """A table's rows of a day as a state has them, or of some folders of it."""
        live = {f: [day] for f, days in state.live[table].items() if day in days and (folders is None or f in folders)}
        only = replace(state, live=state.live | {table: live})
        return self.logs(only) if table == "logs" else self.rollups(only)

    def compact(self, day: str, file_rows: int = FILE_ROWS, folders: list[str] | None = None) -> Manifest | None:
        """Rewrite a day's batches, or those of some ``folders``, as one, in few files
        with disjoint ranges of service and time, and one row per rollup key."""
        state = self.state()
        if folders is not None and any(day not in state.live[t].get(f, []) for t in TABLES for f in folders):
            return None

        def frames() -> dict[str, DataFrame]:
            logs, rollups = self._day("logs", day, state, folders), self._day("rollups", day, state, folders)
            files = max(1, -(-logs.count() // file_rows))
            return {
                "logs": logs.repartitionByRange(files, "service", "timestamp"),
                "rollups": merge_rollups(rollups).select(*ROLLUP.fieldNames(), "day").repartitionByRange(files, "service", "bucket_start"),
            }

        return self._replace("compact", day, list(TABLES), frames, state, folders)

    def rebuild_rollups(self, day: str) -> Manifest | None:
        """Write one day's rollup anew from its rows, as the backfill does."""
        state = self.state()

        def frames() -> dict[str, DataFrame]:
            return {"rollups": build_rollup(self._day("logs", day, state)).withColumn("day", F.to_date("bucket_start"))}

        return self._replace("rebuild", day, ["rollups"], frames, state)

    def rebuild_all_rollups(self) -> list[str]:
        """Write the rollups of all days anew by one job and swap them in by one
        manifest; the days that were rebuilt.

        Days whose rows or rollups were replaced or dropped meanwhile are left as
        they are: call it again for those.  Batches that are committed meanwhile
        keep their own deltas."""
        state = self.state()
        days = sorted({d for own in state.live["logs"].values() for d in own})
        if not days:
            return []
        folder = f"rebuild-all-{uuid.uuid4().hex[:12]}"
        self._write(build_rollup(self.logs(state)).withColumn("day", F.to_date("bucket_start")), "rollups", folder)
        seen = {d: {t: {f for f, own in state.live[t].items() if d in own} for t in TABLES} for d in days}

        def swap(now: State) -> Manifest | None:
            kept = [d for d in days if all(d in now.live[t].get(f, []) for t in TABLES for f in seen[d][t])]
            gone: dict[str, list[str]] = {}
            for d in kept:
                for f in seen[d]["rollups"]:
                    gone.setdefault(f, []).append(d)
            return Manifest(folder, folder, 0, 1, kept, gone, tables=["rollups"], order=now.order + 1) if kept else None

        done = self._commit_when(swap)
        if done is None:
            self.files.delete(f"{self.base}/rollups/batch={folder}")
        return done.days if done else []

    def drop_expired(self, days: int, now: datetime) -> list[str]:
        """Drop the days before the cutoff from rows and rollups at once; the
        cutoff day stays.  The manifest comes first, then the files go: those
        of every batch, also of batches that compaction has replaced and of
        failed ones."""
        cutoff = retention_cutoff(days, now)
        expired = lambda found: sorted(d for d in set(found) if date.fromisoformat(d) < cutoff)

        def drop(state: State) -> Manifest | None:
            gone = expired(d for t in TABLES for days in state.live[t].values() for d in days)
            return Manifest(f"drop-{uuid.uuid4().hex[:8]}", dropped=gone, order=state.order + 1) if gone else None

        done = self._commit_when(drop)
        for table, folder, day in self._stored():
            if date.fromisoformat(day) < cutoff:
                self._delete_day(table, folder, day)
        return done.dropped if done else []

    def vacuum(self, now: datetime, hours: float = 24.0) -> int:
        """Delete the files of days that no reader sees and that are older than
        ``hours`` (so that neither slow readers nor running writers need them)."""
        live, gone = {t: self.visible(t) for t in TABLES}, 0
        for table, folder, day in self._stored():
            path = f"{self.base}/{table}/{folder}/day={day}"
            seen = day in live[table].get(folder.removeprefix("batch="), set())
            if not seen and self.files.modified(path) < now.timestamp() - hours * 3600:
                self._delete_day(table, folder, day)
                gone += 1
        return gone

    def _delete_day(self, table: str, folder: str, day: str) -> None:
        self.files.delete(f"{self.base}/{table}/{folder}/day={day}")
        if table == "logs":
            self.files.delete(f"{self.base}/index/{folder}/of={day}")

    def _stored(self) -> Iterator[tuple[str, str, str]]:
        """(table, folder, day) of all that is on disk."""
        for table in TABLES:
            for folder in self.files.list(f"{self.base}/{table}"):
                for name in self.files.list(f"{self.base}/{table}/{folder}"):
                    if name.startswith("day="):
                        yield table, folder, name[4:]


def retention_cutoff(days: int, now: datetime) -> date:
    """The first day that is kept: the UTC day of ``now`` less ``days``."""
    return now.astimezone(timezone.utc).date() - timedelta(days=days)


def retention_days(value: str | None, default: int = 30) -> int:
    """RETENTION_DAYS; zero keeps today alone."""
    if value is None:
        return default
    try:
        number = float(value.strip() or 0)
    except ValueError:
        number = -1.0
    if number < 0 or number != int(number):
        raise ValueError("RETENTION_DAYS must be a non-negative integer")
    return int(number)
