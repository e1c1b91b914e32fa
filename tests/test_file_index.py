"""Zones, signatures, and searches that open few files."""

import random
import shutil
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from bucketwise.functions.time import parse_instant
from bucketwise.operators.search import matching, newest_in_files, page_of
from bucketwise.plans.cursor import Cursor
from bucketwise.plans.query import AggregateQuery, LogQuery
from bucketwise.sources import file_index
from bucketwise.sources.store import LogStore

NOON = parse_instant("2024-05-01T12:00:00Z")
HOUR = 3_600_000_000
_ROW = "position long, micros long, level string, service string, message string, attributes string, attributes_text map<string,string>"


def frame(spark, rows):
    """Rows (micros, level, service, message, attributes) in the order of their position."""
    df = spark.createDataFrame([(i, m, level, s, text, "{}", a) for i, (m, level, s, text, a) in enumerate(rows)], _ROW)
    return df.withColumn("timestamp", F.timestamp_micros("micros")).drop("micros")


def random_rows(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh-é😀İ") for _ in range(rng.randrange(1, 9)))
    for _ in range(n):
        at = NOON + rng.randrange(-40, 40) * HOUR // 2 + rng.choice((0, 0, 1, 999))  # many ties
        keys = {rng.choice(("user_id", "k", "é", "a.b")): str(rng.randrange(30)) for _ in range(rng.randrange(3))}
        yield at, rng.choice(("info", "error", "debug")), rng.choice("abc"), " ".join(word() for _ in range(rng.randrange(1, 6))), keys


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Twelve batches of random rows, one day of them compacted into many files, one batch without an index."""
    base = tmp_path_factory.mktemp("indexed")
    made, rng = LogStore(spark, f"file://{base}"), random.Random(6)
    folders = [made.append(frame(spark, list(random_rows(rng, 60)))).folder for _ in range(12)]
    made.compact("2024-05-01", file_rows=40)
    shutil.rmtree(base / "index" / f"batch={folders[3]}")
    return LogStore(spark, f"file://{base}")


def queries(rng, store, n):
    texts = [r.message for r in store.logs().select("message").collect()]
    for _ in range(n):
        text = rng.choice(texts)
        at = rng.randrange(len(text))
        since = NOON + rng.randrange(-30, 10) * HOUR
        yield LogQuery(
            service=rng.choice((None, None, "a", "zz")),
            level=rng.choice((None, None, "error")),
            since=rng.choice((None, since)),
            until=rng.choice((None, since + rng.randrange(1, 30) * HOUR)),
            q=rng.choice((None, "", text[at : at + rng.randrange(1, 9)].upper(), "no such text")),
            limit=rng.choice((1, 3, 20, 700)),
            cursor=rng.choice((None, None, Cursor(since + 20 * HOUR, rng.randrange(1, 700)))),
            attributes=rng.choice(({}, {}, {"k": "7"}, {"user_id": "3"}, {"é": "4", "k": "1"}, {"no": "1"})),
        )


def test_pages_and_whole_results_are_those_of_all_files(store):
    rng = random.Random(1)
    for q in queries(rng, store, 25):
        whole = matching(store.logs(), q).withColumn("micros", F.unix_micros("timestamp")).collect()
        want = sorted(((r.micros, r.id) for r in whole), reverse=True)[: q.limit + 1]
        opened = []
        assert [(r.micros, r.id) for r in store.newest(q, opened=opened)] == want, q
        assert len(opened) == len(set(opened))
        assert sorted(r.id for r in matching(store.logs_for(q), q).collect()) == sorted(r.id for r in whole), q


def test_pages_follow_one_another(store):
    q, seen = LogQuery(limit=97), []
    while True:
        page = page_of(store.newest(q), q)
        seen += [int(r["id"]) for r in page["logs"]]
        if page["next_cursor"] is None:
            break
        q = LogQuery(limit=97, cursor=Cursor.decode(page["next_cursor"]))
    rows = store.logs().withColumn("micros", F.unix_micros("timestamp")).select("micros", "id").collect()
    assert seen == [r.id for r in sorted(rows, reverse=True)]


def test_counts_use_the_chosen_files(store):
    q = AggregateQuery(NOON - 9 * HOUR, NOON + 9 * HOUR, "1h", q="abc", attributes={"k": "7"})
    files = store.choose(list(store.candidates(q)), q)
    assert len(files) < len(list(store.candidates(q)))
    assert matching(store.logs_for(q), LogQuery(q="abc")).count() <= store.logs().count()


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """One day in fifty files, by service and time; a rare word in one row, a rare attribute in another."""
    store = LogStore(spark, f"file://{tmp_path_factory.mktemp('large')}")
    rows = [(NOON + i * 4_000_000, ("info", "warn")[i // 1000 % 2], f"s{i % 5}", f"request {i % 97} served", {"host": f"h{i % 11}", "trace": f"t{i}"}) for i in range(10_000)]
    rows[4321] = (*rows[4321][:3], "Panic: DISK FULL on node", {"host": "odd one"})
    store.append(frame(spark, rows).repartition(4))
    store.compact("2024-05-01", file_rows=200)
    return store


def test_a_rare_text_or_attribute_opens_few_files(large):
    every = len(list(large.candidates(LogQuery())))
    assert every >= 40
    for q, most in ((LogQuery(q="disk full"), 2), (LogQuery(q="Request 96 served", attributes={"host": "odd one"}), 1), (LogQuery(attributes={"trace": "t777"}), 3), (LogQuery(attributes={"trace": "x"}), 2)):
        files = large.choose(list(large.candidates(q)), q)
        assert len(files) <= most, (q, len(files))
        found = large.logs_for(q)
        assert len(found.inputFiles()) == len(files)
        assert matching(found, q).count() == matching(large.logs(), q).count()
    assert len(large.choose(list(large.candidates(LogQuery(q="fu"))), LogQuery(q="fu"))) == every  # no trigram


def test_an_hour_of_a_service_and_level_opens_few_files(large):
    q = LogQuery("s3", "warn", NOON + 2 * HOUR, NOON + 3 * HOUR)
    found = large.logs_for(q)
    assert len(found.inputFiles()) <= 8 < 40 <= len(large.logs().inputFiles())
    assert matching(found, q).count() == matching(large.logs(), q).count() > 0


def test_a_page_opens_few_files_of_a_day(large):
    opened = []
    rows = large.newest(LogQuery(service="s1", limit=50), opened=opened)
    assert [r.id for r in rows] == [9997 - 5 * i for i in range(51)] and len(opened) <= 4
    opened.clear()
    assert len(large.newest(LogQuery(q="request 5 ", limit=3), opened=opened)) == 4 and len(opened) <= 12


def test_files_are_opened_until_no_other_can_hold_a_row():
    rng = random.Random(3)
    for _ in range(300):
        rows = [SimpleNamespace(micros=rng.randrange(30), id=i) for i in range(rng.randrange(1, 80))]
        files, rest = [], rows[:]
        while rest:
            n = rng.randrange(1, 9)
            files.append(rest[:n])
            rest = rest[n:]
        last = lambda f: max(r.micros for r in f)
        files.sort(key=last, reverse=True)
        wanted, opened = rng.randrange(1, 20), []

        def rows_of(some, since, n):
            opened.extend(some)
            found = [r for f in some for r in f if since is None or r.micros >= since]
            return sorted(found, key=lambda r: (r.micros, r.id), reverse=True)[:n]

        got = newest_in_files(iter(files), wanted, last, rows_of, first=1)
        want = sorted(rows, key=lambda r: (r.micros, r.id), reverse=True)[:wanted]
        assert got == want
        unread = files[len(opened) :]
        assert not unread or last(unread[0]) < want[-1].micros
    assert newest_in_files([], 3, len, None) == []


def test_signatures_never_miss(spark, tmp_path):
    rng = random.Random(9)
    texts = ["x" * 50_000 + "needle", "😀😀é", "ab", "", "İstanbul\nTWO lines", "a\x00b c", *("".join(rng.choice("ab😀é.%_\\") for _ in range(30)) for _ in range(40))]
    rows = [(NOON + i, "info", "s", t, {f"k{i}": t, "": "x"}) for i, t in enumerate(texts)]
    store = LogStore(spark, f"file://{tmp_path}/s")
    for at in range(0, len(rows), 10):
        store.append(frame(spark, rows[at : at + 10]).repartition(1))
    files = list(store.candidates(LogQuery()))
    for text in texts[:6] + texts[6::6]:
        at = rng.randrange(max(1, len(text) - 3))
        part = text[at : at + rng.randrange(3, 12)]
        for q in (LogQuery(q=part.swapcase()), LogQuery(q=text[-40:]), LogQuery(attributes={"": "x"}, q=part)):
            chosen = {(z.folder, z.name) for z in store.choose(files, q)}
            want = matching(store.logs(), q).select("_metadata.file_path").distinct().collect()
            assert {(p.split("batch=")[1].split("/")[0], p.rsplit("/", 1)[1]) for (p,) in want} <= chosen


def test_signatures_grow_with_their_items(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/s")
    store.append(frame(spark, [(NOON, "info", "s", "one message", {f"k{i}": "v" for i in range(20_000)})]))
    table = spark.read.parquet(f"{store.base}/index/*/*").groupBy("kind").agg(F.max("blocks").alias("blocks"), F.sum(F.bit_count(F.conv(F.hex(F.substring("bits", 1, 1)), 16, 10).cast("int"))).alias("n"))
    assert {r.kind: r.blocks for r in table.collect()} == {"q": 1, "a": 8}
    assert store.choose(list(store.candidates(LogQuery())), LogQuery(attributes={"k19999": "v"}))
    absent = [i for i in range(40) if store.choose(list(store.candidates(LogQuery())), LogQuery(attributes={f"k{i}": "w", f"x{i}": "w"}))]
    assert len(absent) <= 1


def test_zones_by_time_level_and_service():
    zone = file_index.Zone("b", "2024-05-01", "f", 3, NOON, NOON + HOUR, ("info", "warn"), ("a", "k"))
    fit = lambda **kw: zone.may_fit(LogQuery(**kw))
    assert fit() and fit(service="a") and fit(service="k") and not fit(service="kk") and not fit(service="A")
    assert fit(level="warn") and not fit(level="error")
    assert fit(since=NOON + HOUR) and not fit(since=NOON + HOUR + 1) and not fit(until=NOON) and fit(until=NOON + 1)
    assert fit(cursor=Cursor(NOON, 1)) and not fit(cursor=Cursor(NOON - 1, 1))
    whole = file_index.Zone.unknown("b", "2024-05-01", NOON - 12 * HOUR)
    assert whole.may_fit(LogQuery(service="zz", level="error")) and not whole.may_fit(LogQuery(until=NOON - 12 * HOUR))


def test_an_index_goes_with_its_files(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    store = LogStore(spark, f"file://{tmp_path}/s")
    store.append(frame(spark, [(NOON, "info", "s", "one", {}), (NOON - 48 * HOUR, "info", "s", "two", {})]))
    store.compact("2024-05-01")
    assert len(list((tmp_path / "s/index").glob("*/of=*"))) == 3
    store.drop_expired(1, datetime(2024, 5, 2, tzinfo=timezone.utc))
    assert len(list((tmp_path / "s/index").glob("*/of=2024-05-01"))) == len(list((tmp_path / "s/index").glob("*/of=*"))) == 2
    store.vacuum(datetime.now(timezone.utc) + timedelta(days=2))
    assert len(list((tmp_path / "s/index").glob("*/of=*"))) == 1 and store.logs_for(LogQuery(q="one")).count() == 1
