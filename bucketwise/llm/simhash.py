"""SimHash near-duplicates through the generalised pigeonhole principle.

A document's 64-bit fingerprint has the majority bits of its shingles' hashes.
All pairs within ``radius`` differing bits are found without comparing all:

1. bits that go together on a bounded sample are put into the same partition,
   so that the partitions are nearly independent;
2. thresholds t_i for the partitions add up to ``radius - partitions + 1``
   (-1: not probed).  Two fingerprints within ``radius`` differ by at most t_i
   bits in at least one partition.  A dynamic program allots the thresholds at
   the least estimated cost of probes and candidates; the number of partitions
   is chosen by the same estimate;
3. every fingerprint is filed under its value in each probed partition and
   looks up the values within t_i bits of it;
4. candidates in a bucket are verified on the whole fingerprints.

Any plan gives the same links; sample and estimates affect the cost alone.
Buckets do not emit all their pairs: a task hands on the links of a minimum
spanning forest of what it verified, which has the same components.

Defined results
  * null text and text without words have fingerprint zero, linked like any other;
  * a text of fewer words than a shingle is one shingle; repeated shingles count;
  * documents with one fingerprint share a component; a null doc_id never
    becomes a component's id while another member has one;
  * an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.llm.common import materialize, returns_memory
from bucketwise.llm.components import components

BITS = 64
SEED = 42
RADIUS = 2
SHINGLE_WORDS = 3
#: Fingerprints that the plan is estimated on, at most.
PLAN_SAMPLE = 20_000
#: Costs in the plan's estimate, in units of one verified candidate.
ROW_COST = 200.0
#: Runs up to this length are compared by shifting, longer ones in blocks.
SHORT_RUN = 48
CHUNK_ROWS = 250_000
#: Verified pairs that a task holds before it keeps their forest alone.
CHUNK_PAIRS = 200_000


# -- fingerprints ----------------------------------------------------------------


def shingles(text: str | None, words: int) -> list[bytes]:
    """Shingles of ``words`` words, space-joined, lower-cased in A-Z only."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    whole = b" ".join(found)
    ends, at = [], -1
    for w in found:
        at += 1 + len(w)
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [whole[a:b] for a, b in zip(starts, ends[words - 1 :])]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    found = shingles(text, words)
    return np.fromiter((digest(s, SEED) for s in found), np.uint64, len(found))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes; zero without any."""
    if not len(hashes):
        return 0
    count = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, fp): the fingerprint as a long."""

    @returns_memory
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                fps = np.fromiter(
                    (fingerprint(shingle_hashes(t.as_py(), words)) for t in piece.column(1)), np.uint64, piece.num_rows
                )
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(rows, f"{key} long, fp long")


# -- the plan --------------------------------------------------------------------


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int


def _project(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for k, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def group_bits(sample: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits in ``parts`` groups of nearly equal size; each takes in turn the
    free bit that correlates most with the bits it has."""
    on = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    on -= on.mean(axis=0)
    norm = np.sqrt((on**2).sum(axis=0))
    norm[norm == 0] = 1
    close = np.abs((on.T @ on) / np.outer(norm, norm))
    np.fill_diagonal(close, 0)
    sizes = [BITS * (i + 1) // parts - BITS * i // parts for i in range(parts)]
    free, groups = set(range(BITS)), []
    for size in sizes:
        rest = sorted(free)
        group = [rest[int(np.argmax(close[np.ix_(rest, rest)].sum(axis=1)))]]
        free.discard(group[0])
        while len(group) < size:
            rest = sorted(free)
            group.append(rest[int(np.argmax(close[np.ix_(rest, group)].sum(axis=1)))])
            free.discard(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


@cache
def _masks(width: int, weight: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), weight)], dtype=np.uint64)


def _close_pairs(values: np.ndarray, width: int, most: int) -> list[float]:
    """Share of ordered pairs of different rows at most 0, 1, ... ``most`` bits apart."""
    known, count = np.unique(values, return_counts=True)
    total, shares = -len(values), []  # a row is no pair with itself
    for d in range(most + 1):
        for mask in _masks(width, d):
            other = known ^ mask
            at = np.minimum(np.searchsorted(known, other), len(known) - 1)
            total += int((count * np.where(known[at] == other, count[at], 0)).sum())
        shares.append(total / max(1, len(values) * (len(values) - 1)))
    return shares


def allot_thresholds(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 up) that add up to ``total`` at the least cost;
    ``costs[i][t]`` is partition i's cost at threshold t, and -1 costs nothing."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i, row in enumerate(costs):
        after: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, chosen) in best.items():
            for t in range(-1, len(row)):
                c = cost + (row[t] if t >= 0 else 0.0)
                if have + t not in after or c < after[have + t][0]:
                    after[have + t] = c, [*chosen, t]
        best = after
    return best.get(total, (float("inf"), []))


def plan(sample: np.ndarray, number: int, radius: int) -> list[Partition]:
    """The cheapest partitions for ``number`` fingerprints like ``sample``."""
    if not len(sample):
        sample = np.zeros(1, dtype=np.uint64)
    if not radius:  # equal fingerprints: one look-up by the first bits
        return [Partition(tuple(range(48)), 0)]
    found = None
    for parts in range(2, radius + 2):
        groups, costs = group_bits(sample, parts), []
        for g in groups:
            most = min(2, radius)
            shares = _close_pairs(_project(sample, g), len(g), most)
            rows = np.cumsum([len(_masks(len(g), d)) for d in range(most + 1)])
            costs.append([float(number) * (1 + r) * ROW_COST + s * float(number) ** 2 / 2 for r, s in zip(rows, shares)])
        cost, chosen = allot_thresholds(costs, radius - parts + 1)
        if found is None or cost < found[0]:
            found = cost, [Partition(g, t) for g, t in zip(groups, chosen) if t >= 0]
    return found[1]


# -- probing and verifying ---------------------------------------------------------


def _filed(fps: np.ndarray, partitions: list[Partition]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(bucket keys, row numbers, whether these are look-ups) of fingerprints.
    Of two values that differ, the smaller looks up the larger."""
    rows = np.arange(len(fps))
    for i, p in enumerate(partitions):
        value, prefix = _project(fps, p.bits), np.uint64(i << 48)
        yield value | prefix, rows, False
        for d in range(1, p.threshold + 1):
            for mask in _masks(len(p.bits), d):
                other = value ^ mask
                up = other > value
                yield other[up] | prefix, rows[up], True


def _forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Of links between numbers below ``nodes``, in ascending order of length:
    whether each is in the minimum spanning forest."""
    parent, label = list(range(nodes)), np.arange(nodes)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    open_, kept = np.arange(len(a)), np.zeros(len(a), dtype=bool)
    while True:
        la, lb = label[a[open_]], label[b[open_]]
        apart = la != lb
        open_, la, lb = open_[apart], la[apart], lb[apart]
        if not len(open_):
            return kept
        # every tree takes its shortest link to another
        least = np.full(nodes, len(a), dtype=np.int64)
        np.minimum.at(least, la, open_)
        np.minimum.at(least, lb, open_)
        for row in np.unique(least[least < len(a)]).tolist():
            x, y = top(int(a[row])), top(int(b[row]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept[row] = True
        label = np.fromiter(map(top, range(nodes)), np.int64, nodes)


def spanning_forest(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links a - b of a minimum spanning forest."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends = ends.reshape(2, -1)
    low, high = ends.min(axis=0), ends.max(axis=0)
    order = np.argsort(distance * len(names) ** 2 + low * len(names) + high)
    low, high, distance = low[order], high[order], distance[order]
    kept = _forest(low, high, len(names))
    return names[low[kept]], names[high[kept]], distance[kept]


def verified_pairs(
    keys: np.ndarray, looks_up: np.ndarray, fps: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows sorted by key: pairs of rows with one key, not both look-ups,
    whose fingerprints are within ``radius``: (row, row, distance)."""
    n = len(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([first, [n]]))
    short = np.repeat(length <= SHORT_RUN, length)
    at = np.flatnonzero(short)
    run_end = np.repeat(first + length, length)
    for k in range(1, SHORT_RUN):
        at = at[at + k < run_end[at]]
        if not len(at):
            break
        d = np.bitwise_count(fps[at] ^ fps[at + k])
        ok = (d <= radius) & ~(looks_up[at] & looks_up[at + k])
        yield at[ok], at[ok] + k, d[ok].astype(np.int64)
    for f, size in zip(first[length > SHORT_RUN].tolist(), length[length > SHORT_RUN].tolist()):
        rows = np.arange(f, f + size)
        filed = rows[~looks_up[rows]]
        for x in range(0, size, 1024):
            left = rows[x : x + 1024]
            for y in range(0, len(filed), 1024):
                right = filed[y : y + 1024]
                d = np.bitwise_count(fps[left][:, None] ^ fps[right][None, :])
                # a pair of filed rows is met twice; the lower row speaks for it
                i, j = np.nonzero((d <= radius) & ((left[:, None] < right[None, :]) | looks_up[left][:, None]))
                yield left[i], right[j], d[i, j].astype(np.int64)


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b, distance) that connect all ``nodes`` (node long, fp long)
    within ``radius`` bits as the whole set of such pairs does: every task
    hands on a spanning forest of the pairs that it found, which has the same
    components."""
    nodes = nodes.select("node", "fp")
    drawn = nodes.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64)
    partitions = plan(np.ascontiguousarray(drawn).view(np.uint64), nodes.count(), radius)

    @returns_memory
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            fp = np.ascontiguousarray(batch.column(1).to_numpy(zero_copy_only=False)).view(np.uint64)
            for key, row, look in _filed(fp, partitions):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array(np.full(len(row), look)),
                        pa.array(fp[row].view(np.int64)),
                        pa.array(node[row]),
                    ],
                    names=["bucket", "looks_up", "fp", "node"],
                )

    @returns_memory
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def links(rows: tuple) -> pa.RecordBatch:
            key, look, fp, node = rows
            got, size = [tuple(np.zeros(0, dtype=np.int64) for _ in range(3))], 0
            for i, j, d in verified_pairs(key, look, fp.view(np.uint64), radius):
                got.append((node[i], node[j], d))
                size += len(d)
                if size > CHUNK_PAIRS:  # the forest of the forest so far and of more is the forest of all
                    got = [spanning_forest(*(np.concatenate(c) for c in zip(*got)))]
                    size = 0
            found = spanning_forest(*(np.concatenate(c) for c in zip(*got)))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "distance"])

        def columns() -> tuple:
            return tuple(np.concatenate(c) for c in zip(*held))

        for batch in batches:
            held.append(tuple(np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns))
            if sum(len(h[0]) for h in held) >= CHUNK_ROWS:
                rows = columns()
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
                held = [tuple(c[cut:] for c in rows)]
                if cut:
                    yield links(tuple(c[:cut] for c in rows))
        if held:
            yield links(columns())

    return (
        nodes.mapInArrow(file, "bucket long, looks_up boolean, fp long, node long")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(verify, "a long, b long, distance long")
        .groupBy("a", "b")
        .agg(F.min("distance").alias("distance"))
    )


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(``key``, fp, component_id): documents whose fingerprints are linked,
    directly or through others, share the smallest ``key`` among them."""
    marked = materialize(fingerprints(docs, words, key, text), "fingerprints")
    known = marked.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(near_links(known.select(F.col("fp").alias("node"), "fp"), radius).select("a", "b"))
    known = known.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = known.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(key, "fp", "component_id")


def op5_simhash_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
