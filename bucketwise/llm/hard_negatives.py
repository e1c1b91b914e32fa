"""Hard negatives by a vector-approximation file.

For each anchor: its positives (the best rows of its own label) and, for each of
those, the best rows of other labels whose score lies in a window below the
positive's.  A score is the inner product of integer vectors; of equal scores
the smaller key comes first.

The file.  Each dimension is cut into at most 256 cells by quantiles of a bounded
sample (``SAMPLE_COMPONENTS``); the outermost cells reach to the least and
largest component of all rows.  A row's approximation is its cell numbers, one
byte for each dimension, beside the exact vector.

A search.  For an anchor, every cell has a least and a largest product; they
stand in a table.  A row's lower and upper score bound is the sum of its cells'
entries.  Only rows whose bounds may enter one of the anchor's windows, and
which may still be among the best there, are scored exactly.

The plan.  Anchors come in waves of bounded size (``WAVE_ROWS`` anchors and
``WAVE_COMPONENTS`` components), each broadcast with its windows; a wave is one
scan of the file without a shuffle.  A small share of the rows (``SEED_SHARE``)
is scanned first, so that all tasks start from a floor under each window's last
place and hand on few rows.  Results do not depend on cells, sample, waves or
seeds.  No row is paired with another one in a plan, labels are never brought
together, and only a wave's anchors, positives and floors reach the driver.
A wave's result is written before the next begins; lost tasks are repeated.

The work is every anchor against every row, so with anchors a fixed share of the
rows it grows with their square; that is the searches' own size.

Defined results
  * rows with a null key or label, a null vector, or a null or non-finite
    component take no part;
  * repeated rows are rows of their own: each is "another row" to the other,
    may be an anchor, and has its own places;
  * a positive with a negative score has an empty window;
  * an anchor without another row of its label has no result;
  * an empty table gives an empty table; other columns are not read;
  * vectors of different widths, and components whose products would not fit
    64 bits, are refused (ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bucketwise.llm.common import materialize, materialize_each, returns_memory
from bucketwise.llm.vectors import Measure, is_whole, matrix, measure, scaled

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A window: from these hundredths of the positive's score to those.
LEAST_PERCENT, MOST_PERCENT = 30, 90
CELLS = 256
SAMPLE_COMPONENTS = 1 << 21
#: One row in so many is a seed.
SEED_SHARE = 32
WAVE_ROWS, WAVE_COMPONENTS = 8192, 1 << 22
#: Rows and anchors whose bounds are held at once; pairs that are scored at once.
CHUNK_ROWS, CHUNK_ANCHORS, CHUNK_PAIRS = 2048, 32, 1 << 15
_LOWEST, _HIGHEST = -(2**62), 2**62


@dataclass(frozen=True)
class Cells:
    """Corners of the cells of each dimension: cell c of dimension d holds the
    integers from ``low[d, c]`` to ``high[d, c]``."""

    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, least: np.ndarray, most: np.ndarray, cells: int = CELLS) -> "Cells":
        n, width = sample.shape
        low = np.repeat(most[:, None] + 1, cells, axis=1)
        high = np.repeat(most[:, None] + 1, cells, axis=1)
        at = np.arange(1, cells) * n // cells
        for d in range(width if n else 0):
            marks = np.unique(np.sort(sample[:, d])[at])
            marks = marks[marks > least[d]]
            low[d, 0], low[d, 1 : len(marks) + 1] = least[d], marks
            high[d, : len(marks)], high[d, len(marks)] = marks - 1, most[d]
        return Cells(low, high)

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes = [np.searchsorted(self.low[d], x[:, d], side="right") - 1 for d in range(x.shape[1])]
        return np.stack(codes, axis=1).astype(np.uint8) if codes else np.zeros(x.shape, np.uint8)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """Dimension x cell x (lower bounds of all anchors, then upper ones)."""
        one, two = self.low[:, :, None] * anchors.T[:, None, :], self.high[:, :, None] * anchors.T[:, None, :]
        both = np.concatenate([np.minimum(one, two), np.maximum(one, two)], axis=2)
        reach = np.abs(both).max(axis=(1, 2), initial=0).sum()
        return both.astype(np.int32) if reach < 2**31 else both


def bounds(tables: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper scores, rows x anchors, by looking up each dimension's cell."""
    width, _, columns = tables.shape
    total = np.zeros((len(codes), columns), tables.dtype)
    entry = np.empty_like(total)
    for d in range(width):
        np.take(tables[d], codes[:, d], axis=0, out=entry, mode="clip")
        total += entry
    return total[:, : columns // 2], total[:, columns // 2 :]


@dataclass(frozen=True)
class Wave:
    """Anchors with the windows that they search: one for each column of ``low``."""

    row: np.ndarray
    key: np.ndarray
    label: np.ndarray
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    #: Scores under which no row can be among the best of a window.
    floor: np.ndarray
    #: Whether rows of the anchor's own label are sought, or all others.
    same: bool
    most: int


class _Best:
    """The best rows of each window so far."""

    def __init__(self, wave: Wave):
        self.most, self.need = wave.most, np.maximum(wave.low, wave.floor)
        self.rows = [np.empty(0, np.int64)] * 3

    def add(self, found: list[list[np.ndarray]]) -> None:
        window, score, key = (np.concatenate(c) for c in zip(self.rows, *found))
        order = np.lexsort((key, -score, window))
        window, score, key = window[order], score[order], key[order]
        first = np.flatnonzero(np.diff(window, prepend=-1))
        place = np.arange(len(window)) - np.repeat(first, np.diff(np.append(first, len(window))))
        kept = place < self.most
        last = place == self.most - 1
        self.need.ravel()[window[last]] = score[last]
        self.rows = [window[kept], score[kept], key[kept]]


def _search(wave: Wave, cells: Cells, best: _Best, row: np.ndarray, key: np.ndarray, label: np.ndarray, codes: np.ndarray, x: np.ndarray) -> None:
    """Put rows into the windows that they enter."""
    found: list[list[np.ndarray]] = []

    def block(anchors: np.ndarray, rows: np.ndarray, tables: np.ndarray) -> None:
        lower, upper = bounds(tables, codes[rows])
        may = np.zeros(lower.shape, bool)
        for w in range(wave.low.shape[1]):
            may |= (upper >= best.need[anchors, w]) & (lower <= wave.high[anchors, w])
        if not wave.same:
            may &= label[rows, None] != wave.label[anchors]
        r, a = np.nonzero(may)
        r, a = rows[r], anchors[a]
        other = row[r] != wave.row[a]
        r, a = r[other], a[other]
        for at in range(0, len(r), CHUNK_PAIRS):
            i, j = r[at : at + CHUNK_PAIRS], a[at : at + CHUNK_PAIRS]
            score = np.einsum("ij,ij->i", x[i], wave.x[j])
            for w in range(wave.low.shape[1]):
                inside = np.flatnonzero((score >= best.need[j, w]) & (score <= wave.high[j, w]))
                found.append([j[inside] * wave.low.shape[1] + w, score[inside], key[i[inside]]])

    if wave.same:
        present = np.intersect1d(wave.label, label)
        pairs = [(np.flatnonzero(wave.label == one), np.flatnonzero(label == one)) for one in present]
    else:
        pairs = [(np.arange(len(wave.row)), np.arange(len(row)))]
    for anchors, rows in pairs:
        for a in range(0, len(anchors), CHUNK_ANCHORS):
            some = anchors[a : a + CHUNK_ANCHORS]
            tables = cells.tables(wave.x[some])
            for r in range(0, len(rows), CHUNK_ROWS):
                block(some, rows[r : r + CHUNK_ROWS], tables)
    if found:
        best.add(found)


def _scan(file: DataFrame, wave: Wave, cells: Cells) -> DataFrame:
    """(anchor, window, place, score, key): the best rows of each window, where
    ``anchor`` is the place in the wave and ``place`` counts from 1."""
    shared = file.sparkSession.sparkContext.broadcast((wave, cells))
    names = ["anchor", "window", "score", "key"]

    @returns_memory
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grid = shared.value
        best, width, windows = _Best(own), own.x.shape[1], own.low.shape[1]
        for batch in batches:
            row, key, label = (batch.column(c).to_numpy() for c in range(3))
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(row), width)
            _search(own, grid, best, row, key, label, codes, matrix(batch.column(4), width))
        window, score, key = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array((window // windows).astype(np.int32)), pa.array((window % windows).astype(np.int32)), pa.array(score), pa.array(key)], names=names
        )

    every = file.select("row", "key", "label", "cells", "x").mapInArrow(rows, "anchor int, window int, score long, key long")
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "key")
    return every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wave.most)


def _raised(wave: Wave, places: DataFrame) -> Wave:
    """The wave with floors from what a part of the rows has already."""
    floor = wave.floor.copy()
    for r in places.where(F.col("place") == wave.most).select("anchor", "window", "score").collect():
        floor[r.anchor, r.window] = r.score
    return replace(wave, floor=floor)


def _grid(rows: DataFrame, size: Measure) -> Cells:
    """Cells from a bounded sample of the rows and the reach of all of them."""
    width = size.width

    @returns_memory
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = np.full(width, _HIGHEST), np.full(width, _LOWEST)
        for batch in batches:
            x = matrix(batch.column(0), width)
            least, most = np.minimum(least, x.min(axis=0, initial=_HIGHEST)), np.maximum(most, x.max(axis=0, initial=_LOWEST))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(least), pa.array(most)], names=["d", "least", "most"])

    ends = rows.select("x").mapInArrow(reach, "d long, least long, most long").groupBy("d").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    ends = ends.orderBy("d").toArrow()  # a row for each dimension
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(max(1, SAMPLE_COMPONENTS // max(1, width))).select("x").toArrow().column(0)
    return Cells.of(matrix(sample.combine_chunks(), width), ends.column(1).to_numpy(), ends.column(2).to_numpy())


def _with_cells(rows: DataFrame, cells: Cells, width: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    @returns_memory
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = shared.value.encode(matrix(batch.column(3), width))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=["row", "key", "label", "x", "cells"]
            )

    return rows.select("row", "key", "label", "x").mapInArrow(coded, "row long, key long, label long, x array<int>, cells binary")


def _waves(anchors: DataFrame, width: int) -> Iterator[Wave]:
    """Anchors in bounded waves, in order of their row, each seeking positives."""
    last, most = -1, max(1, min(WAVE_ROWS, WAVE_COMPONENTS // max(1, width)))
    while True:
        got = anchors.where(F.col("row") > F.lit(last)).orderBy("row").limit(most).select("row", "key", "label", "x").toArrow()
        if not got.num_rows:
            return
        row, key, label = (got.column(c).to_numpy() for c in range(3))
        last, one = int(row[-1]), np.ones((len(row), 1), np.int64)
        x = matrix(got.column(3).combine_chunks(), width)
        yield Wave(row, key, label, x, one * _LOWEST, one * _HIGHEST, one * _LOWEST, True, POSITIVES)


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, is_anchor: str, key: str = "vec_id", label: str = "label", x: str = "x") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``x`` is a column of integer vectors without nulls, ``is_anchor`` a condition
    in SQL on the columns of ``vectors``."""
    spark = vectors.sparkSession
    numbered = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"),
        F.col(x).cast("array<int>").alias("x"), F.expr(is_anchor).alias("anchor"),
    )
    rows = materialize(numbered.where("key IS NOT NULL AND label IS NOT NULL"), "vectors")
    size = measure(rows, "x")
    cells = _grid(rows, size)
    file = materialize(_with_cells(rows, cells, size.width), "approximations")
    seeds = materialize(file.where(F.pmod(F.xxhash64("row"), F.lit(SEED_SHARE)) == 0), "seeds")
    anchors = materialize(rows.where("anchor"), "anchors")

    def results() -> Iterator[DataFrame]:
        for wave in _waves(anchors, size.width):
            wave = _raised(wave, _scan(seeds, wave, cells))
            shape = len(wave.row), POSITIVES
            low, high = np.full(shape, _HIGHEST), np.full(shape, _LOWEST)  # no positive: an empty window
            positives = _scan(file, wave, cells).collect()
            for r in positives:
                low[r.anchor, r.place - 1] = -((-LEAST_PERCENT * r.score) // 100)
                high[r.anchor, r.place - 1] = MOST_PERCENT * r.score // 100
            wave = replace(wave, low=low, high=high, floor=np.full(shape, _LOWEST), same=False, most=NEGATIVES)
            wave = _raised(wave, _scan(seeds, wave, cells))
            named = [(int(r.anchor), r.place - 1, int(wave.key[r.anchor]), r.key, r.score) for r in positives]
            named = spark.createDataFrame(named, "anchor int, window int, anchor_id long, positive_id long, positive_score long")
            # at most POSITIVES rows for each anchor of the wave
            yield _scan(file, wave, cells).join(F.broadcast(named), ["anchor", "window"]).select(
                "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
            )

    return materialize_each(spark, results(), _RESULT, "negatives")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table.where(is_whole(F.col("embedding"))).select("vec_id", moved.alias("label"), scaled(F.col("embedding"), SCALE).alias("x"))
    return hard_negatives(vectors, "vec_id % 100 = 0")


OP11_SQL = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
  FROM scores WHERE same QUALIFY place <= {POSITIVES})
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scores s USING (anchor)
  WHERE NOT s.same AND {LEAST_PERCENT} * positive_score <= 100 * s.score AND 100 * s.score <= {MOST_PERCENT} * positive_score)
WHERE rank <= {NEGATIVES}
"""
