"""Compression of vectors to codes of a byte for each part, by integer codebooks.

Vectors are cut into equal consecutive parts.  Each part position has a
codebook of at most 256 entries; a part's code is the index of the nearest
entry (squared Euclidean distance, ties to the lower index).

Codebooks start from the parts of the vectors with the smallest keys.  In each
round they are broadcast (at most ``parts * 256 * width`` integers, whatever the
number of vectors); tasks compute all distances of an Arrow batch by
|x|^2 - 2 x.c + |c|^2 with exact products of 64-bit integers, and keep for each
entry the sum and the number of its parts.  These partial sums, one row for each
entry and task, are merged by a grouped shuffle; the new entries, componentwise
floor(sum / number), come back to the driver: again at most 256 for each part.
Nothing else does, and no task holds more than a batch and the sums.

All arithmetic is on integers, so codes, codebooks and errors do not depend on
how rows are dealt out, and a lost executor repeats its tasks with the same result.

Defined results
  * rows whose vector is null or has a null or non-finite component are dropped;
  * fewer vectors than entries give smaller codebooks; an empty table gives an
    empty table and codebooks without entries;
  * an entry without parts stays as it is; of equal entries the first is used;
  * equal keys are put in order by vector; null keys come last;
  * repeated rows count as often as they come and have a row each;
  * vectors of different widths, of a width that the parts do not divide, or with
    components whose products would not fit 64 bits are refused (ValueError);
  * other columns are kept; those that start with ``vc_`` are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.llm.common import materialize, no_columns, returns_memory
from bucketwise.llm.vectors import is_whole, matrix, measure, scaled

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a batch whose distances are held at once.
CHUNK = 4096
#: Sums per label up to this many are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Shares that the rows of one label are dealt into in that shuffle.
SALT = 32


@dataclass(frozen=True)
class Codebooks:
    #: Parts x entries x components, 64-bit integers.
    entries: np.ndarray

    @property
    def sha256(self) -> str:
        """Of all components in decimal, in order of part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, its columns of ``x``, nearest entries, squared distances) for each part."""
        parts, _, width = self.entries.shape
        for p in range(parts):
            own, book = x[:, p * width : (p + 1) * width], self.entries[p]
            # |x|^2 is alike for all entries of a row
            distance = (book * book).sum(axis=1) - 2 * (own @ book.T)
            best = distance.argmin(axis=1)
            yield p, own, best, distance[np.arange(len(own)), best] + (own * own).sum(axis=1)

    def decode(self, codes: bytes) -> list[int]:
        """The vector that a code stands for."""
        return [int(c) for p, k in enumerate(codes) for c in self.entries[p][k]]


def _sums(books: Codebooks, vectors: DataFrame, column: str) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (number, sums) over the parts whose nearest entry it is."""
    parts, n, width = books.entries.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books.entries)

    @returns_memory
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(shared.value)
        number, total = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                x = matrix(batch.slice(at, CHUNK).column(0), parts * width)
                for p, part, best, _ in own.nearest(x):
                    order = best.argsort(kind="stable")
                    found, first = np.unique(best[order], return_index=True)
                    number[p, found] += np.diff(np.append(first, len(order)))
                    total[p, found] += np.add.reduceat(part[order], first, axis=0)
        p, k = np.nonzero(number)
        sums = total[p, k]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(number[p, k]), flat], names=["p", "k", "number", "sums"])

    partial = vectors.select(column).mapInArrow(rows, "p int, k int, number long, sums array<long>")
    merged = partial.groupBy("p", "k").agg(F.sum("number").alias("number"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    found = {(r.p, r.k): (r.number, list(r[3:])) for r in merged.collect()}  # one row an entry
    shared.destroy()
    return found


def train_codebooks(
    vectors: DataFrame, column: str, width: int, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codebooks:
    """Codebooks of a column of integer vectors, all of ``width`` components."""
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    if not 1 <= entries <= 256:
        raise ValueError("a code of one byte has from 1 to 256 entries")
    first = vectors.orderBy(F.col(key).asc_nulls_last(), F.col(column)).limit(entries).select(column).collect()
    start = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, width // parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    for _ in range(rounds if first else 0):
        after = books.entries.copy()
        for (p, k), (number, sums) in _sums(books, vectors, column).items():
            after[p, k] = np.array(sums, np.int64) // number
        books = Codebooks(after)
    return books


def with_codes(vectors: DataFrame, column: str, books: Codebooks) -> DataFrame:
    """``vectors`` with ``vc_code``, a byte for each part, and ``vc_error``, the
    squared distances to the entries summed over the parts."""
    no_columns(vectors, "vc_")
    at, width = vectors.columns.index(column), books.entries.shape[0] * books.entries.shape[2]
    shared = vectors.sparkSession.sparkContext.broadcast(books.entries)
    schema = T.StructType([*vectors.schema.fields, T.StructField("vc_code", T.BinaryType()), T.StructField("vc_error", T.LongType())])

    @returns_memory
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(first, CHUNK)
                found = list(own.nearest(matrix(piece.column(at), width)))
                codes = np.stack([best for _, _, best, _ in found], axis=1).astype(np.uint8)
                error = np.sum([distance for *_, distance in found], axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(error)],
                    names=[*piece.schema.names, "vc_code", "vc_error"],
                )

    return vectors.mapInArrow(rows, schema)


def with_total(coded: DataFrame, by: str, value: str, name: str, broadcast_most: int = BROADCAST_LABELS) -> DataFrame:
    """``coded`` with the sum of ``value`` over the rows of equal ``by``, nulls together.

    Rows are summed before they are shuffled.  Few sums are broadcast; many are
    joined, with each label's rows dealt into ``SALT`` shares by their content."""
    sums = materialize(coded.groupBy(F.col(by).alias("vt_by")).agg(F.sum(value).alias(name)), "label-sums")
    if sums.count() <= broadcast_most:
        return coded.join(F.broadcast(sums), F.col(by).eqNullSafe(F.col("vt_by")), "left").drop("vt_by")
    dealt = coded.withColumn("vt_share", F.pmod(F.xxhash64(*(c for c, t in coded.dtypes if not t.startswith("map"))), F.lit(SALT)).cast("int"))
    shares = sums.withColumn("vt_of", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = dealt.join(shares, F.col(by).eqNullSafe(F.col("vt_by")) & (F.col("vt_share") == F.col("vt_of")), "left")
    return joined.drop("vt_by", "vt_of", "vt_share")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of ``embeddings``."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    whole = table.where(is_whole(F.col("embedding"))).select("vec_id", "label", scaled(F.col("embedding"), SCALE).alias("x"))
    vectors = materialize(whole, "vectors")
    books = train_codebooks(vectors, "x", measure(vectors, "x").width, "vec_id")
    coded = materialize(with_codes(vectors, "x", books).select("vec_id", "label", "vc_code", "vc_error"), "codes")
    return with_total(coded, "label", "vc_error", "label_error").select(
        "vec_id",
        F.lower(F.hex("vc_code")).alias("code"),
        F.col("vc_error").alias("error"),
        "label_error",
        F.lit(books.sha256).alias("codebooks_sha256"),
    )


def _assign_sql(round_: int) -> str:
    """Nearest entry of each part by the codebooks of a round."""
    return f"""near{round_} AS (
  SELECT row, part, min_by(entry, (distance, entry)) AS entry, min(distance) AS distance FROM (
    SELECT p.row, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
    FROM parts p JOIN book{round_} b USING (part)) GROUP BY row, part)"""


def _update_sql(round_: int) -> str:
    """The codebooks after a round; floor division of whole numbers."""
    return f"""book{round_ + 1} AS (
  SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM book{round_} b LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS c FROM (
      SELECT q.part, a.entry, q.place, sum(q.x)::BIGINT AS s, count(*)::BIGINT AS n
      FROM (SELECT row, part, unnest(v) AS x, unnest(range(len(v))) AS place FROM parts) q JOIN near{round_} a USING (row, part)
      GROUP BY ALL) GROUP BY part, entry) n USING (part, entry))"""


OP13_SQL = f"""
WITH vectors AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS row, vec_id, label, x FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS (
  SELECT row, part, list_slice(x, part * len(x) // {PARTS} + 1, (part + 1) * len(x) // {PARTS}) AS v
  FROM vectors, (SELECT unnest(range({PARTS})) AS part)),
book0 AS (SELECT part, row - 1 AS entry, v AS c FROM parts WHERE row <= {ENTRIES}),
{", ".join(f"{_assign_sql(r)}, {_update_sql(r)}" for r in range(ROUNDS))},
{_assign_sql(ROUNDS)},
coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM near{ROUNDS} GROUP BY row),
digest AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS place FROM book{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM vectors JOIN coded USING (row), digest
"""
