"""Media columns: payloads as content-defined chunks, each stored once.

A rolling gear hash cuts a payload where its value has ``CUT_BITS`` zero bits,
so equal stretches are cut alike wherever they stand.  Chunk digests that occur
more than once are found by a Spark aggregate over digests alone; a Bloom
filter of them, of bounded size, is broadcast.  The store has two tables:

  * ``recipes``: per row its ordered chunk list (digest, length) and, inline,
    the compressed frames of chunks that no other row can share;
  * ``chunks``: every other chunk once, by digest.

A false positive of the filter moves a chunk to ``chunks``; nothing else
changes.  Reading joins chunk lists that lack frames with ``chunks``, once per
distinct list, puts each payload together in order and verifies every digest.
Payload bytes that occur once never move between executors.

The stored form of a row is its container: a header, the chunk list and the
frames in order; it is the same whether frames stood inline or in ``chunks``.

Defined results
  * null text counts as empty: a payload of 576 bytes 255;
  * equal texts have equal recipes, containers and features;
  * repeated rows each have a recipe, and null keys are kept; an empty table
    gives two empty tables; other columns are not read;
  * a damaged or missing chunk raises an error when it is read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketwise.llm.common import digest_key, digest_keys, returns_memory
from bucketwise.llm.url_filter import BlockedBloom
from bucketwise.sources.files import shared_folder

UNIT, PAD = 576, 255
LEAST, MOST = 1024, 16384
CUT_BITS = 12
WINDOW = 32
DIGEST_BYTES = 16
MAGIC = b"CDM1"
LEVEL = 3


def _gear_table() -> np.ndarray:
    """256 well-mixed 32-bit numbers by a rule (splitmix64 of the index)."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear_table()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the WINDOW bytes up to it:
    the sum of GEAR[byte] shifted by the byte's distance."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes([PAD]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def cut(payloads: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each payload.  Chunks are at least LEAST bytes,
    which is more than WINDOW, so payloads hashed in one array do not touch."""
    whole = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    marks = np.flatnonzero((gear_hash(whole) >> np.uint32(32 - CUT_BITS)) == 0) + 1
    starts = np.cumsum([0, *map(len, payloads)])
    low, high = np.searchsorted(marks, starts[:-1]), np.searchsorted(marks, starts[1:])
    out = []
    for start, end, a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), low.tolist(), high.tolist()):
        last, ends = start, []
        for mark in marks[a:b].tolist():
            while mark - last > MOST:
                last += MOST
                ends.append(last - start)
            if mark - last >= LEAST:
                last = mark
                ends.append(last - start)
        while end - last > MOST:
            last += MOST
            ends.append(last - start)
        if last < end:
            ends.append(end - start)
        out.append(ends)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST_BYTES).digest()


def container(digests: list[bytes], lengths: list[int], frames: list[bytes]) -> bytes:
    head = [MAGIC, struct.pack("<I", len(digests))]
    head += [struct.pack("<II", n, len(f)) + d for d, n, f in zip(digests, lengths, frames)]
    return b"".join(head + frames)


def _batches(batches: Iterable[pa.RecordBatch], size: int = 256) -> Iterator[tuple[pa.Array, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            piece = batch.slice(at, size)
            yield piece.column(0), [payload(t) for t in piece.column(1).to_pylist()]


def _chunks(data: bytes, ends: list[int]) -> list[bytes]:
    return [data[a:b] for a, b in zip([0, *ends], ends)]


@dataclass
class MediaStore:
    recipes: DataFrame
    chunks: DataFrame


RECIPES = "media_key long, n_bytes long, recipe_id binary, digests binary, lengths array<int>, frames array<binary>, n_missing int"
CHUNKS = "digest binary, frame binary"


def write_media(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> MediaStore:
    """Store the payload of every row; the files lie under ``path`` (by default
    a new folder in the shared one)."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    docs = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))

    @returns_memory
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in _batches(batches):
            found = [digest(c) for p, e in zip(data, cut(data)) for c in _chunks(p, e)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["digest"])

    shared = (
        docs.mapInArrow(digests, "digest binary").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    )
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(shared.select(digest_key(F.col("digest")).alias("h")).distinct()).words)

    @returns_memory
    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, press = BlockedBloom(bloom.value), zstandard.ZstdCompressor(level=LEVEL)
        for keys, data in _batches(batches):
            cuts = cut(data)
            rows: list[list] = [[] for _ in range(6)]
            for p, ends in zip(data, cuts):
                parts = _chunks(p, ends)
                names = [digest(c) for c in parts]
                elsewhere = known.may_contain(digest_keys(names)).tolist()
                joined = b"".join(names)
                for column, value in zip(
                    rows,
                    (
                        len(p.rstrip(bytes([PAD]))),  # 255 never occurs in UTF-8
                        hashlib.blake2b(joined, digest_size=DIGEST_BYTES).digest(),
                        joined,
                        [len(c) for c in parts],
                        [None if e else press.compress(c) for c, e in zip(parts, elsewhere)],
                        sum(elsewhere),
                    ),
                ):
                    column.append(value)
            types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [keys, *(pa.array(v, t) for v, t in zip(rows, types))],
                names=["media_key", "n_bytes", "recipe_id", "digests", "lengths", "frames", "n_missing"],
            )

    @returns_memory
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, press = BlockedBloom(bloom.value), zstandard.ZstdCompressor(level=LEVEL)
        sent: set[bytes] = set()  # a task sends a chunk once, as far as it remembers
        for _, data in _batches(batches):
            parts = [c for p, e in zip(data, cut(data)) for c in _chunks(p, e)]
            names = [digest(c) for c in parts]
            found: dict[bytes, bytes] = {}
            for name, part, hit in zip(names, parts, known.may_contain(digest_keys(names)).tolist()):
                if hit and name not in sent and name not in found:
                    found[name] = press.compress(part)
            if len(sent) > 200_000:
                sent.clear()
            sent.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())],
                names=["digest", "frame"],
            )

    docs.mapInArrow(recipes, RECIPES).write.option("compression", "none").parquet(f"{path}/recipes")
    docs.mapInArrow(chunks, CHUNKS).dropDuplicates(["digest"]).write.option("compression", "none").parquet(f"{path}/chunks")
    return open_media(spark, path)


def open_media(spark: SparkSession, path: str) -> MediaStore:
    return MediaStore(
        spark.read.schema(RECIPES).parquet(f"{path}/recipes"), spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    )


def rebuild(digests: bytes, lengths: list[int], frames: list[bytes]) -> tuple[bytes, bytes]:
    """(payload, container) of a chunk list with its frames; verifies each chunk."""
    names = [digests[i : i + DIGEST_BYTES] for i in range(0, len(digests), DIGEST_BYTES)]
    undo = zstandard.ZstdDecompressor()
    parts = []
    for name, size, frame in zip(names, lengths, frames, strict=True):
        if frame is None:
            raise ValueError(f"chunk {name.hex()} is missing")
        part = undo.decompress(frame, max_output_size=size)
        if len(part) != size or digest(part) != name:
            raise ValueError(f"chunk {name.hex()} is damaged")
        parts.append(part)
    return b"".join(parts), container(names, lengths, frames)


def features(data: bytes) -> str:
    """Of 8-bit samples around 128: mean, deviation, crossings of the middle,
    and the shares of eight equal ranges of values."""
    x = np.frombuffer(data, dtype=np.uint8)
    shares = np.bincount(x >> 5, minlength=8) / len(x)
    signs = x >= 128
    crossings = int((signs[1:] != signs[:-1]).sum())
    return f"{x.mean():.4f},{x.std():.4f},{crossings}," + ",".join(f"{s:.4f}" for s in shares)


FACTS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_FACT_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def media_facts(store: MediaStore) -> DataFrame:
    """Per stored row: its key, n_bytes and FACTS, from the stored bytes."""

    @returns_memory
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = batch.num_columns - 3
            rows: list[list] = [[] for _ in FACTS]
            for i in range(batch.num_rows):
                data, stored = rebuild(*(batch.column(fixed + c)[i].as_py() for c in range(3)))
                for column, value in zip(
                    rows,
                    (
                        len(data),
                        hashlib.sha256(data).hexdigest(),
                        zlib.crc32(data[-32:]),
                        len(stored),
                        hashlib.sha256(stored).hexdigest(),
                        features(data),
                    ),
                ):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:fixed], *(pa.array(v, t) for v, t in zip(rows, _FACT_TYPES))],
                names=[*batch.schema.names[:fixed], *FACTS],
            )

    kinds = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    whole = store.recipes.where("n_missing = 0").select("media_key", "n_bytes", "digests", "lengths", "frames")
    whole = whole.mapInArrow(facts, f"media_key long, n_bytes long, {kinds}")

    lacking = store.recipes.where("n_missing > 0")
    # one row for each distinct chunk list; rows that share it differ in their key alone
    lists = lacking.select("recipe_id", "digests", "lengths", "frames").dropDuplicates(["recipe_id"])
    placed = lists.select("recipe_id", "digests", F.posexplode("frames").alias("at", "frame")).select(
        "recipe_id", "at", "frame", F.expr(f"substring(digests, at * {DIGEST_BYTES} + 1, {DIGEST_BYTES})").alias("digest")
    )
    fetched = (
        placed.where("frame is null")
        .drop("frame")
        .join(store.chunks, "digest", "left")  # a missing chunk is an error, not a missing row
        .select("recipe_id", F.struct("at", "frame").alias("f"))
    )
    frames = (
        fetched.unionByName(placed.where("frame is not null").select("recipe_id", F.struct("at", "frame").alias("f")))
        .groupBy("recipe_id")
        .agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["frame"]).alias("frames"))
    )
    built = (
        lists.select("recipe_id", "digests", "lengths")
        .join(frames, "recipe_id")
        .select("recipe_id", "digests", "lengths", "frames")
        .mapInArrow(facts, f"recipe_id binary, {kinds}")
    )
    shared = lacking.select("media_key", "n_bytes", "recipe_id").join(built, "recipe_id").drop("recipe_id")
    return whole.unionByName(shared)


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return media_facts(write_media(docs)).withColumnRenamed("media_key", "doc_id")
