"""Pieces that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketwise.sources.files import shared_folder

#: A word: a run of characters that are not one of the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_scratch: list[list[str]] = []


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs nothing that was computed before."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def materialize_each(spark: SparkSession, frames: Iterable[DataFrame], schema: str, name: str) -> DataFrame:
    """Write tables of one schema, each before the next is made, and read them as one."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    parts = []
    for df in frames:
        parts.append(f"{path}/{len(parts)}")
        df.write.option("compression", "zstd").parquet(parts[-1])
    out = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    out._shared_path = path
    return out


class temporary:  # noqa: N801  a context manager
    """Tables that are materialised inside are deleted at the end, but for those
    handed to :meth:`keep`, which belong to the next scope outside."""

    def __enter__(self) -> "temporary":
        _scratch.append([])
        self._made, self._kept, self._spark = _scratch[-1], set(), None
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self._kept.add(df._shared_path)
        self._spark = df.sparkSession
        return df

    def __exit__(self, *_: object) -> None:
        _scratch.remove(self._made)
        spark = self._spark or SparkSession.getActiveSession()
        for path in self._made:
            if path not in self._kept:
                delete(spark, path)
            elif _scratch:
                _scratch[-1].append(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def no_columns(df: DataFrame, prefix: str) -> None:
    """Refuse a table with columns that an operator would overwrite."""
    clash = sorted(c for c in df.columns if c.lower().startswith(prefix))
    if clash:
        raise ValueError(f"columns that start with {prefix} are the operator's own; rename {', '.join(clash)}")


def discard(df: DataFrame) -> None:
    """Delete the files behind a table from :func:`materialize`."""
    path = getattr(df, "_shared_path", None)
    if path is not None:
        delete(df.sparkSession, path)


def word_count(text: Column) -> Column:
    """Number of words (``WORD``) of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on ``seed`` and the keys alone (52 bits of MD5)."""
    parts = [F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys)]
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def digest_key(digest: Column) -> Column:
    """The first eight bytes of a binary digest as a signed big-endian long."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def digest_keys(digests: list[bytes]) -> np.ndarray:
    """:func:`digest_key` of digests that Python holds."""
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype=">i8").astype(np.int64)


def returns_memory(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For functions of ``mapInArrow``: workers outlive tasks, so what a task
    has freed goes back to the system at its end instead of staying with the
    allocators."""

    @wraps(rows)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from rows(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not every C library has it
                pass

    return run
