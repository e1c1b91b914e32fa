"""Vectors of reals as vectors of integers, for operators that compute exactly."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are held as 32-bit integers; larger ones are refused by :func:`measure`.
_HELD = 2**31 - 1


def is_whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""

    def finite(x: Column) -> Column:
        x = x.cast("double")
        return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))

    return F.coalesce(F.forall(vector, finite), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as a double; beyond 32 bits the largest value."""

    def whole(x: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.least(F.greatest(y, F.lit(-_HELD)), F.lit(_HELD)).cast("int")

    return F.transform(vector, whole)


@dataclass(frozen=True)
class Measure:
    rows: int
    width: int
    #: The largest magnitude of a component.
    most: int


def measure(df: DataFrame, column: str) -> Measure:
    """Rows, common width and largest component of a column of :func:`scaled` vectors.

    Vectors of different widths, and components whose products could leave 64
    bits, have no exact result: both are refused."""
    x = F.col(column)
    got = df.agg(
        F.count("*").alias("rows"),
        F.min(F.size(x)).alias("least"),
        F.max(F.size(x)).alias("width"),
        F.max(F.greatest(F.abs(F.array_max(x)), F.abs(F.array_min(x)))).alias("most"),
    ).first()
    width, most = got.width or 0, got.most or 0
    if (got["least"] or 0) != width:
        raise ValueError(f"vectors have from {got['least']} to {width} components")
    if most >= _HELD or 4 * max(width, 1) * most * most >= 2**63:
        raise ValueError(f"components reach {most} after scaling: their products do not fit 64 bits")
    return Measure(got.rows, width, most)


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists without nulls as a matrix of 64-bit integers."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), width)
