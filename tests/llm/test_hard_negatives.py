"""The file's bounds, and whole searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bucketwise.llm import hard_negatives as hn
from bucketwise.llm.vectors import is_whole, scaled
from tests.llm.conftest import VECTORS, odd_vectors


def brute_force(rows):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = math.fmod(label + 1, 10) if i % 7 == 0 else label
        kept.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (i, label, x) in enumerate(kept):
        if i % 100:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), j, other == label) for b, (j, other, y) in enumerate(kept) if b != a]
        for score, positive, _ in sorted(s for s in scores if s[2])[:5]:
            inside = sorted(s for s in scores if not s[2] and 30 * -score <= 100 * -s[0] <= 90 * -score)
            out += [(i, positive, rank, j, -score, -s) for rank, (s, j, _) in enumerate(inside[:10], 1)]
    return sorted(out)


def vectors(spark, rows):
    table = spark.createDataFrame(rows, VECTORS)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return table.where(is_whole(F.col("embedding"))).select("vec_id", moved.alias("label"), scaled(F.col("embedding"), 256).alias("x"))


def test_query_against_brute_force(spark, tables):
    got = sorted(tuple(r) for r in hn.op11_hard_negatives(spark, f"{tables}/odd").collect())
    assert got and got == brute_force(odd_vectors())


@pytest.mark.parametrize("wave, cells, seeds", [(3, 2, 1), (2, 256, 1000)])
def test_waves_cells_and_seeds_do_not_change_results(spark, monkeypatch, wave, cells, seeds):
    of = hn.Cells.of
    monkeypatch.setattr(hn, "WAVE_ROWS", wave)
    monkeypatch.setattr(hn, "SEED_SHARE", seeds)
    monkeypatch.setattr(hn, "SAMPLE_COMPONENTS", 80)
    monkeypatch.setattr(hn.Cells, "of", staticmethod(lambda *a: of(*a, cells)))
    got = hn.hard_negatives(vectors(spark, odd_vectors()), "vec_id % 100 = 0")
    assert sorted(map(tuple, got.collect())) == brute_force(odd_vectors())


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 40, (2000, 16))).astype(np.int64)
    x[7, 3] = 10**6  # an outlier makes one wide cell alone
    cells = hn.Cells.of(x[:500], x.min(axis=0), x.max(axis=0))
    codes, anchors = cells.encode(x), x[:20]
    d = np.arange(16)
    assert (cells.low[d, codes] <= x).all() and (x <= cells.high[d, codes]).all()
    low, high = hn.bounds(cells.tables(anchors), codes)
    exact = x @ anchors.T
    assert (low <= exact).all() and (exact <= high).all()
    best = np.sort(exact, axis=0)[-10]
    assert (high >= best).mean() < 0.05


def test_tables_of_large_products_are_wide():
    cells = hn.Cells.of(np.array([[2**20, -(2**20)]]), np.array([-(2**20)] * 2), np.array([2**20] * 2))
    assert cells.tables(np.array([[2**20, 2**20]])).dtype == np.int64
    low, high = hn.bounds(cells.tables(np.array([[2**20, 2**20]])), cells.encode(np.array([[2**20, 2**20]])))
    assert low[0, 0] <= 2**41 <= high[0, 0]
