"""Codebooks against brute force with Python's own integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bucketwise.llm import vector_codes as vc
from bucketwise.llm.vectors import is_whole, measure, scaled
from tests.llm.conftest import VECTORS, odd_vectors


def brute_force(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(part, book):
        distance, k = min((sum((a - b) ** 2 for a, b in zip(part, entry)), k) for k, entry in enumerate(book))
        return k, distance

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(nearest(cut(v)[p], books[p])[0], []).append(cut(v)[p])
            for k, members in mine.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    coded, totals = [], {}
    for i, v, label in kept:
        found = [nearest(part, books[p]) for p, part in enumerate(cut(v))]
        error = sum(d for _, d in found)
        totals[label] = totals.get(label, 0) + error
        coded.append((i, label, "".join(f"{k:02x}" for k, _ in found), error))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(i, code, error, totals[label], digest) for i, label, code, error in coded]


def key(row):
    return tuple((x is None, x) for x in row)


def integers(df, scale=vc.SCALE):
    return df.where(is_whole(F.col("embedding"))).select("vec_id", "label", scaled(F.col("embedding"), scale).alias("x"))


def test_query_against_brute_force(spark, tables):
    got = [tuple(r) for r in vc.op13_vector_codes(spark, f"{tables}/odd").collect()]
    assert sorted(got, key=key) == sorted(brute_force(odd_vectors(), vc.PARTS, vc.ENTRIES, vc.ROUNDS, vc.SCALE), key=key)


@pytest.mark.parametrize("entries, rounds, parts", [(1, 2, 2), (7, 3, 8), (5, 0, 1)])
def test_other_shapes(spark, entries, rounds, parts):
    vectors = integers(spark.createDataFrame(odd_vectors(), VECTORS), 64).cache()
    books = vc.train_codebooks(vectors, "x", 8, "vec_id", parts, entries, rounds)
    want = brute_force(odd_vectors(), parts, entries, rounds, 64)
    assert books.sha256 == want[0][4]
    got = vc.with_codes(vectors, "x", books).select("vec_id", F.lower(F.hex("vc_code")), "vc_error").collect()
    assert sorted(map(tuple, got), key=key) == sorted((r[:3] for r in want), key=key)


def test_few_vectors_have_small_codebooks_and_no_error(spark):
    vectors = integers(spark.createDataFrame([(5, [0.5, -0.5], 1), (3, [-0.1, 0.2], 1), (3, [-0.1, 0.2], None)], VECTORS))
    books = vc.train_codebooks(vectors, "x", 2, "vec_id", 2)
    assert books.entries.shape == (2, 3, 1)
    rows = vc.with_codes(vectors, "x", books).collect()
    assert {(r.vec_id, bytes(r.vc_code).hex(), r.vc_error) for r in rows} == {(5, "0202", 0), (3, "0000", 0)}
    assert all(books.decode(bytes(r.vc_code)) == r.x for r in rows)


def test_sums_by_label_are_the_same_by_broadcast_and_by_shares(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 2 > 0, F.col("id") % 7).alias("label"), (F.col("id") * 3).alias("error"))
    one, two = (vc.with_total(rows, "label", "error", "total", most) for most in (100, 2))
    assert sorted(map(tuple, one.collect()), key=key) == sorted(map(tuple, two.collect()), key=key)
    want = {label: sum(r.error for r in rows.collect() if r.label == label) for label in (None, 0, 1, 2, 3, 4, 5, 6)}
    assert all(r.total == want[r.label] for r in two.collect())


def test_what_is_refused(spark):
    def size(*vectors):
        return measure(integers(spark.createDataFrame([(i, list(v), 0) for i, v in enumerate(vectors)], VECTORS)), "x")

    assert (size((0.5, 1.0), (-2.0, 0.0)).width, size((0.5, 1.0), (-2.0, 0.0)).most) == (2, 2048)
    with pytest.raises(ValueError, match="from 1 to 2"):
        size((0.5,), (0.5, 1.0))
    with pytest.raises(ValueError, match="64 bits"):
        size((1e30,))
    with pytest.raises(ValueError, match="equal parts"):
        vc.train_codebooks(spark.createDataFrame([], "vec_id long, x array<int>"), "x", 6, "vec_id")
    with pytest.raises(ValueError, match="vc_code"):
        vc.with_codes(spark.createDataFrame([], "x array<int>, vc_code int"), "x", vc.Codebooks(np.zeros((1, 1, 1), np.int64)))
