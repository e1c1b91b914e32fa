import pytest
from pyspark.sql import functions as F

from bucketwise.llm import mixing as mx


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Cut and reshare by weight until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, fixed, total = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(most * sizes[s] for s in fixed)
        share = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if share * weight[s] > most * sizes[s]]
        if not over:
            target |= {s: share * weight[s] for s in free} | {s: most * sizes[s] for s in fixed}
            return target
        fixed |= set(over)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10}, {"a": 1, "b": 2, "c": 1000, None: 7}, {"a": 0, "b": 5}, {"a": 0}, {f"s{i:02d}": i * i for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "mix_source string, mix_size long")
    got = {r.mix_source: r.mix_target for r in mx.source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix(spark, odd, empty):
    mixed = mx.mix_sources(odd)
    assert set(odd.columns) <= set(mixed.columns) and mixed.count() == odd.count()
    copies = mixed.agg(F.sum("mix_copies")).first()[0]
    out = mx.emit_copies(mixed)
    assert out.columns == odd.columns and out.count() == copies
    assert mixed.where("mix_copies > 3 or mix_copies < 0").count() == 0
    assert mixed.collect() == mx.mix_sources(odd).collect()
    assert mx.emit_copies(mx.mix_sources(empty)).count() == 0


def test_taken_comes_near_the_targets(spark):
    rows = [(i, "w " * (20 + i % 30), f"s{i % 4}") for i in range(8000)]
    df = mx.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in df.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("t"), F.first("mix_target").alias("g")).collect():
        assert r.t == pytest.approx(r.g, rel=0.05)
