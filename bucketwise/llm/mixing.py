"""Mixing sources to target weights.

Plan: one aggregate of words per source, closed-form water filling over the
(small) table of sources, then every document is emitted ``floor(rate)`` times
plus one more time if its hash-seeded coin falls below the fraction of the
rate.  Only DataFrame functions are used.  The documents themselves are never
shuffled when the table of sources is small enough for Catalyst to broadcast
by its measured size; else they meet it in a sort-merge join whose hot sources
adaptive execution splits.

Defined results
  * null text has size 0; a null source is a source of its own, after all others;
  * sources without any word get target 0, rate 0 and no copies;
  * rows that repeat a doc_id are separate rows that share one coin;
  * an empty table gives an empty table; extra columns are carried by
    :func:`mix_sources` and :func:`emit_copies` unchanged;
  * added columns start with ``mix_``; a column whose name does is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketwise.llm.common import materialize, no_columns, unit_hash, word_count

#: No source is repeated more often than this.
MAX_RATE = 3
#: Weights that sources take in turn, in the order of their names' code points.
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")


def cyclic_weight(rank: Column, weights: tuple[int, ...] = WEIGHTS) -> Column:
    """The weight of the ``rank``-th source (from 1)."""
    table = F.array(*(F.lit(int(w)) for w in weights))
    return F.element_at(table, (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))


def source_targets(sizes: DataFrame, max_rate: int = MAX_RATE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source (``mix_source``): ``mix_source_size``, ``mix_weight``, ``mix_target``.

    ``sizes`` has ``mix_source`` and ``mix_size``.  All targets sum to all
    words.  A target is ``level * weight`` but at most ``max_rate`` times its
    source's size; what is cut is shared by weight among the others, so the
    level is the largest of ``(total - cut before) / weight left`` over the
    sources in the order in which they reach their limit.

    The windows run over one row per source, not over documents.
    """
    per = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last()))
    per = per.withColumn("mix_weight", cyclic_weight(rank, weights).cast("long"))
    limit = F.col("mix_source_size") * F.lit(max_rate)
    by_limit = Window.orderBy(
        (limit / F.col("mix_weight")).asc(), F.col("mix_source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("mix_source_size").over(everything) - (F.sum(limit).over(by_limit) - limit)
    weight_left = F.sum("mix_weight").over(everything) - (F.sum("mix_weight").over(by_limit) - F.col("mix_weight"))
    per = per.withColumn("mix_level", left.cast("double") / weight_left.cast("double"))
    level = F.max("mix_level").over(everything)
    return per.select(
        "mix_source",
        "mix_source_size",
        "mix_weight",
        F.least(limit.cast("double"), level * F.col("mix_weight").cast("double")).alias("mix_target"),
    )


def mix_sources(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    max_rate: int = MAX_RATE,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target``,
    ``mix_rate`` and ``mix_copies`` (how often the mix takes the document)."""
    no_columns(docs, "mix_")
    sized = docs.withColumn("mix_size", word_count(F.col(text)))
    # written first, so that its size is known when the join is planned
    targets = materialize(
        source_targets(sized.select(F.col(source).alias("mix_source"), "mix_size"), max_rate, weights), "targets"
    )
    rate = F.when(
        F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size").cast("double")
    ).otherwise(F.lit(0.0))
    whole = F.floor("mix_rate")
    coin = unit_hash(seed, F.col(key)) < F.col("mix_rate") - whole
    return (
        sized.join(targets, F.col(source).eqNullSafe(F.col("mix_source")), "left")
        .drop("mix_source", "mix_weight")
        .withColumn("mix_rate", rate)
        .withColumn("mix_copies", whole + F.when(coin, 1).otherwise(0))
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The mixed corpus: each document ``mix_copies`` times, as rows."""
    copies = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1), F.col("mix_copies").cast("int")))
    return mixed.withColumn("mix_copy", F.explode(copies)).drop(*ADDED, "mix_copy")


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"),
    )


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER () - (sum(3 * source_size) OVER w - 3 * source_size))::DOUBLE
       / (sum(weight) OVER () - (sum(weight) OVER w - weight))::DOUBLE AS level
  FROM weighed
  WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, (max(level) OVER ()) * weight::DOUBLE) AS target FROM levels
), rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN
          ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0
          < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
