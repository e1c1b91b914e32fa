"""Connected components of a distributed list of links.

Alternating large-star and small-star rounds: each round is two equi-joins
and aggregates over links, never a list of a node's neighbours, so a node with
very many links is only a skewed join, which adaptive execution splits.  Every
round is written to the shared folder; nothing is kept on one executor and no
links reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.llm.common import discard, materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star round over links (a > b), again as distinct links a > b."""
    flipped = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = links.unionByName(flipped) if large else links
    least = around.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    met = around.join(least, F.col("a") == F.col("node"))
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return out.where("a > b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns) that is not
    its own root; the root is the smallest node that can be reached.

    Links may repeat, run either way or join a node to itself; null ends are
    ignored.  Raises if ``most_rounds`` rounds (each about halves the longest
    path) do not settle it.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    now = materialize(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(a.isNotNull() & b.isNotNull())
        .where("a > b")
        .distinct(),
        "links",
    )

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = digest(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        after = materialize(_star(_star(now, True), False), "links")
        discard(now)
        now, before, seen = after, seen, digest(after)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
