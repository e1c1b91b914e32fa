"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

Every URL gets a canonical form by column expressions.  The filter, whose
size has a hard upper bound, is built from segments in parallel, gathered and
broadcast; URLs that it cannot contain are settled without a shuffle.  The
possible hits alone meet the list in an exact equi-join that removes the false
positives, so the filter's size affects the cost and never the result.

Rules (host, path prefix) are a fixed, short parameter; they come before the list.

Defined results
  * a null url, or one without ``://``, has an empty host and an empty path,
    fits no rule, has no canonical form and is allowed by the method;
  * null or empty listed URLs list nothing; repeated ones count once;
  * repeated rows are judged alike, each on its own; an empty table stays
    empty; extra columns are carried; added columns start with ``url_``; a
    column whose name does is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.llm.common import discard, materialize, no_columns, returns_memory

#: (verdict, host, path prefix); of those that fit, the longest wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A session can name a list of URLs (lines of text) for the registered query;
#: else pages on hosts with one of these labels supply it.
LIST_SETTING = "spark.bucketwise.urlList"
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: Query parameters that do not name a different page.
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)(?:=[^&]*)?"

BLOCK_BITS = 512
WORDS_PER_BLOCK = BLOCK_BITS // 64
PROBES = 8
BITS_PER_KEY = 16
#: Upper bound of the filter: 2**28 bits are 32 MB.
MAX_BLOCKS = 2**28 // BLOCK_BITS
#: Parts of a filter that are built apart, at most 64 kB each.
SEGMENTS = 512

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s)(?:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s)(?:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` and port 80 or 443, path without a last ``/``,
    the query without tracking parameters and sorted; no scheme, no fragment.
    Null where there is no ``://``."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(url, r"^(?s)(?:.*?)://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^" + TRACKING + "$"))
    )
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(url.contains("://"), F.concat(host, path, tail))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        name = F.when(fits, F.lit(rule_host + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of 64-bit hashes: the block, and the PROBES bit numbers inside it."""
    keys = keys.view(np.uint64)
    block = ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    step = (keys * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    with np.errstate(over="ignore"):
        bits = (keys[:, None] + step[:, None] * np.arange(1, PROBES + 1, dtype=np.uint64)) >> np.uint64(55)
    return block.astype(np.int64), bits.astype(np.int64)


class BlockedBloom:
    """A Bloom filter whose probes for a key fall into one block of 512 bits."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.blocks = len(words) // WORDS_PER_BLOCK

    @staticmethod
    def blocks_for(keys: int) -> int:
        need = max(1, -(-keys * BITS_PER_KEY // BLOCK_BITS))
        return min(MAX_BLOCKS, max(SEGMENTS, 1 << (need - 1).bit_length()))

    @staticmethod
    def segment_of(keys: np.ndarray, blocks: int) -> np.ndarray:
        return _places(keys, blocks)[0] // (blocks // SEGMENTS)

    @staticmethod
    def fill(keys: np.ndarray, blocks: int, first: int, count: int) -> np.ndarray:
        """The words of blocks ``first`` to ``first + count`` for these keys."""
        words = np.zeros(count * WORDS_PER_BLOCK, dtype=np.uint64)
        block, bits = _places(keys, blocks)
        at = (block - first)[:, None] * WORDS_PER_BLOCK + (bits >> 6)
        np.bitwise_or.at(words, at.ravel(), (np.uint64(1) << (bits & 63).astype(np.uint64)).ravel())
        return words

    def may_contain(self, keys: np.ndarray) -> np.ndarray:
        block, bits = _places(keys, self.blocks)
        got = self.words[block[:, None] * WORDS_PER_BLOCK + (bits >> 6)] >> (bits & 63).astype(np.uint64)
        return (got & np.uint64(1)).all(axis=1)

    @classmethod
    def build(cls, hashes: DataFrame) -> "BlockedBloom":
        """From a one-column DataFrame of distinct longs.  At most MAX_BLOCKS
        blocks (32 MB) reach the driver, whatever the number of keys."""
        column, hashes = hashes.columns[0], materialize(hashes, "bloom-keys")  # counted first, then used
        blocks = cls.blocks_for(hashes.count())
        span = blocks // SEGMENTS

        @returns_memory
        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}  # segments are small; keys stream by
            for batch in batches:
                keys = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
                segment = cls.segment_of(keys, blocks)
                for k in np.unique(segment).tolist():
                    words = cls.fill(keys[segment == k], blocks, k * span, span)
                    found[k] = found[k] | words if k in found else words
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int32()), pa.array([w.tobytes() for w in found.values()], pa.binary())], names=["segment", "words"]
            )

        # a segment is a range of the keys' upper bits, so 512 ranges deal out whole segments
        parts = (
            hashes.select(F.col(column).cast("long").alias("h"))
            .repartition(min(SEGMENTS, max(1, blocks // 4096)), F.shiftrightunsigned("h", 55))
            .mapInArrow(fill, "segment int, words binary")
            .collect()
        )
        words = np.zeros(blocks * WORDS_PER_BLOCK, dtype=np.uint64)
        for row in parts:
            at = row.segment * span * WORDS_PER_BLOCK
            words[at : at + span * WORDS_PER_BLOCK] |= np.frombuffer(row.words, dtype=np.uint64)
        discard(hashes)
        return cls(words)


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with ``url_host``, ``url_path``, ``url_rule`` and ``url_verdict``.

    ``listed``: one column of URLs to block.
    """
    no_columns(pages, "url_")
    spark = pages.sparkSession
    keys = (
        listed.select(canonical_url(F.col(listed.columns[0])).alias("url_listed"))
        .where(F.length("url_listed") > 0)
        .distinct()
    )
    bloom = spark.sparkContext.broadcast(
        BlockedBloom.build(keys.select(F.xxhash64("url_listed").alias("h")).distinct()).words
    )

    @F.pandas_udf(T.BooleanType())
    def possible(h: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(bloom.value).may_contain(h.to_numpy(np.int64)))

    judged = pages.withColumn("url_host", url_host(F.col(url))).withColumn("url_path", url_path(F.col(url)))
    rule, verdict = fitting_rule(F.col("url_host"), F.col("url_path"), rules)
    judged = judged.withColumn("url_rule", rule).withColumn("url_verdict", verdict)
    open_ = judged.withColumn("url_canonical", canonical_url(F.col(url)))
    unsettled = F.col("url_verdict").isNull() & F.coalesce(F.length("url_canonical") > 0, F.lit(False))
    probed = open_.withColumn("url_hit", unsettled & possible(F.xxhash64("url_canonical")))
    settled = probed.where(~F.col("url_hit")).withColumn(
        "url_verdict", F.coalesce("url_verdict", F.lit("allow"))
    )
    hits = (
        probed.where("url_hit")
        .join(keys, F.col("url_canonical") == F.col("url_listed"), "left")
        .withColumn("url_verdict", F.when(F.col("url_listed").isNotNull(), "block").otherwise("allow"))
        .drop("url_listed")
    )
    return settled.unionByName(hits).drop("url_hit", "url_canonical")


def listed_by_label(pages: DataFrame, url: str = "url", labels=LISTED_LABELS) -> DataFrame:
    """URLs whose host has one of ``labels``: the list of the registered query."""
    return pages.where(F.arrays_overlap(F.split(url_host(F.col(url)), r"\."), F.array(*map(F.lit, labels)))).select(url)


def op10_filter_urls(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    path = spark.conf.get(LIST_SETTING, None)
    return filter_urls(pages, spark.read.text(path) if path else listed_by_label(pages)).select(
        "page_id",
        F.col("url_host").alias("host"),
        F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"),
        F.col("url_verdict").alias("verdict"),
    )


OP10_SQL = r"""
WITH parsed AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^(?s:.*?)://[^?#]*\?([^#]*)', 1), ''), '&'),
           lambda p: p <> '' AND NOT regexp_full_match(p, '(?:utm_[^=&]*|ref|fbclid|gclid)(?:=[^&]*)?'))) AS kept
  FROM pages
), canon AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
      regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM parsed
), listed AS (
  SELECT DISTINCT canonical AS c FROM canon
  WHERE list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AND length(canonical) > 0
), rules(verdict, rhost, prefix) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT url, arg_max(rhost || prefix, length(rhost || prefix)) AS rule, arg_max(verdict, length(rhost || prefix)) AS v
  FROM (SELECT DISTINCT url, host, path FROM canon) u
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, prefix)
  GROUP BY url
)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN c IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM canon LEFT JOIN best ON canon.url = best.url LEFT JOIN listed ON canonical = c
"""
