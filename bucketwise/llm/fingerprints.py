"""Document fingerprints by one-permutation MinHash, in column expressions only.

Every five-word shingle is hashed once; the top bits of the hash name a bin
and each bin keeps its least hash.  An empty bin probes other bins in an order
of its own (drawn by a universal hash of its number and the attempt) and takes
the value of the first occupied one, so each occupied bin is equally likely and
documents agree on the choice: optimal densification.  After PROBES attempts, as
in texts of few shingles, the occupied bin of least hash with its number is
taken, which is as likely to be any.  The fingerprint packs the low 8 bits of
every bin.  Two different values agree in them once in 256, which the estimate
of likeness corrects.

Sorting hashes together with one sentinel per bin puts every bin's least hash
at its head, so a document's fingerprint needs no shuffle and no aggregation.

Defined results
  * null text counts as empty; a text without words has no shingle, the
    fingerprint of all zeros, likeness 1 to another such text and 0 to others;
  * a text of fewer than five words is one shingle; repeats do not count;
  * equal texts have equal fingerprints, in any order and any table;
  * the order that neighbours are taken from is descending doc_id, null ids
    last, rows with equal ids by hash and text; the last is followed by the
    first, the only row by itself;
  * an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
BINS = 128
LOW_BITS = 8
PROBES = 12
_SHIFT = 57  # the top log2(BINS) bits of a hash name its bin
_REST = (1 << _SHIFT) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


_SENTINELS = [_signed((b << _SHIFT) | _REST) for b in range(BINS)]


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, _SHIFT)


def _tail(a: Column, first: int) -> Column:
    return F.slice(a, F.lit(first), F.greatest(F.size(a) - (first - 1), F.lit(0)))


def _pairwise(a: Column, b: Column, size: Column) -> Column:
    """Hashes of a[i], b[i] for the first ``size`` places."""
    return F.zip_with(F.slice(a, F.lit(1), size), F.slice(b, F.lit(1), size), lambda x, y: F.xxhash64(x, y))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: BINS low-order bytes as an array of numbers, or
    null for a text without words."""
    words, hashes, two, four, all_, heads, used = (f"{out}_{x}" for x in ("w", "h", "2", "4", "s", "b", "u"))
    n = F.size(words)
    keep = df.columns
    df = df.withColumn(words, F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    # hashes of two, four and five words in a row, each from the one before
    df = df.withColumn(two, F.when(n >= SHINGLE_WORDS, _pairwise(F.col(hashes), _tail(F.col(hashes), 2), n - 1)))
    df = df.withColumn(four, F.when(n >= SHINGLE_WORDS, _pairwise(F.col(two), _tail(F.col(two), 3), n - 3)))
    five = _pairwise(F.col(four), _tail(F.col(hashes), 5), n - 4)
    shingles = F.when(n >= SHINGLE_WORDS, five).when(n > 0, F.array(F.xxhash64(F.array_join(words, " "))))
    df = df.withColumn(all_, F.array_sort(F.concat(shingles, F.lit(_SENTINELS).cast("array<bigint>"))))
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.col(all_))
    first = F.zip_with(all_, before, lambda h, b: F.when(b.isNull() | (_bin(b) != _bin(h)), h))
    df = df.withColumn(heads, F.filter(first, lambda h: h.isNotNull()))
    df = df.withColumn(used, F.filter(heads, lambda h: h.bitwiseAND(_REST) != _REST))

    bins = F.transform(heads, lambda h: F.when(h.bitwiseAND(_REST) != _REST, h))

    def dense(s: Column) -> Column:
        mine = _bin(s["h"])
        probes = [F.element_at(s["b"], (F.pmod(F.xxhash64(mine, F.lit(k)), F.lit(BINS)) + 1).cast("int")) for k in range(PROBES)]
        # structs order by their first field; the bin breaks ties
        ranked = F.transform(s["u"], lambda v: F.struct(F.xxhash64(mine, _bin(v)).alias("o"), v.alias("v")))
        # hashed with its new bin, so that one borrowed hash is not the same bits in every bin
        borrowed = F.xxhash64(F.coalesce(*probes, F.array_min(ranked)["v"]), mine)
        return F.when(s["h"].bitwiseAND(_REST) != _REST, s["h"]).otherwise(borrowed)

    all_bins = f"{out}_a"
    df = df.withColumn(all_bins, bins)
    filled = F.transform(
        F.arrays_zip(F.col(heads).alias("h"), F.array_repeat(F.col(all_bins), BINS).alias("b"), F.array_repeat(F.col(used), BINS).alias("u")), dense
    )
    low = F.transform(filled, lambda v: v.bitwiseAND((1 << LOW_BITS) - 1).cast("smallint"))
    return df.withColumn(out, F.when(n > 0, low)).select(*keep, out)


def packed(fp: Column) -> Column:
    """A fingerprint as lower-case hexadecimal digits, a byte per bin."""
    digits = F.array_join(F.transform(fp, lambda v: F.lpad(F.lower(F.hex(v.cast("bigint"))), LOW_BITS // 4, "0")), "")
    return F.coalesce(digits, F.lit("0" * (BINS * LOW_BITS // 4)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles of two fingerprints: the
    share of equal bins less what chance adds to it."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0**-LOW_BITS
    estimate = F.greatest((same - chance) / (1 - chance), F.lit(0.0))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(estimate)


def with_next(df: DataFrame, key: str, values: dict[str, str], tie: str) -> DataFrame:
    """``df`` with, for each ``name: column`` of ``values``, that column of the
    row that follows in descending order of ``key`` (the first follows the last).

    Rows are dealt into ranges of keys, null keys into one of their own, and a
    range that one key fills into ranges of the hash of ``tie``, which orders the
    rows of a key.  A range also gets a copy of the row that follows its last
    one.  The driver sees quantiles, and of each range its first row's key and
    hash and its size, a bounded number; each row moves once.
    """
    spark = df.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    k, h = F.col(key).cast("long"), F.xxhash64(tie)
    cuts = df.agg(F.percentile_approx(k, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    table = F.lit(sorted(set(cuts))).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    dealt = F.when(k.isNull(), F.lit(-1)).otherwise(F.size(F.filter(table, lambda c: c < k)))
    sizes = df.groupBy(dealt.alias("r")).agg(F.count("*").alias("n"), F.min(k).eqNullSafe(F.max(k)).alias("one")).collect()
    share = max(1, sum(r.n for r in sizes) // ranges)
    parts = {r.r: max(1, -(-r.n // share)) if r.one else 1 for r in sizes}
    # ranges of hashes: ascending, so later ones come later in the order
    whole = F.element_at(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), dealt) if parts else F.lit(1)
    inner = F.floor((h.cast("double") / F.lit(2.0**64) + 0.5) * whole).cast("int")
    place = F.struct((-dealt).alias("r"), F.least(F.greatest(inner, F.lit(0)), whole - 1).alias("i"))
    heads = df.groupBy(place.alias("p")).agg(F.min(F.struct((-F.coalesce(k, F.lit(-(2**63) + 1))).alias("k"), h.alias("h"))).alias("head")).collect()
    order = sorted(((r.p.r, r.p.i), r.head.h) for r in heads)
    # what follows the last row of a range is the first of the next; the very first follows the last
    number = {at: i for i, (at, _) in enumerate(order)}
    own = F.element_at(F.create_map(*(F.lit(x) for (r, i), n in number.items() for x in (f"{r}:{i}", n))), F.concat_ws(":", place["r"], place["i"])) if order else F.lit(0)
    df = df.withColumn("next_range", own).withColumn("next_hash", h)
    first = F.element_at(F.lit([x for _, x in order]), F.col("next_range") + 1) if order else F.lit(None).cast("long")
    w = Window.partitionBy("next_at").orderBy("next_copy", F.col(key).desc_nulls_last(), "next_hash", F.col(tie))
    here = F.struct(F.col("next_range").alias("next_at"), F.lit(0).alias("next_copy"))
    before = F.pmod(F.col("next_range") - 1, F.lit(max(1, len(order)))).alias("next_at")
    # rows that may be the first of their range: those with its hash (of other keys, a few in vain)
    places = F.when(F.col("next_hash") == first, F.array(here, F.struct(before, F.lit(1).alias("next_copy")))).otherwise(F.array(here))
    df = df.withColumn("next_place", F.explode(places)).select(
        *[c for c in df.columns if c != "next_range"], "next_place.next_at", "next_place.next_copy"
    )
    for name, column in values.items():
        df = df.withColumn(name, F.lead(column).over(w))
    return df.where("next_copy = 0").drop("next_at", "next_copy", "next_hash")


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = with_fingerprint(docs, "text", "fp")
    pairs = with_next(marked, "doc_id", {"next_text": "text", "next_fp": "fp"}, "text")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - third),
        F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third),
    )
    both = with_fingerprint(pairs.withColumn("edited", edited).drop("next_text"), "edited", "edited_fp")
    return both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("fp")).alias("fingerprint"),
        packed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
