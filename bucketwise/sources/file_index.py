"""What a store knows of each data file, so that queries open only files that may fit.

Zones: rows, first and last instant, levels and the range of services of a file.
They are small and read by the driver, a day of a batch at a time.

Signatures: for each file the trigrams of its lower-cased messages and its
attributes (key and value), as blocked Bloom filters of about ten bits an item:
an item's hash chooses one block of 4 KB and three bits in it.  A file has as
many blocks as its items ask for, a power of two, so a look-up of an item reads
one block a file.  Signatures are a Parquet table sorted by block, made and asked
by column expressions.

A text occurs in a message only if all its trigrams do, so a file that lacks one
cannot fit; likewise a file without an attribute's key and value.  Texts of fewer
than three characters have no trigram: they choose no files, as in any trigram
index.  What remains is filtered exactly, so signatures never change a result.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.model import DAY
from bucketwise.plans.query import AggregateQuery, LogQuery

BLOCK_BITS = 1 << 15
ITEM_BITS, PROBES = 10, 3
MOST_BLOCKS = 1 << 12
#: Trigrams of a text that are looked up; more would hardly choose fewer files.
LOOKED_UP = 48
TEXT, ATTRIBUTE = "q", "a"

SIGNATURES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("blocks", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("batch", T.StringType()),
        T.StructField("of", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Zone:
    """A file of a day of a batch; without a name all files of that day, of which nothing is known."""

    folder: str
    day: str
    name: str | None = None
    rows: int = 0
    first: int = 0
    last: int = 0
    levels: tuple[str, ...] = ()
    services: tuple[str, str] = ("", "")
    size: int = 0

    @staticmethod
    def unknown(folder: str, day: str, first: int) -> "Zone":
        return Zone(folder, day, None, 0, first, first + DAY - 1)

    def may_fit(self, query: LogQuery | AggregateQuery) -> bool:
        """Whether a row of the file may be in the range and have the level and service."""
        cursor = getattr(query, "cursor", None)
        if query.since is not None and self.last < query.since or query.until is not None and self.first >= query.until:
            return False
        if cursor is not None and self.first > cursor.micros:
            return False
        if self.name is None:
            return True
        level = query.level is None or query.level in self.levels
        return level and (query.service is None or self.services[0] <= query.service <= self.services[1])


def zones(written: DataFrame) -> DataFrame:
    """One row a file of a batch that was just written."""
    micros = F.unix_micros("timestamp")
    return written.groupBy(F.col("day").cast("string").alias("day"), F.col("_metadata.file_name").alias("name")).agg(
        F.count("*").alias("rows"),
        F.min(micros).alias("first"),
        F.max(micros).alias("last"),
        F.sort_array(F.collect_set("level")).alias("levels"),
        F.array(F.min("service"), F.max("service")).alias("services"),
        F.max("id").alias("last_id"),
        F.max("_metadata.file_size").alias("size"),
    )


def trigrams(text: Column) -> Column:
    """Hashes of the distinct trigrams of a text, in lower case."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(...))"), F.lit(1))
    return F.transform(F.array_distinct(found), lambda t: F.xxhash64(F.lit(TEXT), t))


def attribute(key: Column, value: Column) -> Column:
    return F.xxhash64(F.lit(ATTRIBUTE), key, value)


def _block(item: Column, blocks: Column) -> Column:
    return item.bitwiseAND(blocks.cast("long") - 1).cast("int")


def _places(item: Column) -> list[Column]:
    """Bits of an item in its block, from bits of the hash that do not choose the block."""
    return [F.shiftrightunsigned(item, 64 - 15 * (k + 1)).bitwiseAND(F.lit(BLOCK_BITS - 1)) for k in range(PROBES)]


def signatures(written: DataFrame) -> DataFrame:
    """(name, kind, blocks, block, bits, of) of a batch's files.

    Items are made distinct before they are counted and before they are set, both
    by hash aggregations that begin in the tasks that read."""
    own = F.transform(F.map_entries("attributes_text"), lambda e: attribute(e["key"], e["value"]))
    sides = F.array(F.struct(F.lit(TEXT).alias("kind"), trigrams(F.col("message")).alias("items")), F.struct(F.lit(ATTRIBUTE).alias("kind"), own.alias("items")))
    file = written.select(F.col("day").cast("string").alias("of"), F.col("_metadata.file_name").alias("name"), F.explode(sides).alias("side"))
    items = file.select("of", "name", "side.kind", F.explode("side.items").alias("item")).distinct()
    wanted = F.ceil(F.count("*") * F.lit(ITEM_BITS) / F.lit(BLOCK_BITS)).cast("double")
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(wanted, F.lit(1.0))))).cast("int")
    size = items.groupBy("of", "name", "kind").agg(F.least(power, F.lit(MOST_BLOCKS)).alias("blocks"))
    placed = items.join(size, ["of", "name", "kind"]).select(
        "of", "name", "kind", "blocks", _block(F.col("item"), F.col("blocks")).alias("block"), F.explode(F.array(*_places(F.col("item")))).alias("place")
    )
    return placed.groupBy("of", "name", "kind", "blocks", "block").agg(F.bitmap_construct_agg("place").alias("bits"))


def _is_set(place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # a shift by a column: divide by the bit's value
    return F.floor(byte / F.pow(F.lit(2.0), place.bitwiseAND(F.lit(7)))) % 2 == 1


def uses_signatures(query: LogQuery | AggregateQuery) -> bool:
    return len(query.q or "") >= 3 or bool(query.attributes)


def fitting(signed: DataFrame, q: str | None, attributes: Mapping[str, str]) -> DataFrame:
    """(batch, of, name) of the files that may hold a row with the text and all attributes."""
    texts = F.slice(trigrams(F.lit(q or "")), 1, LOOKED_UP)
    pairs = [attribute(F.lit(k), F.lit(v)) for k, v in attributes.items()]
    sought = {TEXT: texts, ATTRIBUTE: F.array(*pairs) if pairs else F.array().cast("array<long>")}
    whole = reduce(Column.__add__, map(F.size, sought.values()))

    def hits(items: Column) -> Column:
        def here(item: Column) -> Column:
            return (_block(item, F.col("blocks")) == F.col("block")) & reduce(Column.__and__, map(_is_set, _places(item)))

        return F.size(F.filter(items, here))

    found = F.when(F.col("kind") == TEXT, hits(sought[TEXT])).otherwise(hits(sought[ATTRIBUTE]))
    kinds = [k for k, given in ((TEXT, len(q or "") >= 3), (ATTRIBUTE, bool(pairs))) if given]
    return signed.where(F.col("kind").isin(kinds)).groupBy("batch", "of", "name").agg(F.sum(found).alias("found")).where(F.col("found") == whole).drop("found")
