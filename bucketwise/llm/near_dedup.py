"""Near-duplicate removal: SimHash candidates, then an exact prefix search, verified on five-word shingles.

Two texts are linked if their sets of five-word shingles (lower-cased in A-Z)
have a Jaccard similarity of ``similarity`` or more.  A class is a component of
all such links.  Links are found in three steps, each on what the ones before
left apart, and each is verified on the whole sets:

1. fingerprints of a text's distinct words propose pairs through the generalised
   pigeonhole join of :mod:`bucketwise.llm.simhash`; of the pairs within
   ``RADIUS`` bits a spanning forest is verified;
2. shingles are put in one order for all texts, rare ones first.  Of n shingles,
   the first n - ceil(similarity * n) + 1 are a text's prefix, and two texts that
   are similar enough share a shingle of both prefixes.  Where texts of
   several components have a shingle in their prefixes, each text proposes
   those that it shares most with, among its neighbours in size and the texts
   there that share most with others;
3. all pairs of texts that share such a shingle, that are still apart and that
   sizes and places in the order do not rule out.

Pairs that are proposed are judged by sketches first, a thirtieth to a fifteenth of the
sets' size, which only reject pairs that cannot be similar enough; the whole sets
of what is left, mostly links, are then fetched and compared.

Step 3 leaves no pair out, so the classes are exact; fingerprints, forests,
neighbours and the sampled order affect the cost alone.  Steps 1 and 2 join
dense groups with one link a text, so that step 3 meets few pairs.

Exact copies meet by digest first, so a text is fingerprinted, linked and
verified once however often it occurs.  One document of each class stays:
that of the smallest doc_id.  Texts that no removal can concern do not move.

Defined results
  * null and empty texts are copies of each other each, texts of fewer than
    five words are one shingle, texts without words have none and are only
    ever linked to equal texts;
  * of rows that repeat with doc_id and text one stays; null doc_ids come first;
  * an empty table stays empty; all columns are carried; a column whose name
    starts with ``near_`` is refused;
  * texts are told apart by the first 64 bits of their MD5, shingles by 32 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.llm.common import materialize, no_columns, returns_memory, temporary
from bucketwise.llm.components import components
from bucketwise.llm.simhash import CHUNK_ROWS, SEED, SHORT_RUN, fingerprint, near_links, shingle_hashes
from bucketwise.llm.url_filter import BlockedBloom

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bits that the fingerprints of proposed pairs differ in, at most.
RADIUS = 3
#: Texts that show which shingles are frequent, and frequent shingles that are
#: told apart from rare ones, at most.
ORDER_SAMPLE = 20_000
FREQUENT = 200_000
#: Texts that a text proposes in the second step, at most; the third has no limit.
PARTNERS = 3
#: Texts with one shingle that a task compares with one another, about.
BLOCK = 8000


def word_fingerprint(text: str | None) -> int:
    """The fingerprint of the distinct words of a text."""
    words = sorted(set((text or "").encode("utf-8", "surrogatepass").lower().split()))
    return fingerprint(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words)))


def text_node(text: Column) -> Column:
    """A text's node: 64 bits of its MD5; a null text differs from an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("\x00null"))), 1, 16), 16, -10).cast("long")


def shingle_set(text: str | None) -> np.ndarray:
    """The shingles as sorted 32-bit hashes: of two texts of a thousand words,
    one in ten thousand pairs shares a hash by chance."""
    return np.unique((shingle_hashes(text, SHINGLE_WORDS) >> np.uint64(32)).astype(np.uint32))


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of empty ones 0."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    common = int((a[at] == b).sum())
    return common / (len(a) + len(b) - common)


def sketch_of(words: np.ndarray) -> bytes:
    """For each of m buckets of shingles whether their number is odd, as bits; m is
    the least power of two that is not below the size of the set, 64 at least."""
    m = max(64, 1 << (len(words) - 1).bit_length())
    odd = np.bincount(words & np.uint32(m - 1), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def can_be_similar(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray, similarity: float) -> bool:
    """Whether the sketches (bytes) of two sets of these sizes allow the similarity.

    A bucket that is odd in one set alone holds a shingle of one alone, and of
    sets that are similar enough at most (1 - s) / (1 + s) of both sizes are such.
    A sketch halves to the one of half as many buckets."""
    while len(a) != len(b):
        a, b = sorted((a, b), key=len)
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    differ = int(np.bitwise_count(a ^ b).sum())
    return min(n_a, n_b) > 0 and differ <= (1 - similarity) / (1 + similarity) * (n_a + n_b) + 1e-9


def _filter(keys: DataFrame) -> "pd.Series":
    """A vectorised test for membership, possibly too generous, in distinct longs."""
    bloom = keys.sparkSession.sparkContext.broadcast(BlockedBloom.build(keys).words)

    @F.pandas_udf(T.BooleanType())
    def possible(h: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(bloom.value).may_contain(h.to_numpy(np.int64)))

    return possible


def shingle_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, sketch, words): the shingle set of every text, its size and sketch, once.

    ``texts``: near_key, near_node, text; ``nodes``: near_node, near_key of a row
    that speaks for it, and near_copies, the number of its rows."""
    several = nodes.where("near_copies > 1")
    repeated = _filter(several.select("near_node"))

    @returns_memory
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                found = [shingle_set(text.as_py()) for text in piece.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array([len(f) for f in found], pa.int32()),
                        pa.array([sketch_of(f) for f in found], pa.binary()),
                        pa.array([f.tobytes() for f in found], pa.binary()),
                    ],
                    names=["node", "n", "sketch", "words"],
                )

    def of(rows: DataFrame) -> DataFrame:
        return rows.select("near_node", "text").mapInArrow(sets, "node long, n int, sketch binary, words binary")

    # texts that stand in one row for certain do not move
    alone = of(texts.where(~repeated("near_node")))
    others = texts.where(repeated("near_node")).join(nodes.select("near_key", "near_node"), ["near_key", "near_node"], "left_semi")
    return materialize(alone.unionByName(of(others).dropDuplicates(["node"])), "shingles")


def _tokens(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a batch of sets in one array, and how many each set has."""
    found = [np.frombuffer(w.as_buffer(), np.uint32) if w.is_valid else np.zeros(0, np.uint32) for w in words]
    return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)


def frequent_shingles(shingles: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of texts have, ascending, and how many have them."""
    share = max(1, -(-shingles.count() // ORDER_SAMPLE))

    @returns_memory
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                tokens, _ = _tokens(batch.column(0).slice(at, 512))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int32))], names=["token"])

    sample = shingles.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).select("words")
    counts = sample.mapInArrow(rows, "token int").groupBy("token").count().where("count > 1")
    found = counts.orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    token = np.ascontiguousarray(found.column("token").to_numpy()).astype(np.int32).view(np.uint32)
    order = np.argsort(token)
    return token[order], found.column("count").to_numpy()[order].astype(np.int64)


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many first shingles of n a text of that similarity cannot miss all of."""
    return np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)


def _possible(place_a: np.ndarray, place_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts whose first common shingle has these places (size << 32 |
    place) can be similar enough."""
    size_a, size_b = place_a >> 32, place_b >> 32
    left = np.minimum(size_a - (place_a & 0xFFFFFFFF), size_b - (place_b & 0xFFFFFFFF))
    least = similarity / (1 + similarity) * (size_a + size_b) - 1e-9
    return (left >= least) & (np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - 1e-9)


def _apart(
    token: np.ndarray, place: np.ndarray, root: np.ndarray, similarity: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows sorted by token and place: pairs with one token and two roots
    that can be similar enough (row, row)."""
    n = len(token)
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if n else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([first, [n]]))
    at = np.flatnonzero(np.repeat(length <= SHORT_RUN, length))
    run_end = np.repeat(first + length, length)
    for k in range(1, SHORT_RUN):
        at = at[at + k < run_end[at]]
        if not len(at):
            break
        ok = (root[at] != root[at + k]) & _possible(place[at], place[at + k], similarity)
        yield at[ok], at[ok] + k
    for f, size in zip(first[length > SHORT_RUN].tolist(), length[length > SHORT_RUN].tolist()):
        for x in range(f, f + size, 512):
            left = np.arange(x, min(x + 512, f + size))
            for y in range(x, f + size, 512):
                if (place[y] >> 32) * similarity - 1e-9 > place[left[-1]] >> 32:
                    break  # this text and all after it are too long
                right = np.arange(y, min(y + 512, f + size))
                i, j = np.nonzero((root[left][:, None] != root[right][None, :]) & (left[:, None] < right[None, :]))
                ok = _possible(place[left[i]], place[right[j]], similarity)
                yield left[i[ok]], right[j[ok]]


_PREFIX = "token int, place long, node long"


def prefix_rows(shingles: DataFrame, roots: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(token, place, node) of the shingles in texts' prefixes that texts of
    several components of ``roots`` (node, root) have; place: size << 32 | place."""
    common, count = frequent_shingles(shingles)
    order = shingles.sparkSession.sparkContext.broadcast((common, count))

    @returns_memory
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = order.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                node, words = batch.slice(at, 256).columns
                tokens, n = _tokens(words)
                owner = np.repeat(np.arange(len(n)), n)
                rank = np.zeros(len(tokens), np.int64)
                if len(known):
                    near = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    rank = np.where(known[near] == tokens, often[near], 0)
                by = np.argsort((owner << 32) + rank, kind="stable")  # of one rank: by shingle
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
                kept = place < prefix_length(n, similarity)[owner]
                owner, place = owner[kept], place[kept]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tokens[by][kept].view(np.int32)),
                        pa.array((n[owner] << 32) + place),
                        pa.array(node.to_numpy(zero_copy_only=False)[owner]),
                    ],
                    names=["token", "place", "node"],
                )

    def rows(sets: DataFrame) -> DataFrame:
        return sets.select("node", "words").mapInArrow(prefixes, _PREFIX)

    # most shingles stand in one text alone; the filter spares their rows the way
    joined = shingles.join(roots, "node", "left").select(F.coalesce("root", "node").alias("node"), "words")
    met = rows(joined).groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    met = materialize(met.select("token"), "met")
    possible = _filter(met.select(F.xxhash64("token").alias("h")))
    here = rows(shingles).where(possible(F.xxhash64("token")))
    return materialize(here.join(met, "token", "left_semi"), "prefixes")


def _runs_of_tokens(dealt: DataFrame, keys: list[str], pairs: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(a, b): what ``pairs`` finds among the rows with the same ``keys``, in
    order of place; it gets the columns run, place, root and weight."""

    @returns_memory
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found(run: np.ndarray, place: np.ndarray, node: np.ndarray, root: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
            got, size = [], 0
            for i, j in pairs(run, place, root, weight):
                got.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])))
                size += len(i)
                if size > CHUNK_ROWS:
                    yield batch_of(got)
                    got, size = [], 0
            if size:
                yield batch_of(got)

        def batch_of(got: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], names=["a", "b"])

        for batch in batches:
            held.append(tuple(np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns))
            if sum(len(h[0]) for h in held) >= CHUNK_ROWS:
                rows = tuple(np.concatenate(c) for c in zip(*held))
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last run may go on
                held = [tuple(c[cut:] for c in rows)]
                if cut:
                    yield from found(*(c[:cut] for c in rows))
        if held:
            yield from found(*(np.concatenate(c) for c in zip(*held)))

    rows = dealt.select(F.xxhash64(*keys).alias("run"), "place", "node", "root", "weight")
    rows = rows.repartition("run").sortWithinPartitions("run", "place", "node")
    return rows.mapInArrow(meet, "a long, b long")


def _apart_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` of shingles that still meet several components, with root, weight
    (the shingles of the node in ``rows``), blocks (of a run of one shingle, each
    of BLOCK texts or so) and own, the block of the node."""
    weights = rows.groupBy("node").agg(F.count("*").alias("weight"))
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(weights, "node")
    apart = rooted.groupBy("token").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")
    ).where("low < high").select("token", "blocks")
    return rooted.join(apart, "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))


def best_partners(rows: DataFrame, roots: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), PARTNERS at most of each text: of its neighbours by size in the runs
    of its shingles, and of the texts there that share most shingles with
    others, those of other components that it meets most often.

    An original shares all its shingles with its copies, a copy not all with
    others, so copies that are alike only by way of the original find it."""

    def partners(run: np.ndarray, place: np.ndarray, root: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        heaviest = np.lexsort((-np.arange(len(run)), weight, run))  # runs stay in order
        hub = np.repeat(heaviest[np.append(first[1:], len(run)) - 1], np.diff(np.append(first, len(run))))
        every = np.arange(len(run))
        for i, j in ((every[:-1][run[1:] == run[:-1]], every[1:][run[1:] == run[:-1]]), (every, hub)):
            ok = (root[i] != root[j]) & _possible(place[i], place[j], similarity)
            yield i[ok], j[ok]

    met = _runs_of_tokens(_apart_rows(rows, roots), ["own", "token"], partners).groupBy("a", "b").agg(F.count("*").alias("n"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    order = Window.partitionBy("node").orderBy(F.desc("n"), "other")
    best = met.select(ends.alias("e"), "n").select("e.*", "n").withColumn("place", F.row_number().over(order)).where(F.col("place") <= PARTNERS)
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def pairs_apart(rows: DataFrame, roots: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): all pairs of texts of different components that share a shingle
    of ``rows`` and that can be similar enough.

    Of a run of one shingle beyond BLOCK texts every pair of blocks is a run of
    its own, however large the whole is."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = _apart_rows(rows, roots).select("token", "place", "node", "root", "weight", "own", other)
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return _runs_of_tokens(dealt, ["i", "j", "token"], lambda run, place, root, _: _apart(run, place, root, similarity)).distinct()


def _judged(pairs: DataFrame, sets: DataFrame, judge: Callable[..., bool]) -> DataFrame:
    """The ``pairs`` (a, b) that ``judge`` accepts; it gets the columns of ``sets``
    besides node (binary ones as bytes in arrays), those of a first."""
    possible = _filter(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct())
    sets = sets.where(possible("node"))
    values = [c for c in sets.columns if c != "node"]

    def column(c: pa.Array) -> list:
        return [np.frombuffer(v.as_buffer(), np.uint8) for v in c] if pa.types.is_binary(c.type) else c.to_pylist()

    @returns_memory
    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [judge(*v) for v in zip(*(column(c) for c in batch.columns[2:]))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.select("a", "b")
    for end in ("a", "b"):
        both = both.join(sets.select(F.col("node").alias(end), *(F.col(v).alias(f"{v}_{end}") for v in values)), end)
    of_both = [f"{v}_{end}" for end in ("a", "b") for v in values]
    return both.select("a", "b", *of_both).mapInArrow(accepted, "a long, b long")


def verified_links(proposed: DataFrame, shingles: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) of ``proposed`` whose texts are similar enough: by sketches,
    then what these leave by the whole sets."""

    def likely(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray) -> bool:
        return can_be_similar(n_a, a, n_b, b, similarity)

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        return similarity_of(a.view(np.uint32), b.view(np.uint32)) >= similarity

    proposed = materialize(proposed.select("a", "b"), "proposed")
    left = materialize(_judged(proposed, shingles.select("node", "n", "sketch"), likely), "likely")
    return materialize(_judged(left, shingles.select("node", "words"), similar), "verified")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per distinct row (near_key, near_node): near_rows (how many there are),
    near_class and near_kept (whether the class keeps it)."""
    first = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), first).alias("near_key"), text_node(F.col(text)).alias("near_node"), F.col(text).alias("text"))

    @returns_memory
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((word_fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=["near_key", "near_node", "fp"])

    marked = materialize(rows.mapInArrow(prints, "near_key long, near_node long, fp long"), "marked")
    nodes = marked.groupBy("near_node").agg(F.min("fp").alias("fp"), F.min("near_key").alias("near_key"), F.count("*").alias("near_copies"))
    nodes = materialize(nodes, "nodes")
    shingles = shingle_sets(rows, nodes)
    roots = components(verified_links(near_links(nodes.select(F.col("near_node").alias("node"), "fp"), radius), shingles))
    found = prefix_rows(shingles, roots)
    for search in (best_partners, pairs_apart):
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(links.unionByName(verified_links(search(found, roots), shingles)))
    classes = nodes.join(roots, F.col("near_node") == F.col("node"), "left").select(
        "near_node", F.coalesce("root", "near_node").alias("near_class")
    )
    counted = marked.groupBy("near_key", "near_node").agg(F.count("*").alias("near_rows"))
    counted = materialize(counted.join(classes, "near_node"), "classes")
    kept = counted.groupBy("near_class").agg(F.min(F.struct("near_key", "near_node")).alias("near_best"))
    return counted.join(kept, "near_class").select(
        "near_key",
        "near_node",
        "near_rows",
        "near_class",
        (F.struct("near_key", "near_node") == F.col("near_best")).alias("near_kept"),
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each class of near-duplicates."""
    no_columns(docs, "near_")
    with temporary() as scratch:
        classes = scratch.keep(materialize(near_classes(docs, key, text, radius), "near-classes"))
    concerned = classes.where(~F.col("near_kept") | (F.col("near_rows") > 1))
    possible = _filter(concerned.select(F.xxhash64("near_key", "near_node").alias("h")).distinct())
    # kept rows that the filter cannot tell from removed ones, and rows that repeat
    kept = classes.where("near_kept").select("near_key", "near_node")
    unsure = materialize(kept.where(possible(F.xxhash64("near_key", "near_node"))), "unsure")
    doubtful = _filter(unsure.select(F.xxhash64("near_key", "near_node").alias("h")).distinct())
    named = docs.withColumn("near_key", F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long")))
    named = named.withColumn("near_node", text_node(F.col(text)))
    named = named.withColumn("near_hash", F.xxhash64("near_key", "near_node"))
    others = named.where(~possible("near_hash"))
    checked = named.where(possible("near_hash") & doubtful("near_hash"))
    checked = checked.join(unsure, ["near_key", "near_node"]).dropDuplicates(["near_key", "near_node"])
    return others.select(*docs.columns).unionByName(checked.select(*docs.columns))
