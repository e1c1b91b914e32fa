"""Suffix-array deduplication: removal of every byte under a string of
``length`` bytes that also starts anywhere else.

Passages of over ``WORDS - 1`` words are often shorter than that, so the same
arrays also tell which bytes of a document are *shared*: they lie in a string of
``length`` bytes, or in a passage of ``WORDS`` words and at least ``FILED``
bytes, that another document has too.  Shared bytes are counted, not removed.

Sharding.  A place is filed under the least hash of the 32-byte grams in the
``FILED`` bytes from it on, so equal strings of that length and more meet
wherever they stand.  A maximal run of places with one least hash is a
*segment*, with as many bytes more as its last place needs; every place is in
exactly one.  Segments whose hash stands at one place of the corpus cannot repeat and never
move (a Bloom filter of bounded size passes the others).

Shards.  Segments with equal contents are merged, with their number and the
first and last document that has them, before they move.  A shard takes whole
hash groups, concatenates the distinct segments, builds their suffix array by
induced sorting and the permuted common prefixes.  A string repeats if it shares
its whole length with its neighbour in the order, or if its segment occurs
twice; it is shared if the nearest suffixes of other documents, on either side
in the order, have it.

Hot hashes.  Around a passage that very many documents share, one hash has
very many distinct segments.  Beyond ``HOT_BYTES`` of them a group is not one
shard: its strings are dealt out one by one, by 128-bit digests of their whole
contents, and counted.  No cap, no sampling: this is the same comparison, dealt
over all tasks.

Texts are named by 128-bit digests; equal texts are cut and sorted once.

Defined results
  * null text counts as empty; texts under ``length`` bytes lose nothing;
  * strings are judged on the input; overlapping occurrences count, also
    within one document; nothing matches across documents;
  * repeated rows are documents of their own, so each repeats the other;
    null keys are kept; an empty table stays empty; other columns are not read;
  * a document's repeats within itself are removed but not shared; the words of
    a passage end at ASCII white space or at the end of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.llm.common import digest_key, digest_keys, materialize, returns_memory
from bucketwise.llm.suffix_array import plcp, suffix_array
from bucketwise.llm.url_filter import BlockedBloom

LENGTH = 400
WORDS = 51
FILED = 256
GRAM = 32
#: Bytes of segments that are sorted in one suffix array, about.
SHARD_BYTES = 3 << 19
#: Bytes of the distinct segments of one hash beyond which its strings are dealt out singly.
HOT_BYTES = 1 << 20
_SLICE_BYTES = 1 << 21
_MOST_PLACES = 1 << 28
#: Places whose grams are compared at a time.
_BLOCK = 1 << 15
_BASE = 0x9E3779B97F4A7C15 | 1
_SEPARATOR = 255  # neither a UTF-8 byte plus one nor the end
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A segment's first byte: whether it follows white space (or nothing) in its
#: text.  In the arrays it becomes a symbol that no text has.
_LEAD = (b"x", b" ")
_AFTER_WORD, _AFTER_SPACE = 253, 254


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A well-mixed hash of the GRAM bytes from each position on."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    width, factor = 1, _BASE
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position on."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if width > step else h


def _least_grams(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the gram at each place, and for the ``length`` bytes from each place on
    where their least gram stands, the leftmost of equals.  It goes block by block,
    so that a processor's cache holds the values between."""
    hashes = np.empty(max(len(data) - GRAM + 1, 0), dtype=np.uint64)
    least = np.empty(len(data) - length + 1, dtype=np.int64)
    # the upper bits of a hash and its place are compared
    mask = np.uint64(_MOST_PLACES - 1)
    for low in range(0, len(least), _BLOCK):
        high = min(low + _BLOCK, len(least))
        h = _gram_hashes(data[low : high + length - 1])
        hashes[low : low + len(h)] = h
        h &= ~mask
        h |= np.arange(low, low + len(h), dtype=np.uint64)
        least[low:high] = _least(h, length - GRAM + 1) & mask
    return hashes, least


def segments(texts: list[bytes], length: int = FILED) -> tuple[np.ndarray, ...]:
    """Of all segments: hash, text number, first place, number of places, and
    at how many places the gram with the least hash stands.  A string can
    repeat within a segment only if that is more than one."""
    if sum(map(len, texts)) > _MOST_PLACES:  # piece by piece; a cut only ends a segment
        found, number = [], 0
        for text in texts:
            for at in range(0, max(1, len(text) - length + 1), _MOST_PLACES // 2):
                h, _, first, n, places = segments([text[at : at + _MOST_PLACES // 2 + length - 1]], length)
                found.append((h, np.full(len(h), number), first + at, n, places))
            number += 1
        return tuple(np.concatenate(c) for c in zip(*found))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    hashes, least = _least_grams(data, length)
    before = np.cumsum(windows) - windows  # windows of the texts before
    place = least[np.arange(int(windows.sum())) + np.repeat(starts - before, windows)]
    h = hashes[place]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    new[before[windows > 0]] = True
    first = np.flatnonzero(new)
    number = np.searchsorted(before + windows, first, side="right")
    places = np.add.reduceat(np.concatenate([[True], place[1:] != place[:-1]]).astype(np.int64), first)
    key = h[first]  # least values crowd near zero; spread them again
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    key ^= key >> np.uint64(31)
    return key, number, first - before[number], np.diff(np.concatenate([first, [len(h)]])), places


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of batches with their texts as bytes, a few megabytes each."""
    for batch in batches:
        low, held, texts = 0, 0, []
        for i, t in enumerate(batch.column(column)):
            texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
            held += len(texts[-1])
            if held >= _SLICE_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(low, i + 1 - low), texts
                low, held, texts = i + 1, 0, []


def _name(data: bytes | memoryview) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _symbols(part: bytes) -> np.ndarray:
    s = np.frombuffer(part, dtype=np.uint8) + 1
    s[0] = _AFTER_SPACE if part[:1] == _LEAD[True] else _AFTER_WORD
    return s


def passage_lengths(s: np.ndarray) -> np.ndarray:
    """Of each place of ``s`` (parts with bytes plus one between the symbol of
    their lead and the separator or zero) where a word starts: bytes to the end
    of the WORDS-th word of the same part, else zero."""
    stop = (s == _SEPARATOR) | (s == 0)
    space = stop | (s == 33) | ((s >= 10) & (s <= 14)) | (s == _AFTER_SPACE)
    begins = np.flatnonzero(space[:-1] & ~space[1:] & (s[1:] != _AFTER_WORD)) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    out = np.zeros(len(s), dtype=np.int64)
    if len(begins) < WORDS:
        return out
    ends = ends[np.searchsorted(ends, begins, side="right")]
    part = np.cumsum(stop)[begins]
    last = len(begins) - WORDS + 1
    whole = part[:last] == part[WORDS - 1 :]
    out[begins[:last][whole]] = (ends[WORDS - 1 :] - begins[:last])[whole]
    return out


def _other_documents(common: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For suffixes in order, with ``common`` symbols shared with the one
    before: how many are shared with the nearest one of another document."""

    def before(common: np.ndarray, doc: np.ndarray) -> np.ndarray:
        # least value since the document changed: a falling offset restarts it
        change = np.concatenate([[True], doc[1:] != doc[:-1]])
        offset = np.cumsum(change) * (1 << 32)
        least = np.minimum.accumulate(common - offset) + offset
        least[offset == 1 << 32] = 0  # nothing before the first stretch
        return least

    after = before(np.concatenate([[0], common[:0:-1]]), doc[::-1])[::-1]
    return np.maximum(before(common, doc), after)


def _spans(firsts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(first, end) of the union of spans, firsts ascending."""
    if not len(firsts):
        return np.zeros((0, 2), dtype=np.int64)
    ends = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.concatenate([[True], firsts[1:] > ends[:-1]]))
    return np.stack([firsts[new], ends[np.concatenate([new[1:], [len(ends)]]) - 1]], axis=1)


def _within(firsts: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in ranges of different segments."""
    edges = np.zeros(size + 1, dtype=np.int8)
    edges[firsts] += 1
    edges[firsts + counts] -= 1
    return np.cumsum(edges[:-1], dtype=np.int8).view(bool)


def repeated_strings(rows: list[tuple], length: int = LENGTH) -> list[tuple[list[int], list[int]]]:
    """For each distinct segment (number, first and last document, places,
    bytes after its lead): runs of the places whose
    ``length`` bytes start elsewhere too - in another segment, at another place
    of its own, or in a copy - and spans of bytes that another document shares.

    Segments are judged together, in arrays over the places of all of them."""
    n, low, high, places = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
    parts = [r[4] for r in rows]
    sizes = np.array([len(part) for part in parts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    s = np.frombuffer(b"\0".join([*parts, b""]), dtype=np.uint8) + 1
    s[starts] = np.where(s[starts] == _LEAD[True][0] + 1, _AFTER_SPACE, _AFTER_WORD)
    s[starts + sizes] = _SEPARATOR
    s[-1] = 0
    doc = np.repeat(np.where(low == high, low, -1 - np.arange(len(rows))), sizes + 1)
    passage = passage_lengths(s)
    sa = suffix_array(s)
    phi, common = plcp(s, sa, length)
    again = common >= length
    again[phi[np.flatnonzero(again)]] = True
    other = np.empty_like(common)
    other[sa] = _other_documents(common[sa], doc[sa])
    first, copied, spread = starts + 1, n > 1, low != high
    whole = np.maximum(np.minimum(places, sizes - length), 0)  # places with ``length`` bytes
    judged = _within(first, whole, len(s))
    runs = _runs(judged & again | _within(first[copied], whole[copied], len(s)))
    at = np.flatnonzero(judged & (other >= length) | _within(first[spread], whole[spread], len(s)))
    i = np.flatnonzero((passage >= FILED) & (passage < length) & _within(first, np.minimum(places, sizes - 1), len(s)))
    own = np.searchsorted(starts, i, side="right") - 1
    near = (other[i] >= passage[i]) | spread[own]
    i, own = i[near], own[near]
    # the same bytes may go on within a word elsewhere; passages are compared whole
    met_by: dict[bytes, tuple[int, int]] = {}
    names = [_name(parts[k][a : a + m]) for k, a, m in zip(own.tolist(), (i - starts[own]).tolist(), passage[i].tolist())]
    for name, lowest, highest in zip(names, low[own].tolist(), high[own].tolist()):
        least, most = met_by.get(name, (lowest, highest))
        met_by[name] = min(least, lowest), max(most, highest)
    i = i[np.array([met_by[name][0] != met_by[name][1] for name in names], dtype=bool)]
    firsts, ends = np.concatenate([at, i]), np.concatenate([at + length, i + passage[i]])
    order = np.argsort(firsts, kind="stable")
    shared = _spans(firsts[order], ends[order])  # spans end before the next segment's first place

    def dealt(spans: np.ndarray) -> list[list[int]]:
        own = np.searchsorted(starts, spans[:, 0], side="right") - 1
        bounds = np.searchsorted(own, np.arange(len(rows) + 1)) * 2
        flat, bounds = (spans - first[own][:, None]).ravel().tolist(), bounds.tolist()
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    return list(zip(dealt(runs), dealt(shared)))


def _runs(flags: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).reshape(-1, 2)


SEGMENT = "h long, s binary, t binary, first int, width int, places int, doc long, part binary"


def _recurring_segments(docs: DataFrame, length: int, filed: int) -> DataFrame:
    """One row per occurrence of a segment whose hash may recur (SEGMENT); a
    task sends the bytes of equal segments once, as far as it remembers."""

    @returns_memory
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches, 0):
            h, _, _, _, places = segments(texts, filed)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(places)], names=["h", "places"])

    twice = docs.select("text").mapInArrow(hashes, "h long, places long").groupBy("h").agg(F.sum("places").alias("n"))
    twice = twice.where("n > 1")
    bloom = docs.sparkSession.sparkContext.broadcast(BlockedBloom.build(twice.select("h")).words)

    @returns_memory
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, sent = BlockedBloom(bloom.value), set()
        row = TaskContext.get().partitionId() << 40  # numbers the documents
        for _, texts in _slices(batches, 0):
            h, number, first, n, places = segments(texts, filed)
            pick = np.flatnonzero(known.may_contain(np.ascontiguousarray(h))) if len(h) else np.zeros(0, np.int64)
            names: dict[int, bytes] = {}
            s, t, part = [], [], []
            for k, i, m in zip(number[pick].tolist(), first[pick].tolist(), n[pick].tolist()):
                if k not in names:
                    names[k] = _name(texts[k])
                piece = _LEAD[not i or texts[k][i - 1] in _SPACES] + texts[k][i : i + m + length - 1]
                name = _name(piece + m.to_bytes(8))
                s.append(name)
                t.append(names[k])
                part.append(None if name in sent else piece)
                sent.add(name)
            if len(sent) > 200_000:
                sent.clear()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[pick].view(np.int64)),
                    pa.array(s, pa.binary()),
                    pa.array(t, pa.binary()),
                    pa.array(first[pick].astype(np.int32)),
                    pa.array(n[pick].astype(np.int32)),
                    pa.array(places[pick].astype(np.int32)),
                    pa.array(number[pick].astype(np.int64) + row),
                    pa.array(part, pa.binary()),
                ],
                names=["h", "s", "t", "first", "width", "places", "doc", "part"],
            )
            row += len(texts)

    return materialize(docs.select("text").mapInArrow(rows, SEGMENT), "segments")


MARKS = "h long, s binary, runs array<int>, shared array<int>"
_DISTINCT = ["h", "s", "n", "low", "high", "width", "part"]


def _shard_marks(distinct: DataFrame, length: int) -> DataFrame:
    """MARKS of distinct segments by suffix arrays of whole hash groups."""

    @returns_memory
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def marks() -> pa.RecordBatch:
            found = zip(held, repeated_strings([r[2:] for r in held], length))
            found = [(r[0], r[1], runs, shared) for r, (runs, shared) in found if runs or shared]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in found], pa.int64()),
                    pa.array([r[1] for r in found], pa.binary()),
                    pa.array([r[2] for r in found], pa.list_(pa.int32())),
                    pa.array([r[3] for r in found], pa.list_(pa.int32())),
                ],
                names=["h", "s", "runs", "shared"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield marks()
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield marks()

    return distinct.select(*_DISTINCT).repartition("h").sortWithinPartitions("h", "s").mapInArrow(sort, MARKS)


def _single_marks(distinct: DataFrame, length: int) -> DataFrame:
    """MARKS of distinct segments of hot hashes, string by string."""

    @returns_memory
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, s, n, low, high, width, part in zip(*(c.to_pylist() for c in batch.columns)):
                view = memoryview(part)
                words = passage_lengths(np.append(_symbols(part), np.uint8(0)))
                words = words[1 : width + 1]
                at = np.flatnonzero((words >= FILED) & (words < length))
                whole = max(0, min(width, len(part) - length))
                for lower in range(0, whole, 1 << 16):  # a long segment in pieces
                    upper = min(whole, lower + (1 << 16))
                    here = at[(at >= lower) & ((at < upper) | (upper == whole))]
                    places = np.concatenate([np.arange(lower, upper), here]).astype(np.int32)
                    sizes = np.concatenate([np.full(upper - lower, length), words[here]]).astype(np.int32)
                    yield strings_of(h, s, n, low, high, view, places, sizes)
                if not whole and len(at):
                    yield strings_of(h, s, n, low, high, view, at.astype(np.int32), words[at].astype(np.int32))

    def strings_of(h, s, n, low, high, view, places, sizes) -> pa.RecordBatch:
        m = len(places)
        digests = [_name(view[i + 1 : i + 1 + size]) for i, size in zip(places.tolist(), sizes.tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array([v] * m, kind) for v, kind in ((h, pa.int64()), (s, pa.binary()), (n, pa.int64()), (low, pa.int64()), (high, pa.int64()))]
            + [pa.array(places), pa.array(sizes), pa.array(digests, pa.binary())],
            names=["h", "s", "n", "low", "high", "at", "size", "w"],
        )

    single = materialize(
        distinct.select(*_DISTINCT)
        .repartition("s")
        .mapInArrow(strings, "h long, s binary, n long, low long, high long, at int, size int, w binary"),
        "strings",
    )
    again = single.groupBy("w", "size").agg(
        F.sum("n").alias("all"), (F.min("low") < F.max("high")).alias("others")
    ).where("all > 1")
    of = lambda met, end: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(met, F.struct("at", end)))), lambda x: F.array(x["at"], x["end"])))
    return (
        single.join(again, ["w", "size"])
        .groupBy("h", "s")
        .agg(
            of(F.col("size") == length, (F.col("at") + 1).alias("end")).alias("runs"),
            of(F.col("others"), (F.col("at") + F.col("size")).alias("end")).alias("shared"),
        )
    )


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(t, runs, shared): for every distinct text with repeated strings, its name,
    the runs [first, end, ...) of places whose ``length`` bytes start elsewhere
    too, and spans [first, end, ...) of bytes that another document shares."""
    occurrences = _recurring_segments(docs.select(F.col(text).alias("text")), length, min(length, FILED))
    distinct = occurrences.groupBy("h", "s").agg(
        F.count("*").alias("n"),
        F.sum("places").alias("places"),
        F.min("doc").alias("low"),
        F.max("doc").alias("high"),
        F.max("width").alias("width"),
        F.max("part").alias("part"),
    )
    distinct = materialize(distinct, "distinct-segments")
    groups = distinct.groupBy("h").agg(F.sum("places").alias("all"), F.sum(F.length("part")).alias("size")).where("all > 1")
    met = distinct.join(groups, "h")
    marks = _shard_marks(met.where(F.col("size") <= HOT_BYTES), length).unionByName(
        _single_marks(met.where(F.col("size") > HOT_BYTES), length)
    )
    places = occurrences.select("h", "s", "t", "first").distinct()
    moved = lambda c: F.transform(c, lambda r: r + F.col("first")).alias(c)
    return (
        places.join(marks, ["h", "s"])
        .select("t", moved("runs"), moved("shared"))
        .groupBy("t")
        .agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("shared")).alias("shared"))
    )


def merge_spans(runs: np.ndarray, length: int) -> np.ndarray:
    """Disjoint spans (first, end) of bytes from runs (first, end) of places
    where ``length`` bytes start; with length 1, of spans of bytes."""
    spans = runs.reshape(-1, 2)
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1] + length - 1)
    new = np.concatenate([[True], spans[1:, 0] > ends[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], ends[np.concatenate([first[1:], [len(ends)]]) - 1]], axis=1)


def cut_spans(data: bytes, spans: np.ndarray) -> bytes:
    """``data`` without the bytes in the spans."""
    edges = [0, *spans.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, n_shared) of every row."""
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    found = materialize(repeats(docs, "text", length), "repeats")
    bloom = docs.sparkSession.sparkContext.broadcast(BlockedBloom.build(found.select(digest_key(F.col("t")).alias("h")).distinct()).words)

    @returns_memory
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in _slices(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    pa.array([_name(t) for t in texts], pa.binary()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ],
                names=["key", "t", "n_bytes", "whole_sha256"],
            )

    @returns_memory
    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sent = BlockedBloom(bloom.value), set()
        for _, texts in _slices(batches, 0):
            names = [_name(t) for t in texts]
            hit = known.may_contain(digest_keys(names)) if names else []
            out: dict[bytes, bytes] = {n: t for n, t, y in zip(names, texts, hit) if y and n not in sent}
            if len(sent) > 200_000:
                sent.clear()
            sent.update(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["t", "data"]
            )

    @returns_memory
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, data, runs, shared in zip(*batch.columns):
                data = data.as_py()
                spans = merge_spans(runs.values.to_numpy().astype(np.int64), length)
                common = merge_spans(shared.values.to_numpy().astype(np.int64), 1)
                sizes = [int((x[:, 1] - x[:, 0]).sum()) for x in (spans, common)]
                rows.append((t.as_py(), sizes[0], len(spans), hashlib.sha256(cut_spans(data, spans)).hexdigest(), sizes[1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.binary()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.string()),
                    pa.array([r[4] for r in rows], pa.int64()),
                ],
                names=["t", "n_removed", "n_spans", "kept_sha256", "n_shared"],
            )

    known = docs.mapInArrow(facts, "key long, t binary, n_bytes long, whole_sha256 string")
    cut = (
        docs.select("text")
        .mapInArrow(touched, "t binary, data binary")
        .dropDuplicates(["t"])
        .join(found, "t")
        .select("t", "data", "runs", "shared")
        .mapInArrow(removed, "t binary, n_removed long, n_spans long, kept_sha256 string, n_shared long")
    )
    zero = F.lit(0).cast("long")
    return known.join(cut, "t", "left").select(
        F.col("key").alias(key),
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        F.coalesce("n_shared", zero).alias("n_shared"),
    )


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs)
