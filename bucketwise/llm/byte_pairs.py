"""Byte-level BPE: encoding by a bounded-lookahead streaming transducer, decoding
by an incremental byte-to-text state machine.

Encoding.  A text is cut at special tokens and then into words by the
tokenizer's pattern; both cuts need a few characters ahead.  A word's bytes go
through a transducer that emits a token as soon as no further byte can change
it, and so holds a bounded number of bytes whatever the word's length.

The bound is computed from the merge list (``lookahead``).  Where more bytes
follow, the merges of a prefix change in a region at its end.  The region's left
edge moves only when the token before it, u, merges to its right in one case and
not in the other: by a rule (u, v) whose right part begins, on the left spine of
its derivation, with the token that the edge moved over before, and which ranks
after that step's rule (an earlier one would have been applied before).  The
longest chain of such rules, in bytes of their left parts, bounds the region; one
pass over the list in order of rank finds it.  It takes a list in which every
rule makes a new token of tokens that earlier rules made; others are refused.

A token that ends more than the lookahead before the end of what has come is
final, and what follows it is encoded as if it began there, since no merge
crosses a token's edge.  The pending bytes are merged anew when a block has come.

Short words repeat, so their ids are kept by each worker up to a bound.

Decoding.  Ids become bytes by a table, bytes become text by a state machine
that holds the at most three bytes of an unfinished character; bytes that are
not UTF-8 become U+FFFD for each longest ill-formed part.

Defined results
  * a null text is empty: no ids, and the empty text decoded;
  * special tokens written out in a text become their ids;
  * very long texts and words are taken in pieces of bounded size;
  * ids that the vocabulary does not have decode to nothing;
  * every row has its own result, repeated or not; an empty table gives an
    empty table; other columns are kept, those that start with ``bpe_`` refused.

Tokenizer files of the ``tokenizers`` library are read as data.  Files with a
normaliser, another pre-tokeniser than the byte-level one, dropout, byte
fallback, word affixes, or added tokens that strip or match single words are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.llm.common import no_columns, returns_memory
from bucketwise.llm.id_cache import IdCache, joined

TOKENIZER = "byte_bpe_50k.json"
#: Bytes that a transducer gathers beyond its lookahead before it merges.
BLOCK = 2048
#: Words up to so many bytes are merged together, so many at a time.
SHORT, TOGETHER = 64, 1 << 15
#: Characters of a text that are split at once, and of a word that is passed on in pieces.
CHUNK, OPEN = 1 << 16, 1 << 12
#: Characters of words that a worker keeps with their ids; texts of a batch that are held at once.
KEPT_CHARACTERS, HELD_CHARACTERS, HELD_TEXTS = 1 << 25, 1 << 22, 256
#: Ids that are decoded at once.
DECODED = 1 << 16

# fixed values: the byte-level pre-tokeniser's pattern
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SPACE = regex.compile(r"\s*")
#: Characters after the start of a word that may still change it.
_AHEAD = 3


@cache
def _patterns() -> tuple[frozenset[str], regex.Pattern, list[regex.Pattern]]:
    """(characters that only a newer Unicode calls letters or numbers, the pattern
    of words that does not, runs of one kind of character).

    The library's version of Unicode is asked for what Python's own, which is
    older, does not know."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    unknown = frozenset(c for c in found if len(split("a" + c)) > 1 and len(split("1" + c)) > 1)
    starts = sorted(c for c in unknown if chr(ord(c) - 1) not in unknown)
    ends = sorted(c for c in unknown if chr(ord(c) + 1) not in unknown)
    newer = "".join(f"{a}-{z}" for a, z in zip(starts, ends)) or "\x00"
    letter, number, other = rf"[\p{{L}}--[{newer}]]", rf"[\p{{N}}--[{newer}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]"
    words = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"
    runs = [regex.compile(rf"(?V1){kind}*") for kind in (letter, number, other)]
    return unknown, regex.compile(words), [*runs, _SPACE]


def words_of(text: str) -> list[str]:
    """The words that the pre-tokeniser cuts a text into."""
    if text.isascii():
        return WORDS.findall(text)
    newer, exact, _ = _patterns()
    return (WORDS if newer.isdisjoint(text) else exact).findall(text)


@cache
def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself
    if it is printable in Latin-1, the next one from U+0100 on otherwise."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Merges:
    """A merge list over tokens as byte strings, and the lookahead that it needs."""

    def __init__(self, rules: list[tuple[bytes, bytes]], vocabulary: dict[bytes, int]):
        self.byte_id = [vocabulary.get(bytes([b]), -1) for b in range(256)]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        left: dict[bytes, bytes] = {}
        reach: dict[bytes, int] = {}  # token -> the longest chain that ends with a rule of this left part
        self.lookahead = self.longest = 0
        for rank, (u, v) in enumerate(rules):
            if any(len(t) > 1 and t not in left for t in (u, v)) or u + v in left:
                raise ValueError(f"rule {rank} does not make a new token of tokens that earlier rules made")
            chain, spine = reach.get(v, 0), v
            while spine in left:
                spine = left[spine]
                chain = max(chain, reach.get(spine, 0))
            left[u + v] = u
            reach[u] = max(reach.get(u, 0), len(u) + chain)
            self.lookahead = max(self.lookahead, len(u) + chain)
            self.longest = max(self.longest, len(u + v))
            self.rank[vocabulary[u] << 32 | vocabulary[v]] = rank
            self.made.append(vocabulary[u + v])
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = keys.argsort()
        self._keys, self._ranks, self._made = keys[order], order, np.array(self.made, np.int64)

    def merge(self, data: bytes) -> list[int]:
        """Ids of bytes: of all rules that apply the first in rank, leftmost, until none does."""
        ids, n, rank = [self.byte_id[b] for b in data], len(data), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank(ids[i] << 32 | ids[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        heapify(heap)
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 32 | ids[j]) != r:
                continue
            new = ids[i] = self.made[r]
            ids[j] = -1
            k, p = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                r = rank(new << 32 | ids[k])
                if r is not None:
                    heappush(heap, r << 32 | i)
            if p >= 0:
                r = rank(ids[p] << 32 | new)
                if r is not None:
                    heappush(heap, r << 32 | p)
        return [t for t in ids if t >= 0]


    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of rules where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), max(0, len(self._keys) - 1))
        return np.where(self._keys[at] == key, self._ranks[at], len(self.made)) if len(self._keys) else np.zeros(len(key), np.int64)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`merge` of many words, a rule of each in every step: all ids and each word's number."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.array(self.byte_id, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        word, none = np.repeat(np.arange(len(words)), length), len(self.made)

        def rank_at(p: np.ndarray) -> np.ndarray:
            """Of the pair at each place and the next; none at a word's end."""
            q = np.minimum(p + 1, len(ids) - 1)
            return np.where((q > p) & (word[p] == word[q]), self._rank_of(ids[p], ids[q]), none)

        rank, done = rank_at(np.arange(len(ids))), []
        while len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            live = np.repeat(least < none, size)
            if not live.all():
                done.append((word[~live], ids[~live]))
                ids, word, rank, size, least = ids[live], word[live], rank[live], size[least < none], least[least < none]
                continue
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.diff(word[at], prepend=-1) != 0]  # the leftmost of each word
            ids[at] = self._made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            rank[at] = rank_at(at)
            at = at[at > 0] - 1
            rank[at] = rank_at(at)
        if not done:
            return np.zeros(0, np.uint32), length
        word, ids = (np.concatenate(c) for c in zip(*done))
        order = word.argsort(kind="stable")
        return ids[order].astype(np.uint32), np.bincount(word, minlength=len(words))


class Transducer:
    """Bytes of one word in, ids out as soon as they are final."""

    def __init__(self, merges: Merges, length: list[int], block: int = BLOCK):
        self.merges, self.length = merges, length
        self.block = max(block, merges.longest + 1)
        self.pending = bytearray()

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.block):
            self.pending += data[at : at + self.block]
            final = len(self.pending) - self.merges.lookahead
            if final < self.block:
                continue
            end = 0
            for token in self.merges.merge(self.pending):
                if end + self.length[token] > final:
                    break
                end += self.length[token]
                out.append(token)
            del self.pending[:end]
        return out

    def finish(self) -> list[int]:
        out = self.merges.merge(self.pending)
        self.pending.clear()
        return out


class Splitter:
    """Text in, words out as soon as no further character can change them.

    Events: a list of whole words; (piece, whether it ends the word) of a word
    that is passed on in pieces; the id of a special token."""

    def __init__(self, special: dict[str, int], open_at: int = OPEN):
        self.special, self.open_at = special, open_at
        self.pattern = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.held = self.rest = ""
        self.run = None

    def push(self, text: str, last: bool = False) -> list:
        events: list = []
        text = self.held + text
        at = 0
        for m in self.pattern.finditer(text):
            self._words(text[at : m.start()], True, events)
            events.append(self.special[m.group()])
            at = m.end()
        end = len(text)
        if not last:  # what may be the beginning of a special token waits
            end -= max((n for s in self.special for n in range(1, min(len(s), end - at + 1)) if text.endswith(s[:n])), default=0)
        self.held = text[end:]
        self._words(text[at:end], last, events)
        return events

    def _words(self, text: str, last: bool, events: list) -> None:
        text, self.rest = self.rest + text, ""
        if self.run is not None:
            end = self.run.match(text).end()
            if end == len(text) and not last:
                self._pass_on(text, self.run, events)
                return
            if self.run is _SPACE and end < len(text):
                end -= 1  # the last white space belongs to what follows
            events.append((text[:end], True))
            text, self.run = text[end:], None
        words = words_of(text)
        if not last and words:
            if len(words[-1]) >= self.open_at:
                long = words.pop()
                events.append(words)
                self._pass_on(long, next(r for r in _patterns()[2] if r.match(long, 1).end() == len(long)), events)
                return
            end = start = len(text)
            while words and (end == len(text) or start - len(words[-1]) > len(text) - _AHEAD):
                start -= len(words.pop())
                end = start
            self.rest = text[start:]
        if words:
            events.append(words)

    def _pass_on(self, text: str, run: regex.Pattern, events: list) -> None:
        """A piece of a word of one kind of character; of white space the last may not belong to it."""
        self.run = run
        cut = len(text) - (run is _SPACE)
        events.append((text[:cut], False))
        self.rest = text[cut:]


class TextDecoder:
    """Ids in, text out; bytes of an unfinished character wait."""

    def __init__(self, as_bytes: list[bytes]):
        self.as_bytes = as_bytes
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int]) -> str:
        n = len(self.as_bytes)
        return self.machine.decode(b"".join([self.as_bytes[i] for i in ids if i < n]))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


class BytePairs:
    """A tokenizer file, read as data."""

    def __init__(self, data: bytes):
        file = json.loads(data)
        model, before = file["model"], file.get("pre_tokenizer") or {}
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}
        odd = [k for k, v in plain.items() if (model.get(k) or None) != v] + [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
        if file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            odd.append("normalizer or pre_tokenizer")
        added = file.get("added_tokens", [])
        odd += [t["content"] for t in added if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        if odd:
            raise ValueError(f"not a plain byte-level BPE file: {', '.join(odd)}")
        byte = {c: bytes([b]) for b, c in enumerate(byte_characters())}

        def as_bytes(token: str) -> bytes:
            return b"".join(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

        vocabulary = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in added}
        self.as_bytes = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in [*vocabulary.items(), *((as_bytes(s), i) for s, i in self.special.items())]:
            self.as_bytes[i] = token
        self.length = list(map(len, self.as_bytes))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = Merges([(as_bytes(u), as_bytes(v)) for u, v in pairs], vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.cache, self.kept = IdCache(self._learn), 0

    def _learn(self, words: set[str]) -> None:
        """Short words end before a transducer's lookahead is full: they are merged together."""
        short = [w for w in words if len(w) * 4 <= SHORT or len(w.encode()) <= SHORT]
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            self.cache.add(some, *self.merges.merge_words([w.encode() for w in some]))
        long = list(words.difference(short))
        found, word = [], Transducer(self.merges, self.length)
        for w in long:
            found.append(word.push(w.encode()) + word.finish())
        self.cache.add(long, *joined(found))
        self.kept += sum(map(len, words))

    def _ids(self, words: list[str]) -> np.ndarray:
        return self.cache.gather(self.cache.codes(words))[0]

    def stream(self, pieces: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of one text that comes in pieces, as soon as they are final."""
        splitter, word = Splitter(self.special), Transducer(self.merges, self.length)

        def ids(events: list) -> Iterator[np.ndarray]:
            for e in events:
                if isinstance(e, list):
                    yield self._ids(e)
                elif isinstance(e, tuple):
                    out = word.push(e[0].encode())
                    yield np.array(out + word.finish() if e[1] else out, np.uint32)
                else:
                    yield np.array([e], np.uint32)

        for piece in pieces:
            yield from ids(splitter.push(piece))
            if self.kept > KEPT_CHARACTERS:
                self._forget()
        yield from ids(splitter.push("", True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        words: list[str] = []
        ends, whole = [], {}
        for k, text in enumerate(texts):
            if text and (len(text) > CHUNK or any(s in text for s in self.special)):
                parts = list(self.stream(text[at : at + CHUNK] for at in range(0, len(text), CHUNK)))
                whole[k] = np.concatenate(parts)
            elif text:
                words += words_of(text)
            ends.append(len(words))
        ids, length = self.cache.gather(self.cache.codes(words))
        if self.kept > KEPT_CHARACTERS:
            self._forget()
        number = np.diff(np.concatenate([[0], np.cumsum(length)])[ends], prepend=0)
        if whole:
            parts = np.split(ids, np.cumsum(number)[:-1])
            for k, own in whole.items():
                parts[k], number[k] = own, len(own)
            ids = np.concatenate(parts)
        return ids, number

    def decode(self, ids: np.ndarray) -> str:
        machine = TextDecoder(self.as_bytes)
        parts = [machine.push(ids[at : at + DECODED].tolist()) for at in range(0, len(ids), DECODED)]
        return "".join([*parts, machine.finish()])


_models: dict[bytes, BytePairs] = {}


def _model(data: bytes) -> BytePairs:
    """This worker's tokenizer; it outlives a task."""
    name = hashlib.sha256(data).digest()
    if name not in _models:
        _models.clear()
        _models[name] = BytePairs(data)
    return _models[name]


def read_tokenizer(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, "rb") as f:
        return f.read()


def _pieces(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of a bounded number of texts and characters, or a single text."""
    size = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
    first = held = 0
    for k, n in enumerate(size.tolist()):
        if k > first and (k - first >= HELD_TEXTS or held + n > HELD_CHARACTERS):
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def with_ids(docs: DataFrame, tokenizer: bytes | None = None, text: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with ``bpe_ids``, the ids as little-endian unsigned 32-bit integers,
    and if asked ``bpe_decoded``, the text that those ids decode to.  The
    tokenizer file (a few megabytes) is broadcast."""
    no_columns(docs, "bpe_")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer or read_tokenizer())
    at = docs.columns.index(text)
    own = [T.StructField("bpe_ids", T.BinaryType()), *([T.StructField("bpe_decoded", T.StringType())] if decode else [])]

    @returns_memory
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _model(shared.value)
        for batch in batches:
            for piece in _pieces(batch, at):
                ids, number = coder.encode(piece.column(at).to_pylist())
                parts = np.split(ids.astype("<u4", copy=False), np.cumsum(number)[:-1])
                made = [pa.array([p.tobytes() for p in parts], pa.binary())]
                if decode:
                    made.append(pa.array([coder.decode(p) for p in parts], pa.string()))
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=[*piece.schema.names, *(f.name for f in own)])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, *own]))


def with_decoded(df: DataFrame, ids: str, tokenizer: bytes | None = None) -> DataFrame:
    """``df`` with ``bpe_decoded``, the text of a column of ids as ``with_ids`` writes them."""
    no_columns(df.drop(ids), "bpe_decoded")
    shared = df.sparkSession.sparkContext.broadcast(tokenizer or read_tokenizer())
    at = df.columns.index(ids)

    @returns_memory
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _model(shared.value)
        for batch in batches:
            for piece in _pieces(batch, at):
                texts = [coder.decode(np.frombuffer(v.as_buffer(), "<u4")) if v.is_valid else "" for v in piece.column(at)]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], names=[*piece.schema.names, "bpe_decoded"])

    return df.mapInArrow(rows, T.StructType([*df.schema.fields, T.StructField("bpe_decoded", T.StringType())]))


def op12_byte_pairs(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_ids(docs, decode=True).select(
        "doc_id",
        (F.octet_length("bpe_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("bpe_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("bpe_decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
