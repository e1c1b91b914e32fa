"""Token-ID output in directly addressable codes.

Documents are range-partitioned and sorted by key, encoded, and written as a
table of blocks through Spark's own committing writer, so a lost executor's
task is simply written again.  A block holds whole documents and its ids as
directly addressable codes: level 0 has the low 8 bits of every id and a
continuation bitmap that tells which ids go on; level 1 has the next 8 bits of
those, and so on.  Each bitmap has a rank directory (ones before every 512th
bit), so the ``i``-th id is found level by level without decoding a block.

The files hold the codes as they are: without compression or dictionary, a
page for each block, in order of ``part`` and ``ids_before``, whose page index
leads a look-up to the one page that it needs.  ``offsets`` tells where in
``codes`` each level's chunks, bitmap and directory begin; a look-up takes one
byte, up to 64 bytes of bitmap and one rank of each level out of the block
where it lies, and only these reach the driver.

The tokenizer's vocabulary drops white space and never merges across it, so a
text's ids are the ids of its words in turn.  Each worker asks the tokenizers
library for a word once and keeps its ids; texts for which that split would
not be exact are handed over whole.

Defined results
  * null text counts as empty: it has the end id alone;
  * null keys come last; rows that repeat a key are ordered by a hash of their
    text, then by the text, so that one key's rows, however many, are dealt out;
  * an empty table gives an empty table of blocks; extra columns are ignored;
  * a very long text stays in one block of its own size.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.llm.common import materialize, returns_memory

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: A block is closed at this many ids, at the end of a document.
BLOCK_IDS = 1 << 16
RANK_BITS = 512
#: Words that a worker keeps; beyond, it starts anew.
CACHED_WORDS = 1_500_000

BLOCK_SCHEMA = "part int, seq int, ids_before long, doc_ids array<long>, n_ids array<long>, offsets array<long>, codes binary"
_BLOCK_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("seq", pa.int32()),
        ("ids_before", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_ids", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())),
        ("codes", pa.binary()),
    ]
)
#: A page for each block, its bytes as they are.
FILE_OPTIONS = {
    "compression": "none",
    "parquet.enable.dictionary": "false",
    "parquet.page.size": "4096",
    "parquet.page.size.row.check.min": "1",
}


# -- directly addressable codes ------------------------------------------------


def dac_encode(ids: np.ndarray) -> bytes:
    """``ids`` (unsigned, below 2**32) as bytes: the number of levels, then per
    level its length, chunk bytes, continuation bitmap and rank directory."""
    rest, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        low, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        goes_on = rest > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        step = RANK_BITS // 8
        padded = np.zeros(-(-len(bitmap) // step) * step, dtype=np.uint8)
        padded[: len(bitmap)] = bitmap
        ones = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.uint64)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels += [np.array([len(low)], dtype="<u8").tobytes(), low.tobytes(), bitmap.tobytes(), rank.tobytes()]
        rest = rest[goes_on]
        if not len(rest):
            return b"".join([np.array([len(levels) // 4], dtype="<u4").tobytes(), *levels])


class DacReader:
    """Random access to, or all of, the ids in :func:`dac_encode`'s bytes."""

    def __init__(self, data: bytes):
        self.levels, self.offsets, at = [], [], 4
        for _ in range(int(np.frombuffer(data, "<u4", 1)[0])):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            at += 8
            low = np.frombuffer(data, np.uint8, n, at)
            self.offsets += [at, at + n, at + n + -(-n // 8)]
            at += n
            bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += len(bitmap)
            rank = np.frombuffer(data, "<u4", -(-n // RANK_BITS) + 1, at)
            at += rank.nbytes
            self.levels.append((low, bitmap, rank))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, i: int) -> int:
        """The ``i``-th id; touches one byte, one bit and one rank per level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for depth, (low, bitmap, rank) in enumerate(self.levels):
            value |= int(low[i]) << (8 * depth)
            if not (bitmap[i >> 3] >> (i & 7)) & 1:
                break
            first = (i // RANK_BITS) * (RANK_BITS // 8)
            before = int(np.bitwise_count(bitmap[first : i >> 3]).sum(dtype=np.int64))
            before += (int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            i = int(rank[i // RANK_BITS]) + before
        return value

    def all(self) -> np.ndarray:
        values = np.zeros(0, dtype=np.uint32)
        for low, bitmap, _ in reversed(self.levels):
            out = low.astype(np.uint32)
            if len(values):
                out[np.flatnonzero(np.unpackbits(bitmap, count=len(low), bitorder="little"))] |= values << np.uint32(8)
            values = out
        return values


# -- encoding ------------------------------------------------------------------

_END = "\n"  # never a word
#: Ends the last piece of a run of letters, so that words of letters alone can
#: be encoded many at a time and told apart again.
_WORD_END = "</w>"
_TAIL = ".,!%&*$#|;:?-()\""
#: Separators of Python's split() that the tokenizer treats as characters.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters whose lower case is the same in Python and in the tokenizer's library.
_BEYOND_LATIN = re.compile("[^\x00-įı-ɏ -⁯]")


class WordEncoder:
    """Ids of texts, by way of ids of words that were seen before."""

    def __init__(self, path: str, end_id: int | None = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end_id = end_id
        self._ends_word = np.zeros(self.library.get_vocab_size(with_added_tokens=True), dtype=bool)
        for piece, at in self.library.get_vocab(with_added_tokens=True).items():
            self._ends_word[at] = piece.endswith(_WORD_END)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.length = np.zeros(1 << 16, dtype=np.int64)
        self._add([_END], *_joined([[] if self.end_id is None else [self.end_id]]))

    def _forget(self) -> None:
        """Keep the words that came first; common words come early."""
        kept = CACHED_WORDS // 2
        self.index = dict(islice(self.index.items(), kept))
        self.used = int(self.start[kept - 1] + self.length[kept - 1])

    def _add(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        n, first = len(words), len(self.index)
        while first + n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        ends = self.used + np.cumsum(lengths)
        self.start[first : first + n] = ends - lengths
        self.length[first : first + n] = lengths
        self.used += len(flat)
        self.index.update(zip(words, range(first, first + n)))

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their codes, one after another, and their numbers."""
        start, length = self.start[codes], self.length[codes]
        at = np.repeat(start - (np.cumsum(length) - length), length)
        at += np.arange(len(at))
        return self.flat[at], length

    def _learn(self, words: set[str]) -> None:
        """Letters and a tail of ASCII punctuation are separate to the
        tokenizer, so such words are put together from the two.  The letters
        must end with one in lower case and composed too: U+0130 and letters that
        are taken apart end with a mark there, which the tokenizer keeps apart from letters."""
        split = {}
        for w in words:
            core = w.rstrip(_TAIL)
            if core and len(core) < len(w) and "'" not in w and core[-1].isalpha() and unicodedata.normalize("NFC", core.lower())[-1].isalpha():
                split[w] = core, w[len(core) :]
        whole = words - split.keys()
        whole.update(p for pair in split.values() for p in pair if p not in self.index)
        new = [w for w in whole if w not in self.index]
        plain = [w for w in new if w.isalpha()]
        others = [w for w in new if not w.isalpha()]
        for at in range(0, len(plain), 1024):
            part = plain[at : at + 1024]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.uint32)
            ends = np.flatnonzero(self._ends_word[ids])
            if len(ends) == len(part):
                self._add(part, ids, np.diff(ends, prepend=-1))
            else:
                others += part
        for at in range(0, len(others), 1024):
            part = others[at : at + 1024]
            self._add(part, *_joined([e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]))
        if split:
            codes = np.fromiter((self.index[p] for pair in split.values() for p in pair), np.int64, 2 * len(split))
            flat, length = self._gather(codes)
            self._add(list(split), flat, length.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text's with the end id, and their numbers."""
        words: list[str] = []
        ends = []
        for text in texts:
            if text:
                if _ODD_SPACE.search(text):
                    words.append(text)
                else:
                    words += (text if _BEYOND_LATIN.search(text) else text.lower()).split()
            words.append(_END)
            ends.append(len(words))
        if len(self.index) > CACHED_WORDS:
            self._forget()
        codes = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            new = [words[i] for i in missing]
            self._learn(set(new))
            codes[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        ids, length = self._gather(codes)
        after = np.cumsum(length)
        bounds = np.concatenate([[0], after[np.asarray(ends, dtype=np.int64) - 1]]) if ends else np.zeros(1, np.int64)
        return ids, np.diff(bounds)


def _joined(ids: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, end_id: int | None = END_ID) -> WordEncoder:
    """This worker's encoder; it outlives a task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# -- the table of blocks ---------------------------------------------------------


def encode_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    end_id: int | None = END_ID,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Blocks (``BLOCK_SCHEMA``) of all documents in ascending order of key:
    by ``part``, then ``seq``.  Write it with Spark to get the files."""
    path = tokenizer or default_tokenizer()

    @returns_memory
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        coder = encoder(path, end_id)
        keys: list = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            codes = dac_encode(np.concatenate(ids))
            row = [[part], [seq], [before], [keys], [lengths], [DacReader(codes).offsets], [codes]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _BLOCK_ARROW)], schema=_BLOCK_ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                got, n = coder.encode(piece.column(1).to_pylist())
                first = 0
                for k, size in zip(piece.column(0).to_pylist(), n.tolist()):
                    keys.append(k)
                    lengths.append(size)
                    ids.append(got[first : first + size])
                    first += size
                    held += size
                    if held >= block_ids:
                        yield block()
                        before, seq, held = before + held, seq + 1, 0
                        keys, lengths, ids = [], [], []
        if keys:
            yield block()

    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    order = [F.col("k").asc_nulls_last(), F.xxhash64("t").asc()]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order, F.col("t").asc_nulls_first())
    return ordered.mapInArrow(blocks, BLOCK_SCHEMA)


def part_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each part; one number per partition that wrote blocks."""
    sizes = (
        blocks.groupBy("part")
        .agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
        .collect()
    )
    starts, total = {}, 0
    for row in sorted(sizes, key=lambda r: r.part):
        starts[row.part] = total
        total += row.n
    return starts


def read_documents(blocks: DataFrame) -> DataFrame:
    """Per document of written blocks: doc_id, start, n_tokens, ids_crc32."""
    starts = part_starts(blocks)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    @returns_memory
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, before, keys, lengths, codes = (batch.column(c)[row].as_py() for c in range(5))
                ids = DacReader(codes).all().astype("<u4", copy=False)
                ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
                start = ends - lengths
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(start.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(start + (starts[part] + before), pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=names,
                )

    return blocks.select("part", "ids_before", "doc_ids", "n_ids", "codes").mapInArrow(
        rows, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def write_blocks(blocks: DataFrame, name: str = "token-blocks") -> DataFrame:
    """``blocks`` in the file format, written and opened again."""
    return materialize(blocks, name, **FILE_OPTIONS)


def token_at(blocks: DataFrame, position: int, starts: dict[int, int] | None = None) -> int:
    """The id at ``position`` of the whole corpus, out of the codes of one block."""
    starts = part_starts(blocks) if starts is None else starts
    part = max((p for p in starts if 0 <= starts[p] <= position), key=lambda p: (starts[p], p), default=None)
    if part is None:
        raise IndexError(position)
    inside = position - starts[part]
    here = blocks.where((F.col("part") == part) & (F.col("ids_before") <= inside))
    block = here.orderBy(F.desc("ids_before")).select("ids_before", "offsets", F.length("codes").alias("size")).first()
    at = blocks.where((F.col("part") == part) & (F.col("ids_before") == block.ids_before))
    if position < 0 or inside - block.ids_before >= block.offsets[1] - block.offsets[0]:
        raise IndexError(position)
    value, i = 0, inside - block.ids_before
    for level in range(len(block.offsets) // 3):
        chunk, bitmap, rank = block.offsets[3 * level : 3 * level + 3]
        first, group = i // RANK_BITS * (RANK_BITS // 8), i // RANK_BITS
        cut = lambda offset, size: F.substring("codes", offset + 1, size)
        low, bits, before = at.select(cut(chunk + i, 1), cut(bitmap + first, i // 8 - first + 1), cut(rank + 4 * group, 4)).first()
        value |= low[0] << (8 * level)
        if not bits[-1] >> (i & 7) & 1:
            break
        i = int.from_bytes(before, "little") + sum(b.bit_count() for b in bits[:-1]) + (bits[-1] & ((1 << (i & 7)) - 1)).bit_count()
    return value


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_documents(write_blocks(encode_documents(docs)))
