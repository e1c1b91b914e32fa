"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton holds every ordinary piece of a model.  One pass over a text
visits each position once; the output links of the state there name all pieces
that end at it, and each relaxes the best score of that position (Viterbi).  A
character that no single-character piece covers may be taken as unknown, below
every ordinary score, and is then spelt in byte pieces.  Ties go to the longer
piece.  The segmentation has the greatest sum of the model's scores.

No piece may cross the start of a run of white-space marks, a tab or a line
end (checked when a model is read; else texts are taken whole), so the
best path of a text is the best paths of the parts between, which a worker
computes once per distinct part.  Texts are never shuffled.

Defined results
  * null and empty texts have no pieces and decode to the empty text;
  * the mark U+2581 in a text decodes to a space, as in the format itself;
  * without byte pieces an unknown character becomes the unknown id, which
    decodes to U+2047 between spaces;
  * rows that repeat are encoded alike; an empty table stays empty; extra
    columns are carried by :func:`with_pieces`; a column whose name starts with
    ``sp_`` is refused;
  * models that change texts before they are cut (a character map, removal of
    extra white space, unescaped white space) or that have user-defined pieces are
    refused: their texts would be cut otherwise than the format says.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bucketwise.llm.common import no_columns, returns_memory
from bucketwise.llm.id_cache import IdCache, joined
from bucketwise.llm.piece_paths import PiecePaths

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Subtracted from the least ordinary score for an unknown character.
UNKNOWN_PENALTY = 10.0
#: Parts of texts that a worker keeps; they take twice the memory of ASCII words.
CACHED_PARTS = 150_000
#: Characters of a part beyond which, as with characters that no single-character
#: piece covers, it is segmented alone; others together (:mod:`bucketwise.llm.piece_paths`).
LONG_PART = 64
#: Kinds of pieces in the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_PARTS = re.compile("▁+[^▁\t\n]*|[^▁\t\n]+|[\t\n]")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        yield tag >> 3, value


class PieceModel:
    """Pieces, scores and kinds of a model file, the automaton over the pieces,
    and encoding and decoding with them."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        dummy_prefix, normaliser = True, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), float(piece.get(2, 0.0)), int(piece.get(3, NORMAL))))
            elif number == 3:
                normaliser = dict(_fields(value))
                dummy_prefix = bool(normaliser.get(3, 1))
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("a model with a normaliser of its own is not supported")
        if any(kind == USER_DEFINED for _, _, kind in self.pieces):
            raise ValueError("a model with user-defined pieces is not supported")
        self.dummy_prefix = dummy_prefix
        ordinary = [(i, p, s) for i, (p, s, k) in enumerate(self.pieces) if k == NORMAL and p]
        self.unknown_id = next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0)
        self.unknown_score = min((s for _, _, s in ordinary), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = {int(p[3:-1], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.automaton = ahocorasick.Automaton()
        for i, p, s in ordinary:
            self.automaton.add_word(p, (i, len(p), s))
        self.automaton.make_automaton()
        self.paths = PiecePaths(ordinary)
        self.singles = frozenset(p for _, p, _ in ordinary if len(p) == 1)
        self.separable = not any(MARK in p.lstrip(MARK) or re.search("[\t\n]", p) for _, p, _ in ordinary)
        self.as_bytes = [self._bytes_of(i) for i in range(len(self.pieces))]
        self.cache = IdCache(self._learn, CACHED_PARTS)

    def _bytes_of(self, i: int) -> bytes:
        piece, _, kind = self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    def _unknown(self, char: str) -> list[int]:
        spelt = [self.byte_ids.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown_id] if None in spelt else spelt

    def segment(self, part: str) -> tuple[list[int], float]:
        """Ids and score of the best path through ``part``."""
        n = len(part)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        at, single = -1, True  # position whose outputs are being read

        def close(upto: int) -> None:
            """Settle the positions before ``upto`` that had no outputs, and the last one."""
            nonlocal at, single
            while at < upto:
                if at >= 0 and not single:
                    score = best[at] + self.unknown_score
                    if back[at + 1] is None or score > best[at + 1]:
                        best[at + 1], back[at + 1] = score, (-1, 1)
                at, single = at + 1, False

        for end, (piece, size, score) in self.automaton.iter(part):
            if end != at:
                close(end)
            single = single or size == 1
            score += best[end + 1 - size]
            if back[end + 1] is None or score > best[end + 1]:
                best[end + 1], back[end + 1] = score, (piece, size)
        close(n)
        ids: list[int] = []
        while n:
            piece, size = back[n]
            ids += self._unknown(part[n - 1])[::-1] if piece < 0 else [piece]
            n -= size
        return ids[::-1], best[-1]

    def _learn(self, parts: set[str]) -> None:
        alone = [p for p in parts if len(p) > LONG_PART or not self.singles.issuperset(p)]
        self.cache.add(*self.paths.best(parts.difference(alone)))
        self.cache.add(alone, *joined([self.segment(p)[0] for p in alone]))

    def _parts(self, text: str) -> list[str]:
        text = text.replace(" ", MARK)
        if self.dummy_prefix:
            text = MARK + text
        return _PARTS.findall(text) if self.separable else [text]

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        parts: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                parts += self._parts(text)
            ends.append(len(parts))
        ids, length = self.cache.gather(self.cache.codes(parts))
        return ids, np.diff(np.concatenate([[0], np.cumsum(length)])[ends])

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD."""
        data = b"".join(map(self.as_bytes.__getitem__, ids))
        if self.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


_models: dict[bytes, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    """This worker's model; it outlives a task."""
    name = hashlib.sha256(data).digest()
    if name not in _models:
        _models.clear()
        _models[name] = PieceModel(data)
    return _models[name]


def read_model(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


def with_pieces(docs: DataFrame, model: bytes | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``sp_ids`` (array of int) and ``sp_decoded``, the text that
    those ids decode to.  The model (below a megabyte) is broadcast."""
    no_columns(docs, "sp_")
    shared = docs.sparkSession.sparkContext.broadcast(model or read_model())
    at = docs.columns.index(text)
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("sp_ids", T.ArrayType(T.IntegerType())), T.StructField("sp_decoded", T.StringType())]
    )

    @returns_memory
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _model(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                piece = batch.slice(first, 256)
                ids, n = coder.encode(piece.column(at).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = ids.tolist()
                decoded = [coder.decode(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, lists, pa.array(decoded, pa.string())],
                    names=[*piece.schema.names, "sp_ids", "sp_decoded"],
                )

    return docs.mapInArrow(rows, schema)


def op4_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_pieces, ids_crc32 (of the ids as little-endian
    32-bit integers), decoded_sha256, and whether the text came back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "exact"]

    @returns_memory
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lists, decoded = batch.column(1), batch.column(2), batch.column(3)
            sizes, sums, shas, exact = [], [], [], []
            for t, ids, d in zip(text, lists, decoded):
                values = ids.values.to_numpy().astype("<u4", copy=False)
                d = d.as_py()
                sizes.append(len(values))
                sums.append(zlib.crc32(np.ascontiguousarray(values)))
                shas.append(hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest())
                exact.append(d == (t.as_py() or ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(shas, pa.string()), pa.array(exact, pa.bool_())],
                names=names,
            )

    return with_pieces(docs).mapInArrow(
        digests, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean"
    )
