import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from bucketwise.llm import sentence_pieces as sp


@pytest.fixture(scope="module")
def data():
    return sp.read_model()


@pytest.fixture(scope="module")
def model(data):
    return sp.PieceModel(data)


@pytest.fixture(scope="module")
def library(data):
    """The library's own search for the best path over the same pieces: the
    model's kind is switched from merges (2) to scores (1) in memory."""
    at = data.rindex(b"\x18\x02 \x80\xfa\x01")
    return sentencepiece.SentencePieceProcessor(model_proto=data[:at] + b"\x18\x01" + data[at + 2 :])


def score(model, ids):
    total, unknown = 0.0, 0
    for i in ids:
        _, s, kind = model.pieces[i]
        total += 0 if kind == sp.BYTE else s
    return total


def texts():
    rng = random.Random(3)
    return ["Hello  world", "a", "", None, "  x", " ", "日本 語", "tab\tline\nend\r\n"] + [
        "".join(rng.choice("abcdehéñ  \n\t漢€T.it!%") for _ in range(rng.randint(1, 30))) for _ in range(400)
    ]


def split(model, found):
    ids, n = model.encode(found)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_best_path(model, library):
    same = 0
    for text, ids in zip(texts(), split(model, texts())):
        other = library.encode(text or "")
        same += ids == other
        # the library adds scores in single precision; it is never better
        assert ids == other or score(model, ids) >= score(model, other)
    assert same > 0.9 * len(texts())


def test_parts_and_whole_texts_agree(model, data):
    whole = sp.PieceModel(data)
    whole.separable = False
    for text in texts():
        if text:
            a, b = (split(m, [text])[0] for m in (model, whole))
            assert score(model, a) == score(model, b) and len(a) > 0


def test_best_of_all_paths(model):
    score_of = {p: s for p, s, k in model.pieces if k == sp.NORMAL}
    for part in ("▁them", "▁hello", "there", "ing"):
        best = {0: 0.0}
        for end in range(1, len(part) + 1):
            best[end] = max(best[i] + score_of[part[i:end]] for i in range(end) if part[i:end] in score_of and i in best)
        assert model.segment(part)[1] == best[len(part)]


def test_parts_walked_together_have_the_paths_of_single_ones(model, data, monkeypatch):
    rng = random.Random(8)
    words = [sp.MARK + "".join(rng.choice("abcdeéñhtsing.!") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    words += [p for p, _, k in model.pieces if k == sp.NORMAL and len(p) <= sp.LONG_PART and model.singles.issuperset(p)]
    ordered, ids, n = model.paths.best(set(words))
    assert sorted(ordered) == sorted(set(words))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [model.segment(w)[0] for w in ordered]
    assert model.paths.best([])[0] == []
    with pytest.raises(ValueError, match="no piece"):
        model.paths.best(["x\U0001f9ff"])
    # ordinary words are never segmented one by one; long parts and unknown characters are
    fresh, alone = sp.PieceModel(data), []
    one = fresh.segment
    monkeypatch.setattr(fresh, "segment", lambda part: alone.append(part) or one(part))
    texts = ["hello there  words", "x\U0001f9ff", "y" * (sp.LONG_PART + 1)]
    assert split(fresh, texts) == split(model, texts)
    assert sorted(alone) == sorted(sp.MARK + t for t in texts[1:])


def test_walks_of_ties_chunks_and_failures(monkeypatch):
    from bucketwise.llm import piece_paths

    monkeypatch.setattr(piece_paths, "TOGETHER", 3)
    pieces = [(5, "a", -1.0), (6, "b", -1.0), (7, "ab", -2.0), (8, "bab", -2.5), (9, "aabb", -9.0), (10, "c", -1.0)]
    ordered, ids, n = piece_paths.PiecePaths(pieces).best(["ab", "aababc", "bab", "aabb", "c", "aabc", "b"])
    found = dict(zip(ordered, (x.tolist() for x in np.split(ids, np.cumsum(n)[:-1]))))
    assert found == {"ab": [7], "aababc": [5, 5, 8, 10], "bab": [8], "aabb": [5, 7, 6], "c": [10], "aabc": [5, 7, 10], "b": [6]}


def test_round_trip(spark, odd, empty):
    out = sp.with_pieces(odd.select(*(c for c in odd.columns if c != "text"), "text"))
    assert out.columns[-2:] == ["sp_ids", "sp_decoded"]
    rows = out.select("text", "sp_ids", "sp_decoded").collect()
    assert len(rows) == odd.count() and all(r.sp_decoded == (r.text or "") for r in rows)
    assert all((r.sp_ids == []) == (not r.text) for r in rows)
    assert sp.with_pieces(empty).count() == 0


def test_unknown_without_bytes(data):
    model = sp.PieceModel(data)
    model.byte_ids = {}
    ids = split(model, ["a\U0001f9ff"])[0]
    assert ids[-1] == model.unknown_id and model.decode(ids).endswith(" ⁇ ")


def test_query(spark, sf_dir):
    out = sp.op4_sentence_pieces(spark, sf_dir)
    assert out.where(~F.col("exact")).count() == 0 and out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_models_that_change_texts_are_refused(data):
    field = lambda number, body: bytes([number << 3 | 2, len(body)]) + body
    piece = lambda text, kind: field(1, field(1, text) + bytes([0x18, kind]))
    keeps = field(3, bytes([0x20, 0]))
    assert len(sp.PieceModel(piece(b"a", sp.NORMAL) + keeps).pieces) == 1
    for spoilt in (piece(b"a", sp.NORMAL), piece(b"a", sp.NORMAL) + field(3, field(2, b"map") + bytes([0x20, 0])), piece(b"a", sp.USER_DEFINED) + keeps):
        with pytest.raises(ValueError, match="not supported"):
            sp.PieceModel(spoilt)
