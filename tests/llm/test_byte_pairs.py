"""The transducer against the library on whole texts, and its lookahead against brute force."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bucketwise.llm import byte_pairs as bp

PATH = public_tokenizers.path(bp.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bp.BytePairs(bp.read_tokenizer())


def odd_texts(rng, n):
    long = ["z" * 9000, " " * 9000, "\n " * 5000, "1" * 9000, "!?" * 5000, "é漢" * 4000, "\U00010940" * 3000, "abc" * 3000]
    short = ["<|endoftext|>", "<|endof", "text|>", "'ll", "'", "l", " a", " ", "\n", "can't", " <|endoftext|> ", "it's", "½ ² ① Ⅷ", "İSTANBUL ÜNİVERSİTESİ, 2020"]
    for _ in range(n):
        yield "".join(rng.choice(long if rng.random() < 0.3 else short) if rng.random() < 0.6 else "".join(rng.choice("ab 'sltrev1!\né") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 14)))


def test_whole_texts_and_streams(library, own):
    rng = random.Random(5)
    texts = list(odd_texts(rng, 120))
    ids, number = own.encode([*texts, None, ""])
    for text, got in zip(texts, np.split(ids, np.cumsum(number)[:-1])):
        want = library.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(12)))
        pieces = [text[a:z] for a, z in zip([0, *cuts], [*cuts, len(text)])]
        assert [i for p in own.stream(pieces) for i in p.tolist()] == want
        assert own.decode(got) == library.decode(want, skip_special_tokens=False) == text
    assert number[-2:].tolist() == [0, 0]


def test_characters_of_every_kind(library, own):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 17 == 0 or c in (0x10940, 0x16EA0, 0x1E6C0))]
    texts = [f"a{c}b{c}{c} {c}1{c}'s{c}  {c}\n{c}" for c in map(chr, points)]
    ids, number = own.encode(texts)
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [p.tolist() for p in np.split(ids, np.cumsum(number)[:-1])] == want


def test_decoding_any_ids(library, own):
    rng = random.Random(2)
    for _ in range(1500):
        ids = [rng.randrange(50_260) if rng.random() < 0.5 else rng.choice(own.merges.byte_id) for _ in range(rng.randrange(12))]
        want = library.decode(ids, skip_special_tokens=False)
        assert own.decode(np.array(ids, np.int64)) == want
        machine = bp.TextDecoder(own.as_bytes)
        assert "".join([machine.push([i]) for i in ids] + [machine.finish()]) == want


def random_merges(rng, rules):
    """A merge list in which every rule makes a new token of earlier ones."""
    tokens, made = [bytes([b]) for b in b"abc"], []
    while len(made) < rules:
        u, v = rng.choice(tokens), rng.choice(tokens)
        if u + v not in tokens and len(u + v) < 12:
            tokens.append(u + v)
            made.append((u, v))
    return bp.Merges(made, {t: i for i, t in enumerate(tokens)}), [len(t) for t in tokens], made


def by_rounds(rules, data):
    """Merging by its definition: rule after rule, leftmost first."""
    tokens = [bytes([b]) for b in data]
    for u, v in rules:
        i = 0
        while i + 1 < len(tokens):
            if (tokens[i], tokens[i + 1]) == (u, v):
                tokens[i : i + 2] = [u + v]
            i += 1
    return [len(t) for t in tokens]


def test_lookahead_is_sufficient_and_close():
    rng, most = random.Random(8), 0.0
    for _ in range(150):
        merges, length, rules = random_merges(rng, rng.randrange(1, 25))
        words = []
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 60)))
            words.append(word)
            whole = by_rounds(rules, word)
            assert [length[t] for t in merges.merge(word)] == whole
            ends = set(np.cumsum(whole).tolist())
            for cut in range(1, len(word)):
                part = np.cumsum(by_rounds(rules, word[:cut])).tolist()
                changed = next((e for e, n in zip([0, *part], part) if n not in ends), cut)
                assert cut - changed <= merges.lookahead
                most = max(most, (cut - changed) / merges.lookahead)
        ids, number = merges.merge_words(words)
        assert ids.tolist() == [t for w in words for t in merges.merge(w)]
        assert number.tolist() == [len(merges.merge(w)) for w in words]
    assert most == 1.0  # some lists need all of it


def test_transducer_holds_a_bounded_number_of_bytes():
    rng = random.Random(4)
    for _ in range(60):
        merges, length, rules = random_merges(rng, 20)
        machine, out, word = bp.Transducer(merges, length, 5), [], bytes(rng.choice(b"abc") for _ in range(2000))
        for at in range(0, len(word), 7):
            out += machine.push(word[at : at + 7])
            assert len(machine.pending) < merges.lookahead + 2 * machine.block
        assert out + machine.finish() == merges.merge(word)
        assert len(out) > 20


def test_lookahead_of_the_file(own):
    assert own.merges.lookahead == 320  # bytes, whatever a word's length


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": {"dropout": 0.1}}, {"model": {"merges": [["ab", "c"]]}}])
def test_other_files_are_refused(change):
    file = json.loads(bp.read_tokenizer())
    for k, v in change.items():
        file[k] = {**file[k], **v} if k == "model" else v
    with pytest.raises(ValueError, match="rule 0|plain byte-level"):
        bp.BytePairs(json.dumps(file).encode())


def test_query_against_the_library(spark, tables, library):
    docs = spark.read.parquet(f"{tables}/odd/documents.parquet").collect()
    got = sorted(map(tuple, bp.op12_byte_pairs(spark, f"{tables}/odd").collect()))
    want = []
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)


def test_columns_are_kept_and_ids_decode(spark, odd):
    got = bp.with_decoded(bp.with_ids(odd), "bpe_ids").collect()
    assert len(got) == odd.count() and set(odd.columns) < set(got[0].asDict())
    assert all(r.bpe_decoded == (r.text or "") for r in got)
