import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bucketwise.llm import suffix_array as sa
from bucketwise.llm import suffix_dedup as sd


@given(st.lists(st.integers(1, 4), max_size=80), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_suffix_array(symbols, times):
    s = np.array(symbols * times + [0], dtype=np.int64)
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    order = sa.suffix_array(s)
    assert order.tolist() == want and sa._doubling(s).tolist() == want
    phi, common = sa.plcp(s.astype(np.uint8), order, 6)
    for before, here in zip(want, want[1:]):
        n = next((k for k in range(len(s)) if here + k >= len(s) or before + k >= len(s) or s[here + k] != s[before + k]), 0)
        assert phi[here] == before and (common[here] == n or min(common[here], n) >= 6)


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen, owners = Counter(), defaultdict(set)
    for k, (_, b) in enumerate(texts):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
            owners[b[i : i + length]].add(k)
        for a, z in passages(b, length):
            owners[b[a:z], "words"].add(k)
    out = []
    for d, b in texts:
        gone, common = np.zeros(len(b), dtype=bool), np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
            if len(owners[b[i : i + length]]) > 1:
                common[i : i + length] = True
        for a, z in passages(b, length):
            if len(owners[b[a:z], "words"]) > 1:
                common[a:z] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), int(common.sum())))
    return sorted(out, key=str)


def passages(b, length):
    """(first, end) of all runs of 51 words of 256 bytes and more, shorter than ``length``."""
    at = [m.span() for m in re.finditer(rb"[^ \t-\r]+", b)]
    both = [(a[0], z[1]) for a, z in zip(at, at[50:])]
    return [(a, z) for a, z in both if 256 <= z - a < length]


@pytest.mark.parametrize("hot", [1 << 20, 1])
def test_against_brute_force(spark, tables, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT_BYTES", hot)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/odd/documents.parquet").collect()]
    got = sd.op3_suffix_dedup(spark, f"{tables}/odd").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 400)
    assert sum(r.n_removed > 0 for r in got) > 8


@pytest.mark.parametrize("hot", [1 << 20, 1])
def test_shared_passages(spark, monkeypatch, hot):
    """Passages of over 50 words below 400 bytes, in mid-text and at the ends, cut within words, and repeats within one text."""
    monkeypatch.setattr(sd, "HOT_BYTES", hot)
    rng = random.Random(5)
    some = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(n)]
    passage, other, alone = some(51), some(53), some(60)
    texts = [
        some(80) + passage + some(30), passage + some(20), some(90) + passage, some(10) + [passage[0] + "x"] + passage[1:] + some(9),
        some(9) + passage[:50] + [passage[50] + "x"] + some(9), some(40) + other + some(40), some(20) + other, alone + some(70) + alone, some(200),
    ]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9, "\n".join(other))]
    got = {r.doc_id: r for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(map(tuple, got.values()), key=str) == brute(rows, 400)
    assert {i for i, r in got.items() if r.n_shared} == {0, 1, 2, 5, 6} and got[7].n_removed > 0


def test_test_data(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, sd.op3_suffix_dedup(spark, sf_dir).collect()), key=str) == brute(rows, 400)


def test_shorter_strings_and_odd_columns(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sd.remove_repeats(odd, length=64).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 64)
    assert sd.remove_repeats(empty).count() == 0


def test_segments_partition_windows(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (0, 399, 400, 3000, 1500)] + [b"ab" * 900]
    whole = sd.segments(texts, 400)
    windows = {(k, f + i) for _, k, f, n, _ in zip(*(c.tolist() for c in whole)) for i in range(n)}
    assert windows == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 399)}
    monkeypatch.setattr(sd, "_MOST_PLACES", 1 << 11)  # as for a text of hundreds of megabytes
    parts = sd.segments(texts, 400)
    assert int(parts[3].sum()) == int(whole[3].sum())


def test_spans():
    runs = np.array([5, 7, 100, 101, 6, 9])
    assert sd.merge_spans(runs, 10).tolist() == [[5, 18], [100, 110]]
    assert sd.cut_spans(b"0123456789", np.array([[2, 4], [8, 10]])) == b"014567"


def test_segments_are_judged_together_and_grams_by_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    shared = rng.integers(97, 123, 900, dtype=np.uint8).tobytes()
    parts = [b"x" + rng.integers(97, 123, 300, dtype=np.uint8).tobytes() + shared[k * 10 :] for k in range(12)]
    rows = [(1 + (k == 3), k, k + (k == 3), len(p) - 256, p) for k, p in enumerate(parts)]
    called, runs_of = [], sd._runs
    monkeypatch.setattr(sd, "_runs", lambda flags: called.append(1) or runs_of(flags))
    found = sd.repeated_strings(rows)
    assert len(called) == 1  # not once a segment
    starts: dict[bytes, list] = {}
    for k, p in enumerate(parts):
        for i in range(1, len(p) - 399):
            starts.setdefault(p[i : i + 400], []).append((k, i - 1))
    for k, (n, low, high, places, p) in enumerate(rows):
        whole = range(min(places, len(p) - 400))
        met = [i for i in whole if n > 1 or len(starts[p[i + 1 : i + 401]]) > 1]
        runs, spans = found[k]
        assert [i for a, b in zip(runs[::2], runs[1::2]) for i in range(a, b)] == met
        assert {j for a, b in zip(spans[::2], spans[1::2]) for j in range(a, b)} == {j for i in met for j in range(i, i + 400)}
    texts = [rng.integers(97, 100, m, dtype=np.uint8).tobytes() for m in (5000, 0, 100, 256, 3000)]
    whole = sd.segments(texts)
    monkeypatch.setattr(sd, "_BLOCK", 77)
    assert all((a == b).all() for a, b in zip(whole, sd.segments(texts)))
    at = [(int(k), int(f) + j) for k, f, n in zip(*whole[1:4]) for j in range(int(n))]
    assert at == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 255)]
