import re
from math import comb

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bucketwise.llm import simhash as sh
from tests.llm.test_components import brute


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_against_brute_force(spark, tables, sf_dir):
    for folder in (f"{tables}/odd", sf_dir):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        fps = {}
        for r in docs:
            fps.setdefault(plain_fingerprint(r.text), set()).add(r.doc_id)
        known = np.array(sorted(fps), dtype=np.uint64)
        links = [(x, x) for x in fps]
        for i, x in enumerate(known):
            links += [(int(x), int(known[i + 1 + j])) for j in np.flatnonzero(np.bitwise_count(x ^ known[i + 1 :]) <= 2)]
        roots, least = brute(links), {}
        for fp, ids in fps.items():
            least[roots[fp]] = min(least.get(roots[fp], 1 << 60), min(ids))
        want = sorted((r.doc_id, f"{plain_fingerprint(r.text):016x}", least[roots[plain_fingerprint(r.text)]]) for r in docs)
        got = sh.op5_simhash_near_duplicates(spark, folder).collect()
        assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def _close_family(rng, n):
    fps = [rng.integers(0, 2**63, dtype=np.uint64) for _ in range(n)]
    for x in fps[: n // 4]:
        for _ in range(rng.choice([1, 3, 60])):
            y = int(x)
            for _ in range(rng.integers(0, 4)):
                y ^= 1 << int(rng.integers(64))
            fps.append(np.uint64(y))
    return np.unique(np.array(fps, dtype=np.uint64))


def test_plan_of_unrelated_fingerprints_stays_small():
    """Rows a fingerprint: filed three times up to 10^9 of them; beyond, a few
    look-ups cost less than the candidates in buckets of 21 bits."""
    fps = np.random.default_rng(4).integers(0, 2**64, sh.PLAN_SAMPLE, dtype=np.uint64)
    for number, most in ((10**6, 3), (10**8, 3), (10**9, 3), (10**10, 18)):
        plan = sh.plan(fps, number, 2)
        assert sum(1 + sum(comb(len(p.bits), d) / 2 for d in range(1, p.threshold + 1)) for p in plan) <= most
    assert sh._close_pairs(np.arange(4, dtype=np.uint64), 2, 2) == [0.0, 8 / 12, 1.0]
    assert sh._close_pairs(np.zeros(1, np.uint64), 2, 1) == [0.0, 0.0]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
@pytest.mark.parametrize("number", [1000, 10**8])
def test_plan_finds_every_pair(radius, number):
    fps = _close_family(np.random.default_rng(radius), 240)
    plan = sh.plan(fps[:200], number, radius)
    keys, rows, looks = (np.concatenate(c) for c in zip(*((k, r, np.full(len(r), q)) for k, r, q in sh._filed(fps, plan))))
    order = np.argsort(keys, kind="stable")
    found = set()
    for i, j, _ in sh.verified_pairs(keys[order], looks[order], fps[rows[order]], radius):
        found |= {tuple(sorted(p)) for p in zip(rows[order][i].tolist(), rows[order][j].tolist())}
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert found == set(zip(*(x.tolist() for x in np.nonzero(np.triu(apart <= radius, 1)))))


def test_thresholds_add_up():
    cost, chosen = sh.allot_thresholds([[5.0, 50.0], [1.0, 2.0], [9.0, 90.0]], 0)
    assert sum(chosen) == 0 and chosen == [0, 1, -1] and cost == 7.0
    assert sh.allot_thresholds([[1.0]], 5)[0] == float("inf")


def test_long_runs_are_compared_in_full():
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    fps = np.unique(np.array([base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (5000, 2))], dtype=np.uint64))
    keys, looks = np.zeros(len(fps), np.int64), np.zeros(len(fps), bool)
    got = sum(len(i) for i, _, _ in sh.verified_pairs(keys, looks, fps, 2))
    assert got == int(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1).sum())


def test_spanning_forest():
    a, b, d = np.array([1, 3, 2, 5, 5, 2]), np.array([2, 1, 3, 6, 6, 1]), np.array([1, 2, 1, 4, 4, 1])
    assert sorted(zip(*(c.tolist() for c in sh.spanning_forest(a, b, d)))) == [(1, 2, 1), (2, 3, 1), (5, 6, 4)]
    none = np.zeros(0, np.int64)
    assert [len(c) for c in sh.spanning_forest(none, none, none)] == [0, 0, 0]


def test_dense_groups_keep_their_components(spark, monkeypatch):
    monkeypatch.setattr(sh, "CHUNK_PAIRS", 50)
    fps = _close_family(np.random.default_rng(8), 120)
    nodes = spark.createDataFrame([(i, int(np.int64(f))) for i, f in enumerate(fps.view(np.int64))], "node long, fp long")
    found = [(r.a, r.b) for r in sh.near_links(nodes, 3).collect()]
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    want = list(zip(*(x.tolist() for x in np.nonzero(np.triu(apart <= 3, 1)))))
    every = [(i, i) for i in range(len(fps))]
    assert brute(found + every) == brute(want + every) and set(map(tuple, map(sorted, found))) <= set(want)


def test_carried_through_the_operator(odd):
    out = sh.near_duplicates(odd)
    assert out.count() == odd.count()
    nulls = out.where(F.col("doc_id").isNull()).collect()
    assert sorted(r.component_id for r in nulls) == [0, 18]
