from pyspark.sql import functions as F

from bucketwise.llm.near_dedup import can_be_similar, deduplicate, shingle_set, similarity_of, sketch_of
from tests.llm.conftest import SCHEMA, words
from tests.llm.test_components import brute


def brute_kept(rows):
    texts = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    sets = [shingle_set(t) for _, t in texts]
    links = [(i, i) for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            if texts[i][1] == texts[j][1] or similarity_of(sets[i], sets[j]) >= 0.8:
                links.append((i, j))
    roots = brute(links)
    return sorted({texts[r][0] for r in roots.values()})


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_kept(rows)
    got = sorted(r.doc_id for r in deduplicate(docs).collect())
    assert got == want and len(got) < len(rows)


def test_copies_and_near_copies(spark):
    import random

    rng = random.Random(4)
    rows, number = [], 0
    for group in range(12):
        base = words(rng, 400).split()
        for copy in range(1 + group):
            other = list(base)
            for at in rng.sample(range(400), copy % 4):
                other[at] = "edit" + str(rng.randrange(1000))
            rows.append((number, " ".join(other), "en", "a", 1))
            number += 1
    got = sorted(r.doc_id for r in deduplicate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute_kept([r[:2] for r in rows]) and len(got) == 12


def test_odd_rows(odd, empty):
    out = deduplicate(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    texts = [r.text for r in rows]
    assert len(texts) == len(set(texts))
    assert set(texts) >= {"", None, "x", "one two", "z" * 1500}
    assert deduplicate(empty).count() == 0


def test_repeated_rows(spark):
    rows = [(5, "again and again and again and again", "en", "a", 1)] * 3 + [(None, "t", None, None, None)] * 2
    out = deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert sorted(out.select(F.coalesce("doc_id", F.lit(-1)).alias("d")).collect()) == [(-1,), (5,)]


def test_components_in_blocks(spark, monkeypatch):
    import random

    from bucketwise.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(9)
    base = words(rng, 300).split()
    rows = []
    for i in range(40):
        other = list(base)
        for at in rng.sample(range(300), 2):
            other[at] = f"edit{i}"
        rows.append((i, " ".join(other), "en", "a", 1))
    assert [r.doc_id for r in deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]


def test_copies_that_only_the_original_joins(spark, monkeypatch):
    import random

    from bucketwise.llm import near_dedup

    seen = []
    judge = near_dedup.verified_links
    monkeypatch.setattr(near_dedup, "verified_links", lambda links, sets: seen.append(links.count()) or judge(links, sets))
    rng = random.Random(12)
    base = words(rng, 300, 5000).split()
    rows = [(500, " ".join(base), "en", "a", 1)]
    for i in range(150):
        other = list(base)
        for at in rng.sample(range(0, 300, 6), 6):
            other[at] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(other), "en", "a", 1))
    assert similarity_of(shingle_set(rows[1][1]), shingle_set(rows[2][1])) < 0.8
    assert [r.doc_id for r in deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]
    assert seen[1] <= 3 * 151 and seen[2] < 300  # of 11,175 pairs


def zipf_texts(number, length, vocabulary, s, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    share = 1.0 / np.arange(1, vocabulary + 1) ** s
    drawn = rng.choice(vocabulary, (number, length), p=share / share.sum())
    return [[f"word{w}" for w in text] for text in drawn]


def test_near_copies_among_dense_unrelated_texts(spark):
    # frequent words bring all fingerprints together
    texts = zipf_texts(1500, 200, 60, 1.5, 3)
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]
    rows += [(10_000 + i, " ".join(texts[i][: 200 - 24]), "en", "a", 1) for i in range(150)]
    assert all(similarity_of(shingle_set(rows[i][1]), shingle_set(rows[1500 + i][1])) >= 0.8 for i in range(150))
    got = {r.doc_id for r in deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not [i for i in got if i >= 10_000] and len(got) == 1500


def test_recall_by_length_and_kind_of_edit(spark):
    # every length and edit on its own against brute force: nothing similar enough is kept
    edits = {
        "tail": lambda t, n: t[:-n],
        "head": lambda t, n: t[n:],
        "grown": lambda t, n: t + [f"more{k}" for k in range(n)],
        "middle": lambda t, n: t[: len(t) // 2] + [f"new{k}" for k in range(max(1, n // 2))] + t[len(t) // 2 + max(1, n // 2) :],
    }
    rows, group, number = [], {}, 0
    for length in (12, 30, 60, 100, 300):
        for kind, edit in edits.items():
            for base in zipf_texts(25, length, 3000, 1.0, number):
                base = [f"{kind}{length}x{w}" if k % 9 == 0 else w for k, w in enumerate(base)]
                for text in (base, edit(base, max(1, int(0.18 * length)))):
                    rows.append((number, " ".join(text), "en", "a", 1))
                    group[number] = length, kind
                    number += 1
    want = brute_kept([r[:2] for r in rows])
    got = sorted(r.doc_id for r in deduplicate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(want) < 0.7 * len(rows)
    missed = {}
    for i in set(got) - set(want):
        missed[group[i]] = missed.get(group[i], 0) + 1
    assert not missed and got == want


def test_sketches_reject_no_similar_pair():
    import numpy as np

    rng = np.random.default_rng(8)
    rejected = unlike = 0
    sizes = [0, 1, 2, 5, 63, 64, 65, 100, 129, 500, 1000, 3000]
    for n in sizes:
        base = np.unique(rng.integers(0, 2**32, n, np.uint32))
        for kept in (1.0, 0.95, 0.9, 0.85, 0.8, 0.6, 0.3, 0.0):
            for added in (0.0, 0.05, 0.12, 0.25, 1.0):
                more = rng.integers(0, 2**32, int(added * n), np.uint32)
                other = np.unique(np.concatenate([base[rng.random(len(base)) < kept], more]))
                a, b = (np.frombuffer(sketch_of(w), np.uint8) for w in (base, other))
                for x, y in (((len(base), a), (len(other), b)), ((len(other), b), (len(base), a))):
                    possible = can_be_similar(*x, *y, 0.8)
                    if similarity_of(base, other) >= 0.8:
                        assert possible
                    else:
                        unlike += 1
                        rejected += not possible
    assert rejected > 0.75 * unlike
