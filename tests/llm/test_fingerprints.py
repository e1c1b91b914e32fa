import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from bucketwise.llm import fingerprints as fm


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def spark_hash(*values):
    """Spark's xxhash64: each value is hashed with the hash of those before as seed."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(8 if isinstance(v, Long) else 4, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return Long(h - (1 << 64) if h >> 63 else h)


class Long(int):
    """A number of 64 bits; a plain one has 32."""


def fingerprint(text):
    """Bin by bin."""
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    if not words:
        return "0" * 256
    h = [spark_hash(w) for w in words]
    if len(h) < 5:
        found = [spark_hash(" ".join(words))]
    else:
        two = [spark_hash(a, b) for a, b in zip(h, h[1:])]
        four = [spark_hash(a, b) for a, b in zip(two, two[2:])]
        found = [spark_hash(a, b) for a, b in zip(four, h[4:])]
    least = {}
    for x in found:
        b = (x % 2**64) >> 57
        if x % 2**57 != 2**57 - 1:
            least[b] = min(least.get(b, x), x)
    places = [(i + 64) % 128 for i in range(128)]  # bins in the order of signed hashes
    out = []
    for b in places:
        value = least.get(b)
        if value is None:
            for k in range(fm.PROBES):
                value = least.get(places[spark_hash(Long(b), k) % 128])
                if value is not None:
                    break
            else:
                value = min((spark_hash(Long(b), Long(c)), v) for c, v in least.items())[1]
            value = spark_hash(value, Long(b))
        out.append(f"{value & 255:02x}")
    return "".join(out)


def test_against_brute_force(spark, tables):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/odd/documents.parquet").collect()}
    for r in fm.op9_document_fingerprints(spark, f"{tables}/odd").collect():
        assert r.fingerprint == fingerprint(rows[r.doc_id] or "")


def check(rows, got, spread=0.07):
    rows = sorted(rows, key=lambda r: -r[0])
    texts, by = [t or "" for _, t in rows], {r.doc_id: r for r in got}
    errors = []
    for i, (d, _) in enumerate(rows):
        text, following = texts[i], texts[(i + 1) % len(rows)]
        k = len(text) // 3
        edited, r = text[: len(text) - k] + following[:k], by[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, following)]
    assert np.std(errors) < spread and abs(np.mean(errors)) < 0.02


def test_estimates(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = fm.op9_document_fingerprints(spark, sf_dir).collect()
    check(rows, got)
    by_text = {}
    for r in got:
        text = dict(rows)[r.doc_id]
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 256


def test_odd_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/odd/documents.parquet").dropDuplicates(["doc_id"])
    docs.write.mode("overwrite").parquet(f"{tables}/odd1/documents.parquet")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/odd1/documents.parquet").collect()]
    check(rows, fm.op9_document_fingerprints(spark, f"{tables}/odd1").collect(), 0.1)


def test_likeness_of_texts_without_words(spark):
    df = spark.createDataFrame([("", " \n"), ("", "a b"), ("a b", "a b"), ("a b", "c d")], "a string, b string")
    both = fm.with_fingerprint(fm.with_fingerprint(df, "a", "x"), "b", "y")
    got = [r[0] for r in both.select(fm.likeness(F.col("x"), F.col("y"))).collect()]
    assert got[:3] == [1.0, 0.0, 1.0] and got[3] < 0.05
    assert both.select(fm.packed(F.col("x"))).first()[0] == "0" * 256


def test_neighbours(spark):
    for ids in ([3], [5, 1, 9, 2], [None], [None, 4], [7, 7, 7, 1], list(range(300)), [7] * 300 + [None] * 200 + list(range(50))):
        df = spark.createDataFrame([(d, f"t{i:03d}", 1) for i, d in enumerate(ids)], "doc_id long, text string, at int")
        got = {r.text: r.following for r in fm.with_next(df, "doc_id", {"following": "text"}, "text").collect()}
        assert len(got) == len(ids) and set(got) == set(got.values())
        if None not in ids and len(set(ids)) == len(ids):
            order = sorted(zip(ids, got.keys() if False else [f"t{i:03d}" for i in range(len(ids))]), reverse=True)
            names = [t for _, t in order]
            assert got == dict(zip(names, names[1:] + names[:1]))


def test_one_key_is_dealt_out(spark):
    df = spark.createDataFrame([(7, f"t{i}") for i in range(800)] + [(None, f"n{i}") for i in range(800)], "doc_id long, text string")
    out = fm.with_next(df, "doc_id", {"following": "text"}, "text")
    sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert out.count() == 1600 and len(sizes) > 1 and max(sizes) < 800


def test_no_python_on_the_executors(spark, sf_dir):
    plan = fm.op9_document_fingerprints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
