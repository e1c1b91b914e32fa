import random

import pytest
from pyspark.sql import functions as F


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary):x}{'aeiou'[rng.randrange(5)] * rng.randrange(1, 6)}" for _ in range(n))


def odd_rows():
    """(doc_id, text, lang, source, n_chars): nulls, empties, a long text, copies, ties, repeated rows."""
    rng = random.Random(11)
    base = words(rng, 300)
    long = words(rng, 20_000, 3000)
    near = base.split()
    near[7], near[200] = "changed", "twice"
    texts = [
        base, base, " ".join(near), base[:200], long, long[1000:90_000], None, "", " \n\t ", "x", "one two", "a b c d e",
        "ABC abc Abc", "é漢字 😀 ß", "same line\n" * 120, "z" * 1500, words(rng, 40), words(rng, 900), "!!! ### 123", "word " * 500,
    ]
    langs = ["en", "fr", None]
    rows = [(i * 3, t, langs[i % 3], ["a", "b", None, "zz"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, base, "en", "a", 1), (None, None, None, None, None), (7, rows[5][1], "fr", "b", 2)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names operators might use."""
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    clash = {c: F.lit(i) for i, c in enumerate(("h", "s", "n", "t", "a", "b", "fp", "node", "root", "kind", "raw", "key", "words", "at", "copy", "frame"))}
    return df.withColumns(clash).cache()


def odd_vectors():
    """(vec_id, embedding, label): nulls, infinities, ties, repeated rows, an outlier, two labels with most rows."""
    rng = random.Random(5)
    base = [[rng.choice((-0.75, -0.25, 0.0, 0.3, 0.5, 0.9)) for _ in range(8)] for _ in range(25)]
    rows = [(i, rng.choice(base) if i % 3 else [rng.gauss(0, 0.5) for _ in range(8)], rng.choice((0, 1, 1, 1, 9))) for i in range(420)]
    bad = [None, [None] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [0.1] * 7 + [None]]
    rows += [(1000 + k, v, 1) for k, v in enumerate(bad)] + [(1100, base[0], None), (None, base[1], 0), (None, None, None)]
    rows += [rows[100], rows[100], rows[7], (1200, [50.0, -70.0] + [0.0] * 6, 0), (-100, base[2], 1), (-7, base[3], -3)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def tables(spark, odd, tmp_path_factory):
    """A folder with ``documents`` as the queries read it: the odd rows with ids, and an empty one."""
    base = tmp_path_factory.mktemp("sf")
    odd.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").write.parquet(f"{base}/odd/documents.parquet")
    odd.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{base}/none/documents.parquet")
    vectors = spark.createDataFrame(odd_vectors(), VECTORS).repartition(3)
    vectors.write.parquet(f"{base}/odd/embeddings.parquet")
    vectors.limit(0).write.parquet(f"{base}/none/embeddings.parquet")
    return str(base)
