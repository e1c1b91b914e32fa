import numpy as np
from pyspark.sql import functions as F

from bucketwise.llm import language_id as lid


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    out = lid.op7_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out and lang is not null")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 30 and right >= 0.97


def test_fold(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in [*range(200), None]], "doc_id long")
    for r in df.select("doc_id", lid.held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_nothing_is_learned_from_the_held_out_fold(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(lid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = lid.train(docs), lid.train(spoilt)
    assert a.families == b.families and np.array_equal(a.top[0], b.top[0])


def test_odd_rows(odd, empty):
    model = lid.train(odd)
    rows = lid.with_language(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        blank = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lid_lang == "und") == blank and 0 <= r.lid_score <= 1
        assert blank or r.lid_lang in ("en", "fr")
    by_text = {}
    assert all(by_text.setdefault(r.text, r.lid_lang) == r.lid_lang for r in rows)
    assert lid.train(empty) is None and lid.with_language(empty, None).count() == 0
    assert {r.lid_lang for r in lid.with_language(odd, None).collect()} == {"und"}


def test_numbers_that_are_not_digits_are_no_letters(spark, odd):
    texts = ["½", "²", "①", "Ⅷ", "½ ² ① Ⅷ 12 _", "ª", "½ a", "ー"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = lid.with_language(docs, lid.train(odd)).orderBy("doc_id").collect()
    assert [r.lid_lang == "und" for r in found] == [True] * 5 + [False] * 3
    assert all((r.lid_score == 0) == (r.lid_lang == "und") for r in found)


def test_close_languages_are_told_apart_within_the_family():
    rng = np.random.default_rng(1)
    kinds = {"en": 0, "de": 1, "fr": 2, "es": 3, "qq": 4}
    x = rng.normal(0, 0.3, (300, 12))
    labels = [list(kinds)[i % 5] for i in range(300)]
    for i, lang in enumerate(labels):
        x[i, kinds[lang]] += 2
        x[i, 6 + {"en": 0, "de": 0, "fr": 1, "es": 1, "qq": 2}[lang]] += 2
    model = lid.LanguageModel.fit(x, labels)
    names, score = model.predict(x)
    assert model.families == ["germanic", "qq", "romance"] and np.mean([a == b for a, b in zip(names, labels)]) > 0.99
    assert ((score > 0) & (score <= 1)).all()


def test_languages_of_a_family_are_voted_on_pair_by_pair():
    rng = np.random.default_rng(2)
    langs = ["en", "de", "nl", "sv", "da"]
    # three close ones on a line: the middle one against the rest is not linear
    centre = {"en": (0.0, 0), "de": (0.4, 0), "nl": (0.8, 0), "sv": (0, 0.8), "da": (0.8, 0.8)}
    labels = [langs[i % 5] for i in range(500)]
    x = np.array([centre[v] for v in labels]) + rng.normal(0, 0.03, (500, 2))
    model = lid.LanguageModel.fit(x, labels)
    assert model.within[0][0].shape == (10, 2)
    names, score = model.predict(x)
    assert np.mean([a == b for a, b in zip(names, labels)]) > 0.99 and ((score > 0) & (score <= 1)).all()
    # a cycle of three votes is settled by the sum of margins
    assert lid.vote(np.array([[1.0, -3.0, 1.0]]), 3)[0].tolist() == [2]


def test_every_labelled_language_is_learned(spark):
    rows = [(100 * i + k, f"{chr(0x4E00 + 40 * i)}{chr(0x4E01 + 40 * i)} " * 9, f"q{i}") for i in range(70) for k in range(6)]
    model = lid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.families) == 70


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(lid, "MOST_SAMPLED", 12)
    rows, seen = [(i, f"some words {i}", ("en", "fr", "ru")[i % 3]) for i in range(300)], []
    monkeypatch.setattr(lid.LanguageModel, "fit", lambda x, labels: seen.extend(labels))
    lid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(seen) == ["en"] * 4 + ["fr"] * 4 + ["ru"] * 4


def test_null_ids_and_repeated_texts(spark):
    texts = ["the cat sat on the mat", "der Hund lief durch den Wald", "le chat dort dans la maison"]
    rows = [(None, texts[i % 3], ("en", "de", "fr")[i % 3]) for i in range(9000)] + [(None, "rara avis", "la")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.train(docs)
    assert sorted(sum(model.langs, [])) == ["de", "en", "fr", "la"]
    assert {(r.text, r.lid_lang) for r in lid.with_language(docs, model).distinct().collect()} == {*zip(texts, ("en", "de", "fr")), ("rara avis", "la")}
    varied = spark.createDataFrame([(None, f"{texts[i % 3]} {i}", ("en", "de", "fr")[i % 3]) for i in range(9000)], "doc_id long, text string, lang string")
    assert len(lid.train(varied).families) == 2
