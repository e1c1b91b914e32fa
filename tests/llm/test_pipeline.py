from pyspark.sql import functions as F

import corpus_pipeline as cp
from bucketwise.llm import pii
from bucketwise.llm.common import materialize
from tests.llm.test_near_dedup import brute_kept


def test_stages(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "pii_surrogates", "mix_sources", "sentence_pieces"]
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        seen[name] = materialize(stage(spark, docs, sf_dir), "stage")
        if name != "sentence_pieces":
            assert seen[name].columns == docs.columns
        docs = seen[name]
    all_, known = spark.read.parquet(f"{sf_dir}/documents.parquet").count(), seen["language_id"].count()
    assert known > 0.97 * all_
    rows = [(r.doc_id, r.text) for r in seen["language_id"].collect()]
    kept = seen["simhash_near_dedup"].count()
    assert sorted(r.doc_id for r in seen["simhash_near_dedup"].collect()) == brute_kept(rows) and kept < known
    assert seen["pii_surrogates"].count() == kept
    assert pii.replace_pii(seen["simhash_near_dedup"], "k").where("pii_found > 0").count() > 0
    mixed = seen["mix_sources"]
    assert mixed.groupBy("doc_id").count().where("count > 3").count() == 0 and seen["sentence_pieces"].count() == mixed.count()
    assert seen["sentence_pieces"].where(~F.col("exact")).count() == 0


def test_odd_and_empty_tables(spark, tables):
    assert cp.run(spark, f"{tables}/none").count() == 0
    out = cp.run(spark, f"{tables}/odd").collect()
    assert all(r.exact and r.n_ids == len(r.ids) for r in out)


def test_texts_of_unlearned_languages_are_dropped(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cp.COLUMNS)
    foreign = {
        -1: "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem",
        -2: "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью",
        -3: "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler",
        -4: "xqzt vvkw pfjq zzxk wqpt mnbv qwrx kkjh zxcv lkjq hgfz tyqx",
    }
    more = spark.createDataFrame([(i, t, None, "a", len(t)) for i, t in foreign.items()], docs.schema)
    kept = {r.doc_id for r in cp.keep_known_languages(spark, docs.unionByName(more), sf_dir).select("doc_id").collect()}
    assert not kept & set(foreign) and len(kept) > 0.97 * docs.count()
