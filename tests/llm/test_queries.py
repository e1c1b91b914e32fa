"""Every query: over the test data, an empty table, and against its SQL."""

import os

import pytest
from pyspark.sql import functions as F

from bucketwise.llm import byte_pairs, common, language_id, mixing, near_dedup, pii, registry, sentence_pieces, url_filter
from tests.oracle import same

VECTOR_QUERIES = ["op11_hard_negatives", "op13_vector_codes"]
DOCUMENT_QUERIES = sorted(n for n in registry.QUERIES if n not in ("op10_filter_urls", *VECTOR_QUERIES))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    same(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_mixing_matches_sql_on_odd_rows(spark, tables):
    same(spark, f"{tables}/odd", registry.QUERIES["op8_mix_sources"], registry.ORACLE_SQL["op8_mix_sources"])


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_table(spark, tables, name):
    out = registry.QUERIES[name](spark, f"{tables}/none")
    assert out.count() == 0 and "doc_id" in out.columns


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_one_row_per_row(spark, tables, name):
    rows = spark.read.parquet(f"{tables}/odd/documents.parquet").count()
    assert registry.QUERIES[name](spark, f"{tables}/odd").count() == rows


def test_negatives_match_sql_on_odd_rows(spark, tables):
    same(spark, f"{tables}/odd", registry.QUERIES["op11_hard_negatives"], registry.ORACLE_SQL["op11_hard_negatives"])


def test_codes_match_sql_on_odd_rows(spark, tables):
    query, sql = registry.QUERIES["op13_vector_codes"], registry.ORACLE_SQL["op13_vector_codes"]
    named = "SELECT * REPLACE (coalesce(vec_id, -1) AS vec_id) FROM"  # pandas turns integers with nulls into floats
    same(spark, f"{tables}/odd", lambda s, d: query(s, d).na.fill(-1, ["vec_id"]), f"{named} ({sql})")


@pytest.mark.parametrize("name", VECTOR_QUERIES)
def test_empty_vectors(spark, tables, name):
    got, whole = (registry.QUERIES[name](spark, f"{tables}/{d}") for d in ("none", "odd"))
    assert got.count() == 0 and got.dtypes == whole.dtypes


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize(
    "run, column",
    [
        (lambda d: mixing.mix_sources(d), "mix_size"),
        (lambda d: language_id.with_language(d, None), "LID_lang"),
        (lambda d: sentence_pieces.with_pieces(d), "sp_ids"),
        (lambda d: near_dedup.deduplicate(d), "near_key"),
        (lambda d: pii.replace_pii(d, "k"), "pii_raw"),
        (lambda d: byte_pairs.with_ids(d), "bpe_ids"),
        (lambda d: url_filter.filter_urls(d, d.select("text"), "text"), "url_host"),
    ],
)
def test_own_columns_are_refused(odd, run, column):
    with pytest.raises(ValueError, match=column):
        run(odd.withColumn(column, F.lit(1)))


def test_emitting_copies_keeps_other_columns(odd):
    mixed = mixing.mix_sources(odd).withColumn("mix_own", F.lit(1))
    assert mixing.emit_copies(mixed).columns == [*odd.columns, "mix_own"]


def test_temporary_tables_go(spark):
    with common.temporary() as outer:
        with common.temporary() as inner:
            kept, gone = (inner.keep(common.materialize(spark.range(3), "kept")), common.materialize(spark.range(3), "gone"))
        assert kept.count() == 3 and not os.path.exists(gone._shared_path.removeprefix("file://"))
    assert not os.path.exists(kept._shared_path.removeprefix("file://"))
