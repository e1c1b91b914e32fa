import numpy as np
import pytest
from pyspark.sql import functions as F

from bucketwise.llm import url_filter as uf

URLS = [
    ("https://WWW.Example.org/en/1x?b=2&utm_source=f&a=1#t", "www.example.org", "/en/1x", "example.org/en/1", "block"),
    ("http://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
    ("http://a.example.org", "a.example.org", "", None, "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("x://com/de/?q", "com", "/de/", "com/de/", "block"),
    ("http://a.com/fr/x://b.org/y", "a.com", "/fr/x://b.org/y", "com/fr/", "allow"),
    ("ftp://listed.net/page/", "listed.net", "/page/", None, "block"),
    ("https://www.listed.net:443/page?ref=z", "www.listed.net:443", "/page", None, "block"),
    ("https://listed.net/page?id=3", "listed.net", "/page", None, "allow"),
    ("://", "", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, (u, *_) in enumerate(URLS * 2)], "page_id long, url string, h string")
    listed = spark.createDataFrame([("http://listed.net/page",), ("HTTP://LISTED.net/page/",), (None,), ("",), ("nothing",)], "u string")
    out = uf.filter_urls(pages, listed).orderBy("page_id").collect()
    assert [(r.url, r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in out] == URLS * 2
    assert uf.filter_urls(pages.limit(0), listed).count() == 0
    assert uf.filter_urls(pages, listed.limit(0)).where("url_verdict = 'block' and url_rule is null").count() == 0


def test_canonical_form(spark):
    df = spark.createDataFrame([("http://www.A.org/x/?z=1&utm_id=5&a=2#f",), ("https://a.org:80/x?a=2&z=1",)], "u string")
    assert {r[0] for r in df.select(uf.canonical_url(F.col("u"))).collect()} == {"a.org/x?a=2&z=1"}


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_filter(spark, n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
    bloom = uf.BlockedBloom.build(spark.createDataFrame([(int(k),) for k in keys], "h long"))
    assert bloom.may_contain(keys).all()
    assert bloom.may_contain(rng.integers(-(2**63), 2**63 - 1, 50_000, dtype=np.int64)).mean() < 0.01
    assert np.array_equal(bloom.words, uf.BlockedBloom.fill(keys, bloom.blocks, 0, bloom.blocks))


def test_size_is_bounded():
    assert uf.BlockedBloom.blocks_for(10**12) == uf.MAX_BLOCKS and uf.MAX_BLOCKS * uf.BLOCK_BITS // 8 == 32 << 20
