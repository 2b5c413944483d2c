import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstat.llm import url_filter as uf
from rillstat.llm.queries import RULES

PAGES = "page_id BIGINT, url STRING, html STRING"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:stop])
    tail = rest[stop:]
    return host, tail[:min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]


def address(url):
    host, path = parts(url)
    host = host.removeprefix("www.")
    for end in (".html", ".htm"):
        if path.endswith(end):
            path = path.removesuffix(end)
            break
    return host + path.rstrip("/")


def plain(url, listed):
    host, path = parts(url)
    fits = [rule for rule in RULES if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)]
    rule = max(fits, key=lambda rule: len(rule.text), default=None)
    known = address(url) in listed and address(url) != ""
    return host, path, rule.text if rule else None, rule.verdict if rule else "block" if known else "allow", known


URLS = [
    None, "", "no scheme", "http://", "://x.org/a", "http://EXAMPLE.org/es/x", "https://a.example.org/en/12?q#f", "http://example.org/en/2", "http://org/x", "http://xorg/x",
    "http://a.com/fr/", "http://a.com/fr", "http://a.com/de/1.html", "http://a.net/x/", "http://www.a.net/x", "http://a.net/x.html?y=1", "http://a.net/X", "ftp://É.net/é", "http://a.net?x=/de/",
    "http://example.org", "http://b://c.org/x", "http://a.net/x//", "http://user:pw@a.net:80/x",
]


def test_every_kind_of_url(spark):
    pages = spark.createDataFrame([(i, url, None) for i, url in enumerate([*URLS, *URLS])], PAGES).withColumns({"host": F.lit("x"), "verdict": F.lit(1), "address": F.lit(2)})
    listed = spark.createDataFrame([("http://a.net/x",), ("http://a.net/x",), (None,), ("",), ("http://É.net/é",)], "url STRING")
    addresses = {address("http://a.net/x"), address("http://É.net/é")}
    for row in uf.judged(pages, listed, RULES).collect():
        found = (row["host"], row["path"], row["rule"], row["verdict"], row["listed"])
        assert found == plain(URLS[row["page_id"] % len(URLS)], addresses)


def test_the_filter_has_no_false_negatives_and_the_join_no_false_positives(spark, monkeypatch):
    r = random.Random(1)
    listed = [f"http://h{r.randrange(10**9)}.net/p{i}" for i in range(2000)]
    pages = listed[:1000] + [f"http://g{i}.net/q" for i in range(3000)]
    table = spark.createDataFrame([(i, url, None) for i, url in enumerate(pages)], PAGES)
    urls = spark.createDataFrame([(url,) for url in listed], "url STRING")
    for blocks in (1 << 19, 2):  # a filter that is much too small lets more through, not less
        monkeypatch.setattr(uf, "MOST_BLOCKS", blocks)
        rows = uf.judged(table, urls, ()).collect()
        assert len(rows) == 4000
        assert all((row["verdict"] == "block") == (row["page_id"] < 1000) for row in rows)


def test_how_sharp_the_filter_is(spark):
    bloom = uf.blocked_bloom(spark.range(20_000).select(F.xxhash64("id").alias("hash")), 20_000)
    assert bloom.shape[1] * 64 == uf.BLOCK_BITS
    other = spark.range(100_000, 140_000).select(F.xxhash64("id").alias("hash"))
    inside = spark.range(20_000).select(F.xxhash64("id").alias("hash"))
    assert inside.filter(uf.may_be_listed(bloom, "hash")).count() == 20_000
    assert other.filter(uf.may_be_listed(bloom, "hash")).count() < 0.03 * 40_000
    assert np.unpackbits(bloom.view(np.uint8)).mean() < 0.6


@pytest.mark.parametrize(("pages", "urls", "count"), [([], ["http://a.net/x"], 0), (["http://a.net/x"], [], 1)])
def test_empty_tables(spark, pages, urls, count):
    table = spark.createDataFrame([(i, url, None) for i, url in enumerate(pages)], PAGES)
    listed = spark.createDataFrame([(url,) for url in urls], "url STRING")
    rows = uf.judged(table, listed, RULES).collect()
    assert len(rows) == count and all(row["verdict"] == "allow" for row in rows)
