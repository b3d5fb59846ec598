import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.llm import url_filter
from spikeloom.llm.components import components
from spikeloom.llm.queries import URL_RULES

URLS = ["http://a.com/x", "https://EXAMPLE.com/en/1?q", "http://www.example.com/en/", "http://b.www.example.com/en/z#t", "http://shop.net/es/1", "http://net/fr/", "http://net/fr", None, "no scheme", "http://",
        "http://xcom/", "mailto:a", "http://example.com", "http://notexample.com/en/", "ftp://u.example.org/a?b", "http://a.com/x"]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("limit", [100, 0])
def test_rules(spark, limit):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(0, URLS[0], "c", "c")], "page_id bigint, url string, rule string, host string")
    rules = spark.createDataFrame([*URL_RULES, URL_RULES[0], (None, "/", "block"), ("x", None, "block")], "host string, path string, verdict string")
    rows = url_filter.filter_urls(pages, rules, broadcast_rules=limit).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"], URL_RULES)
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(URLS) + 1
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_bloom_has_no_false_negatives(spark):
    words = url_filter.build_bloom(spark.range(5000).select(F.xxhash64("id").alias("h")), 64)
    h = np.array([r[0] for r in spark.range(5000).select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    mask = url_filter.bloom_bits(h)
    assert ((words[url_filter.block_of(h, 64)] & mask) == mask).all()


def test_components(spark):
    rng = np.random.default_rng(2)
    links = rng.integers(0, 300, (200, 2)).tolist() + [[i, i + 1] for i in range(1000, 1040)] + [[5000, 5000 + i] for i in range(50)] + [[7, 7]]
    root = {x: x for l in links for x in l}
    for a, b in links:
        p, q = root[a], root[b]
        root = {k: min(p, q) if v in (p, q) else v for k, v in root.items()}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in l and l[0] != l[1] for l in links)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hosts_of_very_many_labels(spark):
    long = "a." * 20_000 + "example.com"
    pages = spark.createDataFrame([(1, f"http://{long}/en/x"), (2, "http://com/"), (3, "http://.com/"), (4, "http://www.example.com./")], "page_id bigint, url string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block")], "host string, path string, verdict string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
    assert found == {1: ("example.com/en/", "block"), 2: ("com/", "allow"), 3: ("com/", "allow"), 4: (None, "allow")}
