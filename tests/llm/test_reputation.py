"""URL parts, rules and shrinkage on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from phonolake.llm.reputation import filter_urls, host_reputation, lower_bound


def test_parts_and_rules(spark):
    urls = [
        ("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("x://notexample.org/en/1", "notexample.org", "/en/1", "org/", "allow"),
        ("http://org", "org", "", None, "allow"),
        ("http://m.b.com/de/?://", "m.b.com", "/de/", "com/de/", "block"),
        ("http://b.com/fr/\nline", "b.com", "/fr/\nline", "com/fr/", "allow"),
        ("http://b.com?u=http://c.org/", "b.com", "", None, "allow"),
        ("b.com/de/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u[0], "x", 1) for k, u in enumerate(urls)] + [(None, "http://q.de/", "x", 1)] * 2, "page_id long, url string, host string, n int")
    labels = spark.createDataFrame([(None, 0), (3, None), (7, 1)], "doc_id long, quality int")
    got = {r.page_id: r for r in filter_urls(pages, labels).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict)
    assert filter_urls(pages, labels).count() == len(urls) + 2
    assert filter_urls(pages.limit(0), labels).count() == 0
    assert filter_urls(pages, labels.limit(0)).count() == len(urls) + 2


def test_shrinkage(spark):
    rows = [("bad.a.net", 200.0, 150.0), ("few.a.net", 2.0, 2.0), ("good.a.net", 500.0, 10.0), ("new.a.net", 0.0, 0.0)]
    rows += [(f"h{k}.b{k}.net", 50.0, 5.0) for k in range(20)] + [("one.z.org", 1.0, 1.0)]
    got = host_reputation(spark.createDataFrame(rows, "host string, n double, bad double"))
    got = {r.host: r for r in got.withColumn("low", lower_bound(F.col("alpha"), F.col("beta"))).collect()}
    rate = {h: r.alpha / (r.alpha + r.beta) for h, r in got.items()}
    assert len(got) == len(rows)
    assert got["bad.a.net"].low > 0.5 and got["good.a.net"].low < 0.05
    assert rate["good.a.net"] < rate["new.a.net"] < rate["few.a.net"] < 1 and got["few.a.net"].low < got["bad.a.net"].low
    assert rate["one.z.org"] < 0.8
    assert rate["h1.b1.net"] == pytest.approx(0.1, abs=0.03)
