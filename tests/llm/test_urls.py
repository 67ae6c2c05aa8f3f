"""Operator 4 against a direct reading of the rules, and its cascade."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from keystrata.llm import url_filter as U


def _judge(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = ""
    for c in rest:
        if c in "/?#":
            break
        host += c
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(k, v) for k, v in U.RULES if (host == k.partition("/")[0] or host.endswith("." + k.partition("/")[0])) and path.startswith("/" + k.partition("/")[2])]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    listed = any(host == h or host.endswith("." + h) for h in U.LISTED_HOSTS)
    return host, path, rule, verdict or ("block" if listed else "allow")


URLS = [
    None, "", "no scheme", "://", "http://", "http://A.NET", "http://a.net/", "http://net/", "http://xnet/", "http://example.NET/en/1", "http://www.example.net/en/", "http://www.example.net/en",
    "http://example.net/EN/", "http://example.com/de/x?y://z.net/", "http://myexample.com/de/", "https://a.b.c.org/fr/", "https://org/fr/#top", "ftp://x.spam-farm.example.org", "http://spam-farm.example.org/fr/x",
    "http://notspam-farm.example.org/", "http://É.net/é", "http://a..net/", "http://a.net./", "http://u:p@a.net:80/", "http://a.net?x", "http://a.net#x/", "x://y://z.net/", "http://a\nb.net/", "http://casino-win.example.com",
]


def _spark_rules(spark):
    return spark.createDataFrame(list(U.RULES), "key string, verdict string"), spark.createDataFrame([(h,) for h in U.LISTED_HOSTS], "key string")


def test_against_direct_reading(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS[:3]])], "page_id bigint, url string, Rule string, host string")
    for bits in (U.CASCADE_BITS, 100):  # the second takes several cascades
        monkeypatch.setattr(U, "CASCADE_BITS", bits)
        got = U.judge_urls(pages, *_spark_rules(spark)).select("url", "host_", "path", "rule_", "verdict").collect()
        assert len(got) == len(URLS) + 3
        for r in got:
            assert tuple(r)[1:] == _judge(r.url)


def test_empty(spark):
    pages = spark.createDataFrame([("http://a.net/",)], "url string")
    rules, hosts = _spark_rules(spark)
    assert U.judge_urls(pages.limit(0), rules, hosts).count() == 0
    row = U.judge_urls(pages, rules.limit(0), hosts.limit(0)).first()
    assert (row.rule, row.verdict) == (None, "allow")


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20000).select(F.concat(F.lit("host"), F.col("id").cast("string")).alias("key"))
    listed = keys.filter(F.xxhash64("key") % 20 == 0)
    levels = U.build_cascade(listed, keys)
    assert len(levels) > 1
    want = {r.key for r in listed.collect()}
    assert {r.key for r in keys.collect() if U.is_listed(levels, r.key)} == want


def test_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = {r[0]: r for r in duck.sql(U.OP4_SQL).fetchall()}
    assert {r.page_id: tuple(r) for r in U.op4_url_filter(spark, sf_dir).collect()} == want
