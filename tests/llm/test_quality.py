"""Operator 9: held-out accuracy, shrinkage, and odd documents."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from keystrata.llm import quality as Q
from keystrata.llm.shared import words_of


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    found = Q.classify_quality(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").select("quality", "toxic", "accepted").toPandas()
    clean = found[(found.quality == 1) & (found.toxic == 0)]
    assert clean.accepted.mean() > 0.98
    assert found[found.quality == 0].accepted.mean() < 0.05


def test_held_out_toxic_recall_by_language(spark):
    """Few Spanish documents are labelled toxic; what marks them is the beginning that their words share."""
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    found = Q.classify_quality(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").filter("quality = 1")
    rates = {(r.lang, r.toxic): r.kept for r in found.groupBy("lang", "toxic").agg(F.avg(F.col("accepted").cast("int")).alias("kept")).collect()}
    assert len(rates) == 8
    assert all(kept < 0.25 if toxic else kept > 0.98 for (_, toxic), kept in rates.items())


def test_whole_result_against_numpy(spark, sf_dir):
    """Markers, fit, evidence, site posteriors and scores, worked out anew from plain rows."""
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = {r.doc_id: (int(r.quality == 1 and not r.toxic), int(bool(r.toxic))) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    sample = [d for d in docs if d["doc_id"] in labels]
    terms = [{t for w in set(words_of(d["text"])) for t in Q.terms_of(w)} for d in sample]
    n, bad, toxic = Counter(), Counter(), Counter()
    for d, some in zip(sample, terms, strict=True):
        n.update(some)
        bad.update(some if not labels[d["doc_id"]][0] else ())
        toxic.update(some if labels[d["doc_id"]][1] else ())
    total, strong = len(sample), {}
    for marked, whole in ((bad, sum(1 - labels[d["doc_id"]][0] for d in sample)), (toxic, sum(labels[d["doc_id"]][1] for d in sample))):
        for t, k in marked.items():
            odds = math.log((k + 0.5) / (whole + 1)) - math.log((n[t] - k + 0.5) / (total - whole + 1))
            rate, base = k / n[t], whole / total
            chance = k * math.log(rate / base) + ((n[t] - k) * math.log((1 - rate) / (1 - base)) if n[t] > k else 0)
            if k >= 3 and odds >= 2 and rate > base and chance >= 8:
                strong[t] = max(strong.get(t, 0), odds)
    markers = Q.Markers({t: o for t, o in strong.items() if t[-1:] == b"*" or all(o > strong.get(x, 0) for x in Q.terms_of(t)[1:])})
    x = np.array([Q.features_of(d["text"], markers) for d in sample])
    y = np.array([labels[d["doc_id"]][0] for d in sample], float)
    scale = np.where(x.std(0) < 1e-9, 1, x.std(0))
    z = np.hstack([(x - x.mean(0)) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.array([1.0] * (len(w) - 1) + [1e-6])
    for _ in range(100):  # iteratively reweighted least squares
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        weight = p * (1 - p) + 1e-9
        w = np.linalg.solve((z.T * weight) @ z + np.diag(ridge), (z.T * weight) @ (z @ w) + z.T @ (y - p))
    every = np.array([Q.features_of(d["text"], markers) for d in docs])
    evidence = np.clip(((every - x.mean(0)) / scale) @ w[:-1] + w[-1], -30, 30)
    good = 1 / (1 + np.exp(-evidence))
    overall = good.mean()

    def prior_docs(groups, prior):
        """By the method of moments, over (n, good) and the prior of each group."""
        n, g = np.array(groups).T
        prior = np.broadcast_to(prior, n.shape)
        among = (n * prior * (1 - prior)).sum() / n.sum()
        excess = min(max(((n * (g / n - prior) ** 2).sum() / n.sum() - (prior * (1 - prior)).sum() / n.sum()) / among, 1e-9), 1)
        return min(max((1 - excess) / excess, 1), 10_000)

    def sums(key):
        out = {}
        for d, g in zip(docs, good, strict=True):
            was = out.get(key(d), (0, 0))
            out[key(d)] = (was[0] + 1, was[1] + g)
        return out

    hosts, paths = sums(lambda d: d["source"]), sums(lambda d: (d["source"], d["lang"]))
    k = prior_docs(list(hosts.values()), overall)
    of_host = {h: (overall * k + g) / (k + n) for h, (n, g) in hosts.items()}
    k = prior_docs(list(paths.values()), np.array([of_host[h] for h, _ in paths]))
    of_path = {p: (of_host[p[0]] * k + g) / (k + n) for p, (n, g) in paths.items()}
    got = {r.doc_id: r for r in Q.op9_quality_classifier(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, e in zip(docs, evidence, strict=True):
        r, prior = got[d["doc_id"]], of_path[d["source"], d["lang"]]
        score = 1 / (1 + math.exp(-(e + math.log(prior / (1 - prior)) - math.log(overall / (1 - overall)))))
        assert np.allclose([r.evidence, r.site_prior, r.quality_score], [e, prior, score], atol=1e-6)
        assert r.accepted == (score >= 0.5) or abs(score - 0.5) < 1e-6


def test_terms():
    assert Q.terms_of("réeuxvi".encode()) == ["réeuxvi".encode(), *(x.encode() for x in ("réeu*", "réeux*", "réeuxv*", "réeuxvi*"))]
    markers = Q.Markers({b"abcd*": 2.0, b"abcde": 3.0})
    assert [markers.of([w]) for w in (b"abcde", b"abcdef", b"abc", b"abcx")] == [3.0, 2.0, 0.0, 0.0] and markers.of([b"abcde", b"abcdef"]) == 5.0


def test_sites_shrink(spark):
    """A path of few documents stays near its host, one of many follows its own share."""
    paths = spark.createDataFrame([("few", 0.0, 2), ("many", 0.0, 2000)], "site string, good double, n bigint")
    got = {r.site: r.p for r in paths.select("site", Q._shrunk(paths, F.lit(0.8), 20.0).alias("p")).collect()}
    assert math.isclose(got["few"], 16 / 22) and got["many"] < 0.01
    alike = spark.createDataFrame([(80.0, 100)] * 10, "good double, n bigint")
    apart = spark.createDataFrame([(100.0, 100), (0.0, 100)], "good double, n bigint")
    assert Q._prior_docs(alike, F.lit(0.8)) == Q.PRIOR_DOCS[1] and Q._prior_docs(apart, F.lit(0.5)) == Q.PRIOR_DOCS[0]


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, None), (4, 1, 0), (7, 1, 0), (8, 0, 1), (9, None, 1), (None, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = Q.classify_quality(odd_docs, labels)
    assert got.count() == odd_docs.count() and {"evidence_", "accepted"} <= set(got.columns)
    assert all(0 < r.quality_score < 1 for r in got.collect())
    assert Q.classify_quality(no_docs, labels).count() == 0
    assert Q.classify_quality(odd_docs, labels.limit(0)).filter("accepted").count() == odd_docs.count()


def test_features_of_odd_texts():
    for text in (None, "", "...", "x", "| " * 1000, "Der " * 5000):
        assert len(Q.features_of(text, Q.Markers({b"x": 1.0}))) == len(Q.FEATURES)
