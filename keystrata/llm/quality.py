"""Operator 9: quality classifier whose document evidence is combined with site posteriors by empirical Bayes."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.html_extraction import STOP_WORDS
from keystrata.llm.shared import bounded_batches, fresh, stored, words_of

#: Labelled documents that the classifier is fitted on, chosen by a hash of their id.
SAMPLE_ROWS = 20_000
#: Markers are words and word beginnings of so many characters, which cover a language's inflections ...
STEM_CHARS = range(4, 9)
#: ... in so many toxic (or bad) documents at least, with so large a log odds ratio. They must also be
#: unlikely by chance: a likelihood ratio of e^8 against the base rate.
MARKER_DOCS, MARKER_LOG_ODDS, MARKER_LOG_RATIO = 3, 2.0, 8.0
#: Strength of the ridge penalty on standardised weights.
RIDGE = 1.0
#: Documents are accepted from this posterior on.
ACCEPT = 0.5
#: Bounds of a prior's weight in documents.
PRIOR_DOCS = (1.0, 10_000.0)

_STOPS = frozenset(w.encode() for w in STOP_WORDS)
_SYMBOLS = np.array([chr(b) in "#$%&*+<=>@[\\]^_`{|}~/" for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
FEATURES = ("log_words", "upper", "symbols", "exclaimed", "bars", "digits", "stop_words", "top_word", "repeats", "repeated_lines", "word_bytes", "markers", "marked")


def terms_of(word: bytes) -> list[bytes]:
    """A word and its beginnings, which end in "*"."""
    letters = word.decode()
    return [word, *(letters[:k].encode() + b"*" for k in STEM_CHARS if k <= len(letters))]


class Markers:
    """Log odds by marker. Words whose first bytes no marker has are passed over without building their terms."""

    def __init__(self, terms: dict[bytes, float]):
        self.terms = terms
        self.heads = {t[:4] for t in terms}

    def of(self, words) -> float:
        """Sum over distinct words of the log odds of their strongest marker, or 0."""
        heads, get = self.heads, self.terms.get
        return sum(max(get(t, 0.0) for t in terms_of(w)) for w in words if w[:4] in heads)


def features_of(text: str | None, markers: Markers) -> list[float]:
    """Of a whole text: shares of kinds of characters and words, repetition, and markers."""
    raw = (text or "").encode()
    words = words_of(text)
    n, size = max(len(words), 1), max(len(raw), 1)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper = int(bytes_[_UPPER].sum())
    counts = Counter(words)
    lines = [line for line in (text or "").split("\n") if line.strip()]
    found = markers.of(counts)
    return [
        float(np.log1p(len(words))),
        upper / max(upper + int(bytes_[_LOWER].sum()), 1),
        int(bytes_[_SYMBOLS].sum()) / size,
        int(bytes_[33]) / n,
        int(bytes_[124]) / n,
        int(bytes_[_DIGIT].sum()) / size,
        sum(counts[w] for w in counts.keys() & _STOPS) / n,
        max(counts.values(), default=0) / n if n >= 10 else 0.0,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(map(len, words)) / n,
        min(found, 20.0),
        float(found > 0),
    ]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the intercept comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([RIDGE] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _marker_odds(k: Column, n: Column, bad: int, docs: int) -> Column:
    """Smoothed log odds ratio of a term in k bad ones of n documents; null for no marker."""
    odds = F.log((k + 0.5) / (bad + 1.0)) - F.log((n - k + 0.5) / (docs - bad + 1.0))
    rate, base = k / n, bad / docs
    chance = k * F.log(rate / base) + F.when(n > k, (n - k) * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    return F.when((k >= MARKER_DOCS) & (odds >= MARKER_LOG_ODDS), F.when((rate > base) & (chance >= MARKER_LOG_RATIO), odds))


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """Fit on at most sample_rows labelled documents; None where fewer than two classes are labelled.

    A document is good if its quality is 1 and it isn't toxic (null: not toxic). Markers are words
    and word beginnings with a large smoothed log odds ratio for toxic or for bad documents that
    chance doesn't explain, counted by an aggregation over the sample. Weights of the logistic regression are small enough to send in the task closure.
    """
    good = F.min(((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int"))
    toxic = F.max((F.coalesce(F.col("toxic"), F.lit(0)) != 0).cast("int"))
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(good.alias("good"), toxic.alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("id"), "good", "toxic")
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = stored(sample, "quality-sample")
    docs_, bads, toxics = sample.agg(F.count(F.lit(1)), F.sum(1 - F.col("good")), F.sum("toxic")).first()
    if not docs_ or bads in (0, docs_):
        return None

    @F.arrow_udf("array<string>")
    def distinct_terms(texts: pa.Array) -> pa.Array:
        return pa.array([[t.decode() for t in {t for w in set(words_of(text)) for t in terms_of(w)}] for text in texts.to_pylist()], pa.list_(pa.string()))

    terms = sample.select("good", "toxic", F.explode(distinct_terms("text")).alias("term")).groupBy("term")
    counted = terms.agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("good")).alias("bad"), F.sum("toxic").alias("toxic"))
    odds = F.greatest(*[_marker_odds(F.col(name), F.col("n"), total, docs_) for name, total in (("bad", bads), ("toxic", toxics)) if total])
    strong = {r["term"].encode(): r["odds"] for r in counted.select("term", odds.alias("odds")).filter("odds > 0").collect()}
    markers = Markers({t: o for t, o in strong.items() if t[-1:] == b"*" or all(o > strong.get(stem, 0.0) for stem in terms_of(t)[1:])})
    rows = sample.select("good", _evidence_udf(markers, None)("text").alias("x")).toPandas()  # at most sample_rows rows
    x, y = np.array(rows["x"].tolist()), rows["good"].to_numpy(float)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    return {"markers": markers, "mean": mean, "scale": scale, "weights": _logistic((x - mean) / scale, y)}


def _evidence_udf(markers: Markers, model: dict | None):
    """Features of a text, or with a model the log odds of its being good."""

    @F.arrow_udf("array<double>" if model is None else "double")
    def evidence(texts: pa.Array) -> pa.Array:
        x = [features_of(t, markers) for t in texts.to_pylist()]
        if model is None:
            return pa.array(x, pa.list_(pa.float64()))
        z = (np.array(x).reshape(-1, len(FEATURES)) - model["mean"]) / model["scale"]
        return pa.array(np.clip(z @ model["weights"][:-1] + model["weights"][-1], -30, 30))

    return evidence


def _shrunk(sites: DataFrame, prior: Column, prior_docs: float) -> Column:
    """Posterior mean of a site's share of good documents, with a prior worth prior_docs documents."""
    return (prior * prior_docs + F.col("good")) / (F.lit(prior_docs) + F.col("n"))


def _prior_docs(sites: DataFrame, prior: Column) -> float:
    """Weight of a prior by the method of moments: how much sites differ beyond chance."""
    total = F.sum("n")
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - prior, 2)) / total
    chance = F.sum(prior * (1 - prior)) / total
    scale = F.sum(F.col("n") * prior * (1 - prior)) / total
    got = sites.agg(spread.alias("spread"), chance.alias("chance"), scale.alias("scale")).first()
    if not got["scale"]:
        return PRIOR_DOCS[1]
    excess = min(max((got["spread"] - got["chance"]) / got["scale"], 1e-9), 1.0)
    return min(max((1 - excess) / excess, PRIOR_DOCS[0]), PRIOR_DOCS[1])


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of docs and ``evidence``, ``site_prior``, ``quality_score``, ``accepted`` (renamed where taken).

    evidence is the classifier's log odds for a whole text. Sites have two levels, host and path
    within the host. Their shares of good documents are grouped sums of the classifier's
    probabilities over all documents; a host shrinks toward the global share and a path toward its
    host, each as strongly as the method of moments says that sites differ. quality_score replaces
    the global prior in the document's odds by that of its path, and accepted means a score of ACCEPT
    or more.

    Texts are read by the classifier once: rows are written with their evidence, from which sites are
    summed. Grouped sums are combined before the shuffle, so a hot site costs one row per task. Sites are
    joined back by key: Spark broadcasts them only if their measured size is small, else it sorts
    and splits skewed sides.

    Null text: empty. Null host or path: a site of its own. Repeated rows: each counted and
    scored. No labels of two classes: evidence 0, all accepted. Empty table: no rows.
    """
    bounded_batches(docs.sparkSession)
    model = fit_classifier(docs, labels, id_col, text_col, sample_rows)
    evidence, prior, score, accepted, host, path = fresh(docs, "evidence", "site_prior", "quality_score", "accepted", "site_host", "site_path")
    if model is None:
        return docs.withColumns({evidence: F.lit(0.0), prior: F.lit(0.5), score: F.lit(0.5), accepted: F.lit(True)})
    judged = stored(docs.withColumn(evidence, _evidence_udf(model["markers"], model)(F.col(text_col))), "quality-evidence")
    chance = 1 / (1 + F.exp(-F.col(evidence)))
    paths = stored(judged.groupBy(F.col(host_col).alias(host), F.col(path_col).alias(path)).agg(F.sum(chance).alias("good"), F.count(F.lit(1)).alias("n")), "quality-paths")
    got = paths.agg(F.sum("good") / F.sum("n")).first()[0]
    overall = F.lit(min(max(0.5 if got is None else got, 1e-6), 1 - 1e-6))
    hosts = paths.groupBy(host).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    hosts = hosts.select(F.col(host).alias("key"), _shrunk(hosts, overall, _prior_docs(hosts, overall)).alias("of_host"))
    paths = stored(paths.join(hosts, paths[host].eqNullSafe(hosts["key"])).drop("key"), "quality-sites")
    sites = paths.select(host, path, _shrunk(paths, F.col("of_host"), _prior_docs(paths, F.col("of_host"))).alias(prior))
    joined = judged.join(sites, judged[host_col].eqNullSafe(sites[host]) & judged[path_col].eqNullSafe(sites[path]), "left").drop(host, path)
    odds = lambda p: F.log(p / (1 - p))
    kept_in = F.least(F.greatest(F.col(prior), F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = joined.withColumn(score, 1 / (1 + F.exp(-(F.col(evidence) + odds(kept_in) - odds(overall)))))
    return joined.withColumn(accepted, F.col(score) >= ACCEPT)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; its source is the host and its language the path level."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    found = classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "source", "lang", *[F.round(c, 9).alias(c) for c in ("evidence", "site_prior", "quality_score")], "accepted")
