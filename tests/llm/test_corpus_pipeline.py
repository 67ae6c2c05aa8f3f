"""The corpus pipeline, stage by stage."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_decontamination import _brute as brute_contamination
from test_near_dedup import _brute as brute_classes
from test_secrets import _base as brute_base
from test_secrets import _markov as brute_markov
from tokenizers import Tokenizer

from keystrata.llm.decontamination import find_contamination
from keystrata.llm.near_dedup import near_duplicate_classes
from keystrata.llm.secret_scan import labelled_samples, log_ratios


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept["quality"] for i in clean) > 0.97 * len(clean)
    assert not any(i in kept["quality"] for i, r in labels.items() if r.quality == 0)
    left = spark.createDataFrame(list(kept["near_dedup"].items()), "doc_id bigint, text string")
    assert near_duplicate_classes(left).filter("id <> class_id").count() == 0
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = {r.doc_id for r in find_contamination(left, bench).filter(F.col("contamination.contaminated")).collect()}
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - bad
    assert set(kept["secrets"]) == set(kept["decontamination"])
    assert all(kept["decontamination"][i] == t or "[SECRET]" in t for i, t in kept["secrets"].items())


def test_run(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    parts = defaultdict(int)
    for p in pieces:
        parts[p.doc_id, p.doc_tokens] += p.length
    assert pieces and all(n == total for (_, total), n in parts.items())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]


def test_odd_documents(spark, sf_dir, odd_docs, no_docs):
    """What each stage does with nulls, empty, long and repeated texts, and that it adds no column."""
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(((str(r.doc_id), r.text) for r in df.collect()), key=str)
    every = ids(odd_docs)
    for name in ("quality", "near_dedup", "decontamination", "secrets"):
        got = stages[name](spark, odd_docs, sf_dir)
        assert got.columns == odd_docs.columns and stages[name](spark, no_docs, sf_dir).count() == 0
        if name == "quality":
            assert set(ids(got)) <= set(every)
        elif name == "near_dedup":
            assert ids(got) == [x for x in every if x[0] != "4"]  # copies of 3
        else:
            assert ids(got) == every
    pieces = stages["packing"](spark, odd_docs, sf_dir).collect()
    whole = defaultdict(int)
    for p in pieces:
        whole[str(p.doc_id)] += p.length
    assert set(whole) == {x for x, _ in every} and whole["2"] == 1 and whole["4"] == 2 * whole["3"]
    assert stages["packing"](spark, no_docs, sf_dir).count() == 0
    assert stages["quality"](spark, odd_docs, sf_dir).filter("doc_id = 4").count() in (0, 2)


def _whole_pipeline(rows, kept_quality, benchmark, ratios):
    """Rows that stay and their texts, by plain Python; what the classifier keeps is given and tested with it."""
    rows = [r for r in rows if r["doc_id"] in kept_quality]
    of_class = brute_classes({r["doc_id"]: r["text"] for r in rows})
    rows = [r for r in rows if of_class[r["doc_id"]] == r["doc_id"]]
    out = {}
    for r in rows:
        n, hit, _ = brute_contamination(r["text"], benchmark)
        if not (hit and 20 * hit >= n):
            base = brute_base(r["text"])
            text, at = "", 0
            for start, _, end in sorted(base + brute_markov(r["text"] or "", ratios, base)):
                if start >= at:
                    text += r["text"][at:start] + "[SECRET]"
                at = max(at, end)
            out[r["doc_id"]] = text + (r["text"] or "")[at:]
    return out


def test_run_against_brute_force(spark, sf_dir):
    """The whole pipeline against plain Python, stage after stage, down to every token."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()}
    prose = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ratios = log_ratios(labelled_samples(spark, prose))
    want = _whole_pipeline([r.asDict() for r in docs.collect()], kept, [tuple(r) for r in prose.select("item_id", "text").collect()], ratios)
    parts = defaultdict(dict)
    for p in corpus_pipeline.run(spark, sf_dir).collect():
        parts[p.doc_id][p.start] = bytes(p.ids)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(parts) == set(want)
    for i, text in want.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert b"".join(x for _, x in sorted(parts[i].items())) == np.array(ids, "<u4").tobytes()
