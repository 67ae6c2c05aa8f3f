"""Operator 3 against all pairs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_texts import prose

from keystrata.llm import near_dedup as N
from keystrata.llm.components import connected_components
from keystrata.llm.shared import words_of


def _edited(text, seed, share):
    dice = random.Random(seed)
    return " ".join(prose(seed * 1000 + i, 1) if dice.random() < share else w for i, w in enumerate(text.split()))


def _brute(texts: dict[int, str], least=None) -> dict[int, int]:
    """Class of each document by weighted Jaccard similarity of all pairs; strings, counters and floats only."""
    counts = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        size = min(5, len(words))
        counts[i] = Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else Counter()
    df, n = Counter(x for c in counts.values() for x in c), len(texts)
    least = max(N.FREQUENT, 4 * sum(map(len, counts.values())) / n / N.FEATURES)
    vectors = {i: {x: (1 + math.log(k)) * (1 + math.log(df[x] / n) / math.log(least) if df[x] >= least * n else 2) for x, k in c.items()} for i, c in counts.items() if c}
    total = {i: sum(v.values()) for i, v in vectors.items()}
    root = {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(vectors)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = sum(min(w, vectors[b][x]) for x, w in vectors[a].items() if x in vectors[b])
            if shared / (total[a] + total[b] - shared) >= N.SIMILARITY:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in texts}


@pytest.fixture(scope="module")
def groups():
    base, passage = prose(1, 200), prose(2, 60)
    texts = [prose(100 + i, 150) for i in range(20)]
    texts += [_edited(base, i, 0.01) for i in range(60)]  # a large group of near copies
    texts += [_edited(prose(3, 150), i, 0.035) for i in range(60)]  # one whose members hang together by chains
    texts += [prose(300 + i, 50) + " " + passage + " " + prose(400 + i, 20) for i in range(60)]  # a shared passage only
    texts += [base, base, base.upper(), "one two", "One, two!", "one two three", "", None, "..."]
    order = list(range(len(texts)))
    random.Random(4).shuffle(order)
    return {i: texts[k] for i, k in enumerate(order)}


@pytest.mark.parametrize("small, block, size, hot", [(N.SMALL, N.BLOCK_ROWS, N.BLOCK_BYTES, 2), (2, 16, 1 << 14, 1 << 16), (4, 1000, 1 << 30, 1 << 16)])
def test_against_brute_force(spark, groups, monkeypatch, small, block, size, hot):
    for name, value in (("SMALL", small), ("BLOCK_ROWS", block), ("BLOCK_BYTES", size), ("HOT_BUCKETS", hot), ("HOT_ROWS", 8)):
        monkeypatch.setattr(N, name, value)
    docs = spark.createDataFrame(list(groups.items()), "doc_id bigint, text string")
    got = {r.id: r.class_id for r in N.near_duplicate_classes(docs).collect()}
    assert got == _brute(groups)


def test_odd_documents(odd_docs, no_docs):
    got = [(r.id, r.class_id) for r in N.near_duplicate_classes(odd_docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 3), (4, 3), (None, None), (None, None), (7, 7), (8, 8)], key=str)
    kept = N.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id = 4").count() == 0 and kept.count() == 7
    assert N.near_duplicate_classes(no_docs).count() == 0


def test_each_text_of_an_id_is_judged(spark):
    a, b, c = prose(1, 50), prose(2, 50), prose(3, 50)
    rows = [(3, c), (5, "aaa " + a), (5, c), (6, b), (6, b), (7, None), (7, b), (8, a), (9, a), (9, None), (None, c)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, class_id string")
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = [(3, c), (5, "aaa " + a), (6, b), (6, b), (7, None), (9, None), (None, c)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert sorted((str(r.doc_id), str(r.class_id_)) for r in N.near_duplicate_rows(docs).collect()) == sorted(
        [("3", "3"), ("5", "5"), ("5", "3"), ("6", "6"), ("6", "6"), ("7", "7"), ("7", "6"), ("8", "5"), ("9", "5"), ("9", "9"), ("None", "None")]
    )


def test_frequencies_are_exact(spark, groups):
    docs = spark.createDataFrame(list(groups.items()), "id bigint, text string").repartition(3)
    got = N.document_frequencies(docs)
    counts = Counter(x for t in groups.values() for x in N.shingles_of(words_of(t))[0].tolist())
    least = max(N.FREQUENT, 4 * sum(counts.values()) / len(groups) / N.FEATURES)
    want = {x: 1 + math.log(k / len(groups)) / math.log(least) for x, k in counts.items() if k >= least * len(groups)}
    assert set(got.shingles.tolist()) == set(want)
    assert np.allclose(got.of(np.array(sorted(want), np.uint64)), [want[x] for x in sorted(want)])
    assert got.of(np.array([1, 2], np.uint64)).tolist() == [2, 2]


def test_samples_estimate_the_similarity():
    a, b = N.shingles_of(words_of(prose(1, 400))), N.shingles_of(words_of(_edited(prose(1, 400), 5, 0.02)))
    idf = N.Frequencies(np.empty(0, np.uint64), np.empty(0), 0.001)
    vectors = [(s, N.weights_of(s, c, idf)) for s, c in (a, b)]
    x = N.samples_of([v[0] for v in vectors], [v[1] for v in vectors])
    assert abs((x[0] == x[1]).mean() - N.similarity(*vectors)) < 0.2


def test_shingles(monkeypatch):
    words = prose(5, 3000).encode().split()
    whole = N._run_hashes(words)
    assert len(whole) == 2996 and len(set(whole.tolist())) == len({tuple(words[i : i + 5]) for i in range(2996)})
    assert N._run_hashes(words[17:30]).tolist() == whole[17:26].tolist()
    monkeypatch.setattr(N, "_PIECE", 100)
    assert N._run_hashes(words).tolist() == whole.tolist()
    assert len(N.shingles_of([b"a", b"b"])[0]) == 1 and len(N.shingles_of([])[0]) == 0
    assert N.shingles_of([b"ab", b"c"])[0] != N.shingles_of([b"a", b"bc"])[0]


def test_components(spark):
    dice = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(dice.randint(0, 60), dice.randint(0, 60)) for _ in range(25)] + [(500, 500), (None, 3)]
    root = {x: x for e in edges for x in e if None not in e}
    for _ in root:
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.id: r.component for r in got.collect()} == root
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
