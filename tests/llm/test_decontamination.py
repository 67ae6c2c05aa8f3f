"""Operator 2 against word-by-word search, and its SQL."""

from __future__ import annotations

import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import prose

from keystrata.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(lowered)


def _brute(text, items, size=D.WINDOW):
    words, hit, found = _words(text), set(), set()
    for item_id, item in items:
        own = _words(item)
        n = min(size, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else ()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item_id)
    return len(words), len(hit), sorted(found - {None})


def test_against_brute_force(spark, odd_docs, no_docs, monkeypatch):
    items = [(1, prose(11, 40)), (2, prose(12, 5)), (3, "One-word"), (4, None), (5, "..."), (None, prose(13, 20)), (1, prose(11, 40)), (6, prose(11, 40))]
    texts = [prose(20, 100) + " " + prose(11, 40).upper() + "! " + prose(21, 30), prose(12, 5), "x " + prose(12, 5) + " y", "one--WORD ", prose(13, 20), prose(11, 12), prose(11, 13)[:-1], "é" + prose(11, 40), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(odd_docs.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (D.AUTOMATON_BYTES, 60):
        monkeypatch.setattr(D, "AUTOMATON_BYTES", limit)
        for r in D.find_contamination(docs, bench).collect():
            n, hit, found = _brute(r.text, items)
            c = r.contamination
            assert (c.n_words, c.n_hit, c.items) == (n, hit, found)
            assert c.contaminated == (hit > 0 and 20 * hit >= n)
            assert sum(len(_words(r.text[s.start : s.end])) for s in c.spans) == hit
    assert D.find_contamination(no_docs, bench).count() == 0
    assert "contamination_" in D.find_contamination(odd_docs, bench.limit(0)).columns


_few_words = st.lists(st.sampled_from(["a", "b", "c"]), max_size=40).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(_few_words, max_size=4), _few_words, st.integers(1, 14))
def test_machine_against_brute_force(items, text, window):
    items = list(enumerate(items))
    (got,) = D._scan([text], [None], D.ItemMachine(items, window))
    assert (got["n_words"], got["n_hit"], got["items"]) == _brute(text, items, window)


def test_one_node_for_each_item_word():
    items = [(i, prose(i, 400)) for i in range(200)]
    machine = D.ItemMachine(items, D.WINDOW).machine
    assert machine.get_stats()["nodes_count"] <= 80_001


def test_sql(spark, sf_dir):
    got = {r.doc_id: tuple(r) for r in D.op2_decontamination(spark, sf_dir).collect()}
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = {r[0]: r for r in duck.sql(D.OP2_SQL).fetchall()}
    assert got == want and any(r[-1] for r in want.values())
