"""Operator 8 against all pairs."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from keystrata.llm import embedding_dedup as V


def _brute(rows):
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, (np.array(v, np.float64), label))
    links = {i: set() for i, _, _ in rows}
    for a, (x, l1) in ok.items():
        for b, (y, l2) in ok.items():
            if a != b and l1 == l2 and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a].add(b)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            todo += [b for b in links[todo.pop()] if b not in seen and not seen.add(b)]
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def _rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    out = [(i, (centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.2])).astype(np.float32).tolist(), int(i % 3)) for i in range(300)]
    out += [(300 + i, out[7][1], out[7][2]) for i in range(40)]  # copies
    out += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [float("inf")] + [0.0] * 15, 1), (405, [None] + [1.0] * 15, 1), (406, out[0][1], None)]
    return out + [(407, out[0][1][:8], 0), (408, [x * 1000 for x in out[0][1]], 0), (409, out[1][1][:8], 0), (410, out[0][1][:8], 0)]


@pytest.mark.parametrize("of_root, block_rows, labels", [(8, 2048, 64), (1, 7, 2), (0.5, 50, 64)])
def test_against_brute_force(spark, monkeypatch, of_root, block_rows, labels):
    monkeypatch.setattr(V, "PIVOTS_OF_ROOT", of_root)
    monkeypatch.setattr(V, "PIVOT_LABELS", labels)
    rows = _rows()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.find_near_vectors(df, block_rows=block_rows).collect()}
    assert got == _brute(rows)


def test_very_large_and_small_components(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1.0, 2.0], 1), (3, [1e-200, 2e-200], 1), (4, [2.0, -1.0], 1)]
    got = V.find_near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.find_near_vectors(df).collect()), key=str) == [(5, 1, 5, True), (5, 1, 5, True), (None, 0, None, True)]
    assert V.find_near_vectors(df.limit(0)).count() == 0


def test_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = {r[0]: r for r in duck.sql(V.OP8_SQL).fetchall()}
    assert {r.vec_id: tuple(r) for r in V.op8_embedding_dedup(spark, sf_dir).collect()} == want
