"""Operator 10: linked tool calls and canonical lines."""

from __future__ import annotations

import json
import random

import duckdb

from keystrata.llm import chat_format as C

SCHEMAS = [("search", "query", "string", True), ("search", "limit", "number", False), ("sum", "values", "array", True)]


def _call(**x):
    return "<tool_call>" + json.dumps(x) + "</tool_call>"


def _result(**x):
    return "<tool_result>" + json.dumps(x, indent=1) + "</tool_result>"


def _format(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, JSON string")
    schemas = spark.createDataFrame(SCHEMAS, "tool string, argument string, type string, required boolean")
    return sorted(C.format_chat(df, schemas).collect(), key=lambda r: (r.conv_id or 0, r.turn or 0))


def test_calls_are_linked_ordered_and_validated(spark):
    second = _call(id="b", name="sum", arguments={"values": {"$ref": "a"}}) + _call(id="a", name="search", arguments={"z": 1, "query": "x"})
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", second + _call(id="c", name="search", arguments={"limit": "5"}) + _call(id="d", name="nope", arguments=[1]) + "<tool_call>{broken</tool_call>" + _call(id="a", name="search", arguments={"query": "again"})),
        (1, 2, "tool", _result(id="a", content={"y": [1, 2], "x": "é"}) + _result(id="b", content=3) + _result(id="zz", content=1)),
        (2, 0, "assistant", _call(id="p", name="search", arguments={"query": {"$ref": "q"}}) + _call(id="q", name="search", arguments={"query": {"$ref": "p"}})),
        (2, 1, "tool", _result(id="p", content=1) + _result(id="q", content=2)),
    ]
    got = _format(spark, rows)
    lines = [json.loads(r.json) for r in got]
    calls = lines[1]["tool_calls"]
    problems = {(c["id"], json.dumps(c["arguments"])): c["problems"] for c in calls}
    known = [c["id"] for c in calls if c["id"]]
    assert known.index("a") < known.index("b")
    by_id = {c["id"]: c for c in calls if "repeated id" not in c["problems"]}
    assert by_id["a"]["problems"] == [] and by_id["a"]["result"] == {"x": "é", "y": [1, 2]} and list(by_id["a"]["arguments"]) == ["query", "z"]
    assert by_id["b"]["problems"] == [] and by_id["b"]["result"] == 3
    assert by_id["c"]["problems"] == ["missing query", "not a number in limit", "no result"]
    assert set(by_id["d"]["problems"]) == {"arguments aren't an object", "unknown tool", "no result"}
    assert [c["arguments"] for c in calls if c["id"] is None] == ["{broken"] and problems[None, '"{broken"'] == ["no id"]
    assert sum("repeated id" in c["problems"] for c in calls) == 1
    assert (got[1].n_calls, got[1].n_invalid, got[2].n_results) == (6, 4, 3)
    assert [c["problems"] for c in lines[3]["tool_calls"]] == [["cycle"], ["cycle"]]


def test_lines_are_canonical(spark):
    rows = [(1, 1, None, 'a "b" \\ / \n\t é 🙂'), (1, 2, "robot", None), (None, None, "tool", ""), (1, 1, None, 'a "b" \\ / \n\t é 🙂'), (3, 0, "user", "w " * 200000)]
    got = _format(spark, rows)
    assert len(got) == 5
    for r in got:
        line = json.loads(r.json)
        assert r.json == json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert line["role"] == r.role
    assert {r.role for r in got} == {"user", "tool"}


def test_empty_and_sql(spark, sf_dir):
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert C.format_chat(talks.limit(0), spark.createDataFrame(SCHEMAS, "tool string, argument string, type string, required boolean")).count() == 0
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = sorted(map(tuple, C.op10_chat_format(spark, sf_dir).collect()))
    assert got == sorted(duck.sql(C.OP10_SQL).fetchall())
    said = "".join(r[-1] for r in got)
    assert all(x in said for x in ("missing query", "not a number in limit", "unknown tool", "no result", '"result":{"ok":true'))


def test_levels_of_long_chains_and_graphs(spark, monkeypatch):
    dice, rounds = random.Random(2), []
    plain = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: rounds.append(name) or plain(df, name))
    refs = [(1, f"c{i}", f"c{i - 1}") for i in range(1, 1000)]  # one long chain
    refs += [(2, f"c{i}", f"c{dice.randrange(i)}") for i in range(1, 60) for _ in range(2)]  # several references
    refs += [(3, "a", "b"), (3, "b", "a"), (3, "c", "a"), (3, "d", "nowhere"), (3, "e", "d"), (3, "e", "c"), (3, "f", "d"), (3, "f", "g")]
    calls = sorted({(conv, x) for conv, *ends in refs for x in ends} - {(3, "nowhere")})
    want = dict.fromkeys(calls, 0)
    for _ in range(1001):
        old = dict(want)
        for conv, call, needs in refs:
            if (conv, needs) in want:
                want[conv, call] = max(want[conv, call], want[conv, needs] + 1)
        if old == want or conv == 3 and _ > 1000:
            break
    want |= {(3, x): None for x in "abce"}
    got = C._levels(spark.createDataFrame(calls, "conv bigint, call string"), spark.createDataFrame(refs, "conv bigint, call string, needs string").distinct())
    assert {(r.conv, r.call): r.level for r in got.collect()} == want
    assert rounds.count("chat-jumps") <= 13
