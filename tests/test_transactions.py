"""Transaction transitions on small fixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from keystrata.functions.timestamps import LOGICAL_BITS
from keystrata.operators import mvcc as M
from keystrata.operators import transactions as T

LOCKS = "user_key string, lock_type string, primary_key string, start_ts bigint, ttl bigint, for_update_ts bigint, min_commit_ts bigint"
WRITES = "user_key string, commit_ts bigint, start_ts bigint, write_type string, short_value string"


def _locks(spark, *rows):
    return spark.createDataFrame([(k, kind, k, ts, 3000, ts, ts + 1) for k, kind, ts in rows], LOCKS)


def _writes(spark, *rows):
    return spark.createDataFrame([(k, commit, start, kind, "v") for k, commit, start, kind in rows], WRITES)


def _ask(spark, *keys, **columns):
    df = spark.createDataFrame([(k, ts) for k, ts in keys], "user_key string, start_ts bigint")
    return df.withColumns({n: F.lit(v) for n, v in columns.items()}) if columns else df


def _status(df):
    return {r.user_key: r.status for r in df.collect()}


def test_prewrite(spark):
    asked = _ask(spark, ("free", 10), ("conflict", 10), ("held", 10), ("own", 10), ("rolled", 10))
    locks = _locks(spark, ("held", "P", 5), ("own", "P", 10))
    writes = _writes(spark, ("conflict", 20, 15, "P"), ("free", 8, 7, "P"), ("rolled", 30, 30, "R"))
    got = T.prewrite(asked, locks, writes)
    assert _status(got) == {"free": "locked", "conflict": "write_conflict", "held": "key_locked", "own": "already_locked", "rolled": "locked"}
    rows = got.withColumns({"op": F.lit("P"), "primary_key": F.lit("free"), "value": F.repeat(F.lit("x"), F.when(F.col("user_key") == "free", 300).otherwise(10))})
    new = {r.user_key: (r.short_value is None, r.long_value is None) for r in T.new_locks(rows).collect()}
    assert new == {"free": (True, False), "rolled": (False, True)}


def test_commit(spark):
    locks = _locks(spark, ("a", "P", 10), ("early", "P", 20), ("s", "S", 10), ("foreign", "P", 5))
    asked = _ask(spark, ("a", 10), ("s", 10), ("foreign", 10), ("none", 10)).withColumn("commit_ts", F.lit(20))
    asked = asked.unionAll(_ask(spark, ("early", 20)).withColumn("commit_ts", F.lit(20)))
    assert _status(T.commit(asked, locks)) == {"a": "committed", "early": "commit_ts_too_small", "s": "unlocked", "foreign": "lock_not_found", "none": "lock_not_found"}


def test_rollback_and_status(spark):
    locks, writes = _locks(spark, ("held", "P", 10)), _writes(spark, ("done", 20, 10, "P"), ("back", 10, 10, "R"))
    asked = _ask(spark, ("held", 10), ("done", 10), ("back", 10), ("new", 10))
    got = T.rollback(asked, locks, writes)
    assert _status(got) == {"held": "rolled_back", "done": "already_committed", "back": "already_rolled_back", "new": "rolled_back"}
    assert {r.user_key for r in got.filter("drops_lock").collect()} == {"held"}
    assert _status(T.check_status(asked, locks, writes)) == {"held": "locked", "done": "committed", "back": "rolled_back", "new": "unknown"}
    assert _status(T.check_with_cleanup(asked, locks, writes, F.lit(2999 << LOGICAL_BITS), False))["held"] == "locked"
    late = _status(T.check_with_cleanup(asked, locks, writes, F.lit(3000 << LOGICAL_BITS), True))
    assert (late["held"], late["new"]) == ("expired_rolled_back", "missing_rolled_back")


def test_heartbeat_resolve_cleanup(spark):
    locks = _locks(spark, ("a", "P", 10), ("b", "P", 11), ("c", "S", 12))
    beat = {r.user_key: (r.status, r.new_ttl) for r in T.heartbeat(_ask(spark, ("a", 10), ("b", 99), advised_ttl=5000), locks).collect()}
    assert beat == {"a": ("ok", 5000), "b": ("lock_not_found", None)}
    outcomes = spark.createDataFrame([(10, 30), (11, 0), (12, 30)], "start_ts bigint, commit_ts bigint")
    assert _status(T.resolve(locks, outcomes)) == {"a": "committed", "b": "rolled_back", "c": "unlocked"}
    held = locks.filter("user_key = 'b'").withColumn("primary_key", F.lit("p"))
    assert _status(T.cleanup(held, _writes(spark, ("p", 40, 11, "P")))) == {"b": "committed"}


def test_asynchronous_and_one_phase(spark):
    none = _locks(spark)
    got = T.async_prewrite(_ask(spark, ("a", 10)), none, _writes(spark), 50).first()
    assert (got.status, got.min_commit_ts) == ("locked", 51)
    locks, writes = _locks(spark, ("a", "P", 10)), _writes(spark, ("b", 20, 10, "P"))
    assert {r.user_key: r.min_commit_ts for r in T.async_status(_ask(spark, ("a", 10), ("b", 10)), locks, writes).collect()} == {"a": 11, "b": None}
    primary = spark.createDataFrame([("p", 10, ["a", "b", "c"])], "primary_key string, start_ts bigint, secondaries array<string>")
    assert _status(T.check_secondaries(primary, locks, writes)) == {"a": "locked", "b": "committed", "c": "unknown"}
    mutations = _ask(spark, ("x", 5), ("y", 5), ("b", 6), ("z", 6), value="v").unionAll(_ask(spark, *[(f"k{i}", 7) for i in range(65)], value="v"))
    assert {r.start_ts: (r.status, r.commit_ts) for r in T.one_pc(mutations, none, writes, 3).collect()} == {5: ("committed", 6), 6: ("write_conflict", None), 7: ("not_eligible", None)}
    assert {r.start_ts: r.eligible for r in T.async_eligible(_ask(spark, *[(f"k{i}", 1) for i in range(257)], ("a", 2))).collect()} == {1: False, 2: True}


def test_pessimistic(spark):
    locks, writes = _locks(spark, ("own", "S", 10), ("held", "P", 5)), _writes(spark, ("new", 30, 29, "P"))
    got = {r.user_key: (r.status, r.new_for_update_ts) for r in T.pessimistic_lock(_ask(spark, ("own", 10), ("held", 10), ("new", 10), ("free", 10), for_update_ts=20), locks, writes).collect()}
    assert got == {"own": ("already_locked", 20), "held": ("key_locked", None), "new": ("write_conflict", None), "free": ("locked", 20)}
    assert _status(T.pessimistic_prewrite(_ask(spark, ("own", 10), ("free", 10), is_pessimistic=True), locks, writes)) == {"own": "upgraded", "free": "lock_not_found"}
    assert T.pessimistic_rollback(_ask(spark, ("own", 10), ("held", 5), for_update_ts=0), locks).count() == 1
    assert T.pessimistic_rollback(_ask(spark, ("own", 10), for_update_ts=7), locks).count() == 0


def test_overlay(spark):
    seen = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "user_key string, value string")
    buffer = spark.createDataFrame([("b", "delete", None), ("c", "put", "new"), ("d", "put", "4")], "user_key string, op string, value string")
    assert sorted(map(tuple, T.overlay(seen, buffer).collect())) == [("a", "1"), ("c", "new"), ("d", "4")]


def test_transfers_keep_the_total(spark):
    accounts = spark.createDataFrame([(f"acct:{i:04d}", 100) for i in range(200)], "user_key string, cents bigint")
    moves = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(200)).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(200)).alias("b"), (F.col("id") % 7).alias("n"))
    name = lambda c: F.format_string("acct:%04d", F.col(c))
    deltas = reduce(lambda x, y: x.unionAll(y), [moves.select(name("a").alias("user_key"), -F.col("n")), moves.select(name("b"), F.col("n"))]).toDF("user_key", "delta").groupBy("user_key").sum("delta")
    buffer = accounts.join(deltas, "user_key").select("user_key", F.lit("put").alias("op"), (F.col("cents") + F.col("sum(delta)")).alias("cents"))
    after = T.overlay(accounts, buffer)
    assert after.agg(F.sum("cents")).first()[0] == 20000 and after.select("user_key").distinct().count() == 200


def _held(spark, *rows):
    return _locks(spark, *rows).withColumn("short_value", F.lit("v"))


def _state(pair):
    locks, writes = pair
    return sorted((r.user_key, r.lock_type) for r in locks.collect()), sorted((r.user_key, r.commit_ts, r.start_ts, r.write_type, r.short_value) for r in writes.collect())


def test_commits_and_rollbacks_change_the_state(spark):
    locks = _held(spark, ("a", "P", 10), ("b", "D", 10), ("s", "S", 10), ("other", "P", 11))
    none = _writes(spark, ("z", 5, 4, "P")).limit(0)
    asked = _ask(spark, ("a", 10), ("b", 10), ("s", 10), ("other", 10), ("gone", 10), commit_ts=20)
    assert _state(T.apply_commit(asked, locks, none)) == ([("other", "P")], [("a", 20, 10, "P", "v"), ("b", 20, 10, "D", "v")])
    early = _ask(spark, ("a", 10), commit_ts=10)
    assert _state(T.apply_commit(early, locks, none)) == ([("a", "P"), ("b", "D"), ("other", "P"), ("s", "S")], [])
    left, marks = _state(T.apply_rollback(_ask(spark, ("a", 10), ("gone", 7)), locks, none))
    assert left == [("b", "D"), ("other", "P"), ("s", "S")] and marks == [("a", 10, 10, "R", None), ("gone", 7, 7, "R", None)]
    done = _writes(spark, ("a", 20, 10, "P"))
    assert _state(T.apply_rollback(_ask(spark, ("a", 10)), locks.limit(0), done)) == ([], [("a", 20, 10, "P", "v")])
    outcomes = spark.createDataFrame([(10, 30), (11, 0)], "start_ts bigint, commit_ts bigint")
    assert _state(T.apply_resolve(locks, outcomes, none)) == ([], [("a", 30, 10, "P", "v"), ("b", 30, 10, "D", "v"), ("other", 11, 11, "R", None)])


def test_prewrite_commit_read(spark):
    accounts = _writes(spark, ("a", 2, 1, "P"), ("b", 2, 1, "P"))
    asked = _ask(spark, ("a", 10), ("c", 10)).withColumns({"op": F.lit("P"), "primary_key": F.lit("a"), "value": F.lit("new")})
    locks = T.apply_prewrite(asked, _held(spark, ("x", "P", 1)).limit(0), accounts)
    assert sorted((r.user_key, r.start_ts, r.short_value) for r in locks.collect()) == [("a", 10, "new"), ("c", 10, "new")]
    left, writes = T.apply_commit(_ask(spark, ("a", 10), ("c", 10), commit_ts=20), locks, accounts)
    assert left.count() == 0
    assert {r.user_key: r.short_value for r in M.snapshot(writes, 20).collect()} == {"a": "new", "b": "v", "c": "new"}
    assert {r.user_key: r.short_value for r in M.snapshot(writes, 19).collect()} == {"a": "v", "b": "v"}


def test_one_phase_and_pessimistic_state(spark):
    none = _writes(spark, ("z", 50, 4, "P"))
    asked = _ask(spark, ("a", 10), ("b", 10), ("z", 11), ("c", 11)).withColumns({"op": F.lit("P"), "value": F.lit("n")})
    after = T.apply_one_pc(asked, _held(spark, ("x", "P", 1)), none, 99)
    assert sorted((r.user_key, r.commit_ts) for r in after.collect()) == [("a", 100), ("b", 100), ("z", 50)]
    locks = _held(spark, ("a", "S", 10), ("b", "P", 10), ("c", "S", 12))
    up = _ask(spark, ("a", 10), is_pessimistic=True, op="D", value="w")
    assert sorted((r.user_key, r.lock_type, r.short_value) for r in T.apply_pessimistic_prewrite(up, locks, none).collect()) == [("a", "D", "w"), ("b", "P", "v"), ("c", "S", "v")]
    gone = _ask(spark, ("a", 10), ("c", 12), for_update_ts=0)
    assert [r.user_key for r in T.apply_pessimistic_rollback(gone, locks).collect()] == ["b"]
    expired_at = F.shiftleft(F.lit(5000).cast("bigint"), LOGICAL_BITS)
    assert _state(T.apply_check_with_cleanup(_ask(spark, ("b", 10)), locks, none.limit(0), expired_at, True)) == ([("a", "S"), ("c", "S")], [("b", 10, 10, "R", None)])


def test_transfers_keep_the_sum(spark):
    accounts = spark.createDataFrame([(k, 2, 1, "P", 100) for k in "abcde"], "user_key string, commit_ts bigint, start_ts bigint, write_type string, short_value bigint")
    asked = [(10, "a", "b", 30), (12, "b", "c", 50), (14, "c", "d", 20), (16, "e", "nobody", 5), (18, "d", "d", 7)]
    locks, after = T.transfer(accounts, spark.createDataFrame(asked, "start_ts bigint, source string, target string, amount bigint"))
    balances = {r.user_key: r.short_value for r in M.snapshot(after).collect()}
    # 12 loses b to 10, 14 loses c to 12, 16 has no partner.
    assert balances == {"a": 70, "b": 130, "c": 100, "d": 100, "e": 100} and locks.count() == 0
    assert sorted((r.user_key, r.start_ts) for r in after.filter("write_type = 'R'").collect()) == [("c", 12), ("d", 14), ("e", 16)]
