"""Transaction transitions: requests from customers and events against the pending locks."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.operators import mvcc as M
from keystrata.operators import transactions as T
from keystrata.plans.mvcc_queries import H, L, W, visible
from keystrata.sources.tables import byte_key, ended, history, pending, read

MAX_TS = 12000
BASE = f"WITH {H}, {L}, {W}"
#: Requests: customer n writes key n % 400 in transaction n * 13 + 1; every pending transaction asks as well.
M_SQL = """m AS (SELECT lpad((c_custkey % 400)::VARCHAR, 12, '0') AS user_key, c_custkey * 13 + 1 AS start_ts, c_mktsegment AS value FROM customer
  UNION ALL SELECT user_key, start_ts, 'own' FROM locks)"""
DATA_SQL = "d AS (SELECT user_key, max(commit_ts) AS newest_ts FROM writes WHERE write_type IN ('P', 'D') GROUP BY user_key)"
REC_SQL = "r AS (SELECT user_key, start_ts, arg_max(write_type <> 'R', commit_ts) AS committed, max(commit_ts) AS record_ts FROM writes GROUP BY ALL)"
PRE_SQL = f"{BASE}, {M_SQL}, {DATA_SQL}, p AS (SELECT m.*, l.lock_type, l.start_ts AS lock_ts, newest_ts, CASE WHEN l.start_ts = m.start_ts THEN 'already_locked' WHEN l.start_ts IS NOT NULL THEN 'key_locked' WHEN newest_ts > m.start_ts THEN 'write_conflict' ELSE 'locked' END AS status FROM m LEFT JOIN locks l USING (user_key) LEFT JOIN d USING (user_key))"
#: Status requests: the transactions of all events, ended or pending, and of customers, unknown.
Q_SQL = "q AS (SELECT user_key, start_ts FROM h UNION ALL SELECT lpad(c_custkey::VARCHAR, 12, '0'), 1000000 + c_custkey FROM customer)"
STATUS_SQL = f"{BASE}, {REC_SQL}, {Q_SQL}, s AS (SELECT q.*, l.ttl, l.min_commit_ts, l.start_ts IS NOT NULL AS own, CASE WHEN l.start_ts IS NOT NULL THEN 'locked' WHEN committed THEN 'committed' WHEN NOT committed THEN 'rolled_back' ELSE 'unknown' END AS status, CASE WHEN l.start_ts IS NULL AND committed THEN record_ts END AS found_commit_ts FROM q LEFT JOIN locks l ON l.user_key = q.user_key AND l.start_ts = q.start_ts LEFT JOIN r ON r.user_key = q.user_key AND r.start_ts = q.start_ts)"


def _state(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return pending(events), ended(events)


def _mutations(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(byte_key(F.col("c_custkey") % 400).alias("user_key"), (F.col("c_custkey") * 13 + 1).alias("start_ts"), F.col("c_mktsegment").alias("value"))
    own = _state(spark, sf_dir)[0].select("user_key", "start_ts", F.lit("own").alias("value"))
    return customers.unionAll(own)


def _asked(spark, sf_dir):
    every = history(read(spark, sf_dir, "events")).select("user_key", "start_ts")
    return every.unionAll(read(spark, sf_dir, "customer").select(byte_key("c_custkey"), F.lit(1000000) + F.col("c_custkey")))


def _prewrite(spark, sf_dir):
    return T.prewrite(_mutations(spark, sf_dir), *_state(spark, sf_dir)).select("user_key", "start_ts", "status")


def _commit(spark, sf_dir):
    locks, _ = _state(spark, sf_dir)
    requests = _mutations(spark, sf_dir).withColumn("commit_ts", F.col("start_ts") + F.when(F.col("start_ts") % 3 == 0, 0).otherwise(5))
    return T.commit(requests, locks).select("user_key", "start_ts", "commit_ts", "status")


def _rollback(spark, sf_dir):
    return T.rollback(_asked(spark, sf_dir), *_state(spark, sf_dir)).select("user_key", "start_ts", "status", "drops_lock")


def _check(spark, sf_dir):
    return T.check_status(_asked(spark, sf_dir), *_state(spark, sf_dir)).select("user_key", "start_ts", "status", "found_commit_ts")


def _check_cleanup(spark, sf_dir):
    now = F.shiftleft(F.lit(3080).cast("bigint"), 18)
    rows = T.check_with_cleanup(_asked(spark, sf_dir), *_state(spark, sf_dir), now, True)
    return rows.select("user_key", "start_ts", "status")


def _heartbeat(spark, sf_dir):
    requests = _mutations(spark, sf_dir).withColumn("advised_ttl", F.lit(2900) + F.col("start_ts") % 500)
    return T.heartbeat(requests, _state(spark, sf_dir)[0]).select("user_key", "start_ts", "status", "new_ttl")


def _resolve(spark, sf_dir):
    locks, _ = _state(spark, sf_dir)
    outcomes = locks.select("start_ts", F.when(F.col("start_ts") % 4 == 1, F.lit(0)).otherwise(F.col("start_ts") + F.col("start_ts") % 3).alias("commit_ts"))
    return T.resolve(locks, outcomes).select("user_key", "start_ts", "commit_ts", "status")


def _cleanup(spark, sf_dir):
    return T.cleanup(*_state(spark, sf_dir))


def _async_prewrite(spark, sf_dir):
    return T.async_prewrite(_mutations(spark, sf_dir), *_state(spark, sf_dir), MAX_TS).select("user_key", "start_ts", "status", "min_commit_ts")


def _async_status(spark, sf_dir):
    return T.async_status(_asked(spark, sf_dir), *_state(spark, sf_dir)).select("user_key", "start_ts", "status", "min_commit_ts", "found_commit_ts")


def _secondaries(spark, sf_dir):
    locks, writes = _state(spark, sf_dir)
    by_key = history(read(spark, sf_dir, "events")).groupBy("start_ts").agg(F.first("user_key").alias("primary_key"))
    primaries = by_key.withColumn("secondaries", F.array("primary_key", byte_key(F.col("start_ts") % 100)))
    return T.check_secondaries(primaries, locks, writes)


def _one_pc(spark, sf_dir):
    mutations = read(spark, sf_dir, "customer").select(byte_key("c_custkey").alias("user_key"), (F.col("c_custkey") % 300 * 50 + 1).alias("start_ts"), F.col("c_mktsegment").alias("value"))
    return T.one_pc(mutations, *_state(spark, sf_dir), MAX_TS).select("start_ts", "n_mutations", "n_bytes", "status", "commit_ts")


def _async_eligible(spark, sf_dir):
    mutations = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("start_ts"))
    return T.async_eligible(mutations)


def _pessimistic(spark, sf_dir):
    requests = _mutations(spark, sf_dir).withColumn("for_update_ts", F.col("start_ts") + 500)
    return T.pessimistic_lock(requests, *_state(spark, sf_dir)).select("user_key", "start_ts", "status", "new_for_update_ts")


def _pessimistic_prewrite(spark, sf_dir):
    requests = _mutations(spark, sf_dir).withColumn("is_pessimistic", F.col("start_ts") % 2 == 0)
    return T.pessimistic_prewrite(requests, *_state(spark, sf_dir)).select("user_key", "start_ts", "status")


def _pessimistic_rollback(spark, sf_dir):
    locks, _ = _state(spark, sf_dir)
    requests = locks.select("user_key", "start_ts", F.when(F.col("ttl") % 3 == 0, 0).otherwise(F.col("start_ts") + F.col("ttl") % 3 - 1).alias("for_update_ts"))
    return T.pessimistic_rollback(requests, locks).select("user_key", "start_ts", "for_update_ts")


def _overlay(spark, sf_dir):
    seen = M.snapshot(history(read(spark, sf_dir, "events")), 10000).select("user_key", F.col("short_value").alias("value"))
    buffer = read(spark, sf_dir, "part").select(byte_key("p_partkey").alias("user_key"), F.when(F.col("p_size") > 25, "put").otherwise("delete").alias("op"), F.col("p_retailprice").alias("value"))
    return T.overlay(seen, buffer).orderBy("user_key").limit(120)


def _two_sides(locks, writes):
    """Locks and write records in one table."""
    left = locks.select(F.lit("lock").alias("side"), "user_key", "start_ts", F.lit(None).cast("bigint").alias("commit_ts"), F.col("lock_type").alias("kind"), "short_value")
    return left.unionByName(writes.select(F.lit("write").alias("side"), "user_key", "start_ts", "commit_ts", F.col("write_type").alias("kind"), "short_value"))


def _apply_commit(spark, sf_dir):
    locks, writes = _state(spark, sf_dir)
    requests = locks.filter("start_ts % 3 <> 0").select("user_key", "start_ts", (F.col("start_ts") + 5 * (F.col("start_ts") % 4)).alias("commit_ts"))
    return _two_sides(*T.apply_commit(requests, locks, writes))


def _apply_rollback(spark, sf_dir):
    return _two_sides(*T.apply_rollback(_asked(spark, sf_dir), *_state(spark, sf_dir)))


def _apply_resolve(spark, sf_dir):
    locks, writes = _state(spark, sf_dir)
    outcomes = locks.select("start_ts", F.when(F.col("start_ts") % 4 == 1, F.lit(0)).otherwise(F.col("start_ts") + F.col("start_ts") % 3).alias("commit_ts"))
    return _two_sides(*T.apply_resolve(locks, outcomes, writes))


def _apply_cleanup(spark, sf_dir):
    now = F.shiftleft(F.lit(3080).cast("bigint"), 18)
    return _two_sides(*T.apply_check_with_cleanup(_asked(spark, sf_dir), *_state(spark, sf_dir), now, True))


def _apply_one_pc(spark, sf_dir):
    locks, writes = _state(spark, sf_dir)
    mutations = read(spark, sf_dir, "customer").select(byte_key("c_custkey").alias("user_key"), (F.col("c_custkey") % 300 * 50 + 1).alias("start_ts"), F.lit("P").alias("op"), F.col("c_acctbal").alias("value"))
    return T.apply_one_pc(mutations, locks, writes, MAX_TS).select("user_key", "commit_ts", "start_ts", "write_type", "short_value")


def _apply_pessimistic(spark, sf_dir):
    locks, writes = _state(spark, sf_dir)
    mutations = locks.select("user_key", "start_ts", F.lit(True).alias("is_pessimistic"), F.lit("P").alias("op"), F.lit(7.5).alias("value"))
    return T.apply_pessimistic_prewrite(mutations, locks, writes).select("user_key", "start_ts", F.col("lock_type").alias("kind"), "short_value")


def _transfers(spark, sf_dir):
    """Accounts of 1000 for all customers, a transfer for each order; what the accounts hold before and after."""
    accounts = read(spark, sf_dir, "customer").select(byte_key("c_custkey").alias("user_key"), F.lit(2).cast("bigint").alias("commit_ts"), F.lit(1).cast("bigint").alias("start_ts"), F.lit("P").alias("write_type"), F.lit(1000).cast("bigint").alias("short_value"))
    orders = read(spark, sf_dir, "orders")
    transfers = orders.select((F.lit(10) + 2 * F.col("o_orderkey")).alias("start_ts"), byte_key("o_custkey").alias("source"), byte_key(F.col("o_orderkey") % 997 + 1).alias("target"), (F.lit(1) + F.col("o_orderkey") % 50).alias("amount"))
    locks, after = T.transfer(accounts, transfers)
    total = lambda rows, name: M.snapshot(rows).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum("short_value").alias(f"total_{name}"), F.min("short_value").alias(f"least_{name}")).withColumn("_one", F.lit(1))
    counts = after.agg(F.count_if((F.col("write_type") == "P") & (F.col("start_ts") > 1)).alias("n_committed"), F.count_if(F.col("write_type") == "R").alias("n_rolled_back")).withColumn("_one", F.lit(1))
    left = locks.agg(F.count(F.lit(1)).alias("n_locks_left")).withColumn("_one", F.lit(1))
    return total(accounts, "before").join(total(after, "after"), "_one").join(counts, "_one").join(left, "_one").drop("_one")


def _oldest(spark, sf_dir):
    return T.oldest_lock(_state(spark, sf_dir)[0])


_CASE_RB = "CASE WHEN committed THEN 'already_committed' WHEN NOT committed THEN 'already_rolled_back' ELSE 'rolled_back' END"

QUERIES = {
    "txn_prewrite_status": (_prewrite, f"{PRE_SQL} SELECT user_key, start_ts, status FROM p"),
    "txn_commit": (
        _commit,
        f"""{BASE}, {M_SQL}, c AS (SELECT m.*, start_ts + CASE WHEN start_ts % 3 = 0 THEN 0 ELSE 5 END AS commit_ts FROM m)
        SELECT c.user_key, c.start_ts, c.commit_ts, CASE WHEN l.start_ts IS DISTINCT FROM c.start_ts THEN 'lock_not_found' WHEN c.commit_ts < min_commit_ts THEN 'commit_ts_too_small' WHEN lock_type = 'S' THEN 'unlocked' ELSE 'committed' END AS status
        FROM c LEFT JOIN locks l USING (user_key)""",
    ),
    "txn_rollback": (
        _rollback,
        f"""{BASE}, {REC_SQL}, {Q_SQL} SELECT q.user_key, q.start_ts, {_CASE_RB} AS status, coalesce(l.start_ts = q.start_ts AND committed IS NULL, false) AS drops_lock
        FROM q LEFT JOIN r USING (user_key, start_ts) LEFT JOIN locks l ON l.user_key = q.user_key""",
    ),
    "txn_check_status": (_check, f"{STATUS_SQL} SELECT user_key, start_ts, status, found_commit_ts FROM s"),
    "txn_check_cleanup": (
        _check_cleanup,
        f"{STATUS_SQL} SELECT user_key, start_ts, CASE WHEN own AND 3080 >= (start_ts >> 18) + ttl THEN 'expired_rolled_back' WHEN status = 'unknown' THEN 'missing_rolled_back' ELSE status END AS status FROM s",
    ),
    "txn_heartbeat": (
        _heartbeat,
        f"{BASE}, {M_SQL} SELECT m.user_key, m.start_ts, CASE WHEN l.start_ts = m.start_ts THEN 'ok' ELSE 'lock_not_found' END AS status, CASE WHEN l.start_ts = m.start_ts THEN greatest(ttl, 2900 + m.start_ts % 500) END AS new_ttl FROM m LEFT JOIN locks l USING (user_key)",
    ),
    "txn_resolve_locks": (
        _resolve,
        f"""WITH {L}, o AS (SELECT start_ts, CASE WHEN start_ts % 4 = 1 THEN 0 ELSE start_ts + start_ts % 3 END AS commit_ts FROM locks)
        SELECT user_key, start_ts, commit_ts, CASE WHEN commit_ts = 0 THEN 'rolled_back' WHEN commit_ts < min_commit_ts THEN 'commit_ts_too_small' WHEN lock_type = 'S' THEN 'unlocked' ELSE 'committed' END AS status FROM locks JOIN o USING (start_ts)""",
    ),
    "txn_cleanup": (
        _cleanup,
        f"""{BASE}, {REC_SQL} SELECT a.user_key, a.primary_key, a.start_ts, CASE WHEN l.start_ts = a.start_ts THEN 'locked' WHEN committed THEN 'committed' WHEN NOT committed THEN 'rolled_back' ELSE 'unknown' END AS status,
        CASE WHEN l.start_ts IS DISTINCT FROM a.start_ts AND committed THEN record_ts END AS found_commit_ts
        FROM locks a LEFT JOIN locks l ON l.user_key = a.primary_key LEFT JOIN r ON r.user_key = a.primary_key AND r.start_ts = a.start_ts""",
    ),
    "txn_async_min_commit_ts": (_async_prewrite, f"{PRE_SQL} SELECT user_key, start_ts, status, CASE WHEN status = 'locked' THEN greatest(start_ts + 1, {MAX_TS + 1}) END AS min_commit_ts FROM p"),
    "txn_async_status": (_async_status, f"{STATUS_SQL} SELECT user_key, start_ts, status, CASE WHEN own THEN min_commit_ts END AS min_commit_ts, found_commit_ts FROM s"),
    "txn_check_secondaries": (
        _secondaries,
        f"""{BASE}, {REC_SQL}, e AS (SELECT user_key AS primary_key, start_ts, unnest([user_key, lpad((start_ts % 100)::VARCHAR, 12, '0')]) AS user_key FROM h)
        SELECT e.primary_key, e.start_ts, e.user_key, CASE WHEN l.start_ts = e.start_ts THEN 'locked' WHEN committed THEN 'committed' WHEN NOT committed THEN 'rolled_back' ELSE 'unknown' END AS status,
        CASE WHEN l.start_ts IS DISTINCT FROM e.start_ts AND committed THEN record_ts END AS found_commit_ts
        FROM e LEFT JOIN locks l ON l.user_key = e.user_key LEFT JOIN r ON r.user_key = e.user_key AND r.start_ts = e.start_ts""",
    ),
    "txn_1pc": (
        _one_pc,
        f"""{BASE}, {DATA_SQL}, x AS (SELECT lpad(c_custkey::VARCHAR, 12, '0') AS user_key, c_custkey % 300 * 50 + 1 AS start_ts, c_mktsegment AS value FROM customer),
        p AS (SELECT x.*, CASE WHEN l.start_ts = x.start_ts THEN NULL WHEN l.start_ts IS NOT NULL THEN 'key_locked' WHEN newest_ts > x.start_ts THEN 'write_conflict' END AS problem FROM x LEFT JOIN locks l USING (user_key) LEFT JOIN d USING (user_key)),
        g AS (SELECT start_ts, count(*) AS n_mutations, sum(strlen(user_key) + strlen(value))::BIGINT AS n_bytes, max(problem) AS problem FROM p GROUP BY start_ts),
        j AS (SELECT *, CASE WHEN n_mutations > 64 OR n_bytes >= 262144 THEN 'not_eligible' ELSE coalesce(problem, 'committed') END AS status FROM g)
        SELECT start_ts, n_mutations, n_bytes, status, CASE WHEN status = 'committed' THEN greatest(start_ts + 1, {MAX_TS + 1}) END AS commit_ts FROM j""",
    ),
    "txn_async_eligible": (_async_eligible, "SELECT o_custkey AS start_ts, count(*) AS n_mutations, count(*) <= 256 AS eligible FROM orders GROUP BY o_custkey"),
    "txn_pessimistic_lock": (
        _pessimistic,
        f"""{BASE}, {M_SQL}, {DATA_SQL}, p AS (SELECT m.user_key, m.start_ts, m.start_ts + 500 AS fts, l.for_update_ts AS lfts, CASE WHEN l.start_ts = m.start_ts THEN 'already_locked' WHEN l.start_ts IS NOT NULL THEN 'key_locked' WHEN newest_ts > m.start_ts + 500 THEN 'write_conflict' ELSE 'locked' END AS status
        FROM m LEFT JOIN locks l USING (user_key) LEFT JOIN d USING (user_key))
        SELECT user_key, start_ts, status, CASE status WHEN 'already_locked' THEN greatest(fts, lfts) WHEN 'locked' THEN fts END AS new_for_update_ts FROM p""",
    ),
    "txn_pessimistic_prewrite": (
        _pessimistic_prewrite,
        f"{PRE_SQL} SELECT user_key, start_ts, CASE WHEN lock_ts = start_ts AND lock_type = 'S' THEN 'upgraded' WHEN start_ts % 2 = 0 AND lock_ts IS NULL THEN 'lock_not_found' ELSE status END AS status FROM p",
    ),
    "txn_pessimistic_rollback": (
        _pessimistic_rollback,
        f"WITH {L} SELECT user_key, start_ts, for_update_ts FROM locks WHERE lock_type = 'S' AND ttl % 3 IN (0, 1)",
    ),
    "txn_membuf_overlay": (
        _overlay,
        f"""WITH {H}, b AS (SELECT lpad(p_partkey::VARCHAR, 12, '0') AS user_key, p_size > 25 AS put, p_retailprice AS value FROM part)
        SELECT * FROM (SELECT user_key, short_value AS value FROM {visible(10000)} ANTI JOIN b USING (user_key) UNION ALL SELECT user_key, value FROM b WHERE put) ORDER BY user_key LIMIT 120""",
    ),
    "txn_apply_commit": (
        _apply_commit,
        f"""{BASE}, c AS (SELECT user_key, start_ts, start_ts + 5 * (start_ts % 4) AS commit_ts, lock_type, short_value, start_ts + 5 * (start_ts % 4) >= min_commit_ts AS fine FROM locks WHERE start_ts % 3 <> 0)
        SELECT 'lock' AS side, user_key, start_ts, NULL::BIGINT AS commit_ts, lock_type AS kind, short_value FROM locks WHERE (user_key, start_ts) NOT IN (SELECT (user_key, start_ts) FROM c WHERE fine)
        UNION ALL SELECT 'write', user_key, start_ts, commit_ts, write_type, short_value FROM writes
        UNION ALL SELECT 'write', user_key, start_ts, commit_ts, lock_type, short_value FROM c WHERE fine AND lock_type <> 'S'""",
    ),
    "txn_apply_rollback": (
        _apply_rollback,
        f"""{BASE}, {REC_SQL}, {Q_SQL}, x AS (SELECT DISTINCT q.user_key, q.start_ts FROM q ANTI JOIN r USING (user_key, start_ts))
        SELECT 'lock' AS side, user_key, start_ts, NULL::BIGINT AS commit_ts, lock_type AS kind, short_value FROM locks ANTI JOIN x USING (user_key, start_ts)
        UNION ALL SELECT 'write', user_key, start_ts, commit_ts, write_type, short_value FROM writes UNION ALL SELECT 'write', user_key, start_ts, start_ts, 'R', NULL FROM x""",
    ),
    "txn_apply_resolve": (
        _apply_resolve,
        f"""{BASE}, o AS (SELECT *, CASE WHEN start_ts % 4 = 1 THEN 0 ELSE start_ts + start_ts % 3 END AS decided FROM locks), d AS (SELECT * FROM o WHERE decided = 0 OR decided >= min_commit_ts)
        SELECT 'lock' AS side, user_key, start_ts, NULL::BIGINT AS commit_ts, lock_type AS kind, short_value FROM o WHERE NOT (decided = 0 OR decided >= min_commit_ts)
        UNION ALL SELECT 'write', user_key, start_ts, commit_ts, write_type, short_value FROM writes
        UNION ALL SELECT 'write', user_key, start_ts, CASE WHEN decided = 0 THEN start_ts ELSE decided END, CASE WHEN decided = 0 THEN 'R' ELSE lock_type END, CASE WHEN decided > 0 THEN short_value END FROM d WHERE decided = 0 OR lock_type <> 'S'""",
    ),
    "txn_apply_cleanup": (
        _apply_cleanup,
        f"""{STATUS_SQL}, x AS (SELECT DISTINCT user_key, start_ts FROM s WHERE own AND 3080 >= (start_ts >> 18) + ttl OR status = 'unknown')
        SELECT 'lock' AS side, user_key, start_ts, NULL::BIGINT AS commit_ts, lock_type AS kind, short_value FROM locks ANTI JOIN x USING (user_key, start_ts)
        UNION ALL SELECT 'write', user_key, start_ts, commit_ts, write_type, short_value FROM writes UNION ALL SELECT 'write', user_key, start_ts, start_ts, 'R', NULL FROM x""",
    ),
    "txn_apply_1pc": (
        _apply_one_pc,
        f"""{BASE}, {DATA_SQL}, x AS (SELECT lpad(c_custkey::VARCHAR, 12, '0') AS user_key, c_custkey % 300 * 50 + 1 AS start_ts, c_acctbal AS value FROM customer),
        p AS (SELECT x.*, l.start_ts IS NOT NULL AND l.start_ts <> x.start_ts OR l.start_ts IS NULL AND coalesce(newest_ts > x.start_ts, false) AS bad FROM x LEFT JOIN locks l USING (user_key) LEFT JOIN d USING (user_key)),
        g AS (SELECT start_ts FROM p GROUP BY start_ts HAVING count(*) <= 64 AND NOT bool_or(bad))
        SELECT user_key, commit_ts, start_ts, write_type, short_value FROM writes UNION ALL SELECT user_key, greatest(start_ts + 1, {MAX_TS + 1}), start_ts, 'P', value FROM x JOIN g USING (start_ts)""",
    ),
    "txn_apply_pessimistic_prewrite": (
        _apply_pessimistic,
        f"WITH {L} SELECT user_key, start_ts, CASE lock_type WHEN 'S' THEN 'P' ELSE lock_type END AS kind, CASE WHEN lock_type = 'S' THEN 7.5 ELSE short_value END AS short_value FROM locks",
    ),
    "txn_transfer_invariant": (
        _transfers,
        """WITH t AS (SELECT 10 + 2 * o_orderkey AS start_ts, o_custkey AS source, o_orderkey % 997 + 1 AS target, 1 + o_orderkey % 50 AS amount FROM orders WHERE o_custkey <> o_orderkey % 997 + 1),
        s AS (SELECT start_ts, source AS k, -amount AS change FROM t UNION ALL SELECT start_ts, target, amount FROM t),
        a AS (SELECT s.* FROM s JOIN customer ON c_custkey = k), w AS (SELECT k, min(start_ts) AS start_ts FROM a GROUP BY k),
        l AS (SELECT a.* FROM a JOIN w USING (k, start_ts)), n AS (SELECT start_ts, count(*) AS n FROM l GROUP BY start_ts),
        b AS (SELECT c_custkey, 1000 + coalesce(change, 0) AS balance FROM customer LEFT JOIN (SELECT l.* FROM l JOIN n USING (start_ts) WHERE n = 2) ON k = c_custkey)
        SELECT count(*) AS n_before, (1000 * count(*))::BIGINT AS total_before, 1000::BIGINT AS least_before, count(*) AS n_after, sum(balance)::BIGINT AS total_after, min(balance)::BIGINT AS least_after,
        (SELECT count(*) FROM l JOIN n USING (start_ts) WHERE n = 2) AS n_committed, (SELECT count(*) FROM l JOIN n USING (start_ts) WHERE n < 2) AS n_rolled_back, 0::BIGINT AS n_locks_left FROM b""",
    ),
    "txn_max_ts": (_oldest, f"WITH {L} SELECT max(start_ts) AS max_ts, min(start_ts) AS min_lock_ts FROM locks"),
}
