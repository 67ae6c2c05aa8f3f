"""Transaction transitions as set operations: a request table in, a status for each request out.

Errors are values of the column ``status``. A request batch has each key once per transaction.
The apply_ functions give the state after such a batch: new locks and write records, as tables
that can be written as the next version. Requests that fail change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.timestamps import expired
from keystrata.operators.mvcc import snapshot

#: Columns of a write record; others of a table of records are null in those that a transition adds.
RECORD = ("user_key", "commit_ts", "start_ts", "write_type", "short_value")
#: Fixed limits of the protocol.
ONE_PC_MUTATIONS, ONE_PC_BYTES, ASYNC_KEYS, SHORT_VALUE = 64, 256 << 10, 256, 255


def _lock(locks: DataFrame, *extra: str) -> DataFrame:
    """Locks with their columns prefixed by lock_."""
    names = ("lock_type", "start_ts", *extra)
    return locks.select("user_key", *[F.col(n).alias(n if n == "lock_type" else f"lock_{n}") for n in names])


def _newest_data(writes: DataFrame) -> DataFrame:
    """Newest commit of a put or delete for each key: one grouped maximum."""
    return writes.filter(F.col("write_type").isin("P", "D")).groupBy("user_key").agg(F.max("commit_ts").alias("newest_ts"))


def _record(writes: DataFrame) -> DataFrame:
    """How a transaction ended at a key; a commit counts before a rollback mark."""
    best = F.max(F.struct((F.col("write_type") != "R").alias("committed"), F.col("commit_ts")))
    return writes.groupBy("user_key", "start_ts").agg(best.alias("r")).select("user_key", "start_ts", F.col("r.committed").alias("committed"), F.col("r.commit_ts").alias("record_ts"))


def prewrite(mutations: DataFrame, locks: DataFrame, writes: DataFrame) -> DataFrame:
    """Status of mutations (user_key, start_ts): locked, already_locked, key_locked or write_conflict."""
    rows = mutations.join(_lock(locks), "user_key", "left").join(_newest_data(writes), "user_key", "left")
    return rows.withColumn(
        "status",
        F.when(F.col("lock_start_ts") == F.col("start_ts"), "already_locked")
        .when(F.col("lock_start_ts").isNotNull(), "key_locked")
        .when(F.col("newest_ts") > F.col("start_ts"), "write_conflict")
        .otherwise("locked"),
    )


def new_locks(prewritten: DataFrame) -> DataFrame:
    """Lock rows that a prewrite adds; values above SHORT_VALUE bytes go to the values table instead."""
    short = F.octet_length("value") <= SHORT_VALUE
    return prewritten.filter("status = 'locked'").select("user_key", "op", "primary_key", "start_ts", F.when(short, F.col("value")).alias("short_value"), F.when(~short, F.col("value")).alias("long_value"))


def commit(requests: DataFrame, locks: DataFrame) -> DataFrame:
    """Status of (user_key, start_ts, commit_ts): committed, unlocked, lock_not_found or commit_ts_too_small."""
    rows = requests.join(_lock(locks, "min_commit_ts"), "user_key", "left")
    return rows.withColumn(
        "status",
        F.when(~F.col("lock_start_ts").eqNullSafe(F.col("start_ts")), "lock_not_found")
        .when(F.col("commit_ts") < F.col("lock_min_commit_ts"), "commit_ts_too_small")
        .when(F.col("lock_type") == "S", "unlocked")
        .otherwise("committed"),
    )


def rollback(requests: DataFrame, locks: DataFrame, writes: DataFrame) -> DataFrame:
    """Status of (user_key, start_ts): already_committed, already_rolled_back or rolled_back; whether a lock goes."""
    rows = requests.join(_record(writes), ["user_key", "start_ts"], "left").join(_lock(locks), "user_key", "left")
    status = F.when(F.col("committed"), "already_committed").when(~F.col("committed"), "already_rolled_back").otherwise("rolled_back")
    drops = (F.col("lock_start_ts") == F.col("start_ts")) & F.col("committed").isNull()
    return rows.withColumns({"status": status, "drops_lock": F.coalesce(drops, F.lit(False))})


def check_status(requests: DataFrame, locks: DataFrame, writes: DataFrame) -> DataFrame:
    """Status of (user_key, start_ts): locked, committed, rolled_back or unknown, and the commit timestamp."""
    rows = requests.join(_lock(locks, "ttl"), "user_key", "left").join(_record(writes), ["user_key", "start_ts"], "left")
    own = F.col("lock_start_ts").eqNullSafe(F.col("start_ts"))
    status = F.when(own, "locked").when(F.col("committed"), "committed").when(~F.col("committed"), "rolled_back").otherwise("unknown")
    return rows.withColumns({"status": status, "found_commit_ts": F.when(~own & F.col("committed"), F.col("record_ts"))})


def check_with_cleanup(requests: DataFrame, locks: DataFrame, writes: DataFrame, now_ts: Column, roll_back_missing: bool) -> DataFrame:
    """As check_status; an expired own lock is rolled back, and so is an unknown transaction if asked for."""
    rows = check_status(requests, locks, writes)
    late = (F.col("status") == "locked") & expired(F.col("start_ts"), F.col("lock_ttl"), now_ts)
    missing = F.when(F.lit(roll_back_missing), "missing_rolled_back").otherwise("unknown")
    return rows.withColumn("status", F.when(late, "expired_rolled_back").when(F.col("status") == "unknown", missing).otherwise(F.col("status")))


def heartbeat(requests: DataFrame, locks: DataFrame) -> DataFrame:
    """New time to live of (user_key, start_ts, advised_ttl): the greater one, or lock_not_found."""
    rows = requests.join(_lock(locks, "ttl"), "user_key", "left")
    own = F.col("lock_start_ts").eqNullSafe(F.col("start_ts"))
    return rows.withColumns({"status": F.when(own, "ok").otherwise("lock_not_found"), "new_ttl": F.when(own, F.greatest("lock_ttl", "advised_ttl"))})


def resolve(locks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What happens to the locks of decided transactions (start_ts, commit_ts; 0: roll back).

    The outcomes of many transactions are applied in one join; other locks aren't returned.
    """
    rows = locks.join(outcomes.select("start_ts", "commit_ts"), "start_ts")
    status = F.when(F.col("commit_ts") == 0, "rolled_back").when(F.col("commit_ts") < F.col("min_commit_ts"), "commit_ts_too_small").when(F.col("lock_type") == "S", "unlocked").otherwise("committed")
    return rows.withColumn("status", status)


def cleanup(locks: DataFrame, writes: DataFrame) -> DataFrame:
    """Every lock with the state of its primary key: locked, committed, rolled_back or unknown."""
    asked = locks.select(F.col("user_key").alias("secondary"), F.col("primary_key").alias("user_key"), "start_ts")
    found = check_status(asked, locks, writes)
    return found.select(F.col("secondary").alias("user_key"), F.col("user_key").alias("primary_key"), "start_ts", "status", "found_commit_ts")


def async_prewrite(mutations: DataFrame, locks: DataFrame, writes: DataFrame, max_ts: int) -> DataFrame:
    """Prewrite for asynchronous commit: min_commit_ts lies after the start and after every read so far."""
    later = F.greatest(F.col("start_ts") + 1, F.lit(max_ts + 1))
    rows = prewrite(mutations, locks, writes)
    return rows.withColumn("min_commit_ts", F.when(F.col("status") == "locked", later))


def async_status(requests: DataFrame, locks: DataFrame, writes: DataFrame) -> DataFrame:
    """Earliest commit timestamp of a live asynchronous transaction, else how it ended."""
    ended = check_status(requests, locks, writes)
    least = locks.select("user_key", "min_commit_ts")
    return ended.join(least, "user_key", "left").withColumn("min_commit_ts", F.when(F.col("status") == "locked", F.col("min_commit_ts")))


def check_secondaries(primaries: DataFrame, locks: DataFrame, writes: DataFrame) -> DataFrame:
    """State of each secondary (primary_key, start_ts, secondaries array): one row per secondary key."""
    each = primaries.select("primary_key", "start_ts", F.explode("secondaries").alias("user_key"))
    return check_status(each, locks, writes).select("primary_key", "start_ts", "user_key", "status", "found_commit_ts")


def one_pc(mutations: DataFrame, locks: DataFrame, writes: DataFrame, max_ts: int) -> DataFrame:
    """One-phase commit of whole transactions (start_ts): all their mutations, or none.

    A transaction is eligible up to ONE_PC_MUTATIONS mutations and below ONE_PC_BYTES of keys and values.
    """
    rows = prewrite(mutations, locks, writes)
    size = F.sum(F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0)))
    judged = rows.groupBy("start_ts").agg(F.count(F.lit(1)).alias("n_mutations"), F.coalesce(size, F.lit(0)).alias("n_bytes"), F.max(F.when(~F.col("status").isin("locked", "already_locked"), F.col("status"))).alias("problem"))
    small = (F.col("n_mutations") <= ONE_PC_MUTATIONS) & (F.col("n_bytes") < ONE_PC_BYTES)
    status = F.when(~small, "not_eligible").when(F.col("problem").isNotNull(), F.col("problem")).otherwise("committed")
    return judged.withColumns({"status": status, "commit_ts": F.when(status == "committed", F.greatest(F.col("start_ts") + 1, F.lit(max_ts + 1)))})


def async_eligible(mutations: DataFrame) -> DataFrame:
    """Whether each transaction is small enough for asynchronous commit."""
    return mutations.groupBy("start_ts").agg(F.count(F.lit(1)).alias("n_mutations"), (F.count(F.lit(1)) <= ASYNC_KEYS).alias("eligible"))


def pessimistic_lock(requests: DataFrame, locks: DataFrame, writes: DataFrame) -> DataFrame:
    """Status of (user_key, start_ts, for_update_ts); an own lock keeps the greater for_update_ts."""
    rows = requests.join(_lock(locks, "for_update_ts"), "user_key", "left").join(_newest_data(writes), "user_key", "left")
    own = F.col("lock_start_ts").eqNullSafe(F.col("start_ts"))
    status = F.when(own, "already_locked").when(F.col("lock_start_ts").isNotNull(), "key_locked").when(F.col("newest_ts") > F.col("for_update_ts"), "write_conflict").otherwise("locked")
    kept = F.when(own, F.greatest("for_update_ts", F.coalesce("lock_for_update_ts", F.lit(0)))).when(status == "locked", F.col("for_update_ts"))
    return rows.withColumns({"status": status, "new_for_update_ts": kept})


def pessimistic_prewrite(mutations: DataFrame, locks: DataFrame, writes: DataFrame) -> DataFrame:
    """Prewrite of (user_key, start_ts, is_pessimistic): own pessimistic locks are upgraded, missing ones are an error."""
    rows = prewrite(mutations, locks, writes)
    own = F.col("lock_start_ts").eqNullSafe(F.col("start_ts"))
    status = F.when(own & (F.col("lock_type") == "S"), "upgraded").when(F.col("is_pessimistic") & F.col("lock_start_ts").isNull(), "lock_not_found").otherwise(F.col("status"))
    return rows.withColumn("status", status)


def pessimistic_rollback(requests: DataFrame, locks: DataFrame) -> DataFrame:
    """Pessimistic locks that (user_key, start_ts, for_update_ts; 0: any) remove."""
    asked = requests.select("user_key", "start_ts", F.col("for_update_ts").alias("_asked"))
    rows = locks.filter("lock_type = 'S'").join(asked, ["user_key", "start_ts"])
    return rows.filter("_asked = 0 or _asked = for_update_ts").drop("_asked")


def overlay(visible: DataFrame, buffer: DataFrame, key: str = "user_key") -> DataFrame:
    """A snapshot as its own transaction sees it: buffered puts replace, buffered deletes hide rows.

    buffer: key, op (put or delete) and the columns of visible. Order and limit come after it.
    """
    kept = visible.join(buffer.select(key), key, "left_anti")
    return kept.unionByName(buffer.filter("op = 'put'").select(visible.columns))


def oldest_lock(locks: DataFrame) -> DataFrame:
    """One row: greatest and least start timestamps of locks."""
    return locks.agg(F.max("start_ts").alias("max_ts"), F.min("start_ts").alias("min_lock_ts"))


def _without(locks: DataFrame, gone: DataFrame) -> DataFrame:
    """Locks but those of (user_key, start_ts)."""
    return locks.join(gone.select("user_key", "start_ts"), ["user_key", "start_ts"], "left_anti").select(locks.columns)


def _with_records(writes: DataFrame, records: DataFrame) -> DataFrame:
    """Write records and new ones; one that is there already, of the same key and timestamps, isn't added."""
    new = records.select(*RECORD).join(writes.select("user_key", "commit_ts", "start_ts"), ["user_key", "commit_ts", "start_ts"], "left_anti")
    return writes.unionByName(new, allowMissingColumns=True)


def _marks(rows: DataFrame) -> DataFrame:
    """Rollback records of (user_key, start_ts): a mark at the start timestamp."""
    return rows.select("user_key", F.col("start_ts").alias("commit_ts"), "start_ts", F.lit("R").alias("write_type"), F.lit(None).alias("short_value")).distinct()


def apply_prewrite(mutations: DataFrame, locks: DataFrame, writes: DataFrame, ttl: int = 3000) -> DataFrame:
    """Locks after prewriting mutations (user_key, start_ts, op, primary_key, value)."""
    new = new_locks(prewrite(mutations, locks, writes))
    ahead = {"lock_type": F.col("op"), "ttl": F.lit(ttl).cast("bigint"), "for_update_ts": F.lit(0).cast("bigint"), "min_commit_ts": F.col("start_ts") + 1}
    return locks.unionByName(new.withColumns(ahead).drop("op", "long_value"), allowMissingColumns=True)


def apply_commit(requests: DataFrame, locks: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Locks and write records after committing (user_key, start_ts, commit_ts).

    A committed lock goes and leaves a record with its type and short value; a pessimistic lock
    goes without one.
    """
    done = commit(requests, locks).filter(F.col("status").isin("committed", "unlocked")).select("user_key", "start_ts", "commit_ts", "status")
    held = locks.select("user_key", "start_ts", "lock_type", "short_value")
    records = done.filter("status = 'committed'").join(held, ["user_key", "start_ts"]).withColumnRenamed("lock_type", "write_type")
    return _without(locks, done), _with_records(writes, records)


def apply_rollback(requests: DataFrame, locks: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Locks and write records after rolling back (user_key, start_ts): own locks go, a mark forbids a later prewrite."""
    judged = rollback(requests, locks, writes).filter("status = 'rolled_back'")
    return _without(locks, judged.filter("drops_lock")), _with_records(writes, _marks(judged))


def apply_check_with_cleanup(requests: DataFrame, locks: DataFrame, writes: DataFrame, now_ts: Column, roll_back_missing: bool) -> tuple[DataFrame, DataFrame]:
    """Locks and write records after check_with_cleanup: expired and, if asked for, missing transactions are rolled back."""
    late = check_with_cleanup(requests, locks, writes, now_ts, roll_back_missing).filter(F.col("status").isin("expired_rolled_back", "missing_rolled_back"))
    return _without(locks, late), _with_records(writes, _marks(late))


def apply_resolve(locks: DataFrame, outcomes: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Locks and write records after the outcomes (start_ts, commit_ts; 0: roll back) of many transactions."""
    decided = resolve(locks, outcomes).filter("status <> 'commit_ts_too_small'")
    records = decided.filter("status = 'committed'").withColumnRenamed("lock_type", "write_type")
    marks = _marks(decided.filter("status = 'rolled_back'"))
    return _without(locks, decided), _with_records(_with_records(writes, records), marks)


def apply_one_pc(mutations: DataFrame, locks: DataFrame, writes: DataFrame, max_ts: int) -> DataFrame:
    """Write records after one-phase commit of (user_key, start_ts, op, value): those of whole transactions, no locks."""
    done = one_pc(mutations, locks, writes, max_ts).filter("status = 'committed'").select("start_ts", "commit_ts")
    return _with_records(writes, mutations.join(done, "start_ts").select("user_key", "commit_ts", "start_ts", F.col("op").alias("write_type"), F.col("value").alias("short_value")))


def apply_pessimistic_prewrite(mutations: DataFrame, locks: DataFrame, writes: DataFrame) -> DataFrame:
    """Locks after a prewrite of (user_key, start_ts, is_pessimistic, op, value): own pessimistic locks get its type and value."""
    up = pessimistic_prewrite(mutations, locks, writes).filter("status = 'upgraded'").select("user_key", "start_ts", F.col("op").alias("_op"), F.col("value").alias("_value"))
    rows = locks.join(up, ["user_key", "start_ts"], "left")
    changed = {"lock_type": F.coalesce("_op", "lock_type"), "short_value": F.when(F.col("_op").isNotNull(), F.col("_value")).otherwise(F.col("short_value"))}
    return rows.withColumns(changed).select(locks.columns)


def apply_pessimistic_rollback(requests: DataFrame, locks: DataFrame) -> DataFrame:
    """Locks without the pessimistic ones that the requests remove."""
    return _without(locks, pessimistic_rollback(requests, locks))


def transfer(accounts: DataFrame, transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Locks and write records after a batch of transfers (start_ts, source, target, amount) in two phases.

    accounts are write records whose short value is a balance. A transfer reads both balances at its
    start, prewrites both keys and commits them at start_ts + 1. Of transfers that meet on a key the
    earliest wins there; one that doesn't win both keys, or lacks an account, is rolled back whole.
    """
    sides = transfers.filter("source <> target").select("start_ts", F.explode(F.array(F.struct(F.col("source").alias("user_key"), (-F.col("amount")).alias("change")), F.struct(F.col("target").alias("user_key"), F.col("amount").alias("change")))).alias("s"), F.col("source").alias("primary_key"))
    sides = sides.select("start_ts", "primary_key", "s.*")
    balances = snapshot(accounts).select("user_key", F.col("short_value").alias("balance"))
    asked = sides.join(balances, "user_key")
    earliest = asked.groupBy("user_key").agg(F.min("start_ts").alias("winner"))
    asked = asked.join(earliest, "user_key").withColumns({"op": F.lit("P"), "value": F.col("balance") + F.col("change")})
    held = accounts.limit(0).select("user_key", F.lit("").alias("lock_type"), F.lit("").alias("primary_key"), "start_ts", *[F.lit(0).cast("bigint").alias(c) for c in ("ttl", "for_update_ts", "min_commit_ts")], "short_value")
    locks = apply_prewrite(asked.filter("start_ts = winner").select("user_key", "start_ts", "op", "primary_key", "value"), held, accounts)
    whole = locks.groupBy("start_ts").agg(F.count(F.lit(1)).alias("n"))
    outcomes = whole.select("start_ts", F.when(F.col("n") == 2, F.col("start_ts") + 1).otherwise(0).cast("bigint").alias("commit_ts"))
    return apply_resolve(locks, outcomes, accounts)
