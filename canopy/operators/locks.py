"""Lock views (Q1-Q3) over snapshot DataFrames.

Inputs: ``locks(relation, locktype, transactionid, pid, mppsessionid, mode, granted)``,
``activity(sess_id, usename, query_start, backend_start, client_addr, current_query)``,
``relations(oid, relname, relnamespace)``, ``schemas(oid, nspname)``. ``as_of`` replaces
``current_timestamp``; durations are whole seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.strings import query_short


def _seconds_since(as_of: str, ts: Column) -> Column:
    t0 = F.lit(as_of).cast("timestamp_ntz").cast("timestamp")
    return ((F.unix_micros(t0) - F.unix_micros(ts.cast("timestamp"))) / 1_000_000).cast("bigint")


def locks_all(locks: DataFrame, activity: DataFrame, relations: DataFrame, schemas: DataFrame, as_of: str) -> DataFrame:
    """Q1. The read time and locks FULL JOIN activity, LEFT JOIN relation and schema; ordered by session, pid, schema, relation.

    The full join is written as locks LEFT JOIN activity plus the activity rows of sessions without
    locks (anti join on the distinct lock sessions): a session holding a third of all locks is then a
    skewed key of a left join, which adaptive execution splits; a full outer join it would not."""
    l, a = locks.alias("l"), activity.alias("a")
    c = relations.select(F.col("oid").alias("c_oid"), "relname", "relnamespace")
    n = schemas.select(F.col("oid").alias("n_oid"), "nspname")
    with_activity = l.join(a, F.col("l.mppsessionid") == F.col("a.sess_id"), "left")
    lock_sessions = locks.select(F.col("mppsessionid").alias("__s")).filter(F.col("__s").isNotNull()).distinct()
    idle = activity.join(lock_sessions, activity["sess_id"] == lock_sessions["__s"], "left_anti")
    no_locks = idle.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in locks.schema.fields],
                           *[F.col(f.name) for f in activity.schema.fields]).alias("x")
    both = with_activity.select(*[F.col(f"l.{f.name}") for f in locks.schema.fields],
                                *[F.col(f"a.{f.name}") for f in activity.schema.fields]).unionByName(no_locks)
    both = both.alias("l")
    j = (both.join(c, F.col("l.relation") == F.col("c_oid"), "left")
         .join(n, F.col("relnamespace") == F.col("n_oid"), "left"))
    return j.select(F.lit(as_of).cast("timestamp_ntz").alias("read_time"), "nspname", "relname", "locktype", "transactionid", "pid", "mppsessionid", "mode",
                    "granted", "usename", "query_start", "backend_start", "client_addr",
                    query_short(F.col("current_query")).alias("query_short"), "current_query") \
        .orderBy("mppsessionid", "pid", "nspname", "relname")


#: Waiting sessions of one relation that a task pairs, at least; and relations with more than that, at most.
BLOCK, MOST_HOT = 1_000, 10_000


def _dealt(waiting: DataFrame) -> DataFrame:
    """``(relation, blocks)`` of the relations whose waiting sessions are dealt into blocks; at most ``MOST_HOT`` rows, as a
    block has at least one waiting row in ``MOST_HOT``."""
    size = F.greatest(F.lit(BLOCK), F.ceil(waiting.agg(F.count(F.lit(1))).scalar() / MOST_HOT))
    per = waiting.groupBy(F.col("relation").alias("hot")).agg(F.count(F.lit(1)).alias("n"))
    return per.where(F.col("n") > size).select("hot", F.ceil(F.col("n") / size).cast("int").alias("blocks"))


def locks_blockers(locks: DataFrame, activity: DataFrame, relations: DataFrame, schemas: DataFrame,
                   as_of: str) -> DataFrame:
    """Q2. Granted locks against waiting ones on the same relation by another session.

    All sides are first reduced: locks to one row per (relation, session) (min mode of the granted locks,
    max mode of the waiting ones), activity to one per session, names to one per relation. The waiting sessions of a hot
    relation are dealt into blocks, and its holders and its name are copied to each: every join on a relation goes by
    (relation, block), so a relation with a third of all locks is paired by many tasks."""
    work = activity.where(F.col("sess_id").isNotNull()).groupBy("sess_id").agg(
        F.min("query_start").alias("start"), F.min(query_short(F.col("current_query"))).alias("short"), F.min("current_query").alias("query"))
    n = schemas.select(F.col("oid").alias("n_oid"), "nspname")
    named = (relations.join(n, F.col("relnamespace") == F.col("n_oid")).groupBy("oid")
             .agg(F.min("nspname").alias("table_schema"), F.min("relname").alias("table_name")))

    def side(rows: DataFrame, mode: Column, prefix: str) -> DataFrame:
        per = rows.groupBy("relation", "mppsessionid").agg(mode.alias(f"{prefix}_mode"))
        return per.join(work.select("sess_id", *[F.col(c).alias(f"{prefix}_{c}") for c in ("start", "short", "query")]),
                        F.col("mppsessionid") == F.col("sess_id")).drop("sess_id").withColumnRenamed("mppsessionid", f"{prefix}_session")

    held = side(locks.filter(F.col("granted")), F.min("mode"), "b")
    waiting = side(locks.filter(~F.col("granted")), F.max("mode"), "w")
    hot = F.broadcast(_dealt(waiting))  # bounded, see there

    def in_blocks(df: DataFrame, key: str, block: Column) -> DataFrame:
        return df.join(hot, F.col(key) == F.col("hot"), "left").withColumn("block", block).drop("hot", "blocks")

    every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    one = F.coalesce(F.pmod(F.hash("w_session"), F.col("blocks")), F.lit(0))
    pairs = (in_blocks(waiting, "relation", one)
             .join(in_blocks(held, "relation", every), ["relation", "block"]).where(F.col("b_session") != F.col("w_session"))
             .join(in_blocks(named, "oid", every).withColumnRenamed("oid", "relation"), ["relation", "block"]))
    return pairs.select("table_schema", "table_name", F.col("b_mode").alias("lock_type_blocker"), F.col("w_mode").alias("lock_type_waiting"),
                        F.col("b_start").alias("lock_start_dttm"), _seconds_since(as_of, F.col("w_start")).alias("lock_duration_sec"),
                        F.col("b_short").alias("blocker_query_short"), F.col("w_short").alias("waiting_query_short"),
                        F.col("b_query").alias("blocker_query"), F.col("w_query").alias("waiting_query"), "relation",
                        F.col("b_session").alias("session_id_blocker"), F.col("w_session").alias("session_id_waiting"))


def locks_blocked(locks: DataFrame, activity: DataFrame, relations: DataFrame, schemas: DataFrame,
                  as_of: str) -> DataFrame:
    """Q3. Waiting locks by relation and session: count and waiting time."""
    a = activity.select(F.col("sess_id"), "query_start", "current_query")
    c = relations.select(F.col("oid").alias("c_oid"), "relname", "relnamespace")
    n = schemas.select(F.col("oid").alias("n_oid"), "nspname")
    j = (locks.filter(~F.col("granted"))
         .join(a, F.col("mppsessionid") == F.col("sess_id"))
         .join(c, F.col("relation") == F.col("c_oid"))
         .join(n, F.col("relnamespace") == F.col("n_oid")))
    g = j.groupBy("relation", "mppsessionid").agg(
        F.min("nspname").alias("table_schema"), F.min("relname").alias("table_name"),
        F.min("mode").alias("blocked_lock_type"), F.count(F.lit(1)).alias("segments_blocked"),
        F.min("query_start").alias("__start"),
        F.min(query_short(F.col("current_query"))).alias("waiting_query_short"),
        F.min("current_query").alias("waiting_query"))
    return g.select("table_schema", "table_name", "blocked_lock_type", "segments_blocked",
                    _seconds_since(as_of, F.col("__start")).alias("lock_waiting_time_sec"),
                    "waiting_query_short", "waiting_query", "relation", "mppsessionid")
