"""Admin one-liners (B1-B6): activity list, lock filter, status counts and spans, top-k lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.strings import query_collapsed


def activity_list(activity: DataFrame, as_of: str, hide_idle: bool = False) -> DataFrame:
    """B1. Database, process, session and user with the running time, query text with white space collapsed to 80 characters, longest first."""
    df = activity.filter(F.col("current_query") != "<IDLE>") if hide_idle else activity
    t0 = F.lit(as_of).cast("timestamp_ntz").cast("timestamp")
    running = ((F.unix_micros(t0) - F.unix_micros(F.col("query_start").cast("timestamp"))) / 1_000_000).cast("bigint")
    who = [c for c in ("datname", "procpid") if c in activity.columns]  # a snapshot may lack them
    return df.select(*who, "sess_id", "usename", running.alias("running_sec"),
                     query_collapsed(F.col("current_query")).alias("query_text")).orderBy(F.desc("running_sec"))


def ungranted_locks(locks: DataFrame) -> DataFrame:
    """B2. Locks not granted."""
    return locks.filter(~F.col("granted"))


def status_counts(tasks: DataFrame, status: str, worker: str) -> DataFrame:
    """B3. Count per (status, worker), ordered by both."""
    return tasks.groupBy(F.col(status).alias("replication_status"), F.col(worker).alias("replication_worker")) \
        .agg(F.count(F.lit(1)).alias("cnt")).orderBy("replication_status", "replication_worker")


def status_span(tasks: DataFrame, status: str, ts: str) -> DataFrame:
    """B4. Count, first and last time per status."""
    return tasks.groupBy(F.col(status).alias("replication_status")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min(ts).alias("first_added"), F.max(ts).alias("last_added"))


def last_rows(df: DataFrame, ts: str, n: int, tie: list[str]) -> DataFrame:
    """B5. The ``n`` latest rows (a top-k report: the limit is the feature); ``tie`` makes the order total."""
    return df.orderBy(F.desc(ts), *[F.desc(t) for t in tie]).limit(n)


def last_jobs(queue: DataFrame, groups: DataFrame, on, ts: str, n: int, tie: list[str]) -> DataFrame:
    """B6. Queue joined with its group, the ``n`` latest by submit time."""
    return last_rows(queue.join(groups, on), ts, n, tie)
