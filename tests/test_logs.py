"""GC, process and lock analytics on small hand-made inputs (FIXTURES.md section 5)."""

import datetime as dt

from pyspark.sql import functions as F

from canopy.operators import gclog as G
from canopy.operators import locks as Q
from canopy.operators import process as M
from canopy.operators import reports as B
from canopy.sources.files import split_gc_lines

GC_LINES = [
    "2014-01-01T00:00:01.123+0000: 1.5: [GC [PSYoungGen: 10K->5K(20K)] 30K->25K(90K), 0.0100 secs]",
    "2014-01-01T00:00:02.123+0000: 2.5: [GC 2.5: [DefNew: 10K->5K(20K), 0.0100 secs] 30K->25K(90K), 0.0200 secs]",
    "2014-01-01T00:00:03.123+0000: 3.5: [Full GC [PSYoungGen: 5K->0K(20K)] [PSOldGen: 60K->50K(70K)] "
    "65K->50K(90K) [PSPermGen: 9K->9K(21K)], 0.0500 secs]",
    "anything else",
]


def test_gc_patterns(spark):
    df = spark.createDataFrame([(line, 0) for line in GC_LINES], "gclogline string, gp_segment int")
    r = G.gc_table(df).collect()
    assert [x["is_full"] for x in r] == [0, 0, 1, None]
    assert [x["gc_runtime_sec"] for x in r] == [0.01, 0.02, 0.05, None]
    full = r[2]
    assert (full["old_gen_old_size_kb"], full["old_gen_new_size_kb"], full["old_gen_max_size_kb"]) == (60, 50, 70)
    assert (full["perm_gen_old_size_kb"], full["perm_gen_new_size_kb"], full["perm_gen_max_size_kb"]) == (9, 9, 21)
    assert (full["full_heap_old_size_kb"], full["full_heap_new_size_kb"], full["full_heap_max_size_kb"]) == (65, 50, 90)
    assert r[0]["old_gen_old_size_kb"] is None and r[0]["young_gen_new_size_kb"] == 5
    assert full["gc_start"] == dt.datetime(2014, 1, 1, 0, 0, 3, 123000)
    assert all(v is None for v in r[3].asDict().values() if v != "anything else" and v != 0)


def test_gc_line_source_reject_limit(spark):
    df = spark.createDataFrame([("a|1",), ("b|x",), ("c",)], "value string")
    assert split_gc_lines(df).count() == 1
    import pytest
    from canopy.sources.files import RejectLimitExceeded
    with pytest.raises(RejectLimitExceeded):
        split_gc_lines(df, reject_limit=1)


def _full(seg, ts, new=50, mx=90, secs=0.5):
    return (f"{ts}+0000: 1.5: [Full GC [PSYoungGen: 5K->0K(20K)] [PSOldGen: 60K->50K(70K)] "
            f"65K->{new}K({mx}K) [PSPermGen: 9K->9K(21K)], {secs:.4f} secs]", seg)


def test_gc_reports_and_alerts(spark):
    lines = [_full(0, "2024-01-15T10:00:00.000"), _full(0, "2024-01-15T11:00:00.000"),
             _full(0, "2024-01-15T11:10:00.000", new=80),
             _full(1, "2024-01-15T11:30:00.000")]  # one full GC only: NULL intervals, no alert
    gc = G.gc_table(spark.createDataFrame(lines, "gclogline string, gp_segment int"))
    iv = {r["gp_segment"]: r for r in G.full_gc_intervals(gc).collect()}
    assert iv[0]["avg_full_gc_interval"] == 2100.0 and iv[0]["full_gc_interval"] == 600.0  # (3600 + 600) / 2
    assert iv[1]["avg_full_gc_interval"] is None
    last = {r["gp_segment"]: r["full_heap_new_size_kb"] for r in G.heap_after_full_gc(gc).collect()}
    first = {r["gp_segment"]: r["full_heap_new_size_kb"] for r in G.heap_after_full_gc(gc, "first").collect()}
    assert last[0] == 80 and first[0] == 50
    cnt = {r["gp_segment"]: r["events"] for r in G.full_gc_count_last_hour(gc, "2024-01-15 12:00:00").collect()}
    assert cnt == {0: 1, 1: 1}
    alerts = {(r["gp_segment"], r["rule"]): r["is_error"] for r in G.gc_alerts(gc, "2024-01-15 12:00:00").collect()}
    assert alerts[(0, "fullgc_interval")] is True      # 600 * 2 < 2100
    assert alerts[(1, "fullgc_interval")] is False
    assert alerts[(0, "fullgc_heap")] is True          # 90 * 0.8 < 80


def test_ps_parse(spark):
    good = ("123 1 2048 4096 1.5 0.3 00:00:01 01:00 10:00 - S 3 postgres: port 40000, gpadmin db1 "
            "10.0.0.1(5555) con77 seg3 cmd9 slice2 SELECT")
    noslice = good.replace("slice2 ", "")
    rows = [("3", good), ("3", noslice), ("3", " " + good),
            ("1", "1 1 1 1 1 1 x postgres: port 4, stats collector process con1 seg1 cmd1")]
    df = spark.createDataFrame(rows, "segment_id string, command string")
    parsed = [r["ps"] for r in df.select(M.parse_ps_line("command").alias("ps")).collect()]
    assert parsed[0] == ["123", "2048", "4096", "1.5", "0.3", "gpadmin", "db1", "77", "3", "9", "slice2"]
    assert parsed[1][-1] is None and parsed[2] is None and parsed[3] is None
    view = M.mem_watcher_view(df, "2024-01-01 00:00:00").collect()
    assert len(view) == 2 and view[0]["rss"] == 2048 and view[0]["command_id"] == 9


def test_memory_skew(spark):
    rows = [(s, 1, 7, r * 1024, r * 2048) for s, r in [(0, 10), (1, 30), (2, 20)]] + [(0, 2, 1, 0, 0)]
    mem = spark.createDataFrame(rows, "segment_id int, session_id int, command_id int, rss bigint, vsz bigint")
    r = {x["session_id"]: x for x in M.memory_skew(mem).collect()}
    assert float(r[1]["real_mem_skew"]) == 1.0 and float(r[1]["max_real_mem_mb"]) == 30.0
    assert r[2]["real_mem_skew"] is None   # zero average: NULL instead of an error


def _lock_frames(spark):
    locks = spark.createDataFrame(
        [(10, "relation", 1, 100, 1, "ExclusiveLock", True), (10, "relation", 2, 101, 2, "ShareLock", False),
         (10, "relation", 2, 102, 2, "AccessShareLock", False), (11, "relation", 3, 103, 3, "ShareLock", False)],
        "relation long, locktype string, transactionid int, pid long, mppsessionid long, mode string, granted boolean")
    t = dt.datetime(2024, 1, 1, 0, 0)
    activity = spark.createDataFrame(
        [(1, "u1", t, t, "10.0.0.1", "update  t set x=1"), (2, "u2", t + dt.timedelta(minutes=5), t, "10.0.0.2", "select 1"),
         (4, "idle", t, t, None, "<IDLE>")],
        "sess_id long, usename string, query_start timestamp_ntz, backend_start timestamp_ntz, client_addr string, "
        "current_query string")
    relations = spark.createDataFrame([(10, "t", 1), (11, "u", 1)], "oid long, relname string, relnamespace long")
    schemas = spark.createDataFrame([(1, "public")], "oid long, nspname string")
    return locks, activity, relations, schemas


def test_lock_views(spark):
    frames = _lock_frames(spark)
    allrows = Q.locks_all(*frames, "2024-01-01 01:00:00").collect()
    assert len(allrows) == 5  # 4 locks + 1 session without locks (full join)
    b = Q.locks_blockers(*frames, as_of="2024-01-01 01:00:00").collect()
    assert len(b) == 1
    assert (b[0]["session_id_blocker"], b[0]["session_id_waiting"], b[0]["lock_type_waiting"]) == (1, 2, "ShareLock")
    assert b[0]["lock_duration_sec"] == 3300 and b[0]["blocker_query_short"] == "updatet set x=1"
    w = {r["mppsessionid"]: r for r in Q.locks_blocked(*frames, as_of="2024-01-01 01:00:00").collect()}
    assert w[2]["segments_blocked"] == 2 and w[2]["blocked_lock_type"] == "AccessShareLock"
    assert 3 not in w  # no activity row for session 3


def test_reports(spark):
    locks, activity, _, _ = _lock_frames(spark)
    act = B.activity_list(activity, "2024-01-01 01:00:00", hide_idle=True).collect()
    assert [r["sess_id"] for r in act] == [1, 2] and act[0]["query_text"] == "update t set x=1"
    assert B.ungranted_locks(locks).count() == 3
    top = B.last_rows(locks, "transactionid", 2, ["pid"]).collect()
    assert [r["pid"] for r in top] == [103, 102]


def test_gc_intervals_match_lag_window(spark):
    import random
    from pyspark.sql import Window
    rnd = random.Random(5)
    lines = [_full(rnd.randint(0, 3), f"2024-01-15T{rnd.randint(0, 11):02d}:{rnd.randint(0, 59):02d}:00.000")
             for _ in range(300)] + [_full(9, "2024-01-15T10:00:00.000"), _full(9, "2024-01-15T10:00:00.000")]
    gc = G.gc_table(spark.createDataFrame(lines, "gclogline string, gp_segment int"))
    got = {r["gp_segment"]: (r["avg_full_gc_interval"], r["full_gc_interval"]) for r in G.full_gc_intervals(gc).collect()}
    t = F.unix_micros(F.col("gc_start").cast("timestamp"))
    w = Window.partitionBy("gp_segment").orderBy("gc_start")
    iv = gc.select("gp_segment", "gc_start", ((t - F.lag(t).over(w)) / 1e6).alias("iv"))
    want = {r["gp_segment"]: r["a"] for r in iv.groupBy("gp_segment").agg(F.avg("iv").alias("a")).collect()}
    for seg, a in want.items():
        assert abs(got[seg][0] - a) < 1e-6
    assert got[9] == (0.0, 0.0)  # two full GCs at the same instant
