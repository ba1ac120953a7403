"""Structured Streaming jobs run with availableNow over files; restart picks up only new files."""

from pyspark.sql import functions as F

from canopy.streaming import ingest as ST

PS = ("{pid} 1 2048 4096 1.5 0.3 00:00:01 01:00 10:00 - S 3 postgres: port 40000, u db1 10.0.0.1(5555) "
      "con{s} seg1 cmd2 slice1 SELECT")


def test_process_ingestion_restart(spark, tmp_dir):
    src, out, ck = tmp_dir + "/in", tmp_dir + "/out", tmp_dir + "/ck"
    spark.createDataFrame([(f"1|{PS.format(pid=i, s=7)}",) for i in range(5)], "value string").write.text(src + "/a")
    ST.ingest_process_snapshots(spark, src + "/*", out, ck, read_time=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
                                available_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == 5
    spark.createDataFrame([(f"2|{PS.format(pid=i, s=8)}",) for i in range(3)], "value string").write.text(src + "/b")
    ST.ingest_process_snapshots(spark, src + "/*", out, ck, read_time=F.lit("2024-01-01 00:01:00").cast("timestamp_ntz"),
                                available_now=True).awaitTermination()
    df = spark.read.parquet(out)
    assert df.count() == 8 and df.filter(F.col("session_id") == 8).count() == 3


def _gc_line(hh, mm, secs=1.0, seg=0):
    return (f"2024-01-15T{hh:02d}:{mm:02d}:00.000+0000: 1.5: [Full GC [PSYoungGen: 5K->0K(20K)] "
            f"[PSOldGen: 60K->50K(70K)] 65K->50K(90K) [PSPermGen: 9K->9K(21K)], {secs:.4f} secs]|{seg}")


def _run(spark, tmp_dir, name, lines):
    """One more file of lines, through both streams."""
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{tmp_dir}/in/{name}")
    ST.ingest_gc_log(spark, f"{tmp_dir}/in/*", tmp_dir + "/table", tmp_dir + "/ck1", available_now=True).awaitTermination()
    q = ST.rolling_gc_counters(spark, tmp_dir + "/table", tmp_dir + "/out", tmp_dir + "/ck2", available_now=True, state_partitions=2)
    q.awaitTermination()
    return ST.latest_windows(spark, tmp_dir + "/out")


def test_rolling_gc_counters(spark, tmp_dir):
    w = _run(spark, tmp_dir, "a", [_gc_line(10, m, 100.0) for m in range(0, 60, 8)])
    top = w.orderBy(F.desc("full_gc_events")).first()
    assert top["full_gc_events"] == 8 and top["events_error"] and top["time_error"]


def test_rolling_gc_counters_drop_late_rows(spark, tmp_dir):
    _run(spark, tmp_dir, "b1", [_gc_line(12, 0), _gc_line(12, 30)])
    # a second batch: one row far behind the watermark (late, dropped), one on time
    w = _run(spark, tmp_dir, "b2", [_gc_line(9, 0), _gc_line(12, 31)])
    assert w.filter(F.hour("window_start") < 9).count() == 0 and w.filter(F.hour("window_end") <= 9).count() == 0
    assert w.agg(F.max("full_gc_events")).first()[0] == 3


def test_rejected_lines_are_kept_with_the_rows(spark, tmp_dir):
    _run(spark, tmp_dir, "part=7", [_gc_line(12, 0), "torn", "x|y"])
    assert ST.gc_rows(spark, tmp_dir + "/table").count() == 1
    assert {tuple(r) for r in ST.gc_rejects(spark, tmp_dir + "/table").collect()} == {("7", "torn", "no segment"), ("7", "x|y", "segment is no number")}


def test_closed_windows_leave_the_open_ones(spark, tmp_dir):
    """Whatever the number of batches, a window has one row, and the last batch holds open windows only."""
    lines = [(h, m) for h in range(8, 14) for m in (0, 20, 41)]
    for k in range(0, len(lines), 3):
        w = _run(spark, tmp_dir, f"f{k}", [_gc_line(h, m) for h, m in lines[k:k + 3]])
    got = {(str(r["window_start"]), r["full_gc_events"]) for r in w.collect()}
    want = {}
    for h, m in lines:
        for b in range((60 * h + m) // 5 * 5 - 55, (60 * h + m) // 5 * 5 + 1, 5):
            key = f"2024-01-15 {b // 60:02d}:{b % 60:02d}:00"
            want[key] = want.get(key, 0) + 1
    assert got == set(want.items()) and w.count() == len(want)
    from canopy import store
    assert len(store.names(spark, tmp_dir + "/out/open")) <= 2
    still_open = spark.read.parquet(tmp_dir + "/out/open/" + store.names(spark, tmp_dir + "/out/open")[-1]).where("not closed").count()
    assert still_open <= 15 and spark.read.parquet(tmp_dir + "/out/closed").count() == len(want) - still_open
