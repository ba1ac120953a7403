"""Records read by ranges, the reject channel, remote slices, folder listings."""

import csv
import datetime as dt
import io
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from canopy.sources import files as S
from canopy.sources import records, remote
from canopy.sources import rejects as R


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _local(path):
    import os
    path = path.replace("file:", "")
    os.makedirs(path, exist_ok=True)
    return path


def _field(rng):
    return "".join(rng.choice('ab,é"\n\r ') for _ in range(rng.choice((0, 1, 5, 40)))).strip("\r")


def _log_file(path, rng, rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, quoting=csv.QUOTE_MINIMAL, lineterminator=end)
    for i in range(rows):
        row = [""] * 30
        row[0], row[1], row[8] = "2024-01-01 10:00:00", f"u{i}", str(i)
        row[18], row[19], row[29] = _field(rng), _field(rng) * rng.choice((1, 1, 60)), "1 a\n2 b"
        w.writerow(row)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(out.getvalue())


def test_log_of_many_ranges_equals_the_one_task_reader(spark, tmp_dir, small_ranges):
    rng, folder = random.Random(4), _local(tmp_dir)
    _log_file(f"{folder}/a.csv", rng, 150)
    _log_file(f"{folder}/b.csv", rng, 40, end="\r\n")
    _log_file(f"{folder}/c.csv", rng, 1)
    n_ranges = records.ranges(spark, folder).agg(F.count_if("inside").alias("inside"), F.count(F.lit(1)).alias("n")).first()
    assert n_ranges["n"] > 12 and n_ranges["inside"] > 3
    got = S.load_server_log(spark, folder)
    want = []
    for name in "abc":
        with open(f"{folder}/{name}.csv", encoding="utf-8", newline="") as f:
            want += [(r[1], int(r[8]), r[18] or None, r[19] or None, r[29]) for r in csv.reader(f)]
    rows = [tuple(r) for r in got.rows.select("user_name", "transaction_id", "event_message", "event_detail", "stack_trace").collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr) and got.n_rows == 191 and got.n_rejects == 0
    tasks = records.assemble(spark, folder).where("begins and ends").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 5


def test_records_are_put_together_whatever_the_ranges(spark, tmp_dir):
    rng, folder = random.Random(8), _local(tmp_dir)
    texts = ["".join(rng.choice('xy"\n') if rng.random() < 0.6 else "z" for _ in range(rng.randint(0, 200))).replace('"', '""') for _ in range(60)]
    body = "".join(f'"{t}"\n' for t in texts)
    with open(f"{folder}/t", "w", newline="") as f:
        f.write(body)
    for size in (64, 333, 100_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        pieces = records.assemble(spark, folder).persist()
        whole = [r["text"] for r in pieces.where("begins and ends").collect()]
        joined = records.stitch(pieces.where("not (begins and ends)")).collect()
        assert sorted(whole + [r["text"] for r in joined]) == sorted(f'"{t}"' for t in texts) and all(r["reason"] is None for r in joined)
        assert (size < 1000) == bool(joined)
        pieces.unpersist()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_that_do_not_fit_come_back_with_a_reason(spark, tmp_dir, small_ranges):
    rng, folder = random.Random(5), _local(tmp_dir)
    _log_file(f"{folder}/a.csv", rng, 30)
    with open(f"{folder}/b.csv", "w") as f:
        f.write("one,two\n\n" + '2024-01-01 10:00:00,"u""x"' + "," * 7 + "not a number" + "," * 21 + "\n" + '"never closed\n' + "x\n" * 4000)
    got = S.load_server_log(spark, folder, longest=3000)
    rejects = got.rejects.collect()
    reasons = {r["reason"] for r in rejects}
    assert got.rows.count() == got.n_rows == 30 and reasons == {"does not fit the 30 columns", "record too long"}
    assert {r["segment"] for r in rejects} == {"b.csv"} and got.n_rejects == len(rejects)
    assert sum(len(r["line"]) for r in rejects if r["reason"] == "record too long") > 7500  # in parts, none of them lost
    assert max(len(r["line"]) for r in rejects) < 8000
    with open(f"{folder}/c.csv", "w") as f:
        f.write('"never closed\nx\n')
    assert "quoted field not closed" in {r["reason"] for r in S.load_server_log(spark, folder, longest=3000).rejects.collect()}
    with pytest.raises(R.RejectLimitExceeded, match="b.csv"):
        S.load_server_log(spark, folder, reject_limit=1, longest=3000)


def test_empty_log(spark, tmp_dir):
    folder = _local(tmp_dir)
    open(f"{folder}/a.csv", "w").close()
    got = S.load_server_log(spark, folder)
    assert got.rows.count() == got.n_rows == got.n_rejects == got.rejects.count() == 0


def test_gc_rejects_with_a_limit_for_each_segment(spark, tmp_dir):
    lines = [("a|1", 1), ("b|x", 1), ("c", 1), ("d|99999999999", 2), ("|5", 2), (None, 2)]
    spark.createDataFrame([x for x in lines if x[0]], "value string, segment int").write.partitionBy("segment").text(tmp_dir + "/gc")
    got = S.load_gc_log(spark, tmp_dir + "/gc", reject_limit=2)
    assert sorted(map(tuple, got.rows.collect())) == [("", 5), ("a", 1)] and (got.n_rows, got.n_rejects) == (2, 3)
    assert sorted(map(tuple, got.rejects.collect())) == [("1", "b|x", "segment is no number"), ("1", "c", "no segment"),
                                                         ("2", "d|99999999999", "segment is no number")]
    assert {(r["segment"], r["n"]) for r in R.by_segment(got.rejects).groupBy("segment").agg(F.sum("n").alias("n")).collect()} == {("1", 2), ("2", 1)}
    with pytest.raises(R.RejectLimitExceeded, match="segment 1: 2"):
        S.load_gc_log(spark, tmp_dir + "/gc", reject_limit=1)


def test_the_log_is_scanned_once(spark, tmp_dir):
    spark.createDataFrame([("a|1",), ("b",)], "value string").write.text(tmp_dir + "/gc")
    plan = S.load_gc_log(spark, tmp_dir + "/gc").rows._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "FileScan text" not in plan


@pytest.mark.parametrize("least, greatest, n", [
    (0, 99, 8), (-5, 5, 3), (7, 7, 4), (1, 3, 10), (Decimal("0.5"), Decimal("2.75"), 4), (0.25, 8.5, 5),
    (dt.date(2024, 1, 1), dt.date(2024, 3, 1), 6), (dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 6), 7)])
def test_slices_take_every_row_once(spark, least, greatest, n):
    span = greatest - least
    values = [least, greatest, None] + [least + span * k / 50 if not isinstance(least, (int, Decimal)) else least + (span * k // 50 if isinstance(least, int) else span * k / 50)
                                        for k in range(50)]
    kind = {int: "bigint", Decimal: "decimal(10,4)", float: "double", dt.date: "date", dt.datetime: "timestamp_ntz"}[type(least)]
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    parts = remote.predicates("c", least, greatest, n)
    hits = df.select(sum(F.when(F.expr(p), 1).otherwise(0) for p in parts).alias("hits"))
    assert hits.where("hits <> 1").count() == 0 and 1 <= len(parts) <= n
    if span and n <= 8 and not isinstance(least, int):
        assert len(parts) == n


def test_slices_of_other_dialects_and_types():
    assert remote.predicates("c", None, None, 4) == ["1 = 1"]
    assert "CAST('2024-01-16' AS date)" in remote.predicates("c", dt.date(2024, 1, 1), dt.date(2024, 1, 31), 2, "sqlserver")[1]
    with pytest.raises(TypeError):
        remote.predicates("c", "a", "z", 3)


def test_loads_keep_declared_lengths_and_read_in_slices(spark, tmp_dir):
    src = spark.range(1000).selectExpr("if(id % 10 = 3, null, id) as K", "concat('v', id % 7) as `v#`", "id / 8 as x")
    src.write.parquet(tmp_dir + "/src")
    opts = {"format": "parquet", "path": tmp_dir + "/src"}
    assert remote.read(spark, opts, ("K", 8)).rdd.getNumPartitions() >= 8
    spark.sql(f"CREATE TABLE canopy_kept (k bigint, `v#` varchar(5), x decimal(12,3)) USING parquet LOCATION '{tmp_dir}/kept'")
    try:
        S.load_into_table(spark, "canopy_kept", opts, ("K", 8))
        S.load_into_table(spark, "canopy_kept", opts, ("K", 3))  # truncated first
        assert spark.table("canopy_kept").count() == 1000 and spark.table("canopy_kept").where("k is null").count() == 100
        assert S.field_texts(spark, "canopy_kept") == ["k bigint", "`v#` varchar(5)", "x decimal(12,3)"]
        S.load_table_like(spark, "canopy_like", "canopy_kept", opts, location=tmp_dir + "/like")
        assert S.field_texts(spark, "canopy_like") == S.field_texts(spark, "canopy_kept")
        spark.sql(f"CREATE TABLE canopy_tight (`v#` varchar(1)) USING parquet LOCATION '{tmp_dir}/tight'")
        with pytest.raises(Exception, match="length|LENGTH"):
            S.load_into_table(spark, "canopy_tight", opts)
    finally:
        for t in ("canopy_kept", "canopy_like", "canopy_tight"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_jdbc_reads_are_cut_by_one_question_for_the_bounds(spark, monkeypatch):
    asked = {}

    class Reader:
        def jdbc(self, url, table, predicates, properties):
            asked.update(url=url, table=table, predicates=predicates, properties=properties)
            return "frame"

    class Session:
        read = Reader()

    monkeypatch.setattr(remote, "_bounds", lambda s, o, c: (1, 9))
    opts = {"url": "jdbc:postgresql://h/d", "user": "u", "password": "p", "query": "select * from t", "fetchsize": 1000}
    assert remote.read(Session(), opts, ("k", 2)) == "frame"
    assert asked == {"url": "jdbc:postgresql://h/d", "table": "(select * from t) q", "predicates": ["k < 5 OR k IS NULL", "k >= 5"],
                     "properties": {"user": "u", "password": "p", "fetchsize": "1000"}}


def test_connection_urls_of_sql_server(spark):
    reg = spark.createDataFrame([(1, "SQLServer", "h", None, 1433, "db", "u", "p"), (2, "mssql", "h", "inst", None, "db", "u", "p")],
                                "id int, type string, server_name string, instance_name string, port int, database_name string, "
                                "user_name string, pass string")
    assert S.connection_options(reg, 1) == {"url": "jdbc:sqlserver://h:1433;databaseName=db", "user": "u", "password": "p"}
    assert S.connection_options(reg, 2)["url"] == "jdbc:sqlserver://h;databaseName=db;instanceName=inst"


def test_folders_are_listed_by_tasks(spark, tmp_dir):
    spark.createDataFrame([(i % 2, f"x{i}") for i in range(10)], "seg int, value string").write.partitionBy("seg").text(tmp_dir + "/l")
    folders = spark.createDataFrame([(0, tmp_dir + "/l/seg=0"), (1, tmp_dir + "/l/seg=1"), (9, tmp_dir + "/l/none")], "segment_id int, folder string")
    files = S.list_folders(folders).where(F.col("relfilenode").endswith(".txt"))
    assert files.columns == ["segment_id", "filename", "relfilenode", "size"]
    assert {r["segment_id"]: int(r["s"]) for r in files.groupBy("segment_id").agg(F.sum("size").alias("s")).collect()} == {0: 15, 1: 15}
