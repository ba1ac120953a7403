"""Sources, loads, sinks, lookup, parameters and scoped rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.operators import lookup as K
from canopy.operators.params import Params
from canopy.operators.scoped import SESSION_COL, SessionTable
from canopy.sources import files as S
from canopy.sources import sinks as O


def test_server_log_csv(spark, tmp_dir):
    import os
    os.makedirs(tmp_dir.replace("file:", ""), exist_ok=True)
    fields = ["" for _ in range(30)]
    fields[0] = "2024-01-01 10:00:00"
    fields[1] = "gpadmin"
    fields[8] = "42"
    fields[18] = '"he said ""hi""\nand left"'
    line = ",".join(fields)
    path = tmp_dir.replace("file:", "") + "/log.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write(line + "\n")
    r = S.read_server_log(spark, path).collect()
    assert len(r) == 1
    assert r[0]["user_name"] == "gpadmin" and r[0]["transaction_id"] == 42
    assert r[0]["event_message"] == 'he said "hi"\nand left'
    assert r[0]["database_name"] is None and r[0]["file_line"] is None


def test_table_list_and_listing(spark, tmp_dir):
    spark.createDataFrame([("  public.a \t",), ("",), ("   ",), ("b",)], "value string").write.text(tmp_dir + "/list")
    assert sorted(r[0] for r in S.read_table_list(spark, tmp_dir + "/list").collect()) == ["b", "public.a"]
    spark.range(10).write.parquet(tmp_dir + "/data")
    files = S.read_file_listing(spark, tmp_dir + "/data", glob="*.parquet").collect()
    assert files and all(r["size"] > 0 for r in files)


def test_connection_options(spark):
    reg = spark.createDataFrame([(1, "oracle", "h", "orcl", 1521, "db", "u", "p"),
                                 (2, "postgresql", "h2", None, 5432, "db2", "u2", "p2")],
                                "id int, type string, server_name string, instance_name string, port int, "
                                "database_name string, user_name string, pass string")
    assert S.connection_options(reg, 1)["url"] == "jdbc:oracle:thin:@//h:1521/orcl"
    assert S.connection_options(reg, 2) == {"url": "jdbc:postgresql://h2:5432/db2", "user": "u2", "password": "p2"}
    with pytest.raises(KeyError):
        S.connection_options(reg, 3)


def test_load_conforms_by_name(spark, tmp_dir):
    src = spark.createDataFrame([("x", 1.234, 7)], "C string, b double, a long")
    src.write.parquet(tmp_dir + "/src")
    target = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DecimalType(5, 2)),
                           T.StructField("c", T.StringType())])
    out = S.load_from_source(spark, tmp_dir + "/t", target, {"format": "parquet", "path": tmp_dir + "/src"})
    r = out.first()
    assert out.columns == ["a", "b", "c"] and r["a"] == 7 and str(r["b"]) == "1.23" and r["c"] == "x"
    with pytest.raises(KeyError):
        S.conform(src, T.StructType([T.StructField("zz", T.IntegerType())]))
    assert S.field_list(spark.createDataFrame([(1, 2)], "`a#b` int, c int")) == ["`a#b`", "c"]


def test_dump_escapes(spark, tmp_dir):
    df = spark.createDataFrame([(1, 'a|b', 'q"x', "l1\nl2", None, "back\\slash")],
                               "i int, p string, q string, n string, z string, b string")
    O.dump_delimited(df, tmp_dir + "/dump")
    line = spark.read.text(tmp_dir + "/dump").first()[0]
    assert line == '1|a\\|b|q\\"x|l1\\'
    full = spark.read.option("lineSep", "\x00").text(tmp_dir + "/dump").first()[0]
    assert full == '1|a\\|b|q\\"x|l1\\\nl2||back\\\\slash\n'


def test_csv_export_and_table_writes(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    O.export_csv(df, tmp_dir + "/csv")
    back = spark.read.option("header", True).option("sep", "|").csv(tmp_dir + "/csv")
    assert sorted(tuple(r) for r in back.collect()) == [("1", "a"), ("2", "b")]
    O.write_table(df, tmp_dir + "/t", mode="overwrite", repartition_by=["k"])
    O.write_table(df, tmp_dir + "/t", mode="append")
    assert spark.read.parquet(tmp_dir + "/t").count() == 4
    O.write_table(df.limit(1), tmp_dir + "/t", mode="overwrite")
    assert spark.read.parquet(tmp_dir + "/t").count() == 1


def test_lookup(spark):
    d = spark.range(1, 10001).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), (F.col("id") * 3).alias("c"))
    lk = K.memlookup_load(d, ["a"], ["b", "c"])
    assert lk.table.count() == 10000
    probe = spark.range(1, 10002).select(F.col("id").alias("a"))
    assert K.lookup_aggregate(probe, lk, ["a"], "c").first()[0] == 30000
    found = K.memlookup_find(probe, lk, ["a"], "b").filter(F.col("a") == 10001).first()
    assert found["b"] is None
    with pytest.raises(K.LookupError_):
        K.memlookup_find(probe, lk, ["a"], "nope")
    dup = d.unionByName(d.limit(1))
    with pytest.raises(K.LookupError_):
        K.memlookup_load(dup, ["a"], ["b"])
    assert K.memlookup_load(dup, ["a"], ["b"], dedupe="max").table.count() == 10000


def test_params(spark, tmp_dir):
    p = Params(spark)
    for k, v in [("test1", "aaa"), ("test2", "bbb"), ("test3", "ccc")]:
        p.setparamv(k, v)
    p.setparamn("num", 12.5)
    p.setparamd("day", "2024-03-01")
    p.setparamt("stamp", "2024-03-01 10:00:00")
    assert p.get("test2") == "bbb" and float(p.get("num", "n")) == 12.5 and str(p.get("day", "d")) == "2024-03-01"
    p.setparamn("test3", 7)            # one name space: another type replaces
    assert p.get("test3") == "7"
    p.setparamn("fine", "1.123456789012345")
    assert p.get("fine") == "1.123456789012345" and str(p.get("fine", "n")) == "1.123456789012345"
    p.setparamv("as_text", "0.25")
    assert str(p.get("as_text", "n")) == "0.25"
    p.set_from_query("computed", "SELECT CAST(2.50 AS DECIMAL(10,3))", "n")
    assert p.get("computed") == "2.500" and p.get("missing", "n") is None
    rows = spark.createDataFrame([(1, "test1"), (2, "test2"), (3, "test3"), (4, "test4")], "k int, name string")
    got = {r["k"]: r["v"] for r in p.lookup(rows, "name", "v").collect()}
    assert got[1] == "aaa" and got[4] is None
    assert "test1 -> aaa" in {r[0] for r in p.listentries().collect()}
    p.savetotable(tmp_dir + "/params")
    q = Params(spark)
    q.readfromtable(tmp_dir + "/params")
    assert q.get("test1") == "aaa"
    spark.range(5).createOrReplaceTempView("canopy_nums")
    p.setparamn("lim", 2)
    p.view("canopy_small", "SELECT * FROM canopy_nums WHERE id < session.lim")
    assert spark.table("canopy_small").count() == 2
    p.setparamn("lim", 4)
    assert spark.table("canopy_small").count() == 4


def test_scoped_table(spark, tmp_dir):
    from decimal import Decimal

    def rows(*ks):
        return spark.createDataFrame([(Decimal(k), k) for k in ks], "isn decimal(10,0), foo int")
    t = SessionTable.create(spark, tmp_dir + "/scoped", ["isn decimal(10,0)", "foo int"])
    t.insert(rows(1, 2, 3), "me")
    t.insert(rows(4, 5, 6), None)
    t.insert(rows(7), "other")
    assert sorted(r["foo"] for r in t.read("me").collect()) == [1, 2, 3]
    assert SESSION_COL not in t.read("me").columns
    t.cleanup("me")
    assert t.read("me").count() == 0 and t.base().count() == 4
    t.full_cleanup(spark.createDataFrame([("other",)], "sess_id string"), reorganize=True)
    assert [r["foo"] for r in t.base().collect()] == [7]


def test_sessions_with_ids_that_look_alike(spark, tmp_dir):
    from canopy.operators.scoped import SessionTable
    t = SessionTable.create(spark, f"{tmp_dir}/alike", ["x int"])
    for session in ("1", "01", "text"):
        t.insert(spark.createDataFrame([(len(session),)], "x int"), session)
    assert [[r.x for r in t.read(s).collect()] for s in ("1", "01", "text")] == [[1], [2], [4]]


def test_cleanups_hold_for_other_processes(spark, tmp_dir):
    t = SessionTable.create(spark, f"{tmp_dir}/durable", ["x int"])
    for k, session in enumerate(["a b/ü%", "ab", "gone", None]):
        t.insert(spark.createDataFrame([(k,)], "x int"), session)
    t.cleanup("a b/ü%")
    again = SessionTable(spark, f"{tmp_dir}/durable")  # knows the path only
    assert sorted(r.x for r in again.base().collect()) == [1, 2, 3]
    t.cleanup("never seen")
    again.full_cleanup(spark.createDataFrame([("ab",)], "sess_id string"))
    assert [r.x for r in SessionTable(spark, f"{tmp_dir}/durable").base().collect()] == [1]
    t.insert(spark.createDataFrame([(9,)], "x int"), "ab")
    t.full_cleanup(spark.createDataFrame([("ab",)], "sess_id string"), reorganize=True)
    assert sorted(r.x for r in again.read("ab").collect()) == [1, 9]


def test_gc_segments_over_nine_digits(spark):
    from canopy.sources.files import split_gc_lines
    lines = spark.createDataFrame([("x|2000000000",), ("y|99999999999",), ("z",)], "value string")
    assert [(r.gclogline, r.gp_segment) for r in split_gc_lines(lines).collect()] == [("x", 2000000000)]


def test_inserts_hold_while_a_cleanup_rewrites(spark, tmp_dir, monkeypatch):
    """A part that is inserted during the rewrite stays in force; of two rewriters one wins."""
    from canopy import store
    t = SessionTable.create(spark, f"{tmp_dir}/raced", ["x int"])
    t.insert(spark.createDataFrame([(1,)], "x int"), "me")
    t.insert(spark.createDataFrame([(2,)], "x int"), None)
    write, raced = SessionTable._write, []

    def write_then_insert(self, df):
        part = write(self, df)
        if not raced:
            raced.append(True)
            SessionTable(spark, t.path).insert(spark.createDataFrame([(3,)], "x int"), "late")
        return part

    monkeypatch.setattr(SessionTable, "_write", write_then_insert)
    active = spark.createDataFrame([("me",)], "sess_id string")
    t.full_cleanup(active)
    assert sorted(r.x for r in t.base().collect()) == [1, 3]

    def write_then_clean(self, df):
        part = write(self, df)
        if len(raced) == 1:
            raced.append(True)
            SessionTable(spark, t.path).full_cleanup(active)
        return part

    monkeypatch.setattr(SessionTable, "_write", write_then_clean)
    with pytest.raises(store.Conflict):
        t.full_cleanup(active)
    assert sorted(r.x for r in t.base().collect()) == [1]


def test_versions_without_content_are_passed_over(spark, tmp_dir):
    from canopy import store
    v = store.Versions(spark, f"{tmp_dir}/versions")
    assert v.last() == (-1, None)
    v.commit(-1, {"a": 1})
    store.create_once(spark, f"{tmp_dir}/versions/{1:012d}.json", "")  # its writer was lost
    assert v.last() == (1, {"a": 1})
    with pytest.raises(store.Conflict):
        v.commit(0, {"a": 2})
    assert v.commit(1, {"a": 3}) == 2 and v.last() == (2, {"a": 3})
