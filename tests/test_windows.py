"""Skew-aware window operators against the plain window / brute force."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from canopy.operators import windows as Wn
from canopy.operators import workload as W


def test_row_number_split_matches_plain(spark):
    _, t2 = W.test_tables(spark, 3000)
    split = W.w7_skewed_row_number(t2).select("a", "rn").collect()
    plain = t2.withColumn("rn", F.row_number().over(Window.partitionBy(F.substring("d", 1, 5)).orderBy("c", "a"))) \
        .select("a", "rn").collect()
    assert sorted(split) == sorted(plain)


def test_row_number_split_hot_key_many_partitions(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 20)}", rnd.randint(0, 50), i) for i in range(4000)]
    rows += [(None, 1, 10_000 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, o int, u int")
    a = Wn.row_number_split(df, ["k"], ["o", "u"], "rn", partitions=13).collect()
    b = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o", "u"))).collect()
    assert sorted(a, key=str) == sorted(b, key=str)


def test_row_number_split_of_old_and_late_timestamps(spark):
    df = spark.sql("select * from values (1, timestamp_ntz'0001-01-01 00:00:00'), (1, timestamp_ntz'9999-12-31 00:00:00') "
                   "as t(k, ts)")
    got = Wn.row_number_split(df, ["k"], ["ts"], "rn", partitions=3).select("rn", F.year("ts")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1), (2, 9999)]
    assert Wn.row_number_split(df.limit(0), ["k"], ["ts"], "rn").collect() == []


def test_max_over_and_count_distinct_over(spark):
    rows = [(k % 5 if k % 7 else None, k % 3 if k % 4 else None, k) for k in range(200)]
    df = spark.createDataFrame(rows, "y int, x int, v int")
    m = {r["v"]: r["mx"] for r in Wn.max_over(df, "v", "y", "mx").collect()}
    for y, x, v in rows:
        assert m[v] == max(vv for yy, _, vv in rows if yy == y)
    c = {r["v"]: r["cd"] for r in Wn.count_distinct_over(df, "x", "y", "cd").collect()}
    for y, x, v in rows:
        assert c[v] == len({xx for yy, xx, _ in rows if yy == y and xx is not None})


def test_workload_row_counts(spark):
    n = 999
    t1, t2 = W.test_tables(spark, n)
    assert W.w1_colocated_join(t1, t2).count() == n // 2
    assert W.w2_one_side_join(t1, t2).count() == n // 3
    assert W.w3_two_side_join(t1, t2).count() == n // 3
    assert W.w5_text_join(t1, t2).count() == n


def test_multiply_rows(spark):
    t1, _ = W.test_tables(spark, 10)
    out = W.multiply_rows(t1).collect()
    assert len(out) == 20 and max(r["a"] for r in out) == 20 and max(r["b"] for r in out) == 40


def test_search_pattern_keeps_lazy_and_escaped_ends(spark):
    df = spark.createDataFrame([("zzabc",), ("ab",), (None,)], "t string")
    for p in [".*?abc", ".*abc.*", "abc.*?", "x|.*abc", ".*+abc", "c\\.*"]:
        own = [r[0] for r in df.select(W.regex_any(F.col("t"), [p])).collect()]
        assert own == [r[0] for r in df.select(F.col("t").rlike(p)).collect()], p


def test_tables_from_rows(spark):
    li = spark.createDataFrame([(7, 2, 1, 1, 10.5), (7, 1, 1, 1, 3.25), (2, 5, 1, 1, 1.0)],
                               "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double")
    t1, t2 = W.tables_from(li)
    assert sorted(tuple(r) for r in t1.collect()) == [(1, 2, "text1"), (2, 4, "text2"), (3, 6, "text3")]
    assert sorted((r.a, r.b, float(r.c), r.d) for r in t2.collect()) == [(2, 3, 1.0, "text1"), (4, 6, 3.25, "text2"), (6, 9, 10.5, "text3")]
    many = W.tables_from(spark.range(999).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "id / 4 AS l_extendedprice"))
    assert (W.w1_colocated_join(*many).count(), W.w3_two_side_join(*many).count(), W.w5_text_join(*many).count()) == (499, 333, 999)
