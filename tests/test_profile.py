"""Consistency snapshots, work lists, statistics and orphan detection (FIXTURES.md section 6)."""

import pytest
from pyspark.sql import functions as F

from canopy.operators import profile as C


def test_key_ndv_counts_null_keys(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, None), (1, 2)], "a int, b int")
    assert C.key_ndv(df, ["a", "b"]).first()[0] == 3


def test_snapshot_and_diff(spark):
    t = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    snap = {r["tablename"]: r for r in C.snapshot({"t": t, "u": t}, {"t": ["k"]}, {"t", "u"}).collect()}
    assert snap["t"]["rowcount"] == 3 and snap["t"]["distkeycount"] == 2 and snap["u"]["distkeycount"] is None
    schema = C.SNAPSHOT_SCHEMA
    a = spark.createDataFrame([("only_a", 1, 1, 1), ("cnt", 1, 5, 2), ("keys", 1, 5, None), ("same", 1, 5, 5),
                               ("nulls", 0, 5, None)], schema)
    b = spark.createDataFrame([("only_b", 1, 1, 1), ("cnt", 1, 6, 2), ("keys", 1, 5, 5), ("same", 1, 5, 5),
                               ("nulls", 0, 5, None)], schema)
    d = C.snapshot_diff(a, b).collect()
    names = sorted((r["table_first"] or "", r["table_second"] or "") for r in d)
    assert names == [("", "only_b"), ("cnt", "cnt"), ("keys", "keys"), ("only_a", "")]


def test_work_list_progress_resume(spark):
    tables = spark.createDataFrame([
        ("public", "a", "r", "h"), ("public", "p", "r", "h"), ("public", "p_1", "r", "h"), ("public", "p_1_1", "r", "c"),
        ("pg_catalog", "pg_class", "r", "h"), ("public", "v", "v", "v"), ("public", "x", "r", "x")],
        "nspname string, relname string, relkind string, relstorage string")
    parts = spark.createDataFrame([("public", "p", "public", "p_1", None), ("public", "p", "public", "p_1_1", "p_1")],
                                  "schemaname string, tablename string, partitionschemaname string, "
                                  "partitiontablename string, parentpartitiontablename string")
    w = {r["tablename"]: r["ischeckdistkey"] for r in C.work_list(tables, parts, ["public.p"]).collect()}
    assert w == {"public.a": 0, "public.p_1_1": 1}
    only = C.work_list(tables, parts, None, include=["public.p"]).collect()
    assert [r["tablename"] for r in only] == ["public.p_1_1"]
    work = C.work_list(tables, parts, ["public.p"])
    done = spark.createDataFrame([("public.a", 0, 10, None)], C.SNAPSHOT_SCHEMA)
    prog = {r["tablename"]: r["isprocessed"] for r in C.progress(work, done).collect()}
    assert prog == {"public.a": 1, "public.p_1_1": 0}
    assert [r["tablename"] for r in C.remaining(work, done).collect()] == ["public.p_1_1"]
    no_parts = sorted(r["tablename"] for r in C.tables_without_partitions(tables, parts).collect())
    assert no_parts == ["pg_catalog.pg_class", "public.a", "public.p"]


def test_profile_tables_resumes(spark, tmp_dir):
    t = {f"t{i}": spark.range(i + 1).toDF("k") for i in range(5)}
    first = C.profile_tables(spark, dict(list(t.items())[:2]), {"t0": ["k"]}, tmp_dir, batch=1)
    assert first.count() == 2
    again = C.profile_tables(spark, t, {"t0": ["k"]}, tmp_dir, batch=2)
    assert again.count() == 5 and again.filter(F.col("tablename") == "t4").first()["rowcount"] == 5


def test_column_stats(spark):
    df = spark.createDataFrame([(1, "a"), (1, "bb"), (2, None), (3, "a")], "n int, s string")
    st = {r["column_name"]: r for r in C.column_stats(df, mcv=2, buckets=2).collect()}
    assert st["s"]["null_frac"] == 0.25 and st["s"]["n_distinct"] == 2
    assert abs(st["s"]["avg_width"] - 4 / 3) < 1e-9
    assert st["n"]["most_common_vals"] == ["1", "2"] and st["n"]["most_common_freqs"][0] == 0.5
    assert st["n"]["histogram_bounds"][0] == 1.0 and st["s"]["histogram_bounds"] is None


def test_column_stats_exact_and_estimated_agree_on_few_values(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("n"), F.when(F.col("id") % 3 > 0, F.lit("é")).alias("s"),
                                  F.lit(None).cast("int").alias("nothing"))
    cols = ["column_name", "null_frac", "avg_width", "n_distinct", "most_common_vals", "most_common_freqs"]
    both = [sorted(map(tuple, C.column_stats(df, mcv=3, exact=e).select(cols).collect())) for e in (True, False)]
    assert both[0] == both[1]
    empty = {r["column_name"]: r for r in C.column_stats(df.limit(0)).collect()}
    assert empty["n"]["null_frac"] is None and empty["n"]["n_distinct"] == 0
    assert empty["n"]["most_common_vals"] is None and len(empty) == 3


def test_profile_resume_raises_on_an_unreadable_listing(spark, tmp_dir):
    spark.createDataFrame([("x",)], "value string").write.text(tmp_dir + "/notparquet")
    with pytest.raises(Exception):
        C.profile_tables(spark, {"t": spark.range(1)}, {}, tmp_dir + "/notparquet")


def test_orphan_schemas(spark):
    schemas = spark.createDataFrame([("pg_temp_1",), ("pg_temp_2",), ("pg_temp_2",), ("public",), ("pgXtemp_9",)],
                                    "nspname string")
    sessions = spark.createDataFrame([(1,)], "sess_id int")
    got = sorted(r[0] for r in C.orphan_schema_drops(schemas, sessions).collect())
    # LIKE 'pg_temp%': the '_' is a wildcard, so pgXtemp_9 matches as in the reference
    assert got == ["drop schema if exists pgXtemp_9 cascade;", "drop schema if exists pg_temp_2 cascade;"]


def test_sketches_of_parts_merge(spark, tmp_dir):
    """Statistics of any union of parts from kept states: exact counts, bounded errors for the rest."""
    df = spark.range(20_000).select((F.col("id") % 5).alias("part"), F.when(F.col("id") % 10 > 0, F.col("id") * 7 % 4001).alias("n"),
                                    F.concat(F.lit("v"), F.col("id") % 300).alias("s"), F.lit(None).cast("int").alias("nothing"))
    C.column_sketches(df, ["n", "s", "nothing"], ["part"]).write.parquet(tmp_dir + "/sketches")
    kept = spark.read.parquet(tmp_dir + "/sketches")
    assert kept.count() == 15
    for parts in ([0, 1, 2, 3, 4], [1], [2, 4]):
        got = {r["column_name"]: r for r in C.merged_stats(kept.where(F.col("part").isin(parts)), mcv=3).collect()}
        want = {r["column_name"]: r for r in C.column_stats(df.where(F.col("part").isin(parts)).drop("part"), mcv=3, buckets=100, exact=True).collect()}
        for c in ("n", "s"):
            assert got[c]["null_frac"] == want[c]["null_frac"] and abs(got[c]["avg_width"] - want[c]["avg_width"]) < 1e-9
            assert abs(got[c]["n_distinct"] - want[c]["n_distinct"]) <= 0.05 * want[c]["n_distinct"]
        fine = want["n"]["histogram_bounds"]
        assert all(fine[max(0, 10 * k - 2)] <= b <= fine[min(100, 10 * k + 2)] for k, b in enumerate(got["n"]["histogram_bounds"]))
        assert got["nothing"]["histogram_bounds"] is None and got["nothing"]["null_frac"] == 1 and got["s"]["histogram_bounds"] is None
    assert C.merged_stats(kept.limit(0)).count() == 0
    assert {r["n"] for r in C.merged_stats(C.column_sketches(df.limit(0))).collect()} == {0}


def test_exact_bounds_are_discrete_quantiles(spark):
    values = [5, 1, 1, 1, None, 9, 2, 2, 7, 30, 4, 4, 4, 4]
    df = spark.createDataFrame([(v, str(v)) for v in values], "n int, s string").repartition(5)
    got = {r["column_name"]: r["histogram_bounds"] for r in C.column_stats(df, buckets=4, exact=True).collect()}
    own = sorted(v for v in values if v is not None)
    assert got["n"] == [float(own[max(1, -(-k * len(own) // 4)) - 1]) for k in range(5)] and got["s"] is None


def test_histogram_bounds_by_place_without_a_loop_over_bounds(spark):
    """Each value answers the bounds that its places add: heavy values many, most values none, with fewer rows than bounds too."""
    columns = {"heavy": {1.0: 5, 2.0: 9_000, 7.0: 1, 8.0: 994}, "few": {3.0: 1, 1.0: 1, 2.0: 1}, "one": {4.0: 7}, "many": {float(k): 1 + k % 3 for k in range(701)}}
    rows = [(c, v, n) for c, d in columns.items() for v, n in d.items()]
    found = C._histograms(spark.createDataFrame(rows, "column_name string, num double, n bigint"), 200)
    assert "filter(sequence" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["column_name"]: r["histogram_bounds"] for r in found.collect()}
    for c, d in columns.items():
        values = [v for v in sorted(d) for _ in range(d[v])]
        assert got[c] == [values[max(1, -(-k * len(values) // 200)) - 1] for k in range(201)], c


def test_merged_query_beside_a_session_variable_of_a_column_s_name(spark, tmp_dir):
    from canopy.plans.admin import c6_merged
    spark.range(2_000).selectExpr("id div 4 AS l_orderkey", "id % 90 AS l_partkey", "id % 7 AS l_suppkey", "CAST(id % 4 AS int) AS l_linenumber",
                                  "CAST(id % 50 AS double) AS l_quantity", "id * 1.5D AS l_extendedprice", "0.1D AS l_discount", "0.02D AS l_tax", "'N' AS l_returnflag",
                                  "'O' AS l_linestatus", "TIMESTAMP_NTZ '1996-09-13 00:00:00' AS l_shipdate").write.parquet(f"{tmp_dir}/lineitem.parquet")
    for name in ("fine", "histogram_bounds"):
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} STRING DEFAULT '1.5'")
    try:
        got = {r["column_name"]: r for r in c6_merged(spark, tmp_dir).collect()}
    finally:
        for name in ("fine", "histogram_bounds"):
            spark.sql(f"DROP TEMPORARY VARIABLE {name}")
    assert len(got) == 11 and got["l_orderkey"]["n_distinct"] == 500 and all(r["distinct_within_5_percent"] for r in got.values())
    assert got["l_extendedprice"]["bounds_within_2_percent"] is True and got["l_returnflag"]["bounds_within_2_percent"] is None
