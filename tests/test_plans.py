"""Physical plans of representative queries: filters reach the scan, only used columns are read."""

from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parameter_filter_is_pushed_and_columns_pruned(spark):
    plan = _plan(E.queries()["P1"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_extendedprice), GreaterThan(l_extendedprice,50000.0)]" in plan
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in plan


def test_lookup_broadcasts_small_dictionary_and_prunes_probe(spark):
    plan = _plan(E.queries()["K2"](spark, SF))
    assert "BroadcastHashJoin" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_linenumber:int>" in plan


def test_top_k_report_is_take_ordered(spark):
    plan = _plan(E.queries()["B5"](spark, SF))
    assert "TakeOrderedAndProject(limit=10" in plan and "EqualTo(event_type,error)" in plan


def test_timed_workload_plans_hold_their_work(spark):
    q = E.queries()
    assert "md5(" in _plan(q["W6"](spark, SF))
    w7 = _plan(q["W7"](spark, SF))
    assert "row_number()" in w7 and "Python" not in w7 and "Pandas" not in w7
    assert "max(" in _plan(q["W8"](spark, SF))


def test_gc_alerts_read_the_written_rule_columns_only(spark):
    plan = _plan(E.queries()["GC7"](spark, SF))
    assert "FileScan text" not in plan and "gclogline" not in plan and "FileScan parquet" in plan


def test_estimated_column_stats_take_one_scan(spark):
    from canopy.operators.profile import column_stats
    plan = _plan(column_stats(spark.read.parquet(f"{SF}/lineitem.parquet")))
    assert plan.count("FileScan parquet") == 1


def test_hierarchy_anti_join_reads_the_written_keys_only(spark, tmp_dir):
    from canopy.operators.hierarchy import _Levels
    levels = _Levels(spark.range(3).selectExpr("id", "cast(id as string) as path"))
    assert not levels.add(spark.range(0).selectExpr("id", "cast(id as string) as path"))
    assert levels.add(spark.range(3, 5).selectExpr("id", "cast(id as string) as path"))
    assert levels.all().count() == 5 and levels.last().count() == 2
    assert "ReadSchema: struct<id:bigint>" in _plan(levels.all().select("id"))


def test_process_lines_run_the_pattern_once(spark):
    plan = _plan(E.queries()["M2"](spark, SF))
    assert plan.count("regexp_replace(") == 1 and "RLIKE" not in plan


def test_no_level_shuffles_the_base(spark):
    from canopy.operators import hierarchy as H
    df = spark.range(20_000).selectExpr("id", "id div 2 AS parent", "concat('n', id) AS name")
    base = H._DealtBase(df, ["parent"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = df.where("id < 5000").select("id")
        plan = _plan(H._fresh(frontier, "h").join(H._fresh(base.cold, "t"), H._pred("<parent>.id = <child>.parent")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        base.forget()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert H.equal_columns("<child>.p = <parent>.id and <child>.v > <parent>.w") == (["id"], ["p"])


def test_a_hot_relation_is_paired_by_many_tasks(spark, monkeypatch):
    """A third of all locks on one relation, without adaptive execution: its waiting sessions lie in many partitions."""
    from canopy.operators import locks as Q
    rows = [(1 if i % 3 == 0 else i, i % 2 == 0, i) for i in range(6_000)]
    locks = spark.createDataFrame(rows, "relation bigint, granted boolean, mppsessionid bigint").selectExpr("*", "'m' AS mode")
    act = spark.range(6_000).selectExpr("id AS sess_id", "timestamp_ntz '2024-01-01' AS query_start", "concat('q', id) AS current_query")
    rel = spark.range(6_000).selectExpr("id AS oid", "concat('r', id) AS relname", "0L AS relnamespace")
    sch = spark.createDataFrame([(0, "s")], "oid bigint, nspname string")
    plain = Q.locks_blockers(locks.where("mppsessionid < 600"), act, rel, sch, "2024-02-01").count()
    monkeypatch.setattr(Q, "BLOCK", 50)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = Q.locks_blockers(locks.where("mppsessionid < 600"), act, rel, sch, "2024-02-01")
        assert small.count() == plain == 100 * 101
        waiting = locks.where("not granted").withColumnRenamed("mppsessionid", "w_session")
        assert Q._dealt(waiting).collect()[0].asDict() == {"hot": 1, "blocks": 21}
        out = Q.locks_blockers(locks, act, rel, sch, "2024-02-01")
        tasks = out.where("relation = 1").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in tasks) == 1000 * 1001 and len(tasks) >= 6 and max(r["count"] for r in tasks) < 500_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
