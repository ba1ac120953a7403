"""Consistency / profile queries (C1-C8) over the driver tables.

The catalog metadata for C3, C4, C8 is derived from the data: the driver tables are user tables, and
``orders`` also appears as a two-level partitioned table ``orders_part`` (level 1 by o_orderstatus,
level 2 by the first character of o_orderpriority).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import profile as C
from canopy.plans.registry import query
from canopy.session import scratch_path
from canopy.sources.tables import DRIVER_TABLES, table

TABLES_SCHEMA = "nspname string, relname string, relkind string, relstorage string"
CHECK = ["public.lineitem", "public.orders_part"]
#: The distribution key of each driver table; ``region`` has none.
KEYS = {"region": [], "nation": ["n_regionkey"], "customer": ["c_nationkey", "c_mktsegment"], "supplier": ["s_nationkey"],
        "part": ["p_brand", "p_size"], "orders": ["o_custkey"], "lineitem": ["l_orderkey", "l_linenumber"],
        "events": ["user_id", "event_type"], "documents": ["lang", "source"], "embeddings": ["label"], "pages": ["url"],
        "benchmark": ["item_id"], "labels": ["quality", "toxic"], "conversations": ["conv_id", "role"]}
#: C4: tables that the interrupted run had not reached.
UNREACHED = {"events", "pages", "part"}


def catalog(spark, sf_dir):
    fixed = [("public", n, "r", "a") for n in DRIVER_TABLES] + [
        ("public", "orders_part", "r", "h"), ("pg_catalog", "pg_class", "r", "h"), ("public", "v_orders", "v", "v")]
    base = spark.createDataFrame(fixed, TABLES_SCHEMA)
    o = table(spark, sf_dir, "orders")
    p1 = F.concat(F.lit("orders_part_1_prt_"), "o_orderstatus")
    p2 = F.concat(p1, F.lit("_2_prt_"), F.substring("o_orderpriority", 1, 1))
    lv = o.select(p1.alias("p1"), p2.alias("p2")).distinct()
    l1 = lv.select(F.lit("public").alias("nspname"), F.col("p1").alias("relname"),
                   F.lit("r").alias("relkind"), F.lit("h").alias("relstorage")).distinct()
    l2 = lv.select(F.lit("public").alias("nspname"), F.col("p2").alias("relname"),
                   F.lit("r").alias("relkind"), F.lit("c").alias("relstorage"))
    tables = base.unionByName(l1).unionByName(l2)
    root = [F.lit("public").alias("schemaname"), F.lit("orders_part").alias("tablename"),
            F.lit("public").alias("partitionschemaname")]
    parts = (lv.select(*root, F.col("p1").alias("partitiontablename"),
                       F.lit(None).cast("string").alias("parentpartitiontablename")).distinct()
             .unionByName(lv.select(*root, F.col("p2").alias("partitiontablename"),
                                    F.col("p1").alias("parentpartitiontablename"))))
    return tables, parts


META_CTE = """
WITH tbl AS (
  SELECT 'public' AS nspname, relname, 'r' AS relkind, 'a' AS relstorage
  FROM (VALUES {names}) v(relname)
  UNION ALL SELECT 'public', 'orders_part', 'r', 'h'
  UNION ALL SELECT 'pg_catalog', 'pg_class', 'r', 'h'
  UNION ALL SELECT 'public', 'v_orders', 'v', 'v'
  UNION ALL SELECT DISTINCT 'public', 'orders_part_1_prt_' || o_orderstatus, 'r', 'h' FROM orders
  UNION ALL SELECT DISTINCT 'public', 'orders_part_1_prt_' || o_orderstatus || '_2_prt_' || substr(o_orderpriority, 1, 1), 'r', 'c'
            FROM orders),
prt AS (
  SELECT DISTINCT 'public' AS schemaname, 'orders_part' AS tablename, 'public' AS partitionschemaname,
         'orders_part_1_prt_' || o_orderstatus AS partitiontablename, NULL AS parentpartitiontablename FROM orders
  UNION ALL
  SELECT DISTINCT 'public', 'orders_part', 'public',
         'orders_part_1_prt_' || o_orderstatus || '_2_prt_' || substr(o_orderpriority, 1, 1),
         'orders_part_1_prt_' || o_orderstatus FROM orders),
work AS (
  SELECT t.nspname || '.' || t.relname AS tablename,
         CAST(CASE WHEN t.nspname || '.' || t.relname IN ('public.lineitem', 'public.orders_part')
                     OR p3.schemaname || '.' || p3.tablename IN ('public.lineitem', 'public.orders_part')
                   THEN 1 ELSE 0 END AS SMALLINT) AS ischeckdistkey
  FROM tbl t
  LEFT JOIN (SELECT DISTINCT schemaname, tablename FROM prt) p1
         ON p1.tablename = t.relname AND p1.schemaname = t.nspname
  LEFT JOIN (SELECT DISTINCT partitionschemaname, parentpartitiontablename FROM prt) p2
         ON p2.parentpartitiontablename = t.relname AND p2.partitionschemaname = t.nspname
  LEFT JOIN prt p3 ON p3.partitiontablename = t.relname AND p3.partitionschemaname = t.nspname
  WHERE t.relkind = 'r' AND t.relstorage IN ('h', 'a', 'c')
    AND t.nspname NOT IN ('pg_catalog', 'pg_toast', 'information_schema', 'gp_toolkit', 'madlib', 'pg_aoseg')
    AND p1.tablename IS NULL AND p2.parentpartitiontablename IS NULL)
""".replace("{names}", ", ".join(f"('{n}')" for n in DRIVER_TABLES))


@query("C1", " UNION ALL ".join(f"SELECT '{t}' AS tablename, count(*) AS rowcount FROM {t}" for t in DRIVER_TABLES))
def c1(spark, sf_dir):
    return C.row_counts({t: table(spark, sf_dir, t) for t in DRIVER_TABLES})


SNAP_SQL = " UNION ALL ".join(f"""
SELECT '{t}' AS tablename, CAST(1 AS SMALLINT) AS ischeckdistkey, (SELECT count(*) FROM {t}) AS rowcount,
       {f"(SELECT count(*) FROM (SELECT {', '.join(k)} FROM {t} GROUP BY ALL))" if k else "NULL::BIGINT"} AS distkeycount""" for t, k in KEYS.items())


@query("C2", SNAP_SQL)
def c2(spark, sf_dir):
    return C.snapshot({t: table(spark, sf_dir, t) for t in KEYS}, KEYS, set(KEYS))


@query("C3", META_CTE + "SELECT tablename, ischeckdistkey FROM work")
def c3(spark, sf_dir):
    tables, parts = catalog(spark, sf_dir)
    return C.work_list(tables, parts, CHECK)


@query("C4", META_CTE + """,
done AS (SELECT 'public.' || tablename AS tablename, rowcount, distkeycount FROM (""" + SNAP_SQL + """) s
         WHERE tablename NOT IN (""" + ", ".join(f"'{t}'" for t in sorted(UNREACHED)) + """))
SELECT w.tablename, CASE WHEN d.tablename IS NOT NULL THEN 1 ELSE 0 END AS isprocessed, w.ischeckdistkey,
       d.rowcount, d.distkeycount
FROM work w LEFT JOIN done d ON w.tablename = d.tablename""")
def c4(spark, sf_dir):
    tables, parts = catalog(spark, sf_dir)
    work = C.work_list(tables, parts, CHECK)
    path = scratch_path(spark, "progress")
    done = {t: table(spark, sf_dir, t) for t in KEYS if t not in UNREACHED}
    snap = C.profile_tables(spark, done, KEYS, path, batch=4)
    return C.progress(work, snap.withColumn("tablename", F.concat(F.lit("public."), "tablename")))


C5_SNAP = """
SELECT 'orders_' || o_orderstatus AS tablename, count(*) AS rowcount, count(DISTINCT o_custkey) AS distkeycount
FROM orders WHERE {cond} GROUP BY o_orderstatus"""


@query("C5", f"""
WITH m1 AS ({C5_SNAP.format(cond="o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus <> 'P'")}),
     m2 AS ({C5_SNAP.format(cond="o_orderdate < TIMESTAMP '1998-01-01' OR o_orderstatus = 'F'")})
SELECT m1.tablename AS table_first, m2.tablename AS table_second, m1.rowcount AS rows_before,
       m2.rowcount AS rows_after, m1.distkeycount AS dist_keys_before, m2.distkeycount AS dist_keys_after
FROM m1 FULL OUTER JOIN m2 ON m1.tablename = m2.tablename
WHERE m1.tablename IS NULL OR m2.tablename IS NULL OR m1.rowcount IS DISTINCT FROM m2.rowcount
   OR m1.distkeycount IS DISTINCT FROM m2.distkeycount""")
def c5(spark, sf_dir):
    o = table(spark, sf_dir, "orders")

    def snap(cond):
        return (o.filter(cond).groupBy("o_orderstatus")
                .agg(F.count(F.lit(1)).alias("rowcount"), F.countDistinct("o_custkey").alias("distkeycount"))
                .select(F.concat(F.lit("orders_"), "o_orderstatus").alias("tablename"), "rowcount", "distkeycount"))
    d = F.col("o_orderdate")
    first = snap((d < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") != "P"))
    second = snap((d < F.lit("1998-01-01").cast("timestamp_ntz")) | (F.col("o_orderstatus") == "F"))
    return C.snapshot_diff(first, second)


C6_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
C6_NUMERIC = C6_COLS[:8]


def _bounds_sql(c: str) -> str:
    """All eleven bounds: bound k is the value at place ceil(k n / 10), the first at least."""
    if c not in C6_NUMERIC:
        return "CAST(NULL AS VARCHAR)"
    return f"""(SELECT array_to_string(list_transform(range(0, 11), lambda k: CAST(CAST(v[greatest(1, (k * len(v) + 9) // 10)] AS DECIMAL(18, 4)) AS VARCHAR)), ',')
        FROM (SELECT list({c} ORDER BY {c}) FILTER ({c} IS NOT NULL) AS v FROM lineitem))"""


@query("C6", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name,
       CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS null_frac,
       CAST(avg(octet_length(CAST(CAST({c} AS VARCHAR) AS BLOB))) AS DECIMAL(12, 4)) AS avg_width,
       count(DISTINCT {c}) AS n_distinct,
       (SELECT string_agg(v, ',' ORDER BY n DESC, v) FROM (
           SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL
           GROUP BY 1 ORDER BY n DESC, v LIMIT 3)) AS top3,
       round((SELECT sum(n) FROM (
           SELECT count(*) AS n, CAST({c} AS VARCHAR) AS v FROM lineitem WHERE {c} IS NOT NULL
           GROUP BY v ORDER BY n DESC, v LIMIT 3)) / CAST(count(*) AS DOUBLE), 9) AS top3_freq,
       {_bounds_sql(c)} AS hist
FROM lineitem""" for c in C6_COLS))
def c6(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    st = C.column_stats(li, C6_COLS, mcv=3, exact=True)
    freq = F.aggregate("most_common_freqs", F.lit(0.0), lambda a, b: a + b)
    bounds = F.array_join(F.transform("histogram_bounds", lambda b: b.cast("decimal(18,4)").cast("string")), ",")
    return st.select("column_name", F.col("null_frac").cast("double").alias("null_frac"),
                     F.col("avg_width").cast("decimal(12,4)").alias("avg_width"), "n_distinct",
                     F.array_join("most_common_vals", ",").alias("top3"), F.round(freq, 9).alias("top3_freq"), bounds.alias("hist"))


@query("C6_merged", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) AS n, CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS null_frac,
       CAST(avg(octet_length(CAST(CAST({c} AS VARCHAR) AS BLOB))) AS DECIMAL(12, 4)) AS avg_width, count(DISTINCT {c}) AS n_distinct,
       true AS distinct_within_5_percent, {'true' if c in C6_NUMERIC else 'CAST(NULL AS BOOLEAN)'} AS bounds_within_2_percent FROM lineitem""" for c in C6_COLS))
def c6_merged(spark, sf_dir):
    """Sketches of eight parts of the table, kept and merged, against exact figures."""
    li, path = table(spark, sf_dir, "lineitem"), scratch_path(spark, "sketches")
    C.column_sketches(li.withColumn("part", F.col("l_orderkey") % 8), C6_COLS, ["part"]).write.parquet(path)
    merged = C.merged_stats(spark.read.parquet(path))
    exact = C.column_stats(li, C6_COLS, mcv=1, buckets=200, exact=True).select("column_name", F.col("n_distinct").alias("d"), F.col("histogram_bounds").alias("fine"))
    both = merged.join(exact, "column_name")
    # Bound k of ten lies between the exact bounds 2 % below and above it in rank. Inside a lambda a bare name may be a session variable's.
    bounds, fine = both["histogram_bounds"], both["fine"]
    inside = F.forall(F.sequence(F.lit(0), F.lit(10)), lambda k: F.get(bounds, k).between(
        F.get(fine, F.greatest(20 * k - 4, F.lit(0))), F.get(fine, F.least(20 * k + 4, F.lit(200)))))
    return both.select("column_name", "n", F.col("null_frac").cast("double").alias("null_frac"), F.col("avg_width").cast("decimal(12,4)").alias("avg_width"),
                       F.col("d").alias("n_distinct"), (F.abs(F.col("n_distinct") - F.col("d")) <= 0.05 * F.col("d")).alias("distinct_within_5_percent"),
                       F.when(fine.isNotNull(), inside).alias("bounds_within_2_percent"))


@query("C7", """
SELECT 'drop schema if exists ' || nspname || ' cascade;' AS statement FROM (
  SELECT 'pg_temp_' || n_nationkey AS nspname FROM nation WHERE 'pg_temp_' || n_nationkey LIKE 'pg_temp%'
  EXCEPT
  SELECT 'pg_temp_' || c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def c7(spark, sf_dir):
    schemas = table(spark, sf_dir, "nation").select(F.concat(F.lit("pg_temp_"), F.col("n_nationkey")).alias("nspname"))
    live = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 9900).select(F.col("c_nationkey").alias("sess_id"))
    return C.orphan_schema_drops(schemas, live)


@query("C8", META_CTE + """
SELECT t.nspname || '.' || t.relname AS tablename FROM tbl t
LEFT JOIN prt p ON p.partitiontablename = t.relname AND p.partitionschemaname = t.nspname
WHERE t.relkind = 'r' AND t.relstorage IN ('h', 'a', 'c') AND p.partitiontablename IS NULL""")
def c8(spark, sf_dir):
    tables, parts = catalog(spark, sf_dir)
    return C.tables_without_partitions(tables, parts)
