"""Lookup (K1-K3), parameters (P1, P2, P4, P5), scoped rows (T1-T4), sources (S1, S4, S5, S6),
loads (L1, L2), sinks (O1-O4) and streaming (ST1, ST2) over the driver tables.

Queries that write use fresh folders inside the shared checkpoint folder of the session.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.operators import lookup as K
from canopy.operators.params import Params
from canopy.operators.scoped import SessionTable
from canopy.plans.logs import AS_OF, MEM_CTE, TORN_SQL, gc_log_files, ps_source_text
from canopy.plans.registry import query
from canopy.session import scratch_path
from canopy.sources import files as S
from canopy.sources import sinks as O
from canopy.sources.tables import table
from canopy.streaming import ingest as ST


# ---------------------------------------------------------------- lookup
def supplier_lookup(spark, sf_dir):
    return K.memlookup_load(table(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_name", "s_nationkey"])


@query("K1", "SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def k1(spark, sf_dir):
    return supplier_lookup(spark, sf_dir).table


@query("K2", """
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, s.s_name
FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey""")
def k2(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return K.memlookup_find(li, supplier_lookup(spark, sf_dir), ["l_suppkey"], "s_name")


@query("K3", """
SELECT l.l_returnflag, max(s.s_nationkey) AS max_s_nationkey
FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1""")
def k3(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey")
    return K.lookup_aggregate(li, supplier_lookup(spark, sf_dir), ["l_suppkey"], "s_nationkey", ["l_returnflag"])


# ---------------------------------------------------------------- parameters
def _params(spark, sf_dir):
    """One parameter for each region but the last: its number gives the name, its name the value."""
    p = Params(spark)
    for r in table(spark, sf_dir, "region").where("r_regionkey < 4").collect():  # a handful of rows by use
        p.setparamv(f"region{r['r_regionkey']}", r["r_name"])
    return p


@query("P1", """
SELECT l_returnflag, count(*) AS cnt FROM lineitem WHERE l_extendedprice > 50000 GROUP BY 1""")
def p1(spark, sf_dir):
    p = Params(spark)
    p.setparamn("min_price", 50000)
    li = table(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_extendedprice") > p.col("min_price", "n")).groupBy("l_returnflag") \
        .agg(F.count(F.lit(1)).alias("cnt"))


@query("P3", """
SELECT 'last_order -> ' || CAST(max(o_orderdate) AS VARCHAR) AS entry FROM orders
UNION ALL
SELECT 'max_price -> ' || CAST(max(l_extendedprice) AS VARCHAR) FROM lineitem""")
def p3(spark, sf_dir):
    p = Params(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("canopy_p3_lineitem")
    table(spark, sf_dir, "orders").createOrReplaceTempView("canopy_p3_orders")
    p.set_from_query("max_price", "SELECT max(l_extendedprice) FROM canopy_p3_lineitem", "n")
    p.set_from_query("last_order", "SELECT max(o_orderdate) FROM canopy_p3_orders", "t")
    return p.listentries()


P2_SQL = """
SELECT n_nationkey, 'region' || n_regionkey AS pname, r_name AS pvalue
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 4"""


def _param_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("region"), F.col("n_regionkey")).alias("pname"))


@query("P2", P2_SQL)
def p2(spark, sf_dir):
    return _params(spark, sf_dir).lookup(_param_names(spark, sf_dir), "pname", "pvalue")


@query("P4", P2_SQL)
def p4(spark, sf_dir):
    path = scratch_path(spark, "params")
    _params(spark, sf_dir).savetotable(path)
    loaded = Params(spark)
    loaded.readfromtable(path)
    return loaded.lookup(_param_names(spark, sf_dir), "pname", "pvalue")


@query("P5", "SELECT l_linestatus, count(*) AS cnt FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1")
def p5(spark, sf_dir):
    p = Params(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("canopy_lineitem")
    p.setparamv("flag", "R")
    p.view("canopy_flagged", "SELECT * FROM canopy_lineitem WHERE l_returnflag = session.flag")
    p.setparamv("flag", "N")  # the view follows the current value
    return spark.table("canopy_flagged").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("cnt"))


# ---------------------------------------------------------------- session-scoped rows
def _scoped(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    t = SessionTable.create(spark, scratch_path(spark, "scoped"), [
        "o_orderkey bigint", "o_custkey bigint", "o_orderstatus string", "o_totalprice double", "o_orderdate timestamp_ntz", "o_orderpriority string"])
    t.insert(o.filter(F.col("o_orderstatus") == "F"), "s1")
    t.insert(o.filter(F.col("o_orderstatus") == "O"), "s2")
    t.insert(o.filter(F.col("o_orderstatus") == "P"), None)
    return t


@query("T1", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def t1(spark, sf_dir):
    return _scoped(spark, sf_dir).read("s1")


@query("T2", "SELECT *, CASE o_orderstatus WHEN 'F' THEN 's1' WHEN 'O' THEN 's2' END AS __session_id FROM orders")
def t2(spark, sf_dir):
    return _scoped(spark, sf_dir).base()


@query("T3", "SELECT *, CASE o_orderstatus WHEN 'O' THEN 's2' END AS __session_id FROM orders WHERE o_orderstatus <> 'F'")
def t3(spark, sf_dir):
    t = _scoped(spark, sf_dir)
    t.cleanup("s1")
    return t.base()


@query("T4", "SELECT *, 's2' AS __session_id FROM orders WHERE o_orderstatus = 'O'")
def t4(spark, sf_dir):
    t = _scoped(spark, sf_dir)
    active = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "O").select(F.lit("s2").alias("sess_id"))
    t.full_cleanup(active, reorganize=True)
    return t.base()


# ---------------------------------------------------------------- sources
#: The server log of the orders: for each column the Spark and the DuckDB expression (``k``: o_orderkey, ``c``: o_custkey).
SERVER_LOG = {
    "event_time": ("timestamp(o_orderdate)", "CAST(o_orderdate AS TIMESTAMP)"),
    "user_name": ("concat('user', c)", "'user' || c"),
    "database_name": ("concat('db', c % 3)", "'db' || c % 3"),
    "process_id": ("concat('p', k)", "'p' || k"),
    "thread_id": ("if(k % 2 = 0, null, concat('th', k))", "CASE WHEN k % 2 = 1 THEN 'th' || k END"),
    "remote_host": ("concat('10.0.0.', c % 250)", "'10.0.0.' || c % 250"),
    "remote_port": ("string(1024 + c)", "CAST(1024 + c AS VARCHAR)"),
    "session_start_time": ("timestamp(o_orderdate) - interval 1 hour", "CAST(o_orderdate AS TIMESTAMP) - INTERVAL 1 HOUR"),
    "transaction_id": ("int(k % 1000)", "CAST(k % 1000 AS INTEGER)"),
    "gp_session_id": ("concat('con', c)", "'con' || c"),
    "gp_command_count": ("concat('cmd', k % 7)", "'cmd' || k % 7"),
    "gp_segment": ("concat('seg', k % 4)", "'seg' || k % 4"),
    "slice_id": ("if(k % 5 = 0, null, 'slice1')", "CASE WHEN k % 5 <> 0 THEN 'slice1' END"),
    "distr_tranx_id": ("concat('dx', k)", "'dx' || k"),
    "local_tranx_id": ("concat('x', k)", "'x' || k"),
    "sub_tranx_id": ("'sx1'", "'sx1'"),
    "event_severity": ("case o_orderstatus when 'F' then 'LOG' when 'O' then 'WARNING' else 'ERROR' end",
                       "CASE o_orderstatus WHEN 'F' THEN 'LOG' WHEN 'O' THEN 'WARNING' ELSE 'ERROR' END"),
    "sql_state_code": ("'00000'", "'00000'"),
    "event_message": ("concat('statement: select \"', o_orderpriority, '\",\nfrom t\n\nwhere k = ', k)",
                      "'statement: select \"' || o_orderpriority || '\",' || chr(10) || 'from t' || chr(10) || chr(10) || 'where k = ' || k"),
    "event_detail": ("if(k % 3 = 0, concat('\"\"', k, ',\n\"'), null)", "CASE WHEN k % 3 = 0 THEN '\"\"' || k || ',' || chr(10) || '\"' END"),
    "event_hint": ("string(null)", "CAST(NULL AS VARCHAR)"),
    "internal_query": ("concat('select ', k)", "'select ' || k"),
    "internal_query_pos": ("int(k % 50)", "CAST(k % 50 AS INTEGER)"),
    "event_context": ("concat('ctx ', c % 13)", "'ctx ' || c % 13"),
    "debug_query_string": ("o_orderpriority", "o_orderpriority"),
    "error_cursor_pos": ("if(k % 2 = 0, int(k % 9), null)", "CASE WHEN k % 2 = 0 THEN CAST(k % 9 AS INTEGER) END"),
    "func_name": ("concat('fn_', c % 11)", "'fn_' || c % 11"),
    "file_name": ("'postgres.c'", "'postgres.c'"),
    "file_line": ("int(1000 + k % 9)", "CAST(1000 + k % 9 AS INTEGER)"),
    "stack_trace": ("concat('1 0x', k, '\n2 0x', c)", "'1 0x' || k || chr(10) || '2 0x' || c"),
}
KEYED = "SELECT *, o_orderkey AS k, o_custkey AS c FROM orders"


def _server_log(spark, sf_dir):
    """The server log as files: rows of 30 fields with line ends inside, and a file with rows that don't fit."""
    path = scratch_path(spark, "serverlog")
    o = table(spark, sf_dir, "orders").withColumns({"k": F.col("o_orderkey"), "c": F.col("o_custkey")})
    assert list(SERVER_LOG) == S.SERVER_LOG_SCHEMA.names
    o.select(*[F.expr(e).alias(name) for name, (e, _) in SERVER_LOG.items()]).write.option("quote", '"').option("escape", '"') \
        .option("nullValue", "").option("header", False).csv(f"{path}/rows")
    torn = F.when(F.col("k") % 3 == 0, F.format_string('%d,"only,three",fields', "k")).otherwise(
        F.concat(F.lit('2024-01-01 00:00:00,u,d,"p""1""x",t,h,1,2024-01-01 00:00:00,no number'), F.repeat(F.lit(","), F.lit(21))))
    o.where("k % 50 = 0").select(torn.alias("value")).write.text(f"{path}/torn")
    return S.load_server_log(spark, f"{path}/*")


@query("S1", "SELECT " + ", ".join(f"{e} AS {name}" for name, (_, e) in SERVER_LOG.items()) + f" FROM ({KEYED})")
def s1(spark, sf_dir):
    log = _server_log(spark, sf_dir).rows
    return log.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("event_time", "session_start_time")})


@query("S1_rejects", f"""
SELECT CASE WHEN k % 3 = 0 THEN k || ',"only,three",fields'
            ELSE '2024-01-01 00:00:00,u,d,"p""1""x",t,h,1,2024-01-01 00:00:00,no number' || repeat(',', 21) END AS line,
       'does not fit the 30 columns' AS reason
FROM ({KEYED}) WHERE k % 50 = 0""")
def s1_rejects(spark, sf_dir):
    return _server_log(spark, sf_dir).rejects.select("line", "reason")


@query("S4", """
SELECT segment_id, node, count(DISTINCT l_linenumber) AS n_files, CAST(sum(octet_length(encode(line)) + 1) AS DECIMAL(38, 0)) AS size
FROM (SELECT CAST(l_suppkey % 4 AS INTEGER) AS segment_id, CAST(l_partkey % 5 AS INTEGER) AS node, l_linenumber,
             l_orderkey || ' ' || l_linenumber AS line FROM lineitem) GROUP BY 1, 2""")
def s4(spark, sf_dir):
    """Segment folders with a folder for each file node; of a node, one file for each line number, of known lines."""
    path = scratch_path(spark, "listing")
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 4).cast("int").alias("segment_id"), (F.col("l_partkey") % 5).cast("int").alias("node"),
        F.col("l_linenumber").alias("part"), F.concat_ws(" ", "l_orderkey", "l_linenumber").alias("value"))
    li.repartition("segment_id", "node", "part").write.partitionBy("segment_id", "node", "part").text(path)
    folders = li.select("segment_id", "node").distinct().withColumn(
        "folder", F.format_string(f"{path}/segment_id=%d/node=%d", "segment_id", "node"))
    files = S.list_folders(folders).where(F.col("relfilenode").endswith(".txt"))
    return files.groupBy("segment_id", "node").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("decimal(38,0)").alias("size"))


@query("S5", "SELECT n_name AS table_name FROM nation")
def s5(spark, sf_dir):
    path = scratch_path(spark, "tablelist")
    n = table(spark, sf_dir, "nation")
    lines = n.select(F.explode(F.array(F.concat(F.lit("  "), "n_name", F.lit(" \t")), F.lit("   "), F.lit(""))).alias("value"))
    lines.write.text(path)
    return S.read_table_list(spark, path)


def _registry(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    kind = F.element_at(F.array(*map(F.lit, ("oracle", "postgresql", "SQLServer", "mysql"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    return s.select(F.col("s_suppkey").alias("id"), kind.alias("type"),
                    F.concat(F.lit("host"), F.col("s_nationkey").cast("string")).alias("server_name"),
                    F.when(F.col("s_suppkey") % 2 == 0, F.lit("orcl")).alias("instance_name"),
                    F.when(F.col("s_suppkey") % 5 > 0, F.lit(1500) + F.col("s_nationkey")).alias("port"), F.lit("db").alias("database_name"),
                    F.col("s_name").alias("user_name"), F.lit("secret").alias("pass"))


@query("S6", """
WITH r AS (SELECT *, 'host' || s_nationkey || CASE WHEN s_suppkey % 5 > 0 THEN ':' || (1500 + s_nationkey) ELSE '' END AS host FROM supplier)
SELECT s_suppkey AS id,
       CASE s_nationkey % 4
         WHEN 0 THEN 'jdbc:oracle:thin:@//' || host || '/' || CASE WHEN s_suppkey % 2 = 0 THEN 'orcl' ELSE 'db' END
         WHEN 1 THEN 'jdbc:postgresql://' || host || '/db'
         WHEN 2 THEN 'jdbc:sqlserver://' || host || ';databaseName=db' || CASE WHEN s_suppkey % 2 = 0 THEN ';instanceName=orcl' ELSE '' END
         ELSE 'jdbc:mysql://' || host || '/db' END AS url,
       s_name AS "user", 'secret' AS password
FROM r""")
def s6(spark, sf_dir):
    return S.connection_urls(_registry(spark, sf_dir))


# ---------------------------------------------------------------- loads
def _declared(spark, name: str, fields: str) -> tuple[str, str]:
    """A table of the catalog in the scratch folder: its name and folder."""
    path = scratch_path(spark, name)
    target = f"canopy_{path.rsplit('-', 1)[1]}"
    spark.sql(f"CREATE TABLE {target} ({fields}) USING parquet LOCATION '{path}'")
    return target, path


@query("L1", """
SELECT l_orderkey, CAST(l_linenumber AS SMALLINT) AS l_linenumber, l_returnflag, l_linestatus, CAST(l_quantity AS DECIMAL(12, 2)) AS l_quantity,
       CAST(l_shipdate AS DATE) AS "ship#date"
FROM lineitem""")
def l1(spark, sf_dir):
    """Eight slices by order key into a table that declares lengths; the table is left out of the catalog afterwards."""
    target, path = _declared(spark, "l1", "l_orderkey bigint, l_linenumber smallint, l_returnflag varchar(1), l_linestatus varchar(10), "
                                          "l_quantity decimal(12,2), `ship#date` date")
    view = f"{scratch_path(spark, 'l1-source')}"
    table(spark, sf_dir, "lineitem").withColumnRenamed("l_shipdate", "ship#date").write.parquet(view)  # stands for the remote query
    S.load_into_table(spark, target, {"format": "parquet", "path": view}, slice_by=("l_orderkey", 8))
    spark.sql(f"DROP TABLE {target}")
    return spark.read.parquet(path)


@query("L2", "SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(15, 2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def l2(spark, sf_dir):
    like, _ = _declared(spark, "l2-like", "o_orderkey bigint, o_orderstatus char(1), o_totalprice decimal(15,2), o_orderdate date")
    path = scratch_path(spark, "l2")
    src = {"format": "parquet", "path": f"{sf_dir.rstrip('/')}/orders.parquet"}
    target = f"{like}_loaded"
    S.load_table_like(spark, target, like, src, slice_by=("o_orderdate", 5), location=path)
    assert S.field_texts(spark, target) == S.field_texts(spark, like)
    for t in (like, target):
        spark.sql(f"DROP TABLE {t}")
    return spark.read.parquet(path)


# ---------------------------------------------------------------- sinks
@query("O1", """
SELECT event_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN ts = date_trunc('second', ts) THEN ''
         ELSE '.' || rtrim(strftime(ts, '%f'), '0') END || '|' || user_id || '|' || event_type || '|' || CAST(value AS VARCHAR) || '|' ||
       regexp_replace(props, '([\\\\|"\\r\\n])', '\\\\\\1', 'g') AS value FROM events""")
def o1(spark, sf_dir):
    path = scratch_path(spark, "dump")
    O.dump_delimited(table(spark, sf_dir, "events"), path)
    return spark.read.text(path)


@query("O2", """
SELECT event_type AS replication_status, CAST(user_id % 4 AS VARCHAR) AS replication_worker,
       CAST(count(*) AS VARCHAR) AS cnt FROM events GROUP BY 1, 2""")
def o2(spark, sf_dir):
    from canopy.operators.reports import status_counts
    path = scratch_path(spark, "export")
    e = table(spark, sf_dir, "events").withColumn("worker", F.col("user_id") % 4)
    O.export_csv(status_counts(e, "event_type", "worker"), path)
    return spark.read.option("header", True).option("sep", "|").csv(path)


@query("O3", "SELECT * FROM orders")
def o3(spark, sf_dir):
    path = scratch_path(spark, "ctas")
    O.write_table(table(spark, sf_dir, "orders"), path, compression="zstd", repartition_by=["o_orderkey"])
    return spark.read.parquet(path)


@query("O4", "SELECT o_orderstatus, count(*) AS cnt FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def o4(spark, sf_dir):
    path = scratch_path(spark, "insert")
    o = table(spark, sf_dir, "orders")
    O.write_table(o.filter(F.col("o_orderstatus") == "F"), path, mode="overwrite")   # create-table-as
    O.write_table(o.filter(F.col("o_orderstatus") == "O"), path, mode="overwrite")   # truncate + insert
    O.write_table(o.filter(F.col("o_orderstatus") == "P"), path, mode="append")      # insert-select
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("cnt"))


# ---------------------------------------------------------------- streaming
@query("ST1", MEM_CTE + "SELECT * FROM m")
def st1(spark, sf_dir):
    src = scratch_path(spark, "ps-in")
    ps_source_text(spark, sf_dir).repartition(4).write.text(src)
    out, ck = scratch_path(spark, "ps-table"), scratch_path(spark, "ps-ck")
    q = ST.ingest_process_snapshots(spark, src, out, ck, read_time=F.lit(AS_OF).cast("timestamp_ntz"),
                                    available_now=True)
    q.awaitTermination()
    return spark.read.parquet(out)


@query("ST2", """
WITH e AS (SELECT CAST(user_id % 4 AS INTEGER) AS gp_segment, ts, event_type,
                  CAST(CAST(CAST(value AS DECIMAL(18, 2)) * 0.001 AS DECIMAL(18, 5)) AS DOUBLE) AS secs
           FROM events WHERE event_type <> 'view'),
w AS (SELECT e.*, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL (k * 5) MINUTE AS window_start
      FROM e, range(0, 12) r(k))
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, gp_segment,
       count(*) FILTER (WHERE event_type = 'error') AS full_gc_events,
       sum(CAST(secs AS DECIMAL(18, 5))) AS gc_seconds,
       count(*) FILTER (WHERE event_type = 'error') > 5 AS events_error,
       sum(CAST(secs AS DECIMAL(18, 5))) > 300 AS time_error
FROM w GROUP BY 1, 2, 3""")
def st2(spark, sf_dir):
    out = scratch_path(spark, "gc-out")
    q = ST.rolling_gc_counters(spark, _ingested_gc(spark, sf_dir), out, scratch_path(spark, "gc-ck"), available_now=True,
                               state_partitions=spark.sparkContext.defaultParallelism)
    q.awaitTermination()
    r = ST.latest_windows(spark, out)
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "gp_segment", "full_gc_events",
                    "gc_seconds", "events_error", "time_error")


def _ingested_gc(spark, sf_dir) -> str:
    """The table of GC rows and rejects that the first stream makes of the log files."""
    path = scratch_path(spark, "gc-table")
    src = f"{gc_log_files(spark, sf_dir)}/segment=*"
    ST.ingest_gc_log(spark, src, path, scratch_path(spark, "gc-in-ck"), available_now=True).awaitTermination()
    return path


@query("ST2_rejects", TORN_SQL)
def st2_rejects(spark, sf_dir):
    return ST.gc_rejects(spark, _ingested_gc(spark, sf_dir))
