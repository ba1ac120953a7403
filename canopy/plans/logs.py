"""Log analytics queries (S2/S3, GC1-GC7, M1-M3, Q1-Q3, B1-B6) over inputs derived from the driver tables.

GC log lines and process lines are written out of ``events`` as text (FIXTURES.md section 5) and parsed
back by the operators; the oracles compute the same numbers straight from ``events``. Lock snapshots
come from lineitem (locks), supplier (activity), orders (relations) and nation (schemas).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import gclog as G
from canopy.operators import locks as Q
from canopy.operators import process as M
from canopy.operators import reports as B
from canopy.plans.registry import query
from canopy.session import scratch_path
from canopy.sources.files import load_gc_log, read_process_snapshot
from canopy.sources.rejects import REJECT
from canopy.sources.tables import table

AS_OF = "2024-01-15 12:00:00"
LOCK_AS_OF = "2024-02-01 00:00:00"
DEC = "decimal(20,3)"


# ---------------------------------------------------------------- GC log lines from events
def gc_source_text(spark, sf_dir):
    """``value = '<gc line>|<segment>'`` as the GC log source would deliver it."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    y, z, o, p, h, n = 500 + i % 1000, i % 500, 6000 + i % 100, i % 5000, 6500 + i % 1000, i % 9000
    secs = (F.col("value").cast("decimal(18,2)") * F.lit(0.001).cast("decimal(3,3)")).cast("decimal(18,5)") \
        .cast("string")
    head = F.format_string("%s+0000: %d.5: ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), i)
    full = F.format_string("[Full GC [PSYoungGen: %dK->0K(2000K)] [PSOldGen: %dK->%dK(7000K)] %dK->%dK(9000K) "
                           "[PSPermGen: 90K->90K(210K)], %s secs]", y, o, p, h, n, secs)
    defnew = F.format_string("[GC %d.5: [DefNew: %dK->%dK(2000K), 0.0100 secs] %dK->%dK(9000K), %s secs]",
                             i, y, z, h, n, secs)
    young = F.format_string("[GC [PSYoungGen: %dK->%dK(2000K)] %dK->%dK(9000K), %s secs]", y, z, h, n, secs)
    t = F.col("event_type")
    body = (F.when(t == "error", full).when(t == "signup", defnew).when(t.isin("click", "purchase"), young)
            .otherwise(F.lit("safepoint noise")))
    return e.select(F.concat(head, body, F.lit("|"), (F.col("user_id") % 4).cast("string")).alias("value"))


def gc_torn_text(spark, sf_dir):
    """Lines of the same log that carry no segment, or one that is no number."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    torn = F.when(i % 97 == 0, F.format_string("torn line %d", i)).when(i % 89 == 0, F.format_string("odd segment %d|seg|x%d", i, i)) \
        .when(i % 83 == 0, F.format_string("segment out of range %d|99999999999", i))
    return e.select(torn.alias("value"), (F.col("user_id") % 4).alias("segment")).where("value is not null")


def gc_log_files(spark, sf_dir) -> str:
    """The GC log as text files in the scratch folder, one folder a segment (what the log source reads on a cluster)."""
    path = scratch_path(spark, "gclog")
    good = gc_source_text(spark, sf_dir).withColumn("segment", F.substring_index("value", "|", -1).cast("bigint"))
    good.unionByName(gc_torn_text(spark, sf_dir)).write.partitionBy("segment").text(path)
    return path


def load_gc(spark, sf_dir, *columns):
    """The log read and parsed once, rows (of the given columns, or all) and rejects."""
    def parse(tagged):
        parsed = G.gc_table(tagged, keep=[REJECT])
        return parsed.select(*columns, REJECT) if columns else parsed
    return load_gc_log(spark, gc_log_files(spark, sf_dir), parse=parse)


def gc_lines(spark, sf_dir, *columns):
    return load_gc(spark, sf_dir, *columns).rows


GC_CTE = """
WITH e AS (SELECT event_id AS id, ts, user_id, event_type, value,
                  CAST(CAST(CAST(value AS DECIMAL(18, 2)) * 0.001 AS DECIMAL(18, 5)) AS VARCHAR) AS secs FROM events),
g AS (
  SELECT CAST(user_id % 4 AS INTEGER) AS gp_segment,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+0000: ' || id || '.5: ' ||
         CASE WHEN event_type = 'error' THEN
                '[Full GC [PSYoungGen: ' || (500 + id % 1000) || 'K->0K(2000K)] [PSOldGen: ' || (6000 + id % 100) ||
                'K->' || (id % 5000) || 'K(7000K)] ' || (6500 + id % 1000) || 'K->' || (id % 9000) ||
                'K(9000K) [PSPermGen: 90K->90K(210K)], ' || secs || ' secs]'
              WHEN event_type = 'signup' THEN
                '[GC ' || id || '.5: [DefNew: ' || (500 + id % 1000) || 'K->' || (id % 500) || 'K(2000K), 0.0100 secs] ' ||
                (6500 + id % 1000) || 'K->' || (id % 9000) || 'K(9000K), ' || secs || ' secs]'
              WHEN event_type IN ('click', 'purchase') THEN
                '[GC [PSYoungGen: ' || (500 + id % 1000) || 'K->' || (id % 500) || 'K(2000K)] ' ||
                (6500 + id % 1000) || 'K->' || (id % 9000) || 'K(9000K), ' || secs || ' secs]'
              ELSE 'safepoint noise' END AS gclogline,
         CAST(CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'view' THEN NULL ELSE 0 END AS SMALLINT) AS is_full,
         CASE WHEN event_type <> 'view' THEN ts END AS gc_start,
         CAST(CASE WHEN event_type <> 'view' THEN 500 + id % 1000 END AS INTEGER) AS young_gen_old_size_kb,
         CAST(CASE WHEN event_type = 'error' THEN 0 WHEN event_type <> 'view' THEN id % 500 END AS INTEGER) AS young_gen_new_size_kb,
         CAST(CASE WHEN event_type <> 'view' THEN 2000 END AS INTEGER) AS young_gen_max_size_kb,
         CAST(CASE WHEN event_type = 'error' THEN 6000 + id % 100 END AS INTEGER) AS old_gen_old_size_kb,
         CAST(CASE WHEN event_type = 'error' THEN id % 5000 END AS INTEGER) AS old_gen_new_size_kb,
         CAST(CASE WHEN event_type = 'error' THEN 7000 END AS INTEGER) AS old_gen_max_size_kb,
         CAST(CASE WHEN event_type = 'error' THEN 90 END AS INTEGER) AS perm_gen_old_size_kb,
         CAST(CASE WHEN event_type = 'error' THEN 90 END AS INTEGER) AS perm_gen_new_size_kb,
         CAST(CASE WHEN event_type = 'error' THEN 210 END AS INTEGER) AS perm_gen_max_size_kb,
         CAST(CASE WHEN event_type <> 'view' THEN 6500 + id % 1000 END AS INTEGER) AS full_heap_old_size_kb,
         CAST(CASE WHEN event_type <> 'view' THEN id % 9000 END AS INTEGER) AS full_heap_new_size_kb,
         CAST(CASE WHEN event_type <> 'view' THEN 9000 END AS INTEGER) AS full_heap_max_size_kb,
         CASE WHEN event_type <> 'view' THEN CAST(secs AS DOUBLE) END AS gc_runtime_sec
  FROM e),
ends AS (SELECT gp_segment, count(*) AS n, min(epoch_us(gc_start)) AS lo, max(epoch_us(gc_start)) AS hi FROM g WHERE is_full = 1 GROUP BY 1),
late AS (SELECT gp_segment, max(epoch_us(gc_start)) FILTER (epoch_us(gc_start) < hi) AS earlier, count(*) FILTER (epoch_us(gc_start) = hi) AS at_hi
         FROM g JOIN ends USING (gp_segment) WHERE is_full = 1 GROUP BY 1),
spans AS (SELECT gp_segment, CASE WHEN n > 1 THEN (hi - lo) / (n - 1) / 1e6 END AS mean_span,
                 CASE WHEN at_hi > 1 THEN 0 ELSE (hi - earlier) / 1e6 END AS last_span
          FROM ends JOIN late USING (gp_segment)),
heap AS (SELECT gp_segment, p.mx AS full_heap_max_size_kb, p.nw AS full_heap_new_size_kb
         FROM (SELECT gp_segment, {pick}({'mx': full_heap_max_size_kb, 'nw': full_heap_new_size_kb}, gc_start) AS p FROM g WHERE is_full = 1 GROUP BY 1)),
ev AS (SELECT gp_segment, count(*) AS events FROM g
       WHERE is_full = 1 AND TIMESTAMP '2024-01-15 12:00:00' - gc_start < INTERVAL 1 HOUR GROUP BY gp_segment),
tm AS (SELECT gp_segment, sum(CAST(gc_runtime_sec AS DECIMAL(18, 5))) AS gc_total_runtime FROM g
       WHERE TIMESTAMP '2024-01-15 12:00:00' - gc_start < INTERVAL 1 HOUR GROUP BY gp_segment)
"""
GC_LAST = GC_CTE.replace("{pick}", "arg_max")
GC_FIRST = GC_CTE.replace("{pick}", "arg_min")
GC_COLS = ", ".join(["gp_segment", "gclogline"] + G.FIELDS)


@query("S2", GC_LAST + "SELECT gclogline, gp_segment FROM g")
def s2(spark, sf_dir):
    return load_gc_log(spark, gc_log_files(spark, sf_dir)).rows


TORN_SQL = """
SELECT CAST(user_id % 4 AS VARCHAR) AS segment,
       CASE WHEN event_id % 97 = 0 THEN 'torn line ' || event_id WHEN event_id % 89 = 0 THEN 'odd segment ' || event_id || '|seg|x' || event_id
            ELSE 'segment out of range ' || event_id || '|99999999999' END AS line,
       CASE WHEN event_id % 97 = 0 THEN 'no segment' ELSE 'segment is no number' END AS reason
FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0"""


@query("S2_rejects", TORN_SQL)
def s2_rejects(spark, sf_dir):
    return load_gc(spark, sf_dir).rejects


@query("GC1", GC_LAST + "SELECT gclogline, " + ", ".join(G.FIELDS) + " FROM g")
def gc1(spark, sf_dir):
    lines = load_gc_log(spark, gc_log_files(spark, sf_dir)).rows
    return lines.select("gclogline", G.parse_gc_line("gclogline").alias("g")).select("gclogline", "g.*")


@query("GC2", GC_LAST + f"SELECT {GC_COLS} FROM g")
def gc2(spark, sf_dir):
    return gc_lines(spark, sf_dir)


@query("GC3", GC_LAST + """
SELECT gp_segment, CAST(mean_span AS DECIMAL(20, 3)) AS avg_full_gc_interval, CAST(last_span AS DECIMAL(20, 3)) AS full_gc_interval
FROM spans""")
def gc3(spark, sf_dir):
    r = G.full_gc_intervals(gc_lines(spark, sf_dir, "gp_segment", "is_full", "gc_start"))
    return r.select("gp_segment", F.col("avg_full_gc_interval").cast(DEC).alias("avg_full_gc_interval"),
                    F.col("full_gc_interval").cast(DEC).alias("full_gc_interval"))


@query("GC4", GC_LAST + "SELECT * FROM heap")
def gc4(spark, sf_dir):
    return G.heap_after_full_gc(gc_lines(spark, sf_dir), pick="last")


@query("GC4_first", GC_FIRST + "SELECT * FROM heap")
def gc4_first(spark, sf_dir):
    return G.heap_after_full_gc(gc_lines(spark, sf_dir), pick="first")


@query("GC5", GC_LAST + "SELECT * FROM ev")
def gc5(spark, sf_dir):
    return G.full_gc_count_last_hour(gc_lines(spark, sf_dir), AS_OF)


@query("GC6", GC_LAST + "SELECT * FROM tm")
def gc6(spark, sf_dir):
    return G.gc_seconds_last_hour(gc_lines(spark, sf_dir), AS_OF)


@query("GC7", GC_LAST + f"""
SELECT gp_segment, 'fullgc_interval' AS rule, CAST(last_span AS {DEC}) AS value, CAST(mean_span / 2.0 AS {DEC}) AS threshold,
       coalesce(last_span * 2.0 < mean_span, false) AS is_error FROM spans
UNION ALL
SELECT gp_segment, 'fullgc_heap', CAST(full_heap_new_size_kb AS {DEC}), CAST(full_heap_max_size_kb * 80.0 / 100.0 AS {DEC}),
       coalesce(full_heap_max_size_kb * 80.0 / 100.0 < full_heap_new_size_kb, false) FROM heap
UNION ALL
SELECT gp_segment, 'fullgc_events', CAST(events AS {DEC}), CAST(5 AS {DEC}), events > 5 FROM ev
UNION ALL
SELECT gp_segment, 'gc_time', CAST(gc_total_runtime AS {DEC}), CAST(300 AS {DEC}), gc_total_runtime > 300 FROM tm""")
def gc7(spark, sf_dir):
    rule_columns = ("is_full", "gc_start", "full_heap_max_size_kb", "full_heap_new_size_kb", "gc_runtime_sec")
    return G.gc_alerts(gc_lines(spark, sf_dir, "gp_segment", *rule_columns), AS_OF)


# ---------------------------------------------------------------- process snapshots from events
def ps_source_text(spark, sf_dir):
    """``value = '<segment>|<ps line>'``; error rows are a background process, view rows start with a blank."""
    e = table(spark, sf_dir, "events")
    i, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    head = F.format_string("%d 1 %d %d 1.5 0.3 00:00:01 01:00 10:00 - S 3 postgres: port 40000, ",
                           1000 + i, 10000 + (i * 37) % 50000, 200000 + (i * 91) % 100000)
    work = F.format_string("u%d db1 10.0.0.1(5555) con%d seg%d cmd%d %sSELECT", u, u, i % 4, i % 5,
                           F.when(t == "click", F.lit("")).otherwise(F.lit("slice1 ")))
    line = (F.when(t == "error", F.concat(head, F.lit("stats collector process")))
            .when(t == "view", F.concat(F.lit(" "), head, work))
            .otherwise(F.concat(head, work)))
    return e.select(F.concat((u % 4).cast("string"), F.lit("|"), line).alias("value"))


def ps_files(spark, sf_dir) -> str:
    """Process snapshots as text files in the scratch folder."""
    path = scratch_path(spark, "ps")
    ps_source_text(spark, sf_dir).write.text(path)
    return path


def mem_rows(spark, sf_dir):
    return M.mem_watcher_view(read_process_snapshot(spark, ps_files(spark, sf_dir)), AS_OF)


MEM_CTE = """
WITH m AS (
  SELECT TIMESTAMP '2024-01-15 12:00:00' AS ts, CAST(user_id % 4 AS INTEGER) AS segment_id,
         CAST(1000 + event_id AS INTEGER) AS pid, CAST(10000 + (event_id * 37) % 50000 AS BIGINT) AS rss,
         CAST(200000 + (event_id * 91) % 100000 AS BIGINT) AS vsz, 1.5::DOUBLE AS mem, 0.3::DOUBLE AS cpu,
         'u' || user_id AS username, 'db1' AS database, CAST(user_id AS INTEGER) AS session_id,
         CAST(event_id % 5 AS INTEGER) AS command_id,
         CASE WHEN event_type = 'click' THEN NULL ELSE 'slice1' END AS slice
  FROM events WHERE event_type NOT IN ('error', 'view'))
"""


@query("S3", """
SELECT CAST(user_id % 4 AS VARCHAR) AS segment_id,
       CASE WHEN event_type = 'view' THEN ' ' ELSE '' END ||
       (1000 + event_id) || ' 1 ' || (10000 + (event_id * 37) % 50000) || ' ' || (200000 + (event_id * 91) % 100000) ||
       ' 1.5 0.3 00:00:01 01:00 10:00 - S 3 postgres: port 40000, ' ||
       CASE WHEN event_type = 'error' THEN 'stats collector process'
            ELSE 'u' || user_id || ' db1 10.0.0.1(5555) con' || user_id || ' seg' || (event_id % 4) || ' cmd' ||
                 (event_id % 5) || ' ' || CASE WHEN event_type = 'click' THEN '' ELSE 'slice1 ' END || 'SELECT' END
         AS command
FROM events""")
def s3(spark, sf_dir):
    return read_process_snapshot(spark, ps_files(spark, sf_dir))


@query("M1", MEM_CTE + """
SELECT CAST(pid AS VARCHAR) AS pid, CAST(rss AS VARCHAR) AS rss, CAST(vsz AS VARCHAR) AS vsz, '1.5' AS mem, '0.3' AS cpu,
       username, database, CAST(session_id AS VARCHAR) AS session_id, CAST((pid - 1000) % 4 AS VARCHAR) AS segment,
       CAST(command_id AS VARCHAR) AS command_id, slice
FROM m""")
def m1(spark, sf_dir):
    src = read_process_snapshot(spark, ps_files(spark, sf_dir))
    ps = src.select(M.parse_ps_line("command").alias("ps")).filter(F.col("ps").isNotNull())
    return ps.select(*[F.get("ps", k).alias(name) for k, name in enumerate(M.PS_FIELDS)])


@query("M2", MEM_CTE + "SELECT * FROM m")
def m2(spark, sf_dir):
    return mem_rows(spark, sf_dir)


@query("M3", MEM_CTE + """,
s AS (SELECT segment_id, session_id, command_id, max(rss / 1024) AS real_mem_mb, max(vsz / 1024) AS virtual_mem_mb
      FROM m WHERE command_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT session_id, command_id,
       CAST((max(real_mem_mb) - min(real_mem_mb)) / avg(real_mem_mb) AS DECIMAL(20, 6)) AS real_mem_skew,
       CAST((max(virtual_mem_mb) - min(virtual_mem_mb)) / avg(virtual_mem_mb) AS DECIMAL(20, 6)) AS virtual_mem_skew,
       CAST(max(real_mem_mb) AS DECIMAL(20, 6)) AS max_real_mem_mb, CAST(min(real_mem_mb) AS DECIMAL(20, 6)) AS min_real_mem_mb,
       CAST(max(virtual_mem_mb) AS DECIMAL(20, 6)) AS max_virtual_mem_mb,
       CAST(min(virtual_mem_mb) AS DECIMAL(20, 6)) AS min_virtual_mem_mb
FROM s GROUP BY 1, 2 ORDER BY max(real_mem_mb) DESC, session_id, command_id LIMIT 1000""")
def m3(spark, sf_dir):
    r = M.memory_skew(mem_rows(spark, sf_dir))
    d = "decimal(20,6)"
    return r.select("session_id", "command_id", *[F.col(c).cast(d).alias(c) for c in r.columns[2:]])


# ---------------------------------------------------------------- lock snapshots
def lock_inputs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    locks = li.select(F.col("l_orderkey").alias("relation"), F.lit("relation").alias("locktype"),
                      F.col("l_linenumber").alias("transactionid"), F.col("l_partkey").alias("pid"),
                      F.col("l_suppkey").alias("mppsessionid"), F.col("l_linestatus").alias("mode"),
                      (F.col("l_returnflag") != "R").alias("granted"))
    su = table(spark, sf_dir, "supplier")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    activity = su.select(
        F.concat(F.lit("db"), F.col("s_nationkey")).alias("datname"), (F.col("s_suppkey") + 5000).alias("procpid"),
        F.col("s_suppkey").alias("sess_id"), F.col("s_name").alias("usename"),
        (base + F.make_dt_interval(F.lit(0), F.lit(0), F.col("s_suppkey").cast("int"))).alias("query_start"),
        (base - F.make_dt_interval(F.lit(0), F.col("s_nationkey"))).alias("backend_start"),
        F.concat(F.lit("10.0.0."), F.col("s_nationkey").cast("string")).alias("client_addr"),
        F.concat(F.lit("select  *\n  from t"), F.col("s_suppkey").cast("string"), F.lit("\t\twhere x = "),
                 F.col("s_nationkey").cast("string")).alias("current_query"))
    relations = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("oid"), F.concat(F.lit("rel_"), F.col("o_orderkey").cast("string")).alias("relname"),
        (F.col("o_custkey") % 25).alias("relnamespace"))
    schemas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("oid"), F.col("n_name").alias("nspname"))
    return locks, activity, relations, schemas


LOCK_CTE = """
WITH l AS (SELECT l_orderkey AS relation, 'relation' AS locktype, l_linenumber AS transactionid, l_partkey AS pid,
                  l_suppkey AS mppsessionid, l_linestatus AS mode, l_returnflag <> 'R' AS granted FROM lineitem),
a AS (SELECT 'db' || s_nationkey AS datname, s_suppkey + 5000 AS procpid, s_suppkey AS sess_id, s_name AS usename,
             TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(s_suppkey AS BIGINT)) AS query_start,
             TIMESTAMP '2024-01-01 00:00:00' - to_hours(CAST(s_nationkey AS BIGINT)) AS backend_start,
             '10.0.0.' || s_nationkey AS client_addr,
             'select  *' || chr(10) || '  from t' || s_suppkey || chr(9) || chr(9) || 'where x = ' || s_nationkey
               AS current_query
      FROM supplier),
c AS (SELECT o_orderkey AS oid, 'rel_' || o_orderkey AS relname, o_custkey % 25 AS relnamespace FROM orders),
n AS (SELECT n_nationkey AS oid, n_name AS nspname FROM nation)
"""
SHORT = "substr(regexp_replace({q}, '[ \\t\\r\\n]{{2}}', '', 'g'), 1, 20)"


@query("Q1", LOCK_CTE + f"""
SELECT TIMESTAMP '{LOCK_AS_OF}' AS read_time, n.nspname, c.relname, l.locktype, l.transactionid, l.pid, l.mppsessionid, l.mode, l.granted, a.usename,
       a.query_start, a.backend_start, a.client_addr, {SHORT.format(q='a.current_query')} AS query_short, a.current_query
FROM l FULL JOIN a ON l.mppsessionid = a.sess_id
LEFT JOIN c ON l.relation = c.oid LEFT JOIN n ON c.relnamespace = n.oid""")
def q1(spark, sf_dir):
    return Q.locks_all(*lock_inputs(spark, sf_dir), LOCK_AS_OF)


LOCK_PARTS = LOCK_CTE + f""",
held AS (SELECT relation, mppsessionid AS session, min(mode) AS lowest FROM l WHERE granted GROUP BY ALL),
waiting AS (SELECT relation, mppsessionid AS session, min(mode) AS lowest, max(mode) AS highest, count(*) AS locks
            FROM l WHERE NOT granted GROUP BY ALL),
work AS (SELECT sess_id AS session, min(query_start) AS started, min({SHORT.format(q='current_query')}) AS short,
                min(current_query) AS query, count(*) AS entries FROM a GROUP BY ALL),
named AS (SELECT c.oid AS relation, min(relname) AS tab, min(nspname) AS sch, count(*) AS entries
          FROM c JOIN n ON n.oid = relnamespace GROUP BY ALL)"""


@query("Q2", LOCK_PARTS + f"""
SELECT sch AS table_schema, tab AS table_name, held.lowest AS lock_type_blocker, waiting.highest AS lock_type_waiting,
       first.started AS lock_start_dttm,
       CAST(epoch(TIMESTAMP '{LOCK_AS_OF}' - second.started) AS BIGINT) AS lock_duration_sec,
       first.short AS blocker_query_short, second.short AS waiting_query_short,
       first.query AS blocker_query, second.query AS waiting_query,
       relation, held.session AS session_id_blocker, waiting.session AS session_id_waiting
FROM waiting JOIN held USING (relation) JOIN named USING (relation)
JOIN work AS first ON first.session = held.session JOIN work AS second ON second.session = waiting.session
WHERE held.session <> waiting.session""")
def q2(spark, sf_dir):
    return Q.locks_blockers(*lock_inputs(spark, sf_dir), as_of=LOCK_AS_OF)


@query("Q3", LOCK_PARTS + f"""
SELECT sch AS table_schema, tab AS table_name, lowest AS blocked_lock_type,
       locks * work.entries * named.entries AS segments_blocked,
       CAST(epoch(TIMESTAMP '{LOCK_AS_OF}' - started) AS BIGINT) AS lock_waiting_time_sec,
       short AS waiting_query_short, query AS waiting_query, relation, session AS mppsessionid
FROM waiting JOIN named USING (relation) JOIN work USING (session)""")
def q3(spark, sf_dir):
    return Q.locks_blocked(*lock_inputs(spark, sf_dir), as_of=LOCK_AS_OF)


# ---------------------------------------------------------------- admin one-liners
@query("B1", LOCK_CTE + f"""
SELECT datname, procpid, sess_id, usename, CAST(epoch(TIMESTAMP '{LOCK_AS_OF}' - query_start) AS BIGINT) AS running_sec,
       substr(trim(regexp_replace(regexp_replace(current_query, '[ \\t\\r\\n]', ' ', 'g'), ' +', ' ', 'g')), 1, 80)
         AS query_text
FROM a WHERE current_query <> '<IDLE>'""")
def b1(spark, sf_dir):
    _, activity, _, _ = lock_inputs(spark, sf_dir)
    return B.activity_list(activity, LOCK_AS_OF, hide_idle=True)


@query("B2", LOCK_CTE + "SELECT * FROM l WHERE NOT granted")
def b2(spark, sf_dir):
    locks, _, _, _ = lock_inputs(spark, sf_dir)
    return B.ungranted_locks(locks)


@query("B3", """
SELECT event_type AS replication_status, user_id % 4 AS replication_worker, count(*) AS cnt
FROM events GROUP BY 1, 2 ORDER BY 1, 2""")
def b3(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("worker", F.col("user_id") % 4)
    return B.status_counts(e, "event_type", "worker")


@query("B4", """
SELECT event_type AS replication_status, count(*) AS cnt, min(ts) AS first_added, max(ts) AS last_added
FROM events GROUP BY 1""")
def b4(spark, sf_dir):
    return B.status_span(table(spark, sf_dir, "events"), "event_type", "ts")


@query("B5", """
SELECT user_id AS replication_iteration, props AS replication_table_name, ts AS error_dttm,
       value > 50 AS notification_flag, event_id
FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10""")
def b5(spark, sf_dir):
    err = table(spark, sf_dir, "events").filter(F.col("event_type") == "error").select(
        F.col("user_id").alias("replication_iteration"), F.col("props").alias("replication_table_name"),
        F.col("ts").alias("error_dttm"), (F.col("value") > 50).alias("notification_flag"), "event_id")
    return B.last_rows(err, "error_dttm", 10, ["event_id"])


@query("B6", """
SELECT o_orderkey AS job_isn, c_name AS group_name, c_mktsegment AS priority, o_orderdate AS job_submit_dttm,
       o_orderdate + INTERVAL 5 MINUTE AS job_session_start_dttm, o_orderstatus AS job_status
FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""")
def b6(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_isn"), "o_custkey",
                                               F.col("o_orderdate").alias("job_submit_dttm"),
                                               (F.col("o_orderdate") + F.expr("INTERVAL 5 MINUTES")).alias("job_session_start_dttm"),
                                               F.col("o_orderstatus").alias("job_status"))
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("group_name"),
                                                 F.col("c_mktsegment").alias("priority"))
    return B.last_jobs(q, g, "o_custkey", "job_submit_dttm", 20, ["job_isn"]).drop("o_custkey")
