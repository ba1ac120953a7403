"""Scalar function queries: arrays (A1-A5), JSON (J1-J3), code generation (G1, G2),
generators (D1-D6) and the built-in scalar set (F1-F26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import arrays as A
from canopy.functions import generate as D
from canopy.functions import jsonmap as J
from canopy.functions import strings as S
from canopy.plans.registry import query
from canopy.sources.files import get_field_list
from canopy.sources.tables import DRIVER_TABLES, table


def order_arrays(spark, sf_dir):
    """Per order: parts of odd lines (a) and even lines (b), numerically sorted; NULL when empty."""
    li = table(spark, sf_dir, "lineitem")
    odd = F.col("l_linenumber") % 2 == 1
    g = li.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.when(odd, F.col("l_partkey")))).alias("a0"),
        F.array_sort(F.collect_list(F.when(~odd, F.col("l_partkey")))).alias("b0"))
    return g.select("l_orderkey", F.when(F.size("a0") > 0, F.col("a0")).alias("a"),
                    F.when(F.size("b0") > 0, F.col("b0")).alias("b"))


ARR_CTE = """
WITH g AS (
  SELECT l_orderkey,
         list_sort(list(l_partkey) FILTER (WHERE l_linenumber % 2 = 1)) AS a0,
         list_sort(list(l_partkey) FILTER (WHERE l_linenumber % 2 = 0)) AS b0
  FROM lineitem GROUP BY l_orderkey),
h AS (SELECT l_orderkey,
             CASE WHEN len(a0) > 0 THEN CAST(a0 AS VARCHAR[]) END AS a,
             CASE WHEN len(b0) > 0 THEN CAST(b0 AS VARCHAR[]) END AS b FROM g)
"""


@query("A1", ARR_CTE + """
SELECT l_orderkey, CASE WHEN a IS NOT NULL AND b IS NOT NULL
                        THEN array_to_string(list_sort(list_intersect(a, b)), ',') END AS res FROM h""")
def a1(spark, sf_dir):
    g = order_arrays(spark, sf_dir)
    return g.select("l_orderkey", F.array_join(A.array_intersect("a", "b"), ",").alias("res"))


@query("A2", ARR_CTE + """
SELECT l_orderkey, CASE WHEN a IS NULL THEN array_to_string(b, ',')
                        WHEN b IS NULL THEN array_to_string(a, ',')
                        ELSE array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') END AS res FROM h""")
def a2(spark, sf_dir):
    g = order_arrays(spark, sf_dir)
    return g.select("l_orderkey", F.array_join(A.array_merge("a", "b"), ",").alias("res"))


@query("A3", ARR_CTE + """
SELECT l_orderkey, CASE WHEN a IS NULL THEN NULL
                        WHEN b IS NULL THEN array_to_string(a, ',')
                        ELSE array_to_string(list_sort(list_distinct(
                               list_filter(a, lambda e: NOT list_contains(b, e)))), ',') END AS res FROM h""")
def a3(spark, sf_dir):
    g = order_arrays(spark, sf_dir)
    return g.select("l_orderkey", F.array_join(A.array_minus("a", "b"), ",").alias("res"))


@query("A4", ARR_CTE + """
SELECT l_orderkey, CASE WHEN a IS NOT NULL THEN array_to_string(list_sort(list_concat(a, a)), ',') END AS res FROM h""")
def a4(spark, sf_dir):
    g = order_arrays(spark, sf_dir)
    return g.select("l_orderkey", F.array_join(A.array_sort(F.concat("a", "a")), ",").alias("res"))


@query("A5", ARR_CTE + """
SELECT l_orderkey, CASE WHEN a IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_concat(a, a))), ',') END AS res
FROM h""")
def a5(spark, sf_dir):
    g = order_arrays(spark, sf_dir)
    return g.select("l_orderkey", F.array_join(A.array_uniq(F.concat("a", "a")), ",").alias("res"))


@query("J1", """
SELECT event_id, CAST(json_merge_patch(props, json_object('src', event_type)) AS VARCHAR) AS js FROM events""")
def j1(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", J.json_set("props", "src", F.col("event_type")).alias("js"))


@query("J2", "SELECT event_id, props->>'k' AS k_text, props->>'zz' AS zz_text FROM events")
def j2(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", J.json_get("props", "k").alias("k_text"), J.json_get("props", "zz").alias("zz_text"))


@query("J3", """
WITH j AS (
  SELECT event_id, event_type, user_id, CAST('{"s":"' || event_type || '"' || CASE event_id % 4
           WHEN 0 THEN ',"k":"' || user_id || '"}' WHEN 1 THEN ',"k":' || user_id || '}'
           WHEN 2 THEN ',"k":null}' ELSE '}' END AS JSON) AS js FROM events)
SELECT event_id, (js->>'s') = 'click' AS s_is_click,
       coalesce(json_type(js->'k') = 'VARCHAR' AND (js->>'k') = CAST(user_id AS VARCHAR), false) AS k_is_user,
       coalesce(json_type(js->'k'), 'NULL') = 'NULL' AS k_is_null
FROM j""")
def j3(spark, sf_dir):
    """``k`` is the user as text, the user as a number, null or missing."""
    ev = table(spark, sf_dir, "events")
    user, kind = F.col("user_id").cast("string"), F.col("event_id") % 4
    tail = (F.when(kind == 0, F.concat(F.lit(',"k":"'), user, F.lit('"}')))
            .when(kind == 1, F.concat(F.lit(',"k":'), user, F.lit("}")))
            .when(kind == 2, F.lit(',"k":null}')).otherwise(F.lit("}")))
    j = ev.select("event_id", user.alias("user"), F.concat(F.lit('{"s":"'), "event_type", F.lit('"'), tail).alias("js"))
    return j.select("event_id", J.json_check("js", "s", "click").alias("s_is_click"),
                    J.json_check("js", "k", F.col("user")).alias("k_is_user"),
                    J.json_check("js", "k", F.lit(None)).alias("k_is_null"))


@query("G1", """
SELECT c_custkey, c_name AS "c#name", c_nationkey AS "nation#key", c_acctbal, c_mktsegment,
       'c_custkey,`c#name`,`nation#key`,c_acctbal,c_mktsegment' AS fields
FROM customer""")
def g1(spark, sf_dir):
    """The field list of a catalog table, used as the field list of a query on it."""
    c = table(spark, sf_dir, "customer").withColumnsRenamed({"c_name": "c#name", "c_nationkey": "nation#key"})
    c.createOrReplaceTempView("canopy_customer")
    fields = ",".join(get_field_list(spark, "CANOPY_CUSTOMER"))
    return spark.sql(f"SELECT {fields}, '{fields}' AS fields FROM canopy_customer")


@query("G2", "SELECT c_custkey, 'c.' || array_to_string([c_mktsegment, c_name], '|c.') AS fields FROM customer")
def g2(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", S.put_to_str(F.array("c_mktsegment", "c_name"), "|", "c.").alias("fields"))


def _drawn(seed: int, length: int, below: int) -> str:
    """SQL for the list of numbers of a generator stream: four digits of the md5 of '<seed>:<key>:<block>' each."""
    digits = f"substr(md5('{seed}:' || c_custkey || ':' || (i // 8)), (4 * (i % 8) + 1)::INTEGER, 4)"
    return f"list_transform(range(0, {length}), lambda i: (('0x' || {digits})::BIGINT * {below}) // 65536)"


def _symbols(seed: int, length: int, alphabet: str) -> str:
    return f"array_to_string(list_transform({_drawn(seed, length, len(alphabet))}, lambda v: substr('{alphabet}', (v + 1)::INTEGER, 1)), '')"


def _domain(seed: int) -> str:
    return f"['com', 'ru', 'info', 'co.il'][({_drawn(seed, 1, 4)})[1] + 1]"


def _coordinate(block: int, least: int, steps: int) -> str:
    drawn = f"('0x' || substr(md5('5:' || c_custkey || ':{block}'), 1, 8))::BIGINT"
    return f"CAST(CAST({least} + (({drawn} * {steps}) >> 32) AS DECIMAL(14, 0)) * CAST(0.00001 AS DECIMAL(6, 5)) AS DECIMAL(20, 5))"


BOTH_CASES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _customers(spark, sf_dir, **columns):
    return table(spark, sf_dir, "customer").select("c_custkey", *[v.alias(k) for k, v in columns.items()])


@query("D1", f"SELECT c_custkey, {_symbols(1, 12, '0123456789')} AS digits FROM customer")
def d1(spark, sf_dir):
    return _customers(spark, sf_dir, digits=D.generate_integer(12, "c_custkey"))


@query("D2", f"SELECT c_custkey, {_symbols(2, 10, BOTH_CASES)} AS mixed, {_symbols(21, 9, BOTH_CASES[:26])} AS lower FROM customer")
def d2(spark, sf_dir):
    return _customers(spark, sf_dir, mixed=D.generate_string(10, "c_custkey"), lower=D.generate_string(9, "c_custkey", use_upper=0, seed=21))


@query("D3", f"SELECT c_custkey, {_domain(3)} AS domain FROM customer")
def d3(spark, sf_dir):
    return _customers(spark, sf_dir, domain=D.generate_domain("c_custkey"))


@query("D4", f"SELECT c_custkey, {_symbols(41, 8, BOTH_CASES)} || '@' || {_symbols(42, 5, BOTH_CASES[:26])} || '.' || {_domain(43)} AS email FROM customer")
def d4(spark, sf_dir):
    return _customers(spark, sf_dir, email=D.generate_email(8, 5, "c_custkey"))


@query("D5", f"""
SELECT c_custkey, lat, lon, 'POINT(' || lat || ' ' || lon || ')' AS wkt
FROM (SELECT c_custkey, {_coordinate(0, 5550000, 50001)} AS lat, {_coordinate(1, 3730000, 60001)} AS lon FROM customer)""")
def d5(spark, sf_dir):
    return _customers(spark, sf_dir, p=D.generate_point(55.5, 56.0, 37.3, 37.9, "c_custkey")).select("c_custkey", "p.*")


@query("D6", f"SELECT c_custkey, {_symbols(6, 60, D.TEXT_SYMBOLS)} AS txt FROM customer")
def d6(spark, sf_dir):
    return _customers(spark, sf_dir, txt=D.generate_text(60, "c_custkey"))


@query("F", """
SELECT s_suppkey,
       md5(s_name) AS f1_md5,
       substr(s_name, 1, 5) AS f2_substr,
       split_part(s_name, '#', 2) AS f3_split_part,
       strpos(s_name, '0') AS f4_strpos,
       replace(s_name, 'Supplier', 'S') AS f5_replace,
       regexp_replace(s_name, '[0-9]{2}', '', 'g') AS f6_regexp_replace,
       trim(' ' || s_name || ' ') AS f7_trim,
       lower(s_name) AS f8_lower,
       regexp_matches(s_name, '0{3}') AS f9_regex,
       s_name LIKE 'Supp%1' AS f10_like,
       coalesce(NULL, s_nationkey) AS f11_coalesce,
       greatest(s_nationkey, 10) AS f12_greatest,
       CAST(round(CAST(s_acctbal AS DECIMAL(15, 2)), 1) AS DECIMAL(15, 1)) AS f13_round,
       array_to_string(string_split(s_name, '#'), '/') AS f17_18_join_split,
       len(string_split(s_name, '#')) AS f20_upper,
       string_split(s_name, '#')[1] AS f21_subscript,
       array_to_string(list_prepend('x', string_split(s_name, '#')), '/') AS f22_prepend,
       list_contains(string_split(s_name, '#'), 'Supplier') AS f23_contains,
       CAST(round(CAST(s_acctbal AS DECIMAL(15, 2))) AS INTEGER) AS f24_cast_int,
       CASE WHEN s_acctbal > 5000 THEN 'high' ELSE 'low' END AS f25_case,
       {'k': s_nationkey}.k AS f26_struct_field
FROM supplier""")
def f_scalars(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    parts = F.split(F.col("s_name"), "#")
    return s.select(
        "s_suppkey",
        F.md5("s_name").alias("f1_md5"),
        F.substring("s_name", 1, 5).alias("f2_substr"),
        F.split_part("s_name", F.lit("#"), F.lit(2)).alias("f3_split_part"),
        F.instr("s_name", "0").cast("bigint").alias("f4_strpos"),
        F.replace("s_name", F.lit("Supplier"), F.lit("S")).alias("f5_replace"),
        F.regexp_replace("s_name", "[0-9]{2}", "").alias("f6_regexp_replace"),
        F.trim(F.concat(F.lit(" "), "s_name", F.lit(" "))).alias("f7_trim"),
        F.lower("s_name").alias("f8_lower"),
        F.col("s_name").rlike("0{3}").alias("f9_regex"),
        F.col("s_name").like("Supp%1").alias("f10_like"),
        F.coalesce(F.lit(None).cast("int"), "s_nationkey").alias("f11_coalesce"),
        F.greatest("s_nationkey", F.lit(10)).alias("f12_greatest"),
        F.round(F.col("s_acctbal").cast("decimal(15,2)"), 1).cast("decimal(15,1)").alias("f13_round"),
        F.array_join(parts, "/").alias("f17_18_join_split"),
        F.size(parts).cast("bigint").alias("f20_upper"),
        F.get(parts, 0).alias("f21_subscript"),
        F.array_join(F.array_prepend(parts, F.lit("x")), "/").alias("f22_prepend"),
        F.array_contains(parts, "Supplier").alias("f23_contains"),
        F.round(F.col("s_acctbal").cast("decimal(15,2)")).cast("int").alias("f24_cast_int"),
        F.when(F.col("s_acctbal") > 5000, "high").otherwise("low").alias("f25_case"),
        F.struct(F.col("s_nationkey").alias("k")).k.alias("f26_struct_field"))


@query("F14", """
SELECT l_orderkey, l_linenumber, l_partkey,
       ('0x' || substr(md5('14:' || l_orderkey || '/' || l_linenumber || ':0'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
FROM lineitem""")
def f14(spark, sf_dir):
    """A random number in [0, 1) for each line."""
    line = F.concat_ws("/", "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", D.uniform(14, line).alias("u"))


@query("F_time", """
SELECT event_id,
       CAST(epoch(TIMESTAMP '2024-01-15 12:00:00' - ts) * 1000000 AS BIGINT) AS f15_epoch_micros,
       TIMESTAMP '2024-01-15 12:00:00' - ts < INTERVAL 1 HOUR AS f16_last_hour
FROM events""")
def f_time(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return ev.select("event_id", micros.alias("f15_epoch_micros"),
                     ((as_of - F.col("ts")) < F.expr("INTERVAL 1 HOUR")).alias("f16_last_hour"))


@query("F19", """
SELECT s_suppkey, part FROM supplier, unnest(string_split(s_name, '#')) AS u(part)""")
def f19(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.explode(F.split("s_name", "#")).alias("part"))
