"""Workload queries W1-W15 and the table generators D7, D8.

Both test tables have a row for each line of ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import workload as W
from canopy.plans.registry import query
from canopy.session import scratch_path
from canopy.sources.tables import table


def tables_for(spark, sf_dir):
    return W.tables_from(table(spark, sf_dir, "lineitem"))


TEST_CTE = """
WITH lines AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i,
                      CAST(l_extendedprice AS DECIMAL(20, 3)) AS c FROM lineitem),
test1 AS (SELECT i AS a, 2 * i AS b, 'text' || i AS c FROM lines),
test2 AS (SELECT 2 * i AS a, 3 * i AS b, c, 'text' || i AS d FROM lines)
"""

PAIR = ("SELECT t1.a AS t1_a, t1.b AS t1_b, t1.c AS t1_c, t2.a AS t2_a, t2.b AS t2_b, t2.c AS t2_c, t2.d AS t2_d "
        "FROM test1 t1 JOIN test2 t2 ON ")


@query("D7", TEST_CTE + "SELECT a, b, c, d FROM test2")
def d7(spark, sf_dir):
    return tables_for(spark, sf_dir)[1]


@query("D8", TEST_CTE + """
SELECT a, b, c FROM test1
UNION ALL
SELECT a + (SELECT max(a) FROM test1), b + (SELECT max(b) FROM test1), md5('text' || (a + (SELECT max(a) FROM test1)))
FROM test1""")
def d8(spark, sf_dir):
    t1, _ = tables_for(spark, sf_dir)
    return W.multiply_rows(t1, rebuild={"c": lambda a: F.md5(F.concat(F.lit("text"), a.cast("string")))})


@query("W1", TEST_CTE + PAIR + "t1.a = t2.a")
def w1(spark, sf_dir):
    return W.w1_colocated_join(*tables_for(spark, sf_dir))


@query("W2", TEST_CTE + PAIR + "t1.a = t2.b")
def w2(spark, sf_dir):
    return W.w2_one_side_join(*tables_for(spark, sf_dir))


@query("W3", TEST_CTE + PAIR + "t1.b = t2.b")
def w3(spark, sf_dir):
    return W.w3_two_side_join(*tables_for(spark, sf_dir))


@query("W4", TEST_CTE + PAIR + "t1.b = CAST(round(t2.c) AS BIGINT)")
def w4(spark, sf_dir):
    return W.w4_cast_join(*tables_for(spark, sf_dir))


@query("W5", TEST_CTE + PAIR + "t1.c = t2.d")
def w5(spark, sf_dir):
    return W.w5_text_join(*tables_for(spark, sf_dir))


@query("W6", TEST_CTE + """
SELECT md5(CAST(a AS VARCHAR) || '|' || CAST(b AS VARCHAR) || '|' || CAST(c AS VARCHAR) || '|' || d) AS md5 FROM test2""")
def w6(spark, sf_dir):
    return W.w6_md5(tables_for(spark, sf_dir)[1])


@query("W7", TEST_CTE + """
SELECT a, b, c, d, row_number() OVER (PARTITION BY substr(d, 1, 5) ORDER BY c, a) AS rn FROM test2""")
def w7(spark, sf_dir):
    return W.w7_skewed_row_number(tables_for(spark, sf_dir)[1])


@query("W8", TEST_CTE + """
SELECT a, b, c, d, max(a) OVER (PARTITION BY CAST(round(c * 0.01) AS BIGINT)) AS v1 FROM test2""")
def w8(spark, sf_dir):
    return W.w8_window_max(tables_for(spark, sf_dir)[1])


WRITE_COLS = "SELECT t1.a AS a, t1.b AS b, t1.c AS c, t2.b AS b2, t2.c AS c2, t2.d AS d FROM test1 t1 JOIN test2 t2 ON "


@query("W9", TEST_CTE + WRITE_COLS + "t1.a = t2.a")
def w9(spark, sf_dir):
    t1, t2 = tables_for(spark, sf_dir)
    return W.w9_join_write(t1, t2, scratch_path(spark, "w9"))


@query("W10", TEST_CTE + WRITE_COLS + "t1.b = t2.a")
def w10(spark, sf_dir):
    t1, t2 = tables_for(spark, sf_dir)
    return W.w10_redistributed_write(t1, t2, scratch_path(spark, "w10"))


@query("W11", "SELECT count(*) FILTER (WHERE " + " OR ".join(
    f"regexp_matches(text, '{p}')" for p in W.REGEX_PATTERNS) + ") AS matches FROM documents")
def w11(spark, sf_dir):
    return W.w11_regex_count(table(spark, sf_dir, "documents"), "text")


def _part_ranked(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part, [c for c, _ in W.column_ndv(part, exact=True)]


def _lines_ranked(spark, sf_dir, columns):
    """Columns of lineitem far apart in their distinct values, so that their ranks are the same at every scale; the
    first is no key of the rows."""
    lines = table(spark, sf_dir, "lineitem").select(*columns)
    return lines, [c for c, _ in W.column_ndv(lines, exact=True)]


# part columns by NDV at every scale: p_partkey, p_retailprice, p_name, p_size, p_brand, p_type
@query("W12", "SELECT CAST(max(p_partkey) AS VARCHAR) AS max_value FROM part")
def w12(spark, sf_dir):
    return W.w12_disk(*_part_ranked(spark, sf_dir))


@query("W13", """
SELECT count(DISTINCT md5(CAST(l_partkey AS VARCHAR) || CAST(l_quantity AS VARCHAR) || CAST(l_linenumber AS VARCHAR)))
         AS distinct_md5 FROM lineitem""")
def w13(spark, sf_dir):
    return W.w13_cpu(*_lines_ranked(spark, sf_dir, ["l_linenumber", "l_quantity", "l_partkey"]))


LINE_COLS = ["l_linenumber", "l_quantity", "l_partkey", "l_orderkey"]


@query("W14", f"""
WITH per AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS cd FROM lineitem GROUP BY 1)
SELECT {", ".join(LINE_COLS)}, cd FROM lineitem JOIN per USING (l_orderkey)""")
def w14(spark, sf_dir):
    return W.w14_network(*_lines_ranked(spark, sf_dir, LINE_COLS))


@query("W15", f"""
SELECT {", ".join(LINE_COLS)},
       row_number() OVER (o ORDER BY l_partkey, l_quantity, l_linenumber) AS rn1,
       row_number() OVER (o ORDER BY l_quantity, l_partkey, l_linenumber) AS rn2,
       row_number() OVER (o ORDER BY l_linenumber, l_partkey, l_quantity) AS rn3
FROM lineitem WINDOW o AS (PARTITION BY l_orderkey)""")
def w15(spark, sf_dir):
    return W.w15_memory(*_lines_ranked(spark, sf_dir, LINE_COLS))
