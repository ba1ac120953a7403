"""Workload queries (W1-W15) and the tables they run on (D7, D8).

test1(a, b, c) = (i, 2i, 'text' || i); test2(a, b, c, d) = (2i, 3i, i * f(i), 'text' || i), i = 1..n.
The reference draws f from ``random()``; here f(i) = ((i * 7919) mod 1000) / 1000 so runs repeat
and an oracle can recompute c exactly (decimal(20,3)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators.windows import count_distinct_over, max_over, row_number_split

# Fixed values of the stress queries.
REGEX_PATTERNS = [".*(aaa)|(bbb)|(ccc).*", ".*[abc]{5}.*", "[01234]{5,9}", "[xyz]{10}"]
MAX_WINDOWS = 6


def _c_of(i: Column) -> Column:
    thousandths = i * F.pmod(i * F.lit(7919), F.lit(1000))
    return (thousandths.cast("decimal(23,0)") * F.lit(0.001).cast("decimal(3,3)")).cast("decimal(20,3)")


def test_tables(spark: SparkSession, n: int, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """D7. The two benchmark tables for ``n`` rows each (generated in parallel by ``range``)."""
    ids = spark.range(1, n + 1, numPartitions=partitions) if partitions else spark.range(1, n + 1)
    i = F.col("id")
    t1 = ids.select(i.alias("a"), (i * 2).alias("b"), F.concat(F.lit("text"), i.cast("string")).alias("c"))
    t2 = ids.select((i * 2).alias("a"), (i * 3).alias("b"), _c_of(i).alias("c"),
                    F.concat(F.lit("text"), i.cast("string")).alias("d"))
    return t1, t2


#: Columns that put the lines of ``lineitem`` in order (lines that agree in all of them are alike here).
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def tables_from(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two benchmark tables with a row for each line, numbered from 1 in their order: test1(number, twice the number, number
    as text), test2(twice and three times the number, price, number as text). Joins match as many rows as in tables that
    ``test_tables`` makes: all on text, half on a, a third on b."""
    numbered = row_number_split(lineitem.select(*LINE_ORDER), [], list(LINE_ORDER), "id")
    i = F.col("id").cast("bigint")
    t1 = numbered.select(i.alias("a"), (i * 2).alias("b"), F.concat(F.lit("text"), i.cast("string")).alias("c"))
    t2 = numbered.select((i * 2).alias("a"), (i * 3).alias("b"), F.col("l_extendedprice").cast("decimal(20,3)").alias("c"),
                         F.concat(F.lit("text"), i.cast("string")).alias("d"))
    return t1, t2


def multiply_rows(df: DataFrame, shift_from: DataFrame | None = None, a: str = "a", b: str = "b",
                  rebuild: dict | None = None) -> DataFrame:
    """D8. Append the rows shifted by the current maxima of a and b (of ``shift_from``, default ``df``).
    The maxima are scalar subqueries (one aggregate each, evaluated on the cluster), not a cross join.
    ``rebuild`` maps column name -> function(new_a) recomputing dependent columns of the appended copy."""
    src = shift_from if shift_from is not None else df
    max_a = src.select(F.max(a)).scalar()
    max_b = src.select(F.max(b)).scalar()
    new_a = F.col(a) + max_a
    cols = []
    for c in df.columns:
        if c == a:
            cols.append(new_a.alias(a))
        elif c == b:
            cols.append((F.col(b) + max_b).alias(b))
        elif rebuild and c in rebuild:
            cols.append(rebuild[c](new_a).alias(c))
        else:
            cols.append(F.col(c))
    return df.unionByName(df.select(*cols))


def _pair(t1: DataFrame, t2: DataFrame, cond) -> DataFrame:
    x, y = t1.alias("t1"), t2.alias("t2")
    out = [F.col(f"t1.{c}").alias(f"t1_{c}") for c in t1.columns] + \
          [F.col(f"t2.{c}").alias(f"t2_{c}") for c in t2.columns]
    return x.join(y, cond(F.col, "t1", "t2"), "inner").select(*out)


def w1_colocated_join(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """W1. Join on the distribution key of both (``a = a``)."""
    return _pair(t1, t2, lambda c, l, r: c(f"{l}.a") == c(f"{r}.a"))


def w2_one_side_join(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """W2. ``t1.a = t2.b`` (one side redistributed)."""
    return _pair(t1, t2, lambda c, l, r: c(f"{l}.a") == c(f"{r}.b"))


def w3_two_side_join(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """W3. ``t1.b = t2.b`` (both sides redistributed)."""
    return _pair(t1, t2, lambda c, l, r: c(f"{l}.b") == c(f"{r}.b"))


def w4_cast_join(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """W4. ``t1.b = t2.c::int`` on a non-unique decimal; numeric -> int rounds half away from zero."""
    return _pair(t1, t2, lambda c, l, r: c(f"{l}.b") == F.round(c(f"{r}.c")).cast("bigint"))


def w5_text_join(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """W5. ``t1.c = t2.d`` on text."""
    return _pair(t1, t2, lambda c, l, r: c(f"{l}.c") == c(f"{r}.d"))


def md5_of(cols: list[str], sep: str | None = "|") -> Column:
    """md5 of the columns as text joined by ``sep`` (NULL if any is NULL, like ``||``)."""
    parts: list[Column] = []
    for k, c in enumerate(cols):
        if k and sep is not None:
            parts.append(F.lit(sep))
        parts.append(F.col(c).cast("string"))
    return F.md5(F.concat(*parts))


def w6_md5(t2: DataFrame) -> DataFrame:
    """W6. md5 of the four columns joined by '|'."""
    return t2.select(md5_of(["a", "b", "c", "d"]).alias("md5"))


def w7_skewed_row_number(t2: DataFrame) -> DataFrame:
    """W7. ``row_number() over (partition by substr(d,1,5) order by c)`` (tie broken by a).
    Only nine keys exist; hot keys are split over range partitions (see ``row_number_split``)."""
    keyed = t2.withColumn("__p", F.substring("d", 1, 5))
    return row_number_split(keyed, ["__p"], [F.col("c"), F.col("a")], "rn").drop("__p")


def w8_window_max(t2: DataFrame) -> DataFrame:
    """W8. ``max(a) over (partition by (c/100)::int)`` as a grouped max joined back."""
    key = F.round(F.col("c") * F.lit(0.01).cast("decimal(2,2)")).cast("bigint")
    return max_over(t2, "a", key, "v1")


def w9_join_write(t1: DataFrame, t2: DataFrame, path: str) -> DataFrame:
    """W9. Co-located join written as compressed Parquet."""
    out = _join_columns(t1, t2, "a", "a")
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return t1.sparkSession.read.parquet(path)


def w10_redistributed_write(t1: DataFrame, t2: DataFrame, path: str) -> DataFrame:
    """W10. ``t1.b = t2.a`` join written as compressed Parquet."""
    out = _join_columns(t1, t2, "b", "a")
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return t1.sparkSession.read.parquet(path)


def _join_columns(t1: DataFrame, t2: DataFrame, lk: str, rk: str) -> DataFrame:
    x, y = t1.alias("t1"), t2.alias("t2")
    return x.join(y, F.col(f"t1.{lk}") == F.col(f"t2.{rk}")).select(
        F.col("t1.a").alias("a"), F.col("t1.b").alias("b"), F.col("t1.c").alias("c"),
        F.col("t2.b").alias("b2"), F.col("t2.c").alias("c2"), F.col("t2.d").alias("d"))


def search_pattern(p: str) -> str:
    """For a search a greedy ``.*`` at an end of the pattern changes nothing; without it the engine is spared a
    backtracking scan from each position. A lazy, possessive or escaped one stays as it is."""
    if p.startswith(".*") and p[2:3] not in ("?", "+"):
        p = p[2:]
    if p.endswith(".*") and not p.endswith("\\.*"):
        p = p[:-2]
    return p


def regex_any(text: Column, patterns: list[str] = REGEX_PATTERNS) -> Column:
    cond = None
    for p in patterns:
        c = text.rlike(search_pattern(p))
        cond = c if cond is None else cond | c
    return cond


def w11_regex_count(df: DataFrame, text_col: str, patterns: list[str] = REGEX_PATTERNS) -> DataFrame:
    """W11. ``count(*)`` of rows matching any of four regexes."""
    return df.select(text_col).agg(F.count_if(regex_any(F.col(text_col), patterns)).alias("matches"))


def column_ndv(df: DataFrame, exact: bool = False, rsd: float = 0.01) -> list[tuple[str, int]]:
    """Distinct values per column, highest first (one aggregate pass). Ties by column order."""
    f = (lambda c: F.countDistinct(F.col(f"`{c}`"))) if exact else \
        (lambda c: F.approx_count_distinct(F.col(f"`{c}`"), rsd))
    row = df.agg(*[f(c).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    pairs = [(c, int(row[f"n{i}"])) for i, c in enumerate(df.columns)]
    order = {c: i for i, c in enumerate(df.columns)}
    return sorted(pairs, key=lambda p: (-p[1], order[p[0]]))


def w12_disk(df: DataFrame, ranked: list[str]) -> DataFrame:
    """W12. ``max`` of the highest-NDV column."""
    return df.agg(F.max(ranked[0]).cast("string").alias("max_value"))


def w13_cpu(df: DataFrame, ranked: list[str]) -> DataFrame:
    """W13. ``count(distinct md5(all columns as text, concatenated))``."""
    return df.agg(F.countDistinct(md5_of(ranked, sep=None)).alias("distinct_md5"))


def w14_network(df: DataFrame, ranked: list[str]) -> DataFrame:
    """W14. ``count(distinct second) over (partition by first)``."""
    return count_distinct_over(df, ranked[1], ranked[0], "cd")


def w15_memory(df: DataFrame, ranked: list[str]) -> DataFrame:
    """W15. Up to six ``row_number()`` windows partitioned by the first column, each ordered by
    one of the next columns (rn1 .. rn6) and, among equals, by the rest in their rank. Each order is range-partitioned with
    its key (``row_number_split``), so a hot key is spread over tasks."""
    key, rest = ranked[0], ranked[1:]
    out = df
    for k, c in enumerate(rest[:MAX_WINDOWS], start=1):
        out = row_number_split(out, [key], [F.col(c) for c in [c] + [other for other in rest if other != c]], f"rn{k}")
    return out
