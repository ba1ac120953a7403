"""Consistency snapshots, work lists and column statistics (C1-C8).

Counts of many tables run as one job: each table contributes a one-row aggregate and the rows are
unioned, so Spark schedules all scans together instead of one driver round trip per table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.session import written

# Schemas never profiled.
SYSTEM_SCHEMAS = ["pg_catalog", "pg_toast", "information_schema", "gp_toolkit", "madlib", "pg_aoseg"]
TABLE_STORAGE = ["h", "a", "c"]
TOPK_BUCKETS = 512

SNAPSHOT_SCHEMA = "tablename string, ischeckdistkey smallint, rowcount bigint, distkeycount bigint"


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """C1. ``(tablename, rowcount)`` for every table, as one union job."""
    return _union([df.agg(F.count(F.lit(1)).alias("rowcount")).select(F.lit(name).alias("tablename"), "rowcount")
                   for name, df in tables.items()])


def key_ndv(df: DataFrame, keys: list[str]) -> DataFrame:
    """C2. Number of distinct key tuples; NULL keys count as values (a GROUP BY, not count(DISTINCT))."""
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("distkeycount"))


def snapshot(tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None,
             check: set[str] | None = None) -> DataFrame:
    """C1 + C2 snapshot rows ``(tablename, ischeckdistkey, rowcount, distkeycount)``.
    ``distkeycount`` is NULL for unflagged tables and tables without a key."""
    keys = keys or {}
    check = check if check is not None else set(tables)
    parts = []
    for name, df in tables.items():
        flag = 1 if name in check else 0
        cnt = df.agg(F.count(F.lit(1)).alias("rowcount"))
        if flag and keys.get(name):
            ndv = key_ndv(df, keys[name]).scalar()  # a scalar subquery next to the count
            row = cnt.select("rowcount", ndv.alias("distkeycount"))
        else:
            row = cnt.withColumn("distkeycount", F.lit(None).cast("bigint"))
        parts.append(row.select(F.lit(name).alias("tablename"), F.lit(flag).cast("smallint").alias("ischeckdistkey"),
                                "rowcount", "distkeycount"))
    return _union(parts)


def _listed(name: Column, listed) -> Column:
    if listed is None:
        return F.lit(False)
    return name.isin(list(listed))


def work_list(tables: DataFrame, partitions: DataFrame, check_tables=None, include=None) -> DataFrame:
    """C3. User tables to profile: parent and non-leaf partitions removed; ``ischeckdistkey`` = 1 if
    the table or its partition root is in ``check_tables``; optional ``include`` list (same rule).

    ``tables``: (nspname, relname, relkind, relstorage);
    ``partitions``: (schemaname, tablename, partitionschemaname, partitiontablename, parentpartitiontablename).
    """
    t = tables.filter((F.col("relkind") == "r") & F.col("relstorage").isin(TABLE_STORAGE)
                      & ~F.col("nspname").isin(SYSTEM_SCHEMAS))
    roots = partitions.select(F.col("schemaname").alias("nspname"), F.col("tablename").alias("relname")).distinct()
    inner = partitions.select(F.col("partitionschemaname").alias("nspname"),
                              F.col("parentpartitiontablename").alias("relname")).distinct()
    t = t.join(roots, ["nspname", "relname"], "left_anti").join(inner, ["nspname", "relname"], "left_anti")
    link = partitions.select(F.col("partitionschemaname").alias("nspname"), F.col("partitiontablename").alias("relname"),
                             F.concat_ws(".", "schemaname", "tablename").alias("__root"))
    t = t.join(link, ["nspname", "relname"], "left")
    full = F.concat_ws(".", "nspname", "relname")
    flag = F.when(_listed(full, check_tables) | _listed(F.col("__root"), check_tables), 1).otherwise(0)
    out = t.select(full.alias("tablename"), flag.cast("smallint").alias("ischeckdistkey"), "__root")
    if include:
        out = out.filter(_listed(F.col("tablename"), include) | _listed(F.col("__root"), include))
    return out.drop("__root")


def progress(work: DataFrame, processed: DataFrame) -> DataFrame:
    """C4. The progress view: ``(tablename, isprocessed, ischeckdistkey, rowcount, distkeycount)``."""
    p = processed.select("tablename", F.col("rowcount"), F.col("distkeycount"), F.lit(1).alias("__p"))
    v = work.join(p, "tablename", "left")
    return v.select("tablename", F.when(F.col("__p").isNotNull(), 1).otherwise(0).alias("isprocessed"),
                    "ischeckdistkey", "rowcount", "distkeycount")


def remaining(work: DataFrame, processed: DataFrame) -> DataFrame:
    """C4 resume: listed tables without a progress row."""
    return work.join(processed.select("tablename"), "tablename", "left_anti")


def snapshot_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """C5. Tables missing on one side or with a different row count or key count (NULL-safe)."""
    a, b = first.alias("m1"), second.alias("m2")
    j = a.join(b, F.col("m1.tablename") == F.col("m2.tablename"), "full")
    cond = (F.col("m1.tablename").isNull() | F.col("m2.tablename").isNull()
            | ~F.col("m1.rowcount").eqNullSafe(F.col("m2.rowcount"))
            | ~F.col("m1.distkeycount").eqNullSafe(F.col("m2.distkeycount")))
    return j.filter(cond).select(
        F.col("m1.tablename").alias("table_first"), F.col("m2.tablename").alias("table_second"),
        F.col("m1.rowcount").alias("rows_before"), F.col("m2.rowcount").alias("rows_after"),
        F.col("m1.distkeycount").alias("dist_keys_before"), F.col("m2.distkeycount").alias("dist_keys_after"))


NUMERIC = ("integer", "long", "short", "byte", "double", "float", "decimal")


def column_stats(df: DataFrame, columns: list[str] | None = None, mcv: int = 10, buckets: int = 10,
                 exact: bool = False) -> DataFrame:
    """C6. Per column: null fraction, average width (bytes of the text form of non-NULL values), number
    of distinct values, the ``mcv`` most common values with their frequencies, and histogram bounds of
    numeric columns.

    As planner statistics are estimates, the default takes one aggregate over one scan: sketches of a fixed size per
    column and task (distinct values, common values, percentiles) are all that is shuffled. ``exact=True`` counts
    every (column, value) instead (``column_stats_exact``). A column without a value has NULL common values and, as an
    empty table has, NULL fractions."""
    cols = columns or df.columns
    if exact:
        return column_stats_exact(df, cols, mcv, buckets)
    percs = [k / buckets for k in range(buckets + 1)]
    rows = F.count(F.lit(1))

    def stats(c: str) -> Column:
        col = F.col(f"`{c}`")
        text = col.cast("string")
        hist = (F.percentile_approx(col.cast("double"), percs, 10000)
                if df.schema[c].dataType.typeName() in NUMERIC else F.lit(None).cast("array<double>"))
        # more candidates than asked for, so that ties are cut in the order of the values
        found = F.expr(f"approx_top_k(CAST(`{c}` AS STRING), {10 * mcv}, {max(100 * mcv, 1000)})")
        top = F.array_sort(F.transform(F.filter(found, lambda t: t["item"].isNotNull()),
                                       lambda t: F.struct((-t["count"]).alias("less"), t["item"].alias("item"))))
        return F.struct(
            F.lit(c).alias("column_name"), F.try_divide(F.count_if(col.isNull()), rows).alias("null_frac"),
            F.avg(F.octet_length(text)).alias("avg_width"), F.approx_count_distinct(text, 0.02).alias("n_distinct"),
            F.slice(top, 1, mcv).alias("top"), rows.alias("n"), hist.alias("histogram_bounds"))

    one = df.agg(F.array(*[stats(c) for c in cols]).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    some = F.size("top") > 0
    return one.select(
        "column_name", "null_frac", "avg_width", "n_distinct",
        F.when(some, F.transform("top", lambda t: t["item"])).alias("most_common_vals"),
        F.when(some, F.transform("top", lambda t: -t["less"] / F.col("n"))).alias("most_common_freqs"),
        "histogram_bounds")


def column_stats_exact(df: DataFrame, cols: list[str], mcv: int, buckets: int) -> DataFrame:
    """C6 with exact counts. Each column is grouped by its own values in its own type (a scan that reads one column,
    combined map-side); the grouped counts of all columns are written once, with the text of each distinct value, and all figures
    are sums, top-k and running sums over them. Histogram bounds are discrete: bound k is the least value with at least
    k/buckets of the non-NULL rows up to it."""
    numeric = {c for c in cols if df.schema[c].dataType.typeName() in NUMERIC}
    none = F.lit(None).cast("double")
    counts = written(_union([
        df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(c).alias("column_name"), F.col("v").cast("string").alias("value"),
            (F.col("v").cast("double") if c in numeric else none).alias("num"), "n") for c in cols]), "value-counts")
    nn = F.col("value").isNotNull()
    per_col = counts.groupBy("column_name").agg(
        F.sum("n").alias("__rows"), F.coalesce(F.sum(F.when(~nn, F.col("n"))), F.lit(0)).alias("__nulls"),
        F.sum(F.when(nn, F.col("n") * F.octet_length("value"))).alias("__bytes"), F.count_if(nn).alias("n_distinct"))
    per_col = per_col.select(
        "column_name", (F.col("__nulls") / F.col("__rows")).alias("null_frac"),
        F.try_divide("__bytes", F.col("__rows") - F.col("__nulls")).alias("avg_width"),
        F.col("n_distinct").cast("bigint").alias("n_distinct"), "__rows")
    # exact top-k in two steps: top-k per (column, hash bucket of the value), then per column over at most
    # TOPK_BUCKETS * mcv candidates, so a column with billions of distinct values never sits in one task
    order = [F.desc("n"), F.asc("value")]
    bucket = F.pmod(F.xxhash64("value"), F.lit(TOPK_BUCKETS))
    local = (counts.filter(nn)
             .withColumn("__r", F.row_number().over(Window.partitionBy("column_name", bucket).orderBy(*order)))
             .filter(F.col("__r") <= mcv).drop("__r"))
    w = Window.partitionBy("column_name").orderBy(*order)
    top = (local.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= mcv)
           .groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("__r", "value", "n"))).alias("__top")))
    out = per_col.join(top, "column_name", "left").select(
        "column_name", "null_frac", "avg_width", "n_distinct",
        F.transform("__top", lambda t: t["value"]).alias("most_common_vals"),
        F.transform("__top", lambda t: t["n"] / F.col("__rows")).alias("most_common_freqs"))
    if not numeric:
        return out.withColumn("histogram_bounds", F.lit(None).cast("array<double>"))
    return out.join(_histograms(counts.where("num is not null").select("column_name", "num", "n"), buckets), "column_name", "left")


def _histograms(counts: DataFrame, buckets: int) -> DataFrame:
    """``(column_name, histogram_bounds)`` from ``(column_name, num, n)``: running sums over value ranges, with the sums of
    earlier ranges added, so that no task holds the values of a column."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(counts.repartitionByRange(parts, "column_name", "num").withColumn("pid", F.spark_partition_id()), "value-ranges")
    sums = ranged.groupBy("column_name", "pid").agg(F.sum("n").alias("s"))
    earlier = Window.partitionBy("column_name").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("column_name", "pid", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"),
                          F.sum("s").over(Window.partitionBy("column_name")).alias("total"))
    # A range holds the rows of few columns: at most ranges + columns rows, broadcast.
    upto = F.sum("n").over(Window.partitionBy("column_name", "pid").orderBy("num"))
    placed = ranged.withColumn("upto", upto).join(F.broadcast(offsets), ["column_name", "pid"])
    # Bound k is wanted by the row with the least place of at least k/buckets of the rows: up to place p these are 0 to p * buckets
    # div total (none up to place 0), so a row answers those that its places add, mostly none.
    placed = placed.select("column_name", "num", "n", "total", (F.col("before") + F.col("upto")).alias("last"))
    ended = F.when(F.col("last") == F.col("n"), -1).otherwise(F.expr(f"(last - n) * {buckets} div total"))
    hits = (placed.select("column_name", "num", (ended + 1).alias("k1"), F.expr(f"last * {buckets} div total").alias("k2"))
            .where("k1 <= k2").select("column_name", "num", F.explode(F.sequence("k1", "k2")).alias("k")))
    return (hits.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "num"))), lambda b: b["num"]).alias("histogram_bounds")))


SKETCH_TOP, SKETCH_K, SKETCH_HLL = 1_000, 800, 14


def column_sketches(df: DataFrame, columns: list[str] | None = None, parts: list[str] | None = None) -> DataFrame:
    """C6 states that merge: for each part of a table (the values of ``parts``, a partition column say) and column one row with
    counts and sketches of a fixed size, ``(<parts>, column_name, n, nulls, bytes, distinct, quantiles, common)``.

    Kept as a table, they give the statistics of any union of parts by ``merged_stats`` without reading the table again;
    when a partition is loaded or replaced, only its rows are made anew."""
    parts = list(parts or [])
    names = columns or [c for c in df.columns if c not in parts]
    place = {c: k for k, c in enumerate(names)}
    # The text of a value is made once, below the aggregate, and not by each of its sketches.
    rows = df.select(*[F.col(f"`{p}`") for p in parts], *[F.col(f"`{c}`").alias(f"__v{k}") for c, k in place.items()],
                     *[F.col(f"`{c}`").cast("string").alias(f"__t{k}") for c, k in place.items()])

    def sketch(c: str) -> Column:
        col, text = F.col(f"__v{place[c]}"), F.col(f"__t{place[c]}")
        numeric = df.schema[c].dataType.typeName() in NUMERIC
        return F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n"), F.count_if(col.isNull()).alias("nulls"),
            F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint").alias("bytes"), F.hll_sketch_agg(text, SKETCH_HLL).alias("distinct"),
            (F.kll_sketch_agg_double(col.cast("double"), SKETCH_K) if numeric else F.lit(None).cast("binary")).alias("quantiles"),
            F.expr(f"approx_top_k_accumulate(__t{place[c]}, {SKETCH_TOP})").alias("common"))

    one = rows.groupBy(*parts).agg(F.array(*[sketch(c) for c in names]).alias("s"))
    return one.select(*parts, F.explode("s").alias("s")).select(*parts, "s.*")


def merged_stats(sketches: DataFrame, mcv: int = 10, buckets: int = 10) -> DataFrame:
    """C6 from ``column_sketches`` rows: null fraction and width exact, the rest with the sketches' errors (distinct values about
    1 %, histogram bounds 0.5 % in rank, frequencies 0.1 % of the rows)."""
    merged = sketches.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("bytes").alias("bytes"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"), F.kll_merge_agg_double("quantiles").alias("q"), F.count("quantiles").alias("n_q"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(common, {SKETCH_TOP}), {min(10 * mcv, SKETCH_TOP)})").alias("found"))
    top = F.slice(F.array_sort(F.transform(F.filter("found", lambda t: t["item"].isNotNull()),
                                           lambda t: F.struct((-t["count"]).alias("less"), t["item"].alias("item")))), 1, mcv)
    ranks = F.array(*[F.lit(k / buckets) for k in range(buckets + 1)])
    some = F.size("top") > 0
    return merged.withColumn("top", top).select(
        "column_name", "n", F.try_divide("nulls", "n").alias("null_frac"), F.try_divide("bytes", F.col("n") - F.col("nulls")).alias("avg_width"),
        "n_distinct", F.when(some, F.transform("top", lambda t: t["item"])).alias("most_common_vals"),
        F.when(some, F.transform("top", lambda t: -t["less"] / F.col("n"))).alias("most_common_freqs"),
        F.when((F.col("n_q") > 0) & (F.kll_sketch_get_n_double("q") > 0), F.kll_sketch_get_quantile_double("q", ranks)).alias("histogram_bounds"))


def orphan_schema_drops(schemas: DataFrame, sessions: DataFrame, name_col: str = "nspname",
                        session_col: str = "sess_id") -> DataFrame:
    """C7. ``drop schema`` statements for temp schemas of sessions no longer alive (EXCEPT DISTINCT)."""
    temp = schemas.select(F.col(name_col).alias("nspname")).filter(F.col("nspname").like("pg_temp%"))
    live = sessions.select(F.concat(F.lit("pg_temp_"), F.col(session_col).cast("string")).alias("nspname"))
    gone = temp.subtract(live)
    return gone.select(F.concat(F.lit("drop schema if exists "), "nspname", F.lit(" cascade;")).alias("statement"))


def tables_without_partitions(tables: DataFrame, partitions: DataFrame) -> DataFrame:
    """C8. Ordinary tables that are not partitions of another table (``left_anti``)."""
    t = tables.filter((F.col("relkind") == "r") & F.col("relstorage").isin(TABLE_STORAGE))
    p = partitions.select(F.col("partitionschemaname").alias("nspname"), F.col("partitiontablename").alias("relname"))
    return t.join(p, ["nspname", "relname"], "left_anti").select(
        F.concat_ws(".", "nspname", "relname").alias("tablename"))


def profile_tables(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]],
                   progress_path: str, batch: int = 10) -> DataFrame:
    """E2 as one job list: snapshot rows appended per batch of ``batch`` tables to ``progress_path``;
    tables already there are skipped (resume after a failure)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(progress_path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done: set[str] = set()
    if fs.exists(at):  # any other failure to read is raised: going on would write rows twice
        done = {r[0] for r in spark.read.schema(SNAPSHOT_SCHEMA).parquet(progress_path)
                .select("tablename").distinct().collect()}
    todo = [t for t in tables if t not in done]
    for k in range(0, len(todo), batch):
        names = todo[k:k + batch]
        snapshot({n: tables[n] for n in names}, keys, set(keys)).write.mode("append").parquet(progress_path)
    return spark.read.parquet(progress_path)
