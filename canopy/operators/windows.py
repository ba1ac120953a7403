"""Window operators that survive hot partition keys.

* ``row_number_split``: ``row_number() over (partition by keys order by ...)``. Rows are range-partitioned on
  (keys, order), so a hot key is spread over as many ranges as its size needs; rows are numbered inside each (key,
  range) and the counts of the same key in earlier ranges are added.
* ``max_over``: ``max(v) over (partition by k)`` as a grouped aggregate (map-side combined) joined back.
* ``count_distinct_over``: ``count(distinct x) over (partition by y)``, which Spark refuses as a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.session import written


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def row_number_split(df: DataFrame, keys: list[str], order: list, out: str = "rn",
                     partitions: int | None = None) -> DataFrame:
    """``row_number()`` per ``keys`` ordered by ``order`` (Columns or names; ascending unless a Column says
    otherwise). Give a total order (a unique last key) for a deterministic numbering.

    The ranges are written once, so that a range keeps its number. A (key, range) group is never larger than a
    range. Only a key that crosses the border of a range needs an offset: at most two rows a range, broadcast."""
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [F.col(k) for k in keys] + _cols(order)
    ranged = written(df.repartitionByRange(n_parts, *sort_cols).withColumn("__pid", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("__lrn", F.row_number().over(Window.partitionBy(*keys, "__pid").orderBy(*_cols(order))))
    names = [f"__ok{i}" for i in range(len(keys))]
    counts = ranged.groupBy("__pid", *keys).agg(F.count(F.lit(1)).alias("__len"))
    # null keys are keys too: the join below is null-safe
    counts = counts.select(F.col("__pid").alias("__opid"), *[F.col(k).alias(n) for k, n in zip(keys, names)], "__len")
    earlier = Window.partitionBy(*names).orderBy("__opid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("__off", F.sum("__len").over(earlier)).filter(F.col("__off").isNotNull())
               .drop("__len"))
    cond = F.col("__pid") == F.col("__opid")
    for k, n in zip(keys, names):
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    joined = local.join(F.broadcast(offsets), cond, "left")
    return joined.select(*df.columns, (F.col("__lrn") + F.coalesce("__off", F.lit(0))).alias(out))


def max_over(df: DataFrame, value: str, key: Column | str, out: str) -> DataFrame:
    """``max(value) over (partition by key)``: pre-aggregate per key, join back null-safe."""
    key = F.col(key) if isinstance(key, str) else key
    keyed = df.withColumn("__k", key)
    agg = keyed.groupBy("__k").agg(F.max(value).alias(out)).withColumnRenamed("__k", "__k2")
    return keyed.join(agg, keyed["__k"].eqNullSafe(agg["__k2"]), "left").drop("__k", "__k2")


def count_distinct_over(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """``count(distinct x) over (partition by y)``; NULL x is not counted, NULL y is its own group."""
    per_y = (df.select(y, x).filter(F.col(x).isNotNull()).distinct()
             .groupBy(y).agg(F.count(F.lit(1)).alias(out)).withColumnRenamed(y, "__y"))
    joined = df.join(per_y, df[y].eqNullSafe(per_y["__y"]), "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce(F.col(out), F.lit(0)).alias(out))
