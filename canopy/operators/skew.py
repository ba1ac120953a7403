"""Size and skew reports (SK1-SK4): two-level aggregates over file listings, shard stats, key buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas left out of the skew report.
SKEW_EXCLUDED = ["pg_catalog", "information_schema", "gp_toolkit"]
GB = 1024 ** 3          # SK2 uses binary gigabytes
MB_DECIMAL = 1000 ** 2  # SK1 uses decimal megabytes
GB_DECIMAL = 1000 ** 3  # SK3 uses decimal gigabytes


def _catalog(relations: DataFrame, schemas: DataFrame) -> DataFrame:
    """relations(relfilenode, relname, relnamespace, relstorage, relkind) + schemas(oid, nspname)."""
    n = schemas.select(F.col("oid").alias("__ns"), "nspname")
    return relations.join(n, F.col("relnamespace") == F.col("__ns")).drop("__ns")


# Byte counts are summed as bigint per row (ANSI mode raises on overflow, which needs over 9 EB in one
# table) and become decimals only on the aggregated rows.


def _node_sizes(listing: DataFrame, *keys: str) -> DataFrame:
    """Bytes per data-file node (and segment). The files of one table are <node>, <node>.1, <node>.2, ...: they are
    summed before the catalog is joined, so a table of many files is one row a segment in the join."""
    node = F.split_part(F.col("relfilenode"), F.lit("."), F.lit(1)).alias("__node")
    return listing.groupBy(node, *keys).agg(F.sum(F.col("size").cast("bigint")).alias("size"))


def table_sizes_mb(listing: DataFrame, relations: DataFrame, schemas: DataFrame) -> DataFrame:
    """SK1. Size per (schema, table, storage, kind) in decimal MB."""
    cat = _catalog(relations, schemas).withColumn("__rel", F.col("relfilenode").cast("string"))
    j = _node_sizes(listing).join(cat, F.col("__node") == F.col("__rel"))
    return (j.groupBy(F.col("nspname").alias("schemaname"), F.col("relname").alias("tablename"), "relstorage", "relkind")
            .agg((F.sum("size").cast("decimal(30,0)") / F.lit(MB_DECIMAL)).alias("size_mb"))
            .orderBy("schemaname", "tablename", "relstorage", "relkind"))


def _skew_measures(per_part: DataFrame, keys: list[str], size: str, unit: int) -> DataFrame:
    # bytes as decimal(30,0): wide enough for any table, narrow enough that Spark keeps the
    # quotients exact to 8+ places before the numeric(15,2) rounding
    s = F.col(size).cast("decimal(30,0)")
    d15 = "decimal(15,2)"
    return per_part.groupBy(*keys).agg(
        (F.sum(s) / F.lit(unit)).cast(d15).alias("total_size_gb"),
        (F.min(s) / F.lit(unit)).cast(d15).alias("seg_min_size_gb"),
        (F.max(s) / F.lit(unit)).cast(d15).alias("seg_max_size_gb"),
        (F.avg(s) / F.lit(unit)).cast(d15).alias("seg_avg_size_gb"),
        (F.lit(100) * (F.max(s) - F.min(s)) / F.greatest(F.max(s), F.lit(1))).cast("decimal(6,2)")
        .alias("seg_gap_min_max_percent"),
        ((F.max(s) - F.min(s)) / F.lit(unit)).cast(d15).alias("seg_gap_min_max_gb"),
        F.count_if(s == 0).cast("int").alias("nb_empty_seg"))


def get_skew(listing: DataFrame, relations: DataFrame, schemas: DataFrame,
             min_total_gb: float | None = None, min_gap_percent: float | None = None) -> DataFrame:
    """SK2. Per table: total, min, max, avg segment size (GB = 1024^3, numeric(15,2)), gap %, gap GB and
    empty segments; ordinary tables outside system and temp schemas only. The size/gap filters of the
    reference are commented out there, so they are optional here."""
    cat = (_catalog(relations, schemas)
           .filter((F.col("relkind") == "r") & ~F.col("nspname").isin(SKEW_EXCLUDED)
                   & ~F.col("nspname").like("pg_temp%"))
           .withColumn("__rel", F.col("relfilenode").cast("string")))
    j = _node_sizes(listing, "segment_id").join(cat, F.col("__node") == F.col("__rel"))
    per_seg = j.groupBy(F.col("nspname").alias("schema_name"), F.col("relname").alias("table_name"), "segment_id") \
        .agg(F.sum("size").alias("size"))
    out = _skew_measures(per_seg, ["schema_name", "table_name"], "size", GB)
    if min_total_gb is not None:
        out = out.filter(F.col("total_size_gb") > min_total_gb)
    if min_gap_percent is not None:
        out = out.filter(F.col("seg_gap_min_max_percent") > min_gap_percent)
    return out


def shard_stats(shards: DataFrame, docs: str = "docs", deleted: str = "deldocs", size: str = "size") -> DataFrame:
    """SK3. One row: skew of docs and bytes ``(max-min)/sum*n``, deleted %, GB now and after expunge,
    and ``empty`` when no shard holds documents."""
    d, x, s = F.col(docs), F.col(deleted), F.col(size)
    a = shards.agg(F.max(d).alias("mx"), F.min(d).alias("mn"), F.sum(d).alias("sd"), F.count(F.lit(1)).alias("n"),
                   F.max(s).alias("smx"), F.min(s).alias("smn"), F.sum(s).alias("ss"), F.sum(x).alias("sx"))
    nonempty = F.col("mx") > 0
    dec = "decimal(20,6)"
    return a.select(
        F.when(nonempty, "ok").otherwise("empty").alias("status"),
        F.when(nonempty, ((F.col("mx") - F.col("mn")) / F.col("sd") * F.col("n")).cast(dec)).alias("docs_skew"),
        F.when(nonempty, ((F.col("smx") - F.col("smn")) / F.col("ss") * F.col("n")).cast(dec)).alias("size_skew"),
        F.when(nonempty, (F.lit(100.0) * F.col("sx") / F.col("sd")).cast("decimal(10,2)")).alias("deleted_percent"),
        F.when(nonempty, (F.col("ss") / F.lit(GB_DECIMAL)).cast("decimal(20,3)")).alias("total_gb"),
        F.when(nonempty, (F.col("ss") / F.lit(GB_DECIMAL) * (F.lit(1.0) - F.col("sx") / F.col("sd")))
               .cast("decimal(20,3)")).alias("after_expunge_gb"))


def key_skew(df: DataFrame, keys: list[str] | None = None, buckets: int = 200, bucket: Column | None = None) -> DataFrame:
    """SK4. SK2's measures over rows per hash bucket of ``keys`` (``pmod(hash(keys), buckets)``, the
    way a hash-distributed table would place them), or per given ``bucket`` expression. Empty buckets
    count, so all ``buckets`` ids are present."""
    spark: SparkSession = df.sparkSession
    b = bucket if bucket is not None else F.pmod(F.hash(*[F.col(k) for k in keys]), F.lit(buckets))
    per = df.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    allb = spark.range(buckets).select(F.col("id").cast(per.schema["bucket"].dataType).alias("bucket"))
    full = allb.join(per, "bucket", "left").select("bucket", F.coalesce("rows", F.lit(0)).alias("rows"))
    r = F.col("rows")
    return full.agg(
        F.sum(r).alias("total_rows"), F.min(r).alias("min_rows"), F.max(r).alias("max_rows"),
        F.avg(r).cast("decimal(20,2)").alias("avg_rows"),
        (F.lit(100) * (F.max(r) - F.min(r)) / F.greatest(F.max(r), F.lit(1))).cast("decimal(6,2)").alias("gap_percent"),
        F.count_if(r == 0).alias("empty_buckets"))


def partition_skew(df: DataFrame) -> DataFrame:
    """SK4, physical form: rows per Spark partition of ``df`` as it is laid out now."""
    per = df.groupBy(F.spark_partition_id().alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    r = F.col("rows")
    return per.agg(F.sum(r).alias("total_rows"), F.min(r).alias("min_rows"), F.max(r).alias("max_rows"),
                   (F.lit(100) * (F.max(r) - F.min(r)) / F.greatest(F.max(r), F.lit(1))).cast("decimal(6,2)")
                   .alias("gap_percent"))
