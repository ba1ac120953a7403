"""Size / skew (SK1-SK4) and text index (X1, X2) queries.

File listing from lineitem: segment = l_suppkey % 8, file node = l_partkey (with a '.1' suffix for
lines above 4, i.e. a second file of the same table), size = l_extendedprice * 10000 bytes, and 0 for
lines without discount. Catalog from part (one table per part) and region (schemas).
Shards from documents (doc_id % 8), deleted = labels.toxic = 1.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import skew as SK
from canopy.operators import textindex as X
from canopy.plans.registry import query
from canopy.session import scratch_path
from canopy.sources.tables import table


def listing(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    node = F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") > 4, F.lit(".1")).otherwise(F.lit("")))
    size = F.when(F.col("l_discount") == 0, F.lit(0)).otherwise(F.round(F.col("l_extendedprice") * 10000)) \
        .cast("decimal(38,0)")
    return li.select((F.col("l_suppkey") % 8).cast("int").alias("segment_id"), node.alias("relfilenode"),
                     F.concat(F.lit("base/"), node).alias("filename"), size.alias("size"))


def catalog(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rel = p.select(F.col("p_partkey").alias("relfilenode"),
                   F.concat(F.lit("t_"), F.col("p_partkey").cast("string")).alias("relname"),
                   (F.col("p_size") % 5).alias("relnamespace"),
                   F.element_at(F.array(F.lit("h"), F.lit("a"), F.lit("c")), (F.col("p_size") % 3 + 1).cast("int"))
                   .alias("relstorage"),
                   F.when(F.col("p_partkey") % 10 == 0, F.lit("i")).otherwise(F.lit("r")).alias("relkind"))
    r = table(spark, sf_dir, "region")
    sch = r.select(F.col("r_regionkey").alias("oid"),
                   F.when(F.col("r_regionkey") == 4, F.lit("pg_temp_4")).otherwise(F.lower("r_name")).alias("nspname"))
    return rel, sch


SK_CTE = """
WITH f AS (SELECT CAST(l_suppkey % 8 AS INTEGER) AS segment_id,
                  CAST(l_partkey AS VARCHAR) || CASE WHEN l_linenumber > 4 THEN '.1' ELSE '' END AS relfilenode,
                  CAST(CASE WHEN l_discount = 0 THEN 0 ELSE round(l_extendedprice * 10000) END AS DECIMAL(38, 0)) AS size
           FROM lineitem),
c AS (SELECT p_partkey AS relfilenode, 't_' || p_partkey AS relname, p_size % 5 AS relnamespace,
             ['h', 'a', 'c'][p_size % 3 + 1] AS relstorage, CASE WHEN p_partkey % 10 = 0 THEN 'i' ELSE 'r' END AS relkind
      FROM part),
n AS (SELECT r_regionkey AS oid, CASE WHEN r_regionkey = 4 THEN 'pg_temp_4' ELSE lower(r_name) END AS nspname FROM region),
j AS (SELECT f.*, c.relname, c.relstorage, c.relkind, n.nspname
      FROM f JOIN c ON split_part(f.relfilenode, '.', 1) = CAST(c.relfilenode AS VARCHAR)
      JOIN n ON c.relnamespace = n.oid)
"""


@query("SK1", SK_CTE + """
SELECT nspname AS schemaname, relname AS tablename, relstorage, relkind,
       CAST(sum(size) / 1000000 AS DECIMAL(20, 6)) AS size_mb
FROM j GROUP BY 1, 2, 3, 4""")
def sk1(spark, sf_dir):
    rel, sch = catalog(spark, sf_dir)
    out = SK.table_sizes_mb(listing(spark, sf_dir), rel, sch)
    return out.withColumn("size_mb", F.col("size_mb").cast("decimal(20,6)"))


def gb(x: str, n: str) -> str:
    """Exact x / n / 1024^3 rounded half up to 2 places (DuckDB divides decimals in double)."""
    d = f"(2 * CAST({n} AS HUGEINT) * 1073741824)"
    return f"CAST(CAST((200 * CAST({x} AS HUGEINT) + CAST({n} AS HUGEINT) * 1073741824) // {d} AS DECIMAL(15, 0)) * 0.01 AS DECIMAL(15, 2))"


@query("SK2", SK_CTE + f""",
s AS (SELECT nspname AS schema_name, relname AS table_name, segment_id, sum(size) AS size FROM j
      WHERE relkind = 'r' AND nspname NOT IN ('pg_catalog', 'information_schema', 'gp_toolkit')
        AND nspname NOT LIKE 'pg_temp%' GROUP BY 1, 2, 3)
SELECT schema_name, table_name,
       {gb('sum(size)', '1')} AS total_size_gb,
       {gb('min(size)', '1')} AS seg_min_size_gb,
       {gb('max(size)', '1')} AS seg_max_size_gb,
       {gb('sum(size)', 'count(size)')} AS seg_avg_size_gb,
       CAST((2 * 10000 * CAST(max(size) - min(size) AS HUGEINT) + CAST(greatest(max(size), 1) AS HUGEINT))
            // (2 * CAST(greatest(max(size), 1) AS HUGEINT)) AS DECIMAL(15, 0)) * 0.01 AS seg_gap_min_max_percent,
       {gb('max(size) - min(size)', '1')} AS seg_gap_min_max_gb,
       CAST(count(size) FILTER (WHERE size = 0) AS INTEGER) AS nb_empty_seg
FROM s GROUP BY 1, 2""")
def sk2(spark, sf_dir):
    rel, sch = catalog(spark, sf_dir)
    return SK.get_skew(listing(spark, sf_dir), rel, sch)


def shards(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.groupBy((F.col("doc_id") % 8).alias("shard")).agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("toxic") == 1).alias("deldocs"),
        F.sum("n_chars").alias("size"))


@query("SK3", """
WITH s AS (SELECT d.doc_id % 8 AS shard, count(*) AS docs, count(*) FILTER (WHERE l.toxic = 1) AS deldocs,
                  sum(n_chars) AS size
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1),
a AS (SELECT max(docs) AS mx, min(docs) AS mn, sum(docs) AS sd, count(*) AS n, max(size) AS smx, min(size) AS smn,
             sum(size) AS ss, sum(deldocs) AS sx FROM s)
SELECT CASE WHEN mx > 0 THEN 'ok' ELSE 'empty' END AS status,
       CASE WHEN mx > 0 THEN CAST((mx - mn) / sd * n AS DECIMAL(20, 6)) END AS docs_skew,
       CASE WHEN mx > 0 THEN CAST((smx - smn) / ss * n AS DECIMAL(20, 6)) END AS size_skew,
       CASE WHEN mx > 0 THEN CAST(100.0 * sx / sd AS DECIMAL(10, 2)) END AS deleted_percent,
       CASE WHEN mx > 0 THEN CAST(ss / 1000000000 AS DECIMAL(20, 3)) END AS total_gb,
       CASE WHEN mx > 0 THEN CAST(ss / 1000000000 * (1.0 - sx / sd) AS DECIMAL(20, 3)) END AS after_expunge_gb
FROM a""")
def sk3(spark, sf_dir):
    return SK.shard_stats(shards(spark, sf_dir))


def _times(x: str, c: int) -> str:
    return f"((({x}) * {c}) % 4294967296)"


def _turned(x: str, bits: int) -> str:
    return f"((({x}) * {1 << bits}) % 4294967296 + ({x}) // {1 << 32 - bits})"


def _mixed(h: str, k: str) -> str:
    k1 = _times(_turned(_times(k, 0xCC9E2D51), 15), 0x1B873593)
    return f"(({_times(_turned(f'xor({h}, {k1})', 13), 5)} + {0xE6546B64}) % 4294967296)"


#: Spark's hash of a bigint (Murmur3 of its two halves, seed 42), step by step in unsigned arithmetic below 2**32.
HASH_SQL = f"""
h0 AS (SELECT DISTINCT l_orderkey AS k, (l_orderkey & 4294967295)::UBIGINT AS lo, ((l_orderkey >> 32) & 4294967295)::UBIGINT AS hi FROM lineitem),
h1 AS (SELECT k, hi, {_mixed('42::UBIGINT', 'lo')} AS h FROM h0),
h2 AS (SELECT k, xor({_mixed('h', 'hi')}, 8::UBIGINT) AS h FROM h1),
h3 AS (SELECT k, {_times('xor(h, h // 65536)', 0x85EBCA6B)} AS h FROM h2),
h4 AS (SELECT k, {_times('xor(h, h // 8192)', 0xC2B2AE35)} AS h FROM h3),
h5 AS (SELECT k, xor(h, h // 65536)::BIGINT AS h FROM h4),
hashed AS (SELECT k, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM h5)"""


def _skew_sql(buckets: int, ctes: str, bucket: str, source: str) -> str:
    return f"""
WITH {ctes}b AS (SELECT i AS bucket FROM range(0, {buckets}) r(i)),
p AS (SELECT {bucket} AS bucket, count(*) AS rows FROM {source} GROUP BY 1),
f AS (SELECT b.bucket, coalesce(p.rows, 0) AS rows FROM b LEFT JOIN p ON b.bucket = p.bucket)
SELECT sum(rows) AS total_rows, min(rows) AS min_rows, max(rows) AS max_rows, CAST(avg(rows) AS DECIMAL(20, 2)) AS avg_rows,
       CAST(100 * (max(rows) - min(rows)) / greatest(max(rows), 1) AS DECIMAL(6, 2)) AS gap_percent,
       count(*) FILTER (WHERE rows = 0) AS empty_buckets
FROM f"""


@query("SK4", _skew_sql(12, HASH_SQL + ",\n", "((h % 12) + 12) % 12", "lineitem JOIN hashed ON k = l_orderkey"))
def sk4(spark, sf_dir):
    out = SK.key_skew(table(spark, sf_dir, "lineitem"), ["l_orderkey"], buckets=12)
    return out.withColumn("total_rows", F.col("total_rows").cast("decimal(38,0)"))


@query("SK4_bucket", _skew_sql(16, "", "l_orderkey % 16", "lineitem"))
def sk4_bucket(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = SK.key_skew(li, buckets=16, bucket=F.pmod(F.col("l_orderkey"), F.lit(16)))
    return out.withColumn("total_rows", F.col("total_rows").cast("decimal(38,0)"))


X_FIELDS, X_TYPES = ["text", "lang"], ["text_intl", "string"]
X_SQL = r"""
WITH t AS (
  SELECT 'text' AS field, tok AS term, doc_id FROM documents, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_]+')) u(tok)
  WHERE tok <> ''
  UNION ALL
  SELECT 'lang', lang, doc_id FROM documents WHERE lang IS NOT NULL)
SELECT field, term, doc_id, count(*) AS tf FROM t {where} GROUP BY 1, 2, 3"""


def _index(spark, sf_dir) -> str:
    path = scratch_path(spark, "index")
    made = X.create_index(table(spark, sf_dir, "documents"), path, "doc_id", "text", X_FIELDS, X_TYPES)
    assert made.ok, made.notice
    return path


@query("X1", X_SQL.format(where=""))
def x1(spark, sf_dir):
    return X.read_index(spark, _index(spark, sf_dir))


@query("X2", X_SQL.format(where="WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def x2(spark, sf_dir):
    path = _index(spark, sf_dir)
    X.expunge_index(spark, path, table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id"))
    return X.read_index(spark, path)


@query("X2_merge", X_SQL.format(where="WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0 AND doc_id % 2 = 0)"))
def x2_merge(spark, sf_dir):
    """Two segments, two expunges, one merge."""
    path, labels = scratch_path(spark, "index"), table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents")
    X.create_index(docs.where("doc_id % 3 <> 0"), path, "doc_id", "text", X_FIELDS, X_TYPES)
    X.expunge_index(spark, path, labels.where("toxic = 1 AND doc_id % 3 <> 0"))
    X.add_documents(docs.where("doc_id % 3 = 0"), path, "doc_id")
    X.expunge_index(spark, path, labels.where("toxic = 1 OR quality = 0 AND doc_id % 2 = 0"))
    X.merge_index(spark, path)
    return X.read_index(spark, path)
