"""Sources (S1-S6) and loads (L1, L2): readers are plain ``spark.read`` calls with explicit schemas."""

from __future__ import annotations

from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions.strings import quote_ident
from canopy.sources import records, remote
from canopy.sources import rejects as R
from canopy.sources.rejects import RejectLimitExceeded  # noqa: F401  (part of this module's interface)

# The 30 columns of the server log, in file order.
SERVER_LOG_SCHEMA = T.StructType([
    T.StructField("event_time", T.TimestampType()),
    T.StructField("user_name", T.StringType()),
    T.StructField("database_name", T.StringType()),
    T.StructField("process_id", T.StringType()),
    T.StructField("thread_id", T.StringType()),
    T.StructField("remote_host", T.StringType()),
    T.StructField("remote_port", T.StringType()),
    T.StructField("session_start_time", T.TimestampType()),
    T.StructField("transaction_id", T.IntegerType()),
    T.StructField("gp_session_id", T.StringType()),
    T.StructField("gp_command_count", T.StringType()),
    T.StructField("gp_segment", T.StringType()),
    T.StructField("slice_id", T.StringType()),
    T.StructField("distr_tranx_id", T.StringType()),
    T.StructField("local_tranx_id", T.StringType()),
    T.StructField("sub_tranx_id", T.StringType()),
    T.StructField("event_severity", T.StringType()),
    T.StructField("sql_state_code", T.StringType()),
    T.StructField("event_message", T.StringType()),
    T.StructField("event_detail", T.StringType()),
    T.StructField("event_hint", T.StringType()),
    T.StructField("internal_query", T.StringType()),
    T.StructField("internal_query_pos", T.IntegerType()),
    T.StructField("event_context", T.StringType()),
    T.StructField("debug_query_string", T.StringType()),
    T.StructField("error_cursor_pos", T.IntegerType()),
    T.StructField("func_name", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_line", T.IntegerType()),
    T.StructField("stack_trace", T.StringType()),
])

_CORRUPT = "__corrupt"
_CSV = {"sep": ",", "quote": '"', "escape": '"', "nullValue": "", "multiLine": "true", "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": _CORRUPT}


def _server_log_columns(pieces: DataFrame, reason: Column) -> DataFrame:
    """The 30 columns of ``text``, or a reject where ``reason`` or the parser says so."""
    schema = T.StructType([*SERVER_LOG_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    text = F.regexp_replace("text", r"\r$", "")
    parsed = pieces.withColumn("log", F.when(reason.isNull(), F.from_csv(text, schema.simpleString()[7:-1].replace(":", " "), _CSV)))
    unfit = F.coalesce(reason, F.when(F.col(f"log.{_CORRUPT}").isNotNull(), F.lit("does not fit the 30 columns")))
    bad = R.reject(F.substring_index("file", "/", -1), F.col("text"), unfit)
    fields = [F.when(unfit.isNull(), F.col(f"log.{f.name}")).alias(f.name) for f in SERVER_LOG_SCHEMA.fields]
    return parsed.select(*fields, bad.alias(R.REJECT), *[c for c in pieces.columns if c.startswith("__")])


def load_server_log(spark: SparkSession, path: str, reject_limit: int | None = 1_000_000, longest: int = records.LONGEST) -> R.Loaded:
    """S1. CSV, ',' delimiter, '"' quote and escape, '' as NULL, UTF-8, multi-line fields, 30 columns.

    Files are read by as many tasks as they have splits, also within multi-line fields. Records that don't fit the columns
    are rejects of their file, at most ``reject_limit`` a file; empty lines between records are skipped."""
    none = F.lit(None).cast("string")
    pieces = records.assemble(spark, path, longest=longest)
    whole = F.col("begins") & F.col("ends")
    kept = pieces.where(~whole | (F.length(F.regexp_replace("text", r"\r$", "")) > 0))
    marked = kept.select("file", F.when(whole, F.col("text")).alias("text"),
                         F.when(~whole, F.struct("file", "start", "seq", "begins", "ends", "text")).alias("__part"))
    first = R.load(_server_log_columns(marked, none), "server-log", None)
    parts = first.rows.where(F.col("__part").isNotNull()).select("__part.*")
    rest = R.load(_server_log_columns(records.stitch(parts, longest), F.col("reason")), "server-log-borders", None)
    rows = first.rows.where(F.col("__part").isNull()).drop("__part").unionByName(rest.rows)
    rejects = first.rejects.unionByName(rest.rejects)
    bad = first.n_rejects + rest.n_rejects
    if reject_limit is not None and bad > reject_limit:
        R.check_limit(rejects, reject_limit)
    return R.Loaded(rows, rejects, first.n_rows - parts.count() + rest.n_rows, bad)


def read_server_log(spark: SparkSession, path: str) -> DataFrame:
    """S1, the rows that fit."""
    return load_server_log(spark, path).rows


def tag_gc_lines(lines: DataFrame, segment: Column | None = None) -> DataFrame:
    """S2 parsing half: ``value = '<line>|<segment>'`` -> (gclogline, gp_segment), split at the last '|'. A line without
    a whole number behind its last '|' is a reject; ``segment`` names the source segment that it came from."""
    last = F.substring_index("value", "|", -1)
    cut = F.instr("value", "|") > 0
    number = F.when(last.rlike("^-?[0-9]+$"), last.try_cast("int"))
    reason = F.when(~cut, F.lit("no segment")).when(number.isNull(), F.lit("segment is no number"))
    bad = R.reject(F.lit(None).cast("string") if segment is None else segment, F.col("value"), reason)
    text = F.expr("substring(value, 1, length(value) - length(substring_index(value, '|', -1)) - 1)")
    return lines.select(F.when(reason.isNull(), text).alias("gclogline"), F.when(reason.isNull(), number).alias("gp_segment"),
                        bad.alias(R.REJECT))


def split_gc_lines(lines: DataFrame, reject_limit: int | None = 1_000_000) -> DataFrame:
    """The rows of ``lines(value)`` that parse; more than ``reject_limit`` rejects are an error."""
    return R.load(tag_gc_lines(lines), "gc-lines", reject_limit).rows


def load_gc_log(spark: SparkSession, path: str, reject_limit: int | None = 1_000_000, parse=None) -> R.Loaded:
    """S2. Text lines ``line|segment``; more than ``reject_limit`` rejects in one source segment (the folder of a file) are
    an error. ``parse`` (GC2's, say) is applied before the one write, so a log is read and parsed once."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    tagged = tag_gc_lines(lines, R.folder_of(F.col("file")))
    return R.load(parse(tagged) if parse else tagged, "gc-log", reject_limit)


def read_gc_log(spark: SparkSession, path: str, reject_limit: int | None = 1_000_000) -> DataFrame:
    """S2, the rows that parse."""
    return load_gc_log(spark, path, reject_limit).rows


def split_process_lines(lines: DataFrame) -> DataFrame:
    """S3 parsing half: ``value = '<segment>|<ps line>'`` -> (segment_id, command), split at the first '|'."""
    cut = F.instr("value", "|")
    return lines.select(F.when(cut > 0, F.expr("substring(value, 1, instr(value, '|') - 1)"))
                        .otherwise(F.col("value")).alias("segment_id"),
                        F.when(cut > 0, F.expr("substring(value, instr(value, '|') + 1)"))
                        .otherwise(F.lit("")).alias("command"))


def read_process_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """S3. ``segment|ps line`` text."""
    return split_process_lines(spark.read.text(path))


def read_file_listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files under ``path`` with their sizes, listed by the driver (contents are never read: only path and length)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(F.col("path").alias("filename"), name.alias("relfilenode"),
                     F.col("length").cast("decimal(38,0)").alias("size"))


def list_folders(folders: DataFrame, folder_col: str = "folder") -> DataFrame:
    """S4. The files below each row's folder, listed by tasks: the columns of ``folders`` (``segment_id``, say) but the folder
    itself, and ``(filename, relfilenode, size)``. The driver holds no file; a folder that doesn't exist has none. Folders are
    URIs or paths of a file system that Arrow reads (local and mounted, HDFS, S3, GCS)."""
    spark, kept = folders.sparkSession, [f for f in folders.schema.fields if f.name != folder_col]
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*kept, T.StructField("filename", T.StringType()), T.StructField("relfilenode", T.StringType()),
                           T.StructField("size", T.LongType())])

    def run(batches):
        for batch in batches:
            for i, folder in enumerate(batch.column(0).to_pylist()):
                parsed = urlparse(folder)
                fs, path = (pafs.LocalFileSystem(), parsed.path) if parsed.scheme in ("", "file") else pafs.FileSystem.from_uri(folder)
                found = [f for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True)) if f.is_file]
                own = batch.slice(i, 1).take(pa.array([0] * len(found), pa.int64()))
                columns = [own.column(k) for k in range(1, own.num_columns)]
                yield pa.record_batch([*columns, pa.array([f.path for f in found], pa.string()), pa.array([f.base_name for f in found], pa.string()),
                                       pa.array([f.size for f in found], pa.int64())], names=schema.names)

    dealt = folders.select(folder_col, *[f.name for f in kept]).repartition(slices, folder_col)
    return dealt.mapInArrow(run, schema).withColumn("size", F.col("size").cast("decimal(38,0)"))


def read_table_list(spark: SparkSession, path: str) -> DataFrame:
    """S5. One table name per line, stripped; blank lines skipped."""
    stripped = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(stripped.alias("table_name")).filter(F.col("table_name") != "")


def connection_urls(connections: DataFrame) -> DataFrame:
    """S6, column form: ``(id, url, user, password)`` for every registry row ``(id, type, server_name, instance_name, port,
    database_name, user_name, pass)``. Types: oracle, SQL Server (mssql, sqlserver, ms), PostgreSQL; others by their own name."""
    kind = F.lower(F.trim("type"))
    port = F.coalesce(F.concat(F.lit(":"), F.col("port").cast("string")), F.lit(""))
    host = F.concat(F.col("server_name"), port)
    url = (F.when(kind == "oracle", F.concat(F.lit("jdbc:oracle:thin:@//"), host, F.lit("/"), F.coalesce("instance_name", "database_name")))
           .when(kind.isin("mssql", "sqlserver", "ms"), F.concat(
               F.lit("jdbc:sqlserver://"), host, F.coalesce(F.concat(F.lit(";databaseName="), F.col("database_name")), F.lit("")),
               F.coalesce(F.concat(F.lit(";instanceName="), F.col("instance_name")), F.lit(""))))
           .otherwise(F.concat(F.lit("jdbc:"), F.when(kind == "postgres", "postgresql").otherwise(kind), F.lit("://"), host, F.lit("/"),
                               F.col("database_name"))))
    return connections.select("id", url.alias("url"), F.col("user_name").alias("user"), F.col("pass").alias("password"))


def connection_options(connections: DataFrame, connection_id: int) -> dict:
    """S6. JDBC options for one registry row; the registry is keyed, so one row is fetched."""
    row = connection_urls(connections.filter(F.col("id") == connection_id)).limit(2).collect()
    if len(row) != 1:
        raise KeyError(f"connection {connection_id} not found or not unique")
    return {k: row[0][k] for k in ("url", "user", "password")}


def field_list(df: DataFrame) -> list[str]:
    """G1. Column names in order, quoted if they hold '#'."""
    return [quote_ident(c) for c in df.columns]


def get_field_list(spark: SparkSession, table_name: str) -> list[str]:
    """G1 by catalog name (lower-cased, as the reference looks it up)."""
    return field_list(spark.table(table_name.lower()))


def type_text(name: str, declared: str) -> str:
    """L1 type text of a column: lengths of character types and precision/scale of decimals as declared."""
    return f"{quote_ident(name)} {declared}"


def field_texts(spark: SparkSession, table_name: str) -> list[str]:
    """The type texts of a catalog table's columns, in order."""
    found = []
    for r in spark.sql(f"DESCRIBE TABLE {table_name}").collect():  # a row for each column
        if not r["col_name"] or r["col_name"].startswith("# "):
            break
        found.append(type_text(r["col_name"], r["data_type"]))
    return found


def conform(src: DataFrame, target_schema: T.StructType) -> DataFrame:
    """Match columns by name and cast to the target types (missing columns are an error)."""
    cols: list[Column] = []
    lower = {c.lower(): c for c in src.columns}
    for f in target_schema.fields:
        name = lower.get(f.name.lower())
        if name is None:
            raise KeyError(f"source lacks column {f.name}")
        cols.append(F.col(f"`{name}`").cast(f.dataType).alias(f.name))
    return src.select(*cols)


def load_from_source(spark: SparkSession, target_path: str, target_schema: T.StructType, options: dict,
                     fmt: str = "parquet", slice_by: tuple[str, int] | None = None) -> DataFrame:
    """L1 into a folder: remote query -> files there, replaced, columns/types from the schema."""
    df = conform(remote.read(spark, options, slice_by), target_schema)
    df.write.mode("overwrite").format(fmt).save(target_path)
    return spark.read.format(fmt).load(target_path)


def load_like(spark: SparkSession, target_path: str, like: DataFrame, options: dict,
              fmt: str = "parquet", slice_by: tuple[str, int] | None = None) -> DataFrame:
    """L2 into a folder: as L1 with the schema of another table."""
    return load_from_source(spark, target_path, like.schema, options, fmt, slice_by)


def load_into_table(spark: SparkSession, target: str, options: dict, slice_by: tuple[str, int] | None = None) -> None:
    """L1. Remote query -> existing catalog table, truncated first; columns by name. Declared lengths hold: a text longer
    than its ``varchar(n)`` is an error. ``slice_by=(column, n)`` reads through ``n`` connections at once."""
    schema = spark.table(target).schema
    conform(remote.read(spark, options, slice_by), schema).write.insertInto(target, overwrite=True)


def load_table_like(spark: SparkSession, target: str, like: str, options: dict, slice_by: tuple[str, int] | None = None,
                    location: str | None = None, fmt: str = "parquet") -> None:
    """L2. As L1; the target is dropped and created with the declared columns of the table ``like``."""
    fields, at = ", ".join(field_texts(spark, like)), f" LOCATION '{location}'" if location else ""
    spark.sql(f"DROP TABLE IF EXISTS {target}")
    spark.sql(f"CREATE TABLE {target} ({fields}) USING {fmt}{at}")
    load_into_table(spark, target, options, slice_by)
