"""Structured Streaming forms of the two polling jobs.

ST1: process snapshots arrive as text files ``segment|ps line``; each micro-batch is parsed (M1/M2) and
appended to a Parquet table. The reference polls every 60 s; here ``trigger(processingTime='60 seconds')``
in production and ``availableNow`` in tests. Progress is in the checkpoint folder, so a restarted
query continues where it stopped and no snapshot is written twice.

ST2: rolling GC counters in two streams. The first parses GC lines (S2, GC1) once and appends rows and rejects to one
table; the second counts its rows per segment over one-hour windows sliding every five minutes, with a 10-minute watermark
(later rows are dropped: our choice, the reference has no late-data rule), and checks them against the GC rules (events > 5,
seconds > 300). Windows that the watermark has passed move to a table of closed windows, and only open ones are carried
from batch to batch, so the sink holds one row a closed window however many batches have run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopy.operators import gclog as G
from canopy.operators.process import mem_watcher_view
from canopy import store
from canopy.sources import rejects as R
from canopy.sources.files import split_process_lines, tag_gc_lines


def ingest_process_snapshots(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str,
                             read_time=None, available_now: bool = False, interval: str = "60 seconds",
                             max_files_per_trigger: int | None = None) -> StreamingQuery:
    """ST1. ``readStream.text`` -> M1/M2 -> append to Parquet."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(source_dir)
    ts = read_time if read_time is not None else F.current_timestamp().cast("timestamp_ntz")
    rows = mem_watcher_view(split_process_lines(lines), ts)
    w = rows.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def gc_window_counts(gc: DataFrame, window: str = "1 hour", slide: str = "5 minutes",
                     watermark: str = "10 minutes") -> DataFrame:
    """ST2 aggregation: full GCs and GC seconds per segment and sliding window."""
    # event time must be a zoned timestamp for the watermark; the session zone (UTC) is applied
    return (gc.filter(F.col("gc_start").isNotNull())
            .withColumn("__event_time", F.col("gc_start").cast("timestamp"))
            .withWatermark("__event_time", watermark)
            .groupBy(F.window("__event_time", window, slide).alias("w"), "gp_segment")
            .agg(F.count_if(F.col("is_full") == 1).alias("full_gc_events"),
                 F.sum(F.col("gc_runtime_sec").cast("decimal(18,5)")).alias("gc_seconds"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "gp_segment",
                    "full_gc_events", "gc_seconds"))


def with_rules(counts: DataFrame) -> DataFrame:
    """GC7's event and time rules on window rows."""
    return counts.withColumn("events_error", F.col("full_gc_events") > G.FULLGC_EVENTS) \
        .withColumn("time_error", F.col("gc_seconds") > G.GC_TIME_SEC)


def _start_with_partitions(spark: SparkSession, partitions: int | None, start):
    """Start a stream with its own number of state partitions. The stream clones the session when it
    starts, and the number is then fixed in its checkpoint; the caller's session is restored at once."""
    if partitions is None:
        return start()
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(partitions))
    try:
        return start()
    finally:
        spark.conf.set(key, old)


def ingest_gc_log(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str, available_now: bool = False,
                  interval: str = "60 seconds", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """ST2, first stream: text ``line|segment`` -> GC1 -> append to Parquet, rows and rejects in one table.

    The file sink commits each batch once. The progress of the query carries the numbers of lines and rejects (``gc_lines``);
    ``gc_rows`` and ``gc_rejects`` read the table, and ``rejects.check_limit`` holds a limit by segment."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(source_dir).select("value", F.col("_metadata.file_path").alias("file"))
    tagged = G.gc_table(tag_gc_lines(lines, R.folder_of(F.col("file"))), keep=[R.REJECT])
    counted = tagged.observe("gc_lines", F.count(F.lit(1)).alias("lines"), F.count_if(F.col(R.REJECT).isNotNull()).alias("rejects"))
    w = counted.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def gc_rows(spark: SparkSession, table_path: str) -> DataFrame:
    return R.rows_of(spark.read.parquet(table_path))


def gc_rejects(spark: SparkSession, table_path: str) -> DataFrame:
    return R.rejects_of(spark.read.parquet(table_path))


def rolling_gc_counters(spark: SparkSession, table_path: str, out_path: str, checkpoint: str,
                        available_now: bool = False, interval: str = "5 minutes",
                        state_partitions: int | None = None, watermark_minutes: int = 10) -> StreamingQuery:
    """ST2, second stream: the table of ``ingest_gc_log`` -> windowed counts -> rules, per batch.

    ``out_path/open/batch=<id>`` holds the windows that may still change and those that this batch closed, and
    ``out_path/closed/batch=<id>`` the latter for good. A window is closed once the latest window start of all rows is ``watermark_minutes``
    behind its end: the stream's own watermark is at least as far then, so it can't change any more. A batch id that is run again
    starts from the batch before and overwrites its own folders. ``state_partitions`` sizes the state store (fixed at the first
    start of a checkpoint); by default the session's shuffle partitions."""
    out, key = out_path.rstrip("/"), ["window_start", "window_end", "gp_segment"]
    schema = spark.read.parquet(table_path).schema
    gc = R.rows_of(spark.readStream.schema(schema).parquet(table_path))
    counts = gc_window_counts(gc, watermark=f"{watermark_minutes} minutes")

    def sink(batch: DataFrame, batch_id: int) -> None:
        now = batch.sparkSession
        updates = with_rules(batch)
        before = [b for b in _batches(now, out) if b < batch_id]
        merged = updates
        if before:
            held = now.read.parquet(f"{out}/open/batch={before[-1]}").where(~F.col("closed")).drop("closed")
            both = held.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
            values = F.struct(*[c for c in updates.columns if c not in key])
            merged = both.groupBy(*key).agg(F.max_by(values, "__new").alias("v")).select(*key, "v.*")
        merged.write.mode("overwrite").parquet(f"{out}/merged")
        merged = now.read.parquet(f"{out}/merged")  # few rows: open windows don't grow with the stream
        passed = merged.agg(F.max("window_start")).scalar() - F.expr(f"INTERVAL {watermark_minutes} MINUTES")
        merged = merged.withColumn("closed", F.col("window_end") <= passed)
        merged.write.mode("overwrite").parquet(f"{out}/open/batch={batch_id}")
        done = now.read.parquet(f"{out}/open/batch={batch_id}").where("closed").drop("closed")
        done.coalesce(1).write.mode("overwrite").parquet(f"{out}/closed/batch={batch_id}")
        for old in before[:-1]:
            store.delete(now, f"{out}/open/batch={old}")

    w = counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return _start_with_partitions(spark, state_partitions, w.start)


def _batches(spark: SparkSession, out: str) -> list[int]:
    """Batches whose open windows are complete, in order."""
    found = [n for n in store.names(spark, f"{out}/open") if n.startswith("batch=")]
    return sorted(int(n[6:]) for n in found if store.exists(spark, f"{out}/open/{n}/_SUCCESS"))


def latest_windows(spark: SparkSession, out_path: str) -> DataFrame:
    """Read ST2 output: every closed window and the last state of the open ones."""
    out = out_path.rstrip("/")
    last = spark.read.parquet(f"{out}/open/batch={_batches(spark, out)[-1]}").where(~F.col("closed")).drop("closed")
    return spark.read.parquet(f"{out}/closed").drop("batch").unionByName(last)
