"""Process snapshot analytics (M1-M3): parse ``ps`` lines natively, type them, report memory skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (must equal the reference): background process kinds that are skipped, and the line pattern.
SKIPPED_KINDS = [
    "logger process", "primary process", "primary receiver ack process", "primary sender process",
    "primary consumer ack process", "primary recovery process", "primary verification process",
    "stats collector process", "writer process", "checkpoint process", "sweeper process",
]
PS_PATTERN = (r"^([0-9]+)\s+[0-9]+\s+([0-9]+)\s+([0-9]+)\s+([0-9\.]+)\s+([0-9\.]+) .* postgres: port\s+[0-9]+, "
              r"(\w+) (\w+) .* con([0-9]+) seg([0-9]+) cmd([0-9]+) (slice[0-9]+)?")
PS_FIELDS = ["pid", "rss", "vsz", "mem", "cpu", "username", "database", "session_id", "segment", "command_id", "slice"]


_SEP = "\u0001"
_TEMPLATE = _SEP + _SEP.join(f"${i}" for i in range(1, len(PS_FIELDS) + 1))


def _parsed(line: Column) -> Column:
    """An array with the 11 text fields (an array, '' where a group is missing) of a line that parses, else an empty array.

    The pattern runs once a line: a matching line is rewritten into its groups behind a mark, and a line that isn't
    rewritten has no such parts. Skipped kinds are tested by plain search. The rewritten line is bound by a lambda."""
    skipped = None
    for k in SKIPPED_KINDS:
        c = F.instr(line, k) > 0
        skipped = c if skipped is None else skipped | c
    text = F.when(~skipped, line)
    parts = F.split(F.regexp_replace(text, PS_PATTERN + r"[\s\S]*", _TEMPLATE), _SEP)
    good = F.filter(F.array(parts), lambda p: (F.size(p) == len(PS_FIELDS) + 1) & (F.get(p, F.lit(0)) == ""))
    return F.transform(good, lambda p: F.slice(p, 2, len(PS_FIELDS)))


def parse_ps_line(line) -> Column:
    """M1. The 11 text fields of a ``ps`` line (NULL for skipped kinds and unmatched lines); a missing group is NULL."""
    line = F.col(line) if isinstance(line, str) else line
    return F.get(F.transform(_parsed(line), lambda p: F.transform(p, lambda g: F.nullif(g, F.lit("")))), F.lit(0))


def mem_watcher_view(snapshots: DataFrame, read_time, segment_col: str = "segment_id",
                     command_col: str = "command") -> DataFrame:
    """M2. Typed rows with the read time; unparsed lines dropped (group 9, the segment, is unused).
    The fields of a line come as rows (one or none), so that no filter repeats the parsing."""
    ts = F.lit(read_time).cast("timestamp_ntz") if isinstance(read_time, str) else read_time
    q = snapshots.select(F.col(segment_col).alias("segment_id"), F.explode(_parsed(F.col(command_col))).alias("ps"))
    g = lambda i: F.nullif(F.get(F.col("ps"), F.lit(i - 1)), F.lit(""))
    return q.select(ts.alias("ts"), F.col("segment_id").cast("int").alias("segment_id"),
                    g(1).cast("int").alias("pid"), g(2).cast("bigint").alias("rss"), g(3).cast("bigint").alias("vsz"),
                    g(4).cast("double").alias("mem"), g(5).cast("double").alias("cpu"),
                    g(6).alias("username"), g(7).alias("database"), g(8).cast("int").alias("session_id"),
                    g(10).cast("int").alias("command_id"), g(11).alias("slice"))


def memory_skew(mem: DataFrame, top: int = 1000) -> DataFrame:
    """M3. Max memory per (segment, session, command), then per (session, command): skew
    ``(max-min)/avg`` (NULL on a zero average), max and min; the ``top`` largest by max real memory."""
    mb = lambda c: F.col(c).cast("decimal(20,0)") / F.lit(1024)
    per_seg = (mem.filter(F.col("command_id").isNotNull())
               .groupBy("segment_id", "session_id", "command_id")
               .agg(F.max(mb("rss")).alias("real_mem_mb"), F.max(mb("vsz")).alias("virtual_mem_mb")))
    agg = per_seg.groupBy("session_id", "command_id").agg(
        F.try_divide(F.max("real_mem_mb") - F.min("real_mem_mb"), F.avg("real_mem_mb")).alias("real_mem_skew"),
        F.try_divide(F.max("virtual_mem_mb") - F.min("virtual_mem_mb"), F.avg("virtual_mem_mb")).alias("virtual_mem_skew"),
        F.max("real_mem_mb").alias("max_real_mem_mb"), F.min("real_mem_mb").alias("min_real_mem_mb"),
        F.max("virtual_mem_mb").alias("max_virtual_mem_mb"), F.min("virtual_mem_mb").alias("min_virtual_mem_mb"))
    return agg.orderBy(F.desc("max_real_mem_mb"), "session_id", "command_id").limit(top)
