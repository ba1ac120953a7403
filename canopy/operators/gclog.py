"""GC log analytics (GC1-GC7) as one Spark job per question; parsing is native regex, no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.session import written

# Fixed values (must equal the reference): the three line patterns, anchored at line start, and
# the alert thresholds.
YOUNG_PARALLEL = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+)[\+\-][0-9]+\:\s+[0-9]+\.[0-9]+:\s+\[GC \[PSYoungGen: ([0-9]+)K->([0-9]+)K\(([0-9]+)K\)\]\s+([0-9]+)K->([0-9]+)K\(([0-9]+)K\),\s+([0-9]+\.[0-9]+)\s+secs\]"  # noqa: E501
YOUNG_DEFNEW = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+)[\+\-][0-9]+\:\s+[0-9]+\.[0-9]+:\s+\[GC\s+[0-9]+\.[0-9]+:\s+\[DefNew: ([0-9]+)K->([0-9]+)K\(([0-9]+)K\)\,\s+[0-9]+\.[0-9]+\s+secs\]\s+([0-9]+)K->([0-9]+)K\(([0-9]+)K\),\s+([0-9]+\.[0-9]+)\s+secs\]"  # noqa: E501
FULL = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+)[\+\-][0-9]+\:\s+[0-9]+\.[0-9]+:\s+\[Full GC\s+\[PSYoungGen: ([0-9]+)K->([0-9]+)K\(([0-9]+)K\)\]\s+\[PSOldGen: ([0-9]+)K->([0-9]+)K\(([0-9]+)K\)\]\s+([0-9]+)K->([0-9]+)K\(([0-9]+)K\)\s+\[PSPermGen: ([0-9]+)K->([0-9]+)K\(([0-9]+)K\)\],\s([0-9]+\.[0-9]+)\s+secs\]"  # noqa: E501

FULLGC_INTERVAL = 2.0    # last interval * this < average interval
FULLGC_HEAP_PERC = 80.0  # heap after full GC above this % of max
FULLGC_EVENTS = 5        # more full GCs in the last hour
GC_TIME_SEC = 300.0      # more GC seconds in the last hour

FIELDS = ["is_full", "gc_start", "young_gen_old_size_kb", "young_gen_new_size_kb", "young_gen_max_size_kb",
          "old_gen_old_size_kb", "old_gen_new_size_kb", "old_gen_max_size_kb", "perm_gen_old_size_kb",
          "perm_gen_new_size_kb", "perm_gen_max_size_kb", "full_heap_old_size_kb", "full_heap_new_size_kb",
          "full_heap_max_size_kb", "gc_runtime_sec"]

# One regex pass per line: the matching pattern rewrites the whole line into its groups in a fixed
# slot order [date, time, young x3, old x3, perm x3, heap x3, secs], joined by _SEP (empty = missing).
_SEP = "\u0001"
_SLOTS = {
    "parallel": [1, 2, 3, 4, 5, None, None, None, None, None, None, 6, 7, 8, 9],
    "defnew": [1, 2, 3, 4, 5, None, None, None, None, None, None, 6, 7, 8, 9],
    "full": [1, 2, 3, 4, 5, 6, 7, 8, 12, 13, 14, 9, 10, 11, 15],
}
_PATTERNS = {"full": FULL, "defnew": YOUNG_DEFNEW, "parallel": YOUNG_PARALLEL}


def _template(kind: str) -> str:
    return _SEP.join("" if g is None else f"${g}" for g in _SLOTS[kind])


def gc_kind(line: Column) -> Column:
    kind = None
    for name, pat in _PATTERNS.items():
        kind = F.when(line.rlike(pat), F.lit(name)) if kind is None else kind.when(line.rlike(pat), F.lit(name))
    return kind


def gc_slots(line: Column, kind: Column) -> Column:
    """The 15 text slots of a matched line (one ``regexp_replace`` for the matching pattern)."""
    norm = None
    for name, pat in _PATTERNS.items():
        rep = F.regexp_replace(line, pat + r"[\s\S]*", _template(name))
        norm = F.when(kind == name, rep) if norm is None else norm.when(kind == name, rep)
    return F.split(norm, _SEP)


def gc_struct(kind: Column, slots: Column) -> Column:
    def slot(i: int, cast: str = "int") -> Column:
        return F.nullif(F.get(slots, i), F.lit("")).cast(cast)
    start = F.concat(F.get(slots, 0), F.lit(" "), F.get(slots, 1)).try_cast("timestamp_ntz")
    names = FIELDS[2:14]
    return F.struct(
        F.when(kind == "full", 1).when(kind.isNotNull(), 0).cast("smallint").alias("is_full"),
        start.alias("gc_start"),
        *[slot(2 + k).alias(n) for k, n in enumerate(names[:3])],
        *[slot(5 + k).alias(n) for k, n in enumerate(names[3:6])],
        *[slot(8 + k).alias(n) for k, n in enumerate(names[6:9])],
        *[slot(11 + k).alias(n) for k, n in enumerate(names[9:12])],
        slot(14, "double").alias("gc_runtime_sec"))


def parse_gc_line(line) -> Column:
    """GC1. The 15-field struct of a GC log line; a line matching no pattern gives all NULLs."""
    line = F.col(line) if isinstance(line, str) else line
    kind = gc_kind(line)
    return gc_struct(kind, gc_slots(line, kind))


def gc_table(lines: DataFrame, line_col: str = "gclogline", segment_col: str = "gp_segment",
             keep: list[str] | None = None) -> DataFrame:
    """GC2. ``(gp_segment, gclogline, <15 fields>)`` and the columns in ``keep``; unmatched lines are kept with NULL fields.
    The pattern test and the group extraction are separate projections, so each runs once per line."""
    names = ["gp_segment", "gclogline", *(keep or [])]
    k = lines.select(F.col(segment_col).alias("gp_segment"), F.col(line_col).alias("gclogline"), *(keep or []),
                     gc_kind(F.col(line_col)).alias("__kind"))
    s = k.select(*names, "__kind", gc_slots(F.col("gclogline"), F.col("__kind")).alias("__slots"))
    return s.select(*names, gc_struct(F.col("__kind"), F.col("__slots")).alias("g")).select(*names, "g.*")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def full_gc_intervals(gc: DataFrame) -> DataFrame:
    """GC3. Per segment: average full-GC interval and the interval before the latest full GC (seconds).

    Same numbers as ``ts - lag(ts)`` over each segment's full GCs, without putting a segment into one
    task: the intervals telescope, so their average is (last - first) / (n - 1); the last interval is
    the latest start minus the latest earlier start (0 when the latest start occurs twice). Both are
    grouped aggregates combined map-side. The full GCs are parsed once and written (segment and start only); the
    aggregates read that table."""
    full = written(gc.filter(F.col("is_full") == 1).select("gp_segment", _micros(F.col("gc_start")).alias("__t")),
                   "full-gc")
    per = full.groupBy("gp_segment").agg(F.max("__t").alias("__mx"), F.min("__t").alias("__mn"),
                                         F.count("__t").alias("__n"))
    second = (full.join(per, "gp_segment")
              .groupBy("gp_segment")
              .agg(F.max(F.when(F.col("__t") < F.col("__mx"), F.col("__t"))).alias("__prev"),
                   F.count_if(F.col("__t") == F.col("__mx")).alias("__at_max"),
                   F.first("__mx").alias("__mx"), F.first("__mn").alias("__mn"), F.first("__n").alias("__n")))
    avg = F.when(F.col("__n") > 1, (F.col("__mx") - F.col("__mn")) / (F.col("__n") - 1) / 1e6)
    last = (F.when(F.col("__n") < 2, F.lit(None))
            .when(F.col("__at_max") > 1, F.lit(0.0))
            .otherwise((F.col("__mx") - F.col("__prev")) / 1e6))
    return second.select("gp_segment", avg.cast("double").alias("avg_full_gc_interval"),
                         last.cast("double").alias("full_gc_interval"))


def heap_after_full_gc(gc: DataFrame, pick: str = "last") -> DataFrame:
    """GC4. Heap max and heap after one full GC per segment: the latest (``pick='last'``, the intent)
    or the earliest (``pick='first'``, as the reference query is written)."""
    full = gc.filter(F.col("is_full") == 1)
    chooser = F.max_by if pick == "last" else F.min_by
    by = F.struct("gc_start", "full_heap_max_size_kb", "full_heap_new_size_kb")
    return full.groupBy("gp_segment").agg(chooser(by, "gc_start").alias("r")).select(
        "gp_segment", F.col("r.full_heap_max_size_kb").alias("full_heap_max_size_kb"),
        F.col("r.full_heap_new_size_kb").alias("full_heap_new_size_kb"))


def _last_hour(as_of: str) -> Column:
    return (F.lit(as_of).cast("timestamp_ntz") - F.col("gc_start")) < F.expr("INTERVAL 1 HOUR")


def full_gc_count_last_hour(gc: DataFrame, as_of: str) -> DataFrame:
    """GC5. Full GCs per segment with ``as_of - gc_start < 1 hour`` (later rows pass too, as written)."""
    return gc.filter((F.col("is_full") == 1) & _last_hour(as_of)).groupBy("gp_segment").agg(
        F.count(F.lit(1)).alias("events"))


def gc_seconds_last_hour(gc: DataFrame, as_of: str) -> DataFrame:
    """GC6. GC seconds per segment in the last hour (summed exactly as decimal)."""
    return gc.filter(_last_hour(as_of)).groupBy("gp_segment").agg(
        F.sum(F.col("gc_runtime_sec").cast("decimal(18,5)")).alias("gc_total_runtime"))


def gc_alerts(gc: DataFrame, as_of: str, pick: str = "last") -> DataFrame:
    """GC7. The four rules as rows ``(gp_segment, rule, value, threshold, is_error)``.

    The log is read and parsed once: the six columns that the rules need are written, and both passes read that
    table, one for the interval rule, one grouped aggregate for the heap, event and time rules whose row is unfolded
    into rule rows. A rule row exists only where the reference query returns a row for that segment."""
    dec = "decimal(20,3)"
    gc = written(gc.select("gp_segment", "is_full", "gc_start", "full_heap_max_size_kb", "full_heap_new_size_kb",
                           "gc_runtime_sec"), "gc-rules")
    iv = full_gc_intervals(gc).select(
        "gp_segment", F.lit("fullgc_interval").alias("rule"), F.col("full_gc_interval").cast(dec).alias("value"),
        (F.col("avg_full_gc_interval") / FULLGC_INTERVAL).cast(dec).alias("threshold"),
        F.coalesce(F.col("full_gc_interval") * FULLGC_INTERVAL < F.col("avg_full_gc_interval"), F.lit(False))
        .alias("is_error"))
    full = F.col("is_full") == 1
    recent = _last_hour(as_of)
    chooser = F.max_by if pick == "last" else F.min_by
    per = gc.groupBy("gp_segment").agg(
        F.count_if(full).alias("n_full"),
        chooser(F.struct("full_heap_max_size_kb", "full_heap_new_size_kb"), F.when(full, F.col("gc_start"))).alias("h"),
        F.count_if(full & recent).alias("events"),
        F.count_if(recent).alias("n_recent"),
        F.sum(F.when(recent, F.col("gc_runtime_sec").cast("decimal(18,5)"))).alias("secs"))
    hmax, hnew = F.col("h.full_heap_max_size_kb"), F.col("h.full_heap_new_size_kb")
    rule = lambda present, name, value, threshold, err: F.struct(
        present.alias("present"), F.lit(name).alias("rule"), value.cast(dec).alias("value"),
        threshold.cast(dec).alias("threshold"), err.alias("is_error"))
    rules = F.array(
        rule(F.col("n_full") > 0, "fullgc_heap", hnew, hmax * FULLGC_HEAP_PERC / 100.0,
             F.coalesce(hmax * FULLGC_HEAP_PERC / 100.0 < hnew, F.lit(False))),
        rule(F.col("events") > 0, "fullgc_events", F.col("events"), F.lit(FULLGC_EVENTS),
             F.col("events") > FULLGC_EVENTS),
        rule(F.col("n_recent") > 0, "gc_time", F.col("secs"), F.lit(GC_TIME_SEC), F.col("secs") > GC_TIME_SEC))
    rest = (per.select("gp_segment", F.explode(rules).alias("r")).filter(F.col("r.present"))
            .select("gp_segment", "r.rule", "r.value", "r.threshold", "r.is_error"))
    return iv.unionByName(rest)
