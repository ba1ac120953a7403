"""Exact dedup with a heavy-hitter split: of equal texts the row with the smallest ``doc_id`` stays.

Plan (DataFrame operations only).

1. Rows are written once with the SHA-256 of their normalised text (each run of white space is one space) and a
   row number ``rid``, so that later steps read digests and not texts.
2. A Misra-Gries summary of the digests (Spark's frequent-items sketch of fixed size, merged in two levels) names the
   candidates: a digest held by at least one row in ``shares`` is always among them.
3. The candidates are verified: their rows are counted exactly by the whole digest, combined before the shuffle, and
   digests that really hold at least one row in ``shares`` keep their winner (smallest id, then row number) and
   size. There are at most ``shares`` of them, so they are broadcast.
4. Rows of those digests are settled where they lie, on the map side. Only the rest is shuffled by digest; a
   group there has less than one row in ``shares``, so no task gets a hot group. ``shares`` is four times the shuffle
   partitions, 1,024 at least: a group that is shuffled is then small against an even share of a task.

The split changes where a group is settled and never the result.

Defined cases: a null text counts as empty and stays null in the rows returned; a null ``doc_id`` comes after all
others (a group of nulls only keeps one row, with ``keep_id`` null); rows that share ``doc_id`` and text are rows of
their own, of which one stays at most; very long texts are hashed whole; an empty table gives an empty result; columns
that have the name of a new one are replaced by it in ``mark_copies``, and ``drop_copies`` returns every column as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.session import written

#: A Misra-Gries summary of ``m`` counters errs by less than 3.5/(m/0.75) of the rows: with ``8 * shares`` counters and the
#: ``2 * shares`` largest estimates, no digest that holds one row in ``shares`` is missed.
COUNTERS, LARGEST = 8, 2
#: Bounds of the sketch function.
MOST_COUNTERS, LEAST_SHARES = 1_000_000, 1_024


def normalised(text: Column) -> Column:
    """The text with each run of white space (space, 09 to 0D) as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _shares(df: DataFrame) -> int:
    wanted = max(LEAST_SHARES, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return min(wanted, MOST_COUNTERS // COUNTERS)


def frequent(keys: DataFrame, key: str, shares: int) -> DataFrame:
    """Candidates for keys (bigint) that hold at least one row in ``shares``, as one column ``key``; at most ``2 * shares``
    rows. The summaries are merged by slices of the input's partitions first, then in one task."""
    slices = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = (keys.groupBy(F.pmod(F.spark_partition_id(), F.lit(slices)).alias("slice"))
            .agg(F.expr(f"approx_top_k_accumulate({key}, {COUNTERS * shares})").alias("summary")))
    # Grouped by a constant: the combining function fails on tasks without a row, which a global aggregate starts as well.
    whole = part.groupBy(F.lit("")).agg(F.expr(f"approx_top_k_combine(summary, {COUNTERS * shares})").alias("summary"))
    top = whole.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {LARGEST * shares})")).alias("top"))
    return top.select(F.col("top.item").alias(key))


def _settled(docs: DataFrame, columns: list[str], shares: int | None) -> DataFrame:
    """Per row of ``docs``: ``row`` (a struct of the columns), ``digest``, ``keep_id``, ``group_size`` and ``kept``."""
    carried = F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in columns])
    rows = written(docs.select(carried.alias("row"), F.col("doc_id").alias("id"),
                               F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
                   .withColumn("rid", F.monotonically_increasing_id()).withColumn("short", F.xxhash64("digest")), "digests")
    shares = shares or _shares(docs)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    candidates = frequent(rows, "short", shares)
    # F.broadcast is bounded: ``frequent`` gives at most 2 * shares rows, and at most ``shares`` digests reach the threshold.
    counted = (rows.join(F.broadcast(candidates), "short", "left_semi").groupBy("digest")
               .agg(least.alias("winner"), F.count(F.lit(1)).alias("size")))
    heavy = written(counted.where(F.col("size") * shares >= total), "heavy")
    by_digest = Window.partitionBy("digest")
    light = (rows.join(F.broadcast(heavy), "digest", "left_anti")
             .withColumn("winner", least.over(by_digest)).withColumn("size", F.count(F.lit(1)).over(by_digest)))
    hot = rows.join(F.broadcast(heavy), "digest")
    columns = ["row", "digest", F.col("winner.id").alias("keep_id"), F.col("size").alias("group_size"),
               (F.col("rid") == F.col("winner.rid")).alias("kept")]
    return light.select(*columns).unionByName(hot.select(*columns))


def mark_copies(docs: DataFrame, columns: list[str] | None = None, shares: int | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all, unless given) with ``keep_id`` (the ``doc_id`` that stays), ``group_size``, ``kept`` and
    ``text_sha256`` for every row. Without ``text`` among the columns no text is written or shuffled."""
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    columns = [c for c in columns or docs.columns if c not in new]
    found = _settled(docs, columns, shares).withColumn("text_sha256", F.lower(F.hex("digest")))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], *new)


def drop_copies(docs: DataFrame, shares: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts. The rows of heavy digests but their winners are
    removed on the map side, so hot texts are never shuffled."""
    return _settled(docs, docs.columns, shares).where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
