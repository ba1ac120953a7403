"""A reject channel for sources: one pass splits rows that parse from those that don't.

A loader gives each row either its columns or a reject (line and reason). Both are written once into one table in the
shared folder; rejected rows and rows that parse are read from there. The number of rejects comes from the write
itself (an ``Observation``), so the text is read once. The limit holds for each source segment, as an external table's
does: only if more rows than the limit were rejected in all are they counted by segment, over the rejects alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from canopy.session import scratch_path

REJECT = "__reject"


class RejectLimitExceeded(RuntimeError):
    pass


@dataclass
class Loaded:
    """What a load read: ``rows`` that parse, and ``rejects(segment, line, reason)``."""
    rows: DataFrame
    rejects: DataFrame
    n_rows: int
    n_rejects: int


def reject(segment: Column, line: Column, reason: Column) -> Column:
    """The reject of a row; null if ``reason`` is."""
    return F.when(reason.isNotNull(), F.struct(segment.alias("segment"), line.alias("line"), reason.alias("reason")))


def folder_of(path: Column) -> Column:
    """The segment of a source file: the name of its folder, or what follows ``=`` in it (``segment=3``)."""
    return F.substring_index(F.element_at(F.split(path, "/"), -2), "=", -1)


def rows_of(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col(REJECT).isNull()).drop(REJECT)


def rejects_of(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col(f"{REJECT}.reason").isNotNull()).select(f"{REJECT}.*")


def by_segment(rejects: DataFrame) -> DataFrame:
    """``(segment, reason, n)``."""
    return rejects.groupBy("segment", "reason").agg(F.count(F.lit(1)).alias("n"))


def check_limit(rejects: DataFrame, limit: int) -> None:
    """Raises if a segment has more than ``limit`` rejects."""
    over = rejects.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    worst = over.orderBy(F.desc("n"), "segment").first()
    if worst:
        raise RejectLimitExceeded(f"segment {worst['segment']}: {worst['n']} rejected rows, limit {limit}")


def load(tagged: DataFrame, name: str, limit: int | None) -> Loaded:
    """Writes ``tagged`` (columns and ``REJECT``) once; more than ``limit`` rejects in a segment are an error."""
    spark = tagged.sparkSession
    path, seen = scratch_path(spark, name), Observation()
    counted = tagged.observe(seen, F.count(F.lit(1)).alias("all"), F.count_if(F.col(REJECT).isNotNull()).alias("bad"))
    counted.write.parquet(path)
    n, bad = seen.get["all"], seen.get["bad"]
    table = spark.read.schema(tagged.schema).parquet(path)
    found = Loaded(rows_of(table), rejects_of(table), n - bad, bad)
    if limit is not None and bad > limit:
        check_limit(found.rejects, limit)
    return found
