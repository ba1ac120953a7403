"""Sinks (O1-O4): delimited dump, CSV export, compressed table write, append / overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dump_line(df: DataFrame, delimiter: str = "|", escape: str = "\\") -> Column:
    """O1 line: fields joined by ``delimiter`` without quoting; the escape character, the
    delimiter, '"', CR and LF inside a value get ``escape`` in front; NULL is empty."""
    special = "[" + "".join("\\" + ch for ch in {escape, delimiter, '"'}) + "\r\n]"
    rep = (escape.replace("\\", "\\\\")) + "$0"
    fields = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), special, rep)
              for c in df.columns]
    return F.concat_ws(delimiter, *fields)


def dump_delimited(df: DataFrame, path: str, delimiter: str = "|", escape: str = "\\") -> None:
    """O1. Pipe-delimited text dump, one line per row."""
    df.select(dump_line(df, delimiter, escape).alias("value")).write.mode("overwrite").text(path)


def export_csv(df: DataFrame, path: str, sep: str = "|") -> None:
    """O2. CSV with header and ``|`` delimiter."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "zstd",
                partition_by: list[str] | None = None, repartition_by: list[str] | None = None) -> None:
    """O3/O4. Create-table-as (compressed Parquet), append (insert-select) or overwrite
    (truncate + insert). ``repartition_by`` plays the part of ``distributed by``."""
    if repartition_by:
        df = df.repartition(*repartition_by)
    w = df.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
