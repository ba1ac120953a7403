"""Remote queries (the read side of L1 and L2), through one connection or many.

A sliced read asks the source once for the least and greatest value of a column, cuts the span into equal parts and reads
each part through a connection of its own: one predicate a part, the first of which takes the nulls as well. The parts
cover all rows and no row twice. Values may be whole numbers, decimals, floats, dates or timestamps.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Options of a registry row and a query: ``format`` (default jdbc) and the reader's own, such as ``url``, ``query``, ``path``.
_LITERALS = {"default": ("DATE '{}'", "TIMESTAMP '{}'"), "sqlserver": ("CAST('{}' AS date)", "CAST('{}' AS datetime2)")}


def _literal(value, dialect: str) -> str:
    day, moment = _LITERALS.get(dialect, _LITERALS["default"])
    if isinstance(value, dt.datetime):
        return moment.format(value.strftime("%Y-%m-%d %H:%M:%S.%f"))
    if isinstance(value, dt.date):
        return day.format(value.isoformat())
    return str(value)


def borders(least, greatest, n: int) -> list:
    """The inner borders of ``n`` equal parts of the span, without repeats."""
    if isinstance(least, dt.datetime):
        unit = dt.timedelta(microseconds=1)
        found = [least + ((greatest - least) // unit * i // n) * unit for i in range(1, n)]
    elif isinstance(least, dt.date):
        found = [least + dt.timedelta(days=(greatest - least).days * i // n) for i in range(1, n)]
    elif isinstance(least, bool) or not isinstance(least, (int, float, Decimal)):
        raise TypeError(f"can't slice by {type(least).__name__}: give a number, date or timestamp")
    elif isinstance(least, int):
        found = [least + (greatest - least) * i // n for i in range(1, n)]
    else:
        found = [least + (greatest - least) * i / n for i in range(1, n)]
    return [b for i, b in enumerate(found) if b > (found[i - 1] if i else least)]


def predicates(column: str, least, greatest, n: int, dialect: str = "default") -> list[str]:
    """One predicate a part. Together they take every row once, null values with the first part."""
    if least is None:
        return ["1 = 1"]
    cuts = [_literal(b, dialect) for b in borders(least, greatest, n)]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


def _reader(spark: SparkSession, options: dict) -> DataFrame:
    opts = dict(options)
    fmt, path = opts.pop("format", "jdbc"), opts.pop("path", None)
    reader = spark.read.format(fmt).options(**opts)
    return reader.load(path) if path else reader.load()


def _bounds(spark: SparkSession, options: dict, column: str) -> tuple:
    if options.get("format", "jdbc") == "jdbc":
        asked = {**options, "query": f"SELECT min({column}) AS lo, max({column}) AS hi FROM ({options['query']}) q"}
        row = _reader(spark, asked).first()
    else:
        row = _reader(spark, options).agg(F.expr(f"min({column})"), F.expr(f"max({column})")).first()
    return row[0], row[1]


def read(spark: SparkSession, options: dict, slice_by: tuple[str, int] | None = None) -> DataFrame:
    """The remote query as a DataFrame; with ``slice_by=(column, n)`` in up to ``n`` parts of its span."""
    if slice_by is None:
        return _reader(spark, options)
    column, n = slice_by
    least, greatest = _bounds(spark, options, column)
    url = options.get("url", "")
    parts = predicates(column, least, greatest, n, "sqlserver" if url.startswith("jdbc:sqlserver:") else "default")
    if options.get("format", "jdbc") == "jdbc":
        rest = {k: str(v) for k, v in options.items() if k not in ("format", "url", "query")}
        return spark.read.jdbc(url, f"({options['query']}) q", predicates=parts, properties=rest)
    found = None
    for p in parts:
        one = _reader(spark, options).where(p)
        found = one if found is None else found.unionByName(one)
    return found
