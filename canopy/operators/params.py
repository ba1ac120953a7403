"""Named parameters (P1-P5) as Spark SQL session variables.

``setparamv/n/d/t`` declare (or replace) a session variable; there is one name space for all types, so
setting a name with another type replaces it, and reading casts. A number keeps its own scale. Values travel with the query plan,
so every executor sees them. A per-row lookup by a name column joins the parameter table
(``(keyname, keyvalue)`` text rows, one per parameter: small by construction, hence broadcast).
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KIND_TYPE = {"v": "STRING", "d": "DATE", "t": "TIMESTAMP_NTZ"}
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def _number(value) -> Decimal | None:
    try:
        found = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    return found if found.is_finite() else None


def _scale(value) -> int:
    """Digits after the point of a number (0 for anything else)."""
    number = _number(value)
    return 0 if number is None else max(0, -number.as_tuple().exponent)


def _numeric(scale: int) -> str:
    if scale > 38:
        raise ValueError(f"a number with {scale} digits after the point does not fit DECIMAL(38)")
    return f"DECIMAL(38,{scale})"


def _sql_literal(value, kind: str) -> str:
    if value is None:
        return "NULL"
    if kind == "v":
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    if kind == "n":
        return f"CAST('{Decimal(str(value)):f}' AS {_numeric(_scale(value))})"
    if kind == "d":
        v = value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)
        return f"DATE'{v[:10]}'"
    v = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else str(value)
    return f"TIMESTAMP_NTZ'{v}'"


class Params:
    """P1-P5 over one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._kinds: dict[str, str] = {}
        self._scales: dict[str, int] = {}

    def _check(self, name: str) -> str:
        if not _NAME.match(name):
            raise ValueError(f"bad parameter name {name!r}")
        return name.lower()

    def set(self, name: str, value, kind: str = "v") -> None:
        """P1 (setparamv / setparamn / setparamd / setparamt)."""
        name = self._check(name)
        scale = _scale(value)
        sql_type = _numeric(scale) if kind == "n" else _KIND_TYPE[kind]
        self.spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {sql_type} DEFAULT {_sql_literal(value, kind)}")
        self._kinds[name], self._scales[name] = kind, scale

    def set_from_query(self, name: str, scalar_sql: str, kind: str = "v") -> None:
        """P1 with a computed value: ``SET VAR name = (scalar query)``; the query runs on the cluster and
        only its single value becomes the parameter."""
        name = self._check(name)
        if kind in ("n", "v"):  # one value, whose own scale becomes the parameter's
            return self.set(name, self.spark.sql(f"SELECT CAST(({scalar_sql}) AS STRING)").first()[0], kind)
        self.spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {_KIND_TYPE[kind]}")
        self.spark.sql(f"SET VAR {name} = CAST(({scalar_sql}) AS {_KIND_TYPE[kind]})")
        self._kinds[name], self._scales[name] = kind, 0

    def setparamv(self, name, value):
        self.set(name, value, "v")

    def setparamn(self, name, value):
        self.set(name, value, "n")

    def setparamd(self, name, value):
        self.set(name, value, "d")

    def setparamt(self, name, value):
        self.set(name, value, "t")

    def col(self, name: str, kind: str = "v") -> Column:
        """P2 with a constant name: the variable as a column, cast to the reading type."""
        name = self._check(name)
        sql_type = _numeric(self._scales.get(name, 0)) if kind == "n" else _KIND_TYPE[kind]
        if name not in self._kinds:
            return F.lit(None).cast(sql_type.lower())
        return F.expr(f"CAST(session.{name} AS {sql_type})")

    def get(self, name: str, kind: str = "v"):
        """P2 on the driver: the current value."""
        return self.spark.range(1).select(self.col(name, kind).alias("v")).first()["v"]

    def names(self) -> list[str]:
        return sorted(self._kinds)

    def table(self) -> DataFrame:
        """P3 / P4 form: ``(keyname, keyvalue)`` with values as text."""
        if not self._kinds:
            return self.spark.createDataFrame([], "keyname string, keyvalue string")
        parts = [f"SELECT '{n}' AS keyname, CAST(session.{n} AS STRING) AS keyvalue" for n in self.names()]
        return self.spark.sql(" UNION ALL ".join(parts))

    def listentries(self) -> DataFrame:
        """P3. ``'name -> value'`` rows."""
        return self.table().select(F.concat("keyname", F.lit(" -> "), F.coalesce("keyvalue", F.lit(""))).alias("entry"))

    def lookup(self, df: DataFrame, name_col: str, out: str, kind: str = "v") -> DataFrame:
        """P2 per row: the value of the parameter named in ``name_col`` (NULL if unset). Numbers come with the widest
        scale of all parameters, as a column has one type."""
        sql_type = _numeric(max(self._scales.values(), default=0)) if kind == "n" else _KIND_TYPE[kind]
        t = self.table().select(F.col("keyname").alias("__pname"), F.col("keyvalue").alias("__pval"))
        j = df.join(F.broadcast(t), F.lower(F.col(name_col)) == F.col("__pname"), "left")
        return j.withColumn(out, F.col("__pval").cast(sql_type.lower())).drop("__pname", "__pval")

    def savetotable(self, path: str) -> None:
        """P4. Store all parameters as text rows."""
        self.table().write.mode("overwrite").parquet(path)

    def readfromtable(self, path: str) -> None:
        """P4. Load parameters (as text values) written by ``savetotable``."""
        for r in self.spark.read.parquet(path).collect():  # the parameter set: a handful of rows
            self.set(r["keyname"], r["keyvalue"], "v")

    def view(self, view_name: str, sql_using_params: str) -> None:
        """P5. A temp view whose text reads ``session.<name>``: evaluated at query time, so it follows
        later ``set`` calls."""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {view_name} AS {sql_using_params}")
