"""Session-scoped rows (T1-T4): one table whose rows carry ``__session_id``; a session reads and writes only its own rows
(partition pruning).

The table is a folder of parts and a log of versions; the last version names the parts in force, so every process reads
the same rows. An insert (T2) writes a part of its own and commits it; inserts of several writers all hold, as a
writer that loses the race for a version takes the next one. T3 removes the session's folders from the parts. T4
rewrites the parts it has read into one and commits that in their place, together with parts that were inserted meanwhile; of two
rewriters one gets ``store.Conflict``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy import store

SESSION_COL = "__session_id"


class SessionTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.versions = store.Versions(spark, f"{self.path}/versions")

    @classmethod
    def create(cls, spark: SparkSession, path: str, columns: list[str], distribution: list[str] | None = None):
        """T1. Table from ``'name type'`` column items plus ``__session_id``; ``distribution`` deals inserted rows."""
        t = cls(spark, path)
        number, state = t.versions.last()
        if state is not None:
            raise ValueError(f"there is a table at {path} already")
        schema = spark.createDataFrame([], ", ".join(columns)).schema
        t.versions.commit(number, {"schema": schema.json(), "distribution": distribution or [], "parts": []})
        return t

    def _state(self) -> tuple[int, dict]:
        number, state = self.versions.last()
        if state is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return number, state

    def _read(self, state: dict) -> DataFrame:
        own = T.StructType.fromJson(json.loads(state["schema"]))
        # Types are given: guessing the type of a folder name makes '1' of '01'.
        schema = T.StructType([*own.fields, T.StructField("part", T.StringType()), T.StructField(SESSION_COL, T.StringType())])
        columns = [*own.names, SESSION_COL]
        parts = [f"{self.path}/part={p}" for p in state["parts"] if store.exists(self.spark, f"{self.path}/part={p}")]
        if not parts:
            return self.spark.createDataFrame([], schema).select(*columns)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*parts).select(*columns)

    def base(self) -> DataFrame:
        return self._read(self._state()[1])

    def read(self, session_id: str) -> DataFrame:
        """The view: own rows only, without the session column."""
        return self.base().filter(F.col(SESSION_COL) == session_id).drop(SESSION_COL)

    def _write(self, df: DataFrame) -> str:
        part = uuid.uuid4().hex[:12]
        df.write.partitionBy(SESSION_COL).parquet(f"{self.path}/part={part}")
        return part

    def insert(self, df: DataFrame, session_id: str | None) -> None:
        """T2. Insert through the view: rows are tagged with the session id (NULL: visible to nobody)."""
        state = self._state()[1]
        own = T.StructType.fromJson(json.loads(state["schema"]))
        tagged = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in own], F.lit(session_id).cast("string").alias(SESSION_COL))
        if state["distribution"]:
            tagged = tagged.repartition(*state["distribution"])
        part = self._write(tagged)
        while True:
            number, state = self._state()
            try:
                self.versions.commit(number, {**state, "parts": [*state["parts"], part]})
                return
            except store.Conflict:
                continue

    def cleanup(self, session_id: str) -> None:
        """T3. Delete own rows: the session's folder in each part goes, no other session's rows are touched."""
        jvm = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        folder = f"{SESSION_COL}={jvm.escapePathName(session_id)}"
        for part in self._state()[1]["parts"]:
            store.delete(self.spark, f"{self.path}/part={part}/{folder}")
        self.spark.catalog.refreshByPath(self.path)

    def full_cleanup(self, active_sessions: DataFrame, session_col: str = "sess_id", reorganize: bool = False) -> None:
        """T4. Keep only rows of active sessions (NULL or inactive ids go); ``reorganize`` evens out the files by bytes."""
        active = active_sessions.select(F.col(session_col).cast("string").alias(SESSION_COL)).distinct()
        _, before = self._state()
        keep = self._read(before).join(active, SESSION_COL, "left_semi")
        part = self._write(keep.hint("rebalance", SESSION_COL) if reorganize else keep)
        while True:
            number, state = self._state()
            if not set(before["parts"]) <= set(state["parts"]):
                store.delete(self.spark, f"{self.path}/part={part}")
                raise store.Conflict(f"{self.path} was rewritten by another cleanup")
            inserted = [p for p in state["parts"] if p not in before["parts"]]
            try:
                self.versions.commit(number, {**state, "parts": [part, *inserted]})
                return  # the earlier parts are left for running readers
            except store.Conflict:
                continue
