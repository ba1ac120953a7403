"""Helpers shared by the operators: text batches, words, and array files in the shared folder.

Array files hold one Arrow record batch with one row of large lists, so a task can memory-map
them and use the values without copying. They are written under a temporary name and renamed: a task that
is run twice leaves the same complete file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from canopy.session import scratch_path

#: Ends of words: space and the five control characters 09-0D.
SPACES = " \t\n\x0b\x0c\r"


def send_code(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did (on a cluster: from the same folder or
    from the files given with ``--py-files``)."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for files that all executors read, below the session's checkpoint folder."""
    folder = scratch_path(spark, name)
    fs, path = _place(folder)
    fs.create_dir(path, recursive=True)
    return folder


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parsed.path
    return pafs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray], compressed: bool = False) -> None:
    """One file with the given one-dimensional arrays, complete or absent (``compressed``: smaller, but not mapped)."""
    fs, path = _place(uri)
    columns = {}
    for name, values in arrays.items():
        ends = pa.array([0, len(values)], pa.int64())
        columns[name] = pa.LargeListArray.from_arrays(ends, pa.array(values))
    batch = pa.record_batch(columns)
    part = f"{path}.{uuid.uuid4().hex}"
    options = pa.ipc.IpcWriteOptions(compression="zstd" if compressed else None)
    with fs.open_output_stream(part) as out, pa.ipc.new_file(out, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    fs.move(part, path)


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped where the shared folder is mounted, else read."""
    fs, path = _place(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        source = pa.memory_map(path)
    else:
        with fs.open_input_file(path) as f:
            source = pa.BufferReader(f.read_buffer())
    batch = pa.ipc.open_file(source).get_batch(0)
    return {n: batch.column(n).values.to_numpy(zero_copy_only=True) for n in batch.schema.names}


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[dict[str, pa.Array]], dict], schema: str,
             rows: int = 1 << 30) -> DataFrame:
    """``fn`` over Arrow batches of ``columns``, at most ``rows`` at a time; it returns the output columns as lists or arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, rows):
            out = fn({c: batch.column(i) for i, c in enumerate(columns)})
            yield pa.record_batch([_column(out[f.name], f.type) for f in target], names=target.names)

    send_code(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def add_columns(df: DataFrame, columns: list[str], fn: Callable[[dict[str, pa.Array]], dict], new: str,
                drop: list[str] | None = None, rows: int = 1 << 30) -> DataFrame:
    """``df`` with the columns of the DDL ``new``, made by ``fn`` from Arrow batches of ``columns``, at most ``rows`` at a time.

    Columns in ``drop`` go, and so do columns of ``df`` with the name of a new one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(new)
    gone = {*added.names, *(drop or [])}
    kept = [(i, f) for i, f in enumerate(df.schema.fields) if f.name not in gone]
    names, at = [f.name for _, f in kept] + added.names, {c: df.columns.index(c) for c in columns}
    target = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, rows):
            out = fn({c: batch.column(i) for c, i in at.items()})
            yield pa.record_batch([*(batch.column(i) for i, _ in kept), *(_column(out[f.name], f.type) for f in target)], names=names)

    send_code(df.sparkSession)
    return df.mapInArrow(run, StructType([f for _, f in kept] + added.fields))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def executor_files(uri: str, n: int) -> list[str]:
    """The names of ``n`` numbered array files in a shared folder."""
    return [os.path.join(uri, f"{i:06d}.arrow") for i in range(n)]
