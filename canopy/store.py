"""Small files and folders of the shared store, through Hadoop's file systems: what a driver needs to commit a version."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in ``folder``, sorted; none if it doesn't exist."""
    fs, at = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless there is one already: of several writers one gets True."""
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    try:
        out = fs.create(at, False)
    except Exception as e:
        if fs.exists(at):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Conflict(RuntimeError):
    """Another writer committed first."""


class Versions:
    """A log of versions in a folder, one small JSON file each: the last one says what is in force. A version is committed by
    creating its file, which only one writer can do. A file without content (its writer was lost) is no version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names(self.spark, self.folder) if n.endswith(".json") and n[0].isdigit()]

    def last(self) -> tuple[int, dict | None]:
        """(number of the last file, content of the last version)."""
        found = self._numbers()
        for n in reversed(found):
            if text := read(self.spark, f"{self.folder}/{n:012d}.json"):
                return found[-1], json.loads(text)
        return (found[-1] if found else -1), None

    def commit(self, after: int, content: dict) -> int:
        """The version that follows ``after``; ``Conflict`` if another writer has made it."""
        number = after + 1
        if not create_once(self.spark, f"{self.folder}/{number:012d}.json", json.dumps(content)):
            raise Conflict(f"version {number} of {self.folder} was committed by another writer")
        return number
