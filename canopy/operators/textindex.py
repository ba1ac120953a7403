"""Text index over chosen columns (X1) and expunge of deleted documents (X2).

An index is a folder of immutable parts and a log of versions:

* ``segments/<name>/field=<field>``: postings ``(term, doc_id, tf)`` of some documents. A document's terms are counted within
  its row, so postings are written where the document lies, without a shuffle.
* ``deletes/<name>``: a bitmap of deleted documents, one row for each 32,768 ids that has any.
* ``versions``: small files; the last one names the segments in force and the bitmaps that apply to each.

A reader of the index path takes the last version, so it never sees a deleted document or half of a change. Expunging
writes one bitmap, whatever the size of the index; a merge folds bitmaps and segments into one new segment.
Versions are committed by creating their file, so of two writers one gets ``store.Conflict`` and may start again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy import store

TOKEN_SPLIT = r"[^\p{L}\p{M}\p{N}_]+"  # letters, marks and digits of any script
TERM_RUN = r"([^ ]+)(?: \1(?= |$))*+"  # possessive: a plain repeat of this group recurses in Java, once for each repeated term
POSTINGS = "term string, doc_id bigint, tf bigint, field string"
BITMAP_IDS, BITMAP_BYTES = 32_768, 4_096  # of Spark's bitmap functions


@dataclass
class IndexResult:
    ok: bool
    notice: str = ""
    path: str | None = None


def terms(value: Column, field_type: str) -> Column:
    """Terms of one field value: text types are lower-cased and split on non-word characters,
    other types are one term (the value as text)."""
    if field_type.lower().startswith("text"):
        return F.array_remove(F.split(F.lower(value), TOKEN_SPLIT), "")
    return F.when(value.isNotNull(), F.array(value.cast("string"))).otherwise(F.array().cast("array<string>"))


def field_postings(df: DataFrame, id_col: str, field: str, field_type: str) -> DataFrame:
    """``(term, doc_id, tf)`` of one field; ids are unique. No shuffle: the sorted terms of a row, joined by spaces (no term of a text
    has one), are cut into runs of one term, whose number follows from the lengths. No function of this runs a lambda for each term."""
    value, doc = F.col(field), F.col(id_col).alias("doc_id")
    if not field_type.lower().startswith("text"):
        return df.where(value.isNotNull()).select(value.cast("string").alias("term"), doc, F.lit(1).cast("bigint").alias("tf")).where("term is not null")
    sorted_terms = F.array_join(F.sort_array(terms(value, field_type)), " ")
    runs = df.select(doc, F.explode(F.regexp_extract_all(sorted_terms, F.lit(TERM_RUN), F.lit(0))).alias("run"))
    return (runs.select(F.substring_index("run", " ", 1).alias("term"), "doc_id", F.octet_length("run").alias("bytes"))
            .select("term", "doc_id", F.expr("CAST((bytes + 1) div (octet_length(term) + 1) AS BIGINT)").alias("tf")))


def postings(df: DataFrame, id_col: str, fields: list[str], types: list[str]) -> DataFrame:
    """``(field, term, doc_id, tf)`` for every (field, term, document)."""
    if len(fields) != len(types):
        raise ValueError("fields and types differ in length")
    found = None
    for f, t in zip(fields, types):
        one = field_postings(df, id_col, f, t).select(F.lit(f).alias("field"), "term", "doc_id", "tf")
        found = one if found is None else found.unionByName(one)
    return found


def _write_segment(df: DataFrame, index_path: str, id_col: str, fields: dict[str, str]) -> str:
    """A new segment, one write a field: a task has one open file, and reads the columns of one field only. An input with fewer
    tasks than the cluster has cores is small, and is dealt out first."""
    name, cores = f"segment-{uuid.uuid4().hex[:12]}", df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.select(id_col, *[f for f in fields if f != id_col]).repartition(cores)
    try:
        for f, t in fields.items():
            field_postings(df, id_col, f, t).write.option("compression", "zstd").parquet(f"{index_path}/segments/{name}/field={f}")
    except Exception:
        store.delete(df.sparkSession, f"{index_path}/segments/{name}")
        raise
    return name


def _versions(spark: SparkSession, index_path: str) -> store.Versions:
    return store.Versions(spark, f"{index_path.rstrip('/')}/versions")


def _in_force(spark: SparkSession, index_path: str) -> tuple[int, dict]:
    number, state = _versions(spark, index_path).last()
    if state is None:
        raise FileNotFoundError(f"no index at {index_path}")
    return number, state


def create_index(df: DataFrame | None, index_path: str, id_col: str, default_search_col: str,
                 fields: list[str], types: list[str], history_path: str | None = None) -> IndexResult:
    """X1. Checks (each failure is a notice and ``ok=False``): the table exists, no index exists at
    ``index_path``, the id column is bigint, the default search column exists. Then a segment is written and the first version
    committed; a failed build removes what it wrote. With ``history_path`` an ``(action, created_at)`` row is appended there."""
    if df is None:
        return IndexResult(False, "table does not exist")
    spark, index_path = df.sparkSession, index_path.rstrip("/")
    if len(fields) != len(types):
        raise ValueError("fields and types differ in length")
    if _versions(spark, index_path).last()[1] is not None:
        return IndexResult(False, f"Index {index_path} already exists.")
    if id_col not in df.columns or not isinstance(df.schema[id_col].dataType, T.LongType):
        return IndexResult(False, f"id column {id_col} must be bigint")
    if default_search_col not in df.columns:
        return IndexResult(False, f"default search column {default_search_col} does not exist")
    kinds = dict(zip(fields, types))
    segment = _write_segment(df, index_path, id_col, kinds)
    versions = _versions(spark, index_path)
    versions.commit(versions.last()[0], {"fields": kinds, "default": default_search_col, "segments": [{"name": segment, "deletes": []}]})
    notice = f"Created index {index_path}"
    if history_path:
        spark.range(1).select(F.lit(notice).alias("action"), F.current_timestamp().alias("created_at")) \
            .write.mode("append").parquet(history_path)
    return IndexResult(True, notice, index_path)


def add_documents(df: DataFrame, index_path: str, id_col: str) -> None:
    """Further documents as a segment of their own (an id must not be in force in another segment: expunge it first)."""
    spark, index_path = df.sparkSession, index_path.rstrip("/")
    number, state = _in_force(spark, index_path)
    segment = _write_segment(df, index_path, id_col, state["fields"])
    state["segments"].append({"name": segment, "deletes": []})
    _versions(spark, index_path).commit(number, state)


def bitmaps(ids: DataFrame, id_col: str) -> DataFrame:
    """``(bucket, bitmap)``: the ids as bitmaps of 4,096 bytes, one for each 32,768 ids that has any."""
    i = F.col(id_col)
    return (ids.where(i.isNotNull()).groupBy(F.bitmap_bucket_number(i).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(i)).alias("bitmap")))


def bitmap_ids(maps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids in ``(bucket, bitmap)`` rows; bytes without a bit are passed over."""
    used = F.filter(F.transform(F.sequence(F.lit(1), F.lit(BITMAP_BYTES)), lambda at: F.struct(
        at.alias("at"), F.conv(F.hex(F.substring(F.col("bitmap"), at, F.lit(1))), 16, 10).cast("int").alias("byte"))),
        lambda b: b["byte"] != 0)
    set_bits = F.expr("filter(sequence(0, 7), k -> (byte & shiftleft(1, k)) != 0)")
    spots = (maps.select("bucket", F.explode(used).alias("b")).select("bucket", "b.at", "b.byte")
             .select("bucket", "at", F.explode(set_bits).alias("bit")))
    position = ((F.col("at") - 1) * 8 + F.col("bit")).cast("bigint")
    bucket = F.col("bucket").cast("bigint")
    found = F.when(bucket > 0, (bucket - 1) * BITMAP_IDS + position + 1).otherwise(bucket * BITMAP_IDS - position)
    return spots.select(found.alias(id_col)).distinct()


def _live(spark: SparkSession, index_path: str, state: dict) -> DataFrame:
    """Postings of a version. Segments that share their bitmaps are read together."""
    together: dict[tuple, list[str]] = {}
    for s in state["segments"]:
        together.setdefault(tuple(s["deletes"]), []).append(s["name"])
    found = None
    for deletes, segments in together.items():
        post = None
        for s in segments:
            one = spark.read.schema(POSTINGS).parquet(f"{index_path}/segments/{s}")
            post = one if post is None else post.unionByName(one)
        if deletes:
            maps = spark.read.schema("bucket bigint, bitmap binary").parquet(*[f"{index_path}/deletes/{d}" for d in deletes])
            post = post.join(bitmap_ids(maps), "doc_id", "left_anti")
        found = post if found is None else found.unionByName(post)
    return found.select("field", "term", "doc_id", "tf")


def read_index(spark: SparkSession, index_path: str) -> DataFrame:
    """``(field, term, doc_id, tf)`` of the documents in force."""
    index_path = index_path.rstrip("/")
    return _live(spark, index_path, _in_force(spark, index_path)[1])


def expunge(post: DataFrame, deleted_ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """X2 on any postings: those without the deleted documents (anti join on the document id)."""
    return post.join(deleted_ids.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_anti")


def expunge_index(spark: SparkSession, index_path: str, deleted_ids: DataFrame, id_col: str = "doc_id") -> int:
    """X2 on an index: the documents are gone for every reader that starts after this. Writes one bitmap, which applies to all
    segments now in force, and returns the version."""
    index_path = index_path.rstrip("/")
    number, state = _in_force(spark, index_path)
    name = f"deletes-{uuid.uuid4().hex[:12]}"
    bitmaps(deleted_ids.select(F.col(id_col).cast("bigint").alias("doc_id")), "doc_id").write.option("compression", "zstd").parquet(
        f"{index_path}/deletes/{name}")
    for s in state["segments"]:
        s["deletes"] = [*s["deletes"], name]
    return _versions(spark, index_path).commit(number, state)


def merge_index(spark: SparkSession, index_path: str) -> int:
    """All segments as one, without the deleted documents; ``store.Conflict`` if the index changed meanwhile."""
    index_path = index_path.rstrip("/")
    number, state = _in_force(spark, index_path)
    name = f"segment-{uuid.uuid4().hex[:12]}"
    for f in state["fields"]:
        _live(spark, index_path, state).where(F.col("field") == f).drop("field").write.option("compression", "zstd").parquet(
            f"{index_path}/segments/{name}/field={f}")
    return _versions(spark, index_path).commit(number, {**state, "segments": [{"name": name, "deletes": []}]})


def vacuum_index(spark: SparkSession, index_path: str) -> list[str]:
    """Removes segments and bitmaps that the last version doesn't name (no reader or writer of an earlier one may run)."""
    index_path = index_path.rstrip("/")
    state = _in_force(spark, index_path)[1]
    used = {s["name"] for s in state["segments"]} | {d for s in state["segments"] for d in s["deletes"]}
    gone = [f"{index_path}/{kind}/{n}" for kind in ("segments", "deletes") for n in store.names(spark, f"{index_path}/{kind}") if n not in used]
    for path in gone:
        store.delete(spark, path)
    return gone
