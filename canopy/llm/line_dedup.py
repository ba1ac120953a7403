"""Line dedup: a line that many documents share stays only in the last of them.

Plan (DataFrame operations only). Every long line becomes a 128-bit hash with its document and position.

1. The hashes are dealt by (hash, slice of the document), so that a line of a third of all documents is
   spread over as many tasks as there are shuffle partitions, and reduced to one head per hash and slice.
2. The heads are range-partitioned on the hash and sorted by document, last first, and position. A window
   over each hash streams them: the first occurrence names the keeper, the running total says how many
   documents have the line. A hash has at most one head per slice here.
3. Heads of lines to drop meet the occurrences again on (hash, slice), with the exchange of step 1, and the
   dropped positions are collected per document into a keep bitmap, compressed as runs of kept lines.

Only the bitmaps of documents that lose lines move; texts are read where they are applied.

Defined cases: a null or empty text is one empty line and loses nothing; a null ``doc_id`` is a document of
its own, ordered before all others; rows that share a ``doc_id`` count as one document, and each row gets its
own bitmap (rows are told apart by a hash of their text, equal rows need no telling apart); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import SPACES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z only; ``lower`` is quick and right where the text has no other letters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per document row that loses lines: ``doc_id, row_id, n_lines, n_dropped, kept`` without its text.

    ``kept`` is the bitmap of kept lines as runs ``(start, length)``, positions from 0. A row without a bitmap
    keeps all its lines.
    """
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", row_id(F.col("text")).alias("row_id"), text_lines(F.col("text")).alias("lines"),
                        F.size(text_lines(F.col("text"))).alias("n_lines"),
                        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(slices)), F.lit(0)).cast("int").alias("slice"))
    lines = texts.select("doc_id", "row_id", "n_lines", "slice", F.posexplode("lines").alias("pos", "line"))
    stripped = lines.withColumn("line", F.btrim("line", F.lit(SPACES))).where(F.length("line") >= min_chars)
    key = lower_ascii(F.col("line"))
    occurrences = (stripped
                   .select("doc_id", "row_id", "n_lines", "slice", "pos", key.alias("key"))
                   .select("doc_id", "row_id", "n_lines", "slice", "pos", F.xxhash64("key").alias("h1"),
                           F.xxhash64(F.lit("second half"), "key").alias("h2"))
                   .repartition(slices, "h1", "h2", "slice"))
    # The heads take every column of the occurrences, so that both uses share one exchange.
    heads = (occurrences.groupBy("h1", "h2", "slice", "doc_id").agg(F.min(F.struct("pos", "row_id", "n_lines")).alias("at"))
             .groupBy("h1", "h2", "slice")
             .agg(F.count(F.lit(1)).alias("n_docs"),
                  F.max(F.struct("doc_id", (-F.col("at.pos")).alias("back"), "at")).alias("last"))
             .select("h1", "h2", "slice", "n_docs", F.col("last.doc_id").alias("doc_id"), F.col("last.back").alias("back")))
    ordered = heads.repartitionByRange(slices, "h1", "h2")
    by_hash = Window.partitionBy("h1", "h2")
    last_first = by_hash.orderBy(F.col("doc_id").desc(), F.col("back").desc())
    repeated = (ordered
                .withColumn("keeper", F.first("doc_id").over(last_first))
                .withColumn("total", F.sum("n_docs").over(by_hash))
                .where(F.col("total") >= min_docs)
                .select("h1", "h2", "slice", "keeper"))
    dropped = (occurrences.join(repeated, ["h1", "h2", "slice"])
               .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
               .groupBy("doc_id", "row_id", "n_lines").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.col("n_lines")))
    runs = F.filter(
        F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda i: F.struct(
            (F.element_at("edges", i) + 1).alias("start"),
            (F.element_at("edges", i + 1) - F.element_at("edges", i) - 1).alias("length"))),
        lambda run: run["length"] > 0)
    return (dropped.withColumn("edges", edges)
            .select("doc_id", "row_id", "n_lines", F.size("gone").alias("n_dropped"), runs.alias("kept")))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines, and ``n_lines`` and ``n_dropped`` beside it.

    Rows without a bitmap keep their text as it is (a null text stays null).
    """
    d, b = docs.withColumn("__row_id", row_id(F.col("text"))).alias("d"), bitmaps.alias("b")
    on = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.__row_id") == F.col("b.row_id"))
    lines = text_lines(F.col("d.text"))
    rest = F.flatten(F.transform(F.col("b.kept"), lambda run: F.slice(F.col("__lines"), run["start"] + 1, run["length"])))
    joined = d.join(b, on, "left").withColumn("__lines", F.when(F.col("b.kept").isNotNull(), lines))
    text = F.when(F.col("b.kept").isNotNull(), F.array_join(rest, "\n")).otherwise(F.col("d.text"))
    kept = [text.alias(c) if c == "text" else F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*kept, F.size(lines).cast("long").alias("n_lines"),
                         F.coalesce(F.col("b.n_dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` without the lines that ``min_docs`` or more documents share, but for the last of these documents."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
