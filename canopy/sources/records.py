"""Records of quoted text files whose fields may hold line ends, read by many tasks a file.

Whether a line end belongs to a field depends on the quotes before it in the file. They are counted for each byte range
that Spark reads; a prefix sum over the ranges of a file tells which ranges start inside a field. A task then puts the
lines of its ranges together on its own. Only a record that crosses the border of ranges leaves parts, two a range
in general, which a grouped aggregate joins. The text itself is never shuffled.

As usual for such files a quote inside a field is doubled, so quotes inside fields come in pairs. A record of more than
``longest`` characters (a quote that is never closed, say) is no record: its parts come back with a reason, so that a task
holds a bounded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.session import send_code

LONGEST = 16 * 1024 * 1024
_PIECES = "file string, start bigint, seq int, begins boolean, ends boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))


def ranges(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``(file, start, quotes, inside)`` for each byte range: its quotes, and whether it begins inside a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    counted = _lines(spark, path).groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("inside", F.coalesce(F.sum("quotes").over(before) % 2 == 1, F.lit(False)))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], bool, pa.Array]]:
    """(place, inside, lines) for the byte ranges in a batch; the rows of a range lie together."""
    starts = batch.column(2).to_numpy()
    files = pc.dictionary_encode(batch.column(1)).indices.to_numpy()
    cuts = [0, *(np.flatnonzero((starts[1:] != starts[:-1]) | (files[1:] != files[:-1])) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield (batch.column(1)[a].as_py(), int(starts[a])), batch.column(3)[a].as_py(), batch.column(0).slice(a, b - a)


class _Range:
    """One byte range on its way through a task, with the record that is open in it."""

    def __init__(self, place: tuple[str, int], inside: bool):
        self.place, self.inside, self.seq = place, inside, 0
        self.open: list[str] = []
        self.begins = not inside  # whether the open record began here and no part of it has left

    def pieces(self, texts: list[str] | pa.Array, begins: bool, ends: bool) -> pa.RecordBatch:
        """Records, or one part of a record, as rows."""
        self.seq += 1
        n = len(texts)
        columns = [([self.place[0]] * n, pa.string()), ([self.place[1]] * n, pa.int64()), ([self.seq] * n, pa.int32()),
                   ([begins] * n, pa.bool_()), ([ends] * n, pa.bool_()), (texts, pa.string())]
        return pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns],
                               names=["file", "start", "seq", "begins", "ends", "text"])

    def leave(self, ends: bool) -> Iterator[pa.RecordBatch]:
        """The lines of the open record leave."""
        if self.open or ends:
            yield self.pieces(["\n".join(self.open)], self.begins, ends)
            self.open, self.begins = [], ends

    def take(self, lines: pa.Array, quote: str, longest: int) -> Iterator[pa.RecordBatch]:
        after = (np.cumsum(pc.count_substring(lines, quote).to_numpy()) + self.inside) % 2 == 1  # inside a field after the line
        ends = np.flatnonzero(~after)
        self.inside = bool(after[-1])
        if len(ends):
            self.open += lines.slice(0, ends[0] + 1).to_pylist()
            yield from self.leave(ends=True)
            if len(ends) > 1:
                offsets = pa.array(ends - ends[0], pa.int32())
                yield self.pieces(pc.binary_join(pa.ListArray.from_arrays(offsets, lines.slice(ends[0] + 1)), "\n"), True, True)
            lines = lines.slice(ends[-1] + 1)
        self.open += lines.to_pylist()
        if sum(map(len, self.open)) > longest:
            yield from self.leave(ends=False)


def assemble(spark: SparkSession, path: str, quote: str = '"', longest: int = LONGEST) -> DataFrame:
    """``(file, start, seq, begins, ends, text)``: whole records, which begin and end here, and parts of others."""
    send_code(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Range | None = None
        for batch in batches:
            for place, inside, lines in _runs(batch):
                if now is None or now.place != place:
                    if now is not None:
                        yield from now.leave(ends=False)
                    now = _Range(place, inside)
                yield from now.take(lines, quote, longest)
        if now is not None:
            yield from now.leave(ends=False)

    # Broadcast by its bound: one short row for each byte range that begins inside a field. The join keeps the order of lines.
    inside = ranges(spark, path, quote).where("inside").select("file", "start", "inside")
    lines = _lines(spark, path).join(F.broadcast(inside), ["file", "start"], "left")
    return lines.select("value", "file", "start", F.coalesce("inside", F.lit(False)).alias("inside")).mapInArrow(run, _PIECES)


def stitch(parts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The parts of records that cross ranges -> ``(file, text, reason)``; ``reason`` is null where a record came out."""
    in_order = Window.partitionBy("file").orderBy("start", "seq")
    record = Window.partitionBy("file", "record")
    numbered = (parts.withColumn("record", F.count_if("begins").over(in_order))
                .withColumn("size", F.sum(F.length("text")).over(record)).withColumn("closed", F.max("ends").over(record)))
    reason = F.when(F.col("size") > longest, F.lit("record too long")).when(~F.col("closed"), F.lit("quoted field not closed"))
    judged = numbered.withColumn("reason", reason)
    joined = (judged.where(F.col("reason").isNull()).groupBy("file", "record")
              .agg(F.sort_array(F.collect_list(F.struct("start", "seq", "text"))).alias("parts"))
              .select("file", F.array_join("parts.text", "\n").alias("text"), F.lit(None).cast("string").alias("reason")))
    return joined.unionByName(judged.where(F.col("reason").isNotNull()).select("file", "text", "reason"))
