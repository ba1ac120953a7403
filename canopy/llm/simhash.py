"""SimHash near-duplicates: fingerprints in vantage-point trees, linked at a few differing bits.

Two fingerprints that differ in at most ``max_bits`` bits differ in at most ``max_bits // blocks`` bits in one of
``blocks`` equal parts. So there is one vantage-point tree for each part, searched with that smaller radius, where a
triangle bound prunes far more than over all 64 bits. A tree's inner nodes (vantage point and median distance) are
fitted on a bounded sample; every fingerprint is then placed in each tree:

* at home in the one leaf that its distances lead to;
* as a visitor in each other leaf that lies across a boundary by no more than the radius. Of two leaves only the
  visit to the later one is made, as the pair would be met twice.

A (tree, leaf) is a shard. Within it visitors and residents are compared on all 64 bits, in blocks of bounded
size, and only links that join something new come out, never all pairs of a dense group. Equal fingerprints are
one node from the start, with their count of documents left behind.

Defined cases: null and empty texts have no words and fingerprint zero, linked like any other; rows that share a
``doc_id`` are rows of their own; a null ``doc_id`` is left out of the smallest id, and the id of a component
of such rows only is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import as_bytes, map_rows, send_code
from canopy.llm.components import components
from canopy.llm.line_dedup import row_id
from canopy.session import scratch_path

SEED = 42
#: Size of the sample that the trees' inner nodes are fitted on; all fingerprints are placed in the fitted trees.
SAMPLE = 65_536
#: Residents of a leaf that the depth of the trees aims at.
LEAF = 256
#: Entries of a block of comparisons.
BLOCK = 4_000_000


def fingerprint(text: bytes, shingle: int) -> int:
    """64 bits: those set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-shingle]]
        hashes = [xxhash.xxh64_intdigest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[shingle - 1:], strict=True)]
    each = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(each), 65_536):
        counts += np.unpackbits(each[i:i + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, row_id, fp`` (a signed long) for each row."""
    def run(c):
        prints = np.fromiter((fingerprint(t, shingle) for t in as_bytes(c["text"])), np.uint64, len(c["text"]))
        return {"doc_id": c["doc_id"], "row_id": c["row_id"], "fp": prints.view(np.int64)}

    rows = docs.select("doc_id", row_id(F.col("text")).alias("row_id"), "text")
    return map_rows(rows, ["doc_id", "row_id", "text"], run, "doc_id bigint, row_id bigint, fp bigint")


class Trees:
    """The inner nodes of one vantage-point tree for each block of bits, each a full binary tree in heap order."""

    def __init__(self, sample: np.ndarray, depth: int, max_bits: int, blocks: int = 4):
        self.depth, self.blocks, self.radius = depth, blocks, max_bits // blocks
        self.width = 64 // blocks
        self.vantage = np.zeros((blocks, 1 << depth), np.uint64)
        self.median = np.full((blocks, 1 << depth), self.width // 2, np.int64)
        rng = np.random.default_rng(7)
        for tree in range(blocks):
            members = {1: np.unique(self.block(sample, tree))}
            for node in range(1, 1 << depth):
                own = members.pop(node, np.empty(0, np.uint64))
                # A vantage point far out spreads the distances best; without members any point will do.
                tried = rng.choice(own, min(8, len(own)), replace=False) if len(own) else rng.integers(0, 1 << self.width, 1, np.uint64)
                spread = [np.bitwise_count(own ^ t).var() if len(own) else 0 for t in tried]
                self.vantage[tree, node] = tried[int(np.argmax(spread))]
                away = np.bitwise_count(own ^ self.vantage[tree, node]).astype(np.int64)
                if len(own):
                    self.median[tree, node] = int(np.sort(away)[(len(own) - 1) // 2])
                near = away <= self.median[tree, node]
                members[2 * node], members[2 * node + 1] = own[near], own[~near]

    def block(self, prints: np.ndarray, tree: int) -> np.ndarray:
        return (prints >> np.uint64(tree * self.width)) & np.uint64((1 << self.width) - 1)

    def place(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each tree: shard, position of the fingerprint, and whether the leaf is its home."""
        for tree in range(self.blocks):
            part = self.block(prints, tree)
            at, node = np.arange(len(prints)), np.ones(len(prints), np.int64)
            home = np.ones(len(prints), bool)
            for _ in range(self.depth):
                away = np.bitwise_count(part[at] ^ self.vantage[tree, node]).astype(np.int64)
                median = self.median[tree, node]
                inner, outer = away - self.radius <= median, away + self.radius > median
                # On the path of the home leaf, what visits an earlier leaf is dropped: that leaf's residents visit here.
                inner &= ~(home & (away > median))
                at, node, home = (np.concatenate([at[inner], at[outer]]),
                                  np.concatenate([2 * node[inner], 2 * node[outer] + 1]),
                                  np.concatenate([(home & (away <= median))[inner], (home & (away > median))[outer]]))
            yield tree * (1 << self.depth) + node - (1 << self.depth), at, home


def _linked(residents: np.ndarray, visitors: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected in a shard: residents to the first of their group, visitors to groups."""
    found = []
    rows = max(1, BLOCK // max(1, len(residents)))
    some = np.zeros(len(residents), bool)
    for i in range(0, len(residents), rows):
        some[i:i + rows] = (np.bitwise_count(residents[i:i + rows, None] ^ residents[None, :]) <= max_bits).sum(axis=1) > 1
    group = residents.copy()
    left = np.flatnonzero(some)
    while len(left):
        first, left = residents[left[0]], left[1:]
        waiting = [first]
        while waiting and len(left):
            near = np.bitwise_count(residents[left] ^ waiting.pop()) <= max_bits
            if near.any():
                new = left[near]
                left = left[~near]
                group[new] = first
                waiting.extend(residents[new])
    moved = group != residents
    found.append((residents[moved], group[moved]))
    for i in range(0, len(visitors), rows):
        v, r = np.nonzero(np.bitwise_count(visitors[i:i + rows, None] ^ residents[None, :]) <= max_bits)
        if len(v):
            pairs = np.unique(np.stack([visitors[i:i + rows][v], group[r]]), axis=1)
            found.append((pairs[0], pairs[1]))
    return found


def links(prints: DataFrame, max_bits: int = 4, leaf: int = LEAF) -> DataFrame:
    """``prints(fp)``, distinct -> ``(a, b)``: links that connect just what is connected at ``max_bits`` bits."""
    spark = prints.sparkSession
    n = prints.count()
    # Some SAMPLE fingerprints by hash, whatever the number of partitions: a bound on the hash, not the first rows of an order.
    below = int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    rows = prints.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < below).select("fp").toArrow()
    sample = np.sort(rows["fp"].to_numpy().astype(np.int64)).view(np.uint64)
    trees = spark.sparkContext.broadcast(
        Trees(sample, min(14, max(0, math.ceil(math.log2(max(1, n) / leaf)))), max_bits))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for shard, at, home in trees.value.place(own.view(np.uint64)):
                for i in range(0, len(at), 100_000):
                    yield pa.record_batch([pa.array(shard[i:i + 100_000].astype(np.int32)), pa.array(own[at[i:i + 100_000]]),
                                           pa.array(home[i:i + 100_000])], names=["shard", "fp", "home"])

    def link(shard: pa.Table) -> pa.Table:
        own, home = shard["fp"].to_numpy().view(np.uint64), shard["home"].to_numpy()
        found = _linked(own[home], own[~home], max_bits) if home.any() else []
        ends = [np.concatenate([f[k] for f in found] or [np.empty(0, np.uint64)]).view(np.int64) for k in (0, 1)]
        return pa.table({"a": ends[0], "b": ends[1]})

    send_code(spark)
    placed = prints.mapInArrow(place, "shard int, fp bigint, home boolean")
    return placed.groupBy("shard").applyInArrow(link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``doc_id, row_id, fp, root, component_id`` for each row; ``component_id`` is the smallest id that links lead to, and
    ``root`` the component itself (its smallest fingerprint), as components may share an id or have none."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "simhash")
    fingerprints(docs, shingle).write.parquet(folder)
    rows = spark.read.parquet(folder)
    distinct = f"{folder}-distinct"
    rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).write.parquet(distinct)
    nodes = spark.read.parquet(distinct)
    roots = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp").select(
        "doc_id", "row_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (null last), of equal ids the smallest fingerprint, then text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "row_id"))
    chosen = (near_duplicates(docs, shingle, max_bits).groupBy("root").agg(first.alias("row"))
              .select(F.col("row.doc_id").alias("__id"), F.col("row.row_id").alias("__row")))
    rows = docs.withColumn("__row_id", row_id(F.col("text")))
    on = rows["doc_id"].eqNullSafe(chosen["__id"]) & (rows["__row_id"] == chosen["__row"])
    return rows.join(chosen, on, "left_semi").dropDuplicates(["doc_id", "__row_id"]).select(*docs.columns)
