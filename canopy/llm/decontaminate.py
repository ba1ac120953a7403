"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in documents.

The patterns are the windows of ``window`` consecutive words of each item (the whole item if it is shorter). For patterns
of one length there is a shift table over blocks of two words: a block that no pattern holds lets the search skip to where
the next pattern could end, so clean text is read in strides. A block that ends a pattern has shift 0; its suffix bucket
is chosen by that block and the pattern's first word, and its patterns are compared directly, word by word.

Words are 64-bit hashes in the tables, so a table is two sorted arrays, and patterns are places in the words of their items:
a block of the benchmark is a file of arrays that tasks map and never turn into objects. Blocks are bounded by their
number of patterns (words), and a task goes through its texts in portions of bounded size and through the blocks one at a time, so
neither side must fit as a whole. Many stretches of text are searched at once, each with its own place. Documents are
not shuffled.

Defined cases: null and empty texts have no words, on either side; a document's repeated rows are searched each for itself;
items that share an id count once; an item without an id is named by the empty string; an empty benchmark finds nothing; very long
texts are searched whole, in stretches that overlap by a pattern; ``find_contamination`` replaces columns that have the name
of a new one, ``decontaminate`` returns every column as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import add_columns, as_bytes, executor_files, read_arrays, send_code, shared_folder, write_arrays

#: Bytes of benchmark text in a block: at some eight bytes a word, a million patterns.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that are searched for one block before the next is read.
PORTION = 4 << 20
#: Words of a stretch of text that is searched with a place of its own.
STRETCH = 512
#: A-Z lower-cased; every byte that is no letter, digit or part of a longer character becomes a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
U64 = np.uint64


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key of two hashes."""
    h = (a * U64(0x9E3779B97F4A7C15)) ^ b
    h = (h ^ (h >> U64(31))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(29))


def _blocks(hashes: np.ndarray, end: np.ndarray, block: int) -> np.ndarray:
    """Keys of the blocks of one or two words that end at the given places."""
    return _mixed(hashes[end - 1], hashes[end]) if block == 2 else hashes[end]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Words:
    """The words of texts: their hashes one after the other, the number of words of each text, and the words themselves."""

    def __init__(self, texts: list[bytes]):
        joined = pa.array([t.translate(_WORD_BYTES) for t in texts], pa.large_binary())
        parts = pc.ascii_split_whitespace(joined.view(pa.large_string()))
        flat, ends = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        full = pc.not_equal(pc.binary_length(flat), 0)  # texts that begin or end with a space have empty parts
        kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
        self.sizes = kept[ends[1:]] - kept[ends[:-1]]
        self.starts = kept[ends[:-1]]
        coded = pc.dictionary_encode(flat.filter(full))
        self.dictionary = coded.dictionary.cast(pa.large_binary()).to_pylist()
        self.which = coded.indices.to_numpy().astype(np.int64)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.dictionary], U64)
        self.hashes = hashes[self.which] if len(hashes) else np.empty(0, U64)

    def at(self, start: int, length: int) -> list[bytes]:
        return [self.dictionary[i] for i in self.which[start:start + length].tolist()]


def _pack(batches: Iterator[pa.RecordBatch], window: int) -> dict[str, np.ndarray]:
    """The windows of a block's items as arrays: for each pattern length shift and bucket tables, and the items' words."""
    ids, texts = [], []
    for batch in batches:
        ids += [i or "" for i in batch.column(0).to_pylist()]
        texts += as_bytes(batch.column(1))
    words = Words(texts)
    lengths = np.minimum(words.sizes, window)
    arrays: dict[str, np.ndarray] = {"lengths": np.unique(lengths[lengths > 0])}
    for length in arrays["lengths"].tolist():
        own = np.flatnonzero(lengths == length)
        n = words.sizes[own] - length + 1
        item = np.repeat(own, n).astype(np.int32)
        start = np.repeat(words.starts[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        block = min(2, length)
        # The block that ends at word j of an item ends at least at word min(j, length - 1) of a pattern: its least shift.
        size = words.sizes[own] - block + 1
        j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + block - 1
        end = np.repeat(words.starts[own], size) + j
        key, shift = _blocks(words.hashes, end, block), np.maximum(0, length - 1 - j).astype(np.int32)
        order = np.lexsort((shift, key))  # of equal blocks the one with the smallest shift comes first
        key, shift = key[order], shift[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        bucket = _mixed(_blocks(words.hashes, start + length - 1, block), words.hashes[start])
        order = np.argsort(bucket, kind="stable")
        arrays |= {f"key{length}": key[first], f"shift{length}": shift[first], f"bucket{length}": bucket[order],
                   f"start{length}": start[order], f"item{length}": item[order]}
    encoded = [i.encode("utf-8", "surrogatepass") for i in ids]
    return arrays | {"words": np.frombuffer(b"".join(words.dictionary), np.uint8), "word_ends": np.cumsum([0, *map(len, words.dictionary)]),
                     "which": words.which.astype(np.int32), "items": np.frombuffer(b"".join(encoded), np.uint8),
                     "item_ends": np.cumsum([0, *map(len, encoded)])}


class Patterns:
    """The patterns of one length of a block, in mapped arrays."""

    def __init__(self, arrays: dict[str, np.ndarray], length: int):
        self.arrays, self.length, self.block = arrays, length, min(2, length)
        self.default = length - self.block + 1
        self.key, self.shift, self.bucket, self.start, self.item = (arrays[f"{k}{length}"] for k in ("key", "shift", "bucket", "start", "item"))

    def _pattern(self, k: int) -> list[bytes]:
        ends, text = self.arrays["word_ends"], self.arrays["words"]
        return [text[ends[i]:ends[i + 1]].tobytes() for i in self.arrays["which"][self.start[k]:self.start[k] + self.length].tolist()]

    def _name(self, k: int) -> str:
        ends, i = self.arrays["item_ends"], self.item[k]
        return self.arrays["items"][ends[i]:ends[i + 1]].tobytes().decode("utf-8", "surrogatepass")

    def places(self, words: Words) -> np.ndarray:
        """Last words of the places that a pattern could fill: there the block has shift 0. All stretches move at once, each by
        its own shift."""
        n = np.maximum(words.sizes - self.length + 1, 0)  # places for a pattern in each text
        cuts = (n + STRETCH - 1) // STRETCH
        text = np.repeat(np.arange(len(n)), cuts)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * STRETCH
        at = words.starts[text] + begin + self.length - 1
        stop = words.starts[text] + np.minimum(begin + STRETCH, n[text]) + self.length - 1
        found, h = [], words.hashes
        while len(at):
            key = _blocks(h, at, self.block)
            spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            skip = np.where(self.key[spot] == key, self.shift[spot], self.default)
            found.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.concatenate([np.empty(0, np.int64), *found])

    def search(self, words: Words) -> Iterator[tuple[int, str]]:
        """(first word, item) of each occurrence: the suffix bucket's patterns are compared directly."""
        last = self.places(words)
        start, h = last - self.length + 1, words.hashes
        bucket = _mixed(_blocks(h, last, self.block), h[start])
        low, high = np.searchsorted(self.bucket, bucket, side="left"), np.searchsorted(self.bucket, bucket, side="right")
        for i in np.flatnonzero(low < high).tolist():
            own, place = None, int(start[i])
            for k in range(low[i], high[i]):
                own = own or words.at(place, self.length)
                if own == self._pattern(k):
                    yield place, self._name(k)


@lru_cache(maxsize=1)
def _block(file: str) -> list[Patterns]:
    arrays = read_arrays(file)
    return [Patterns(arrays, length) for length in arrays["lengths"].tolist()]


def write_blocks(benchmark: DataFrame, window: int) -> list[str]:
    """The pattern blocks of a benchmark (``item_id, text``), as files in the shared folder."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // BLOCK_BYTES
    files = executor_files(shared_folder(spark, "benchmark"), n)

    def write(key: tuple, items: pa.Table) -> pa.Table:
        block = key[0].as_py()
        write_arrays(files[block], _pack(items.select(["item_id", "text"]).to_batches(), window))
        return pa.table({"block": pa.array([block], pa.int32())})

    send_code(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    written = dealt.groupBy("block").applyInArrow(write, "block int").collect()
    return [files[r["block"]] for r in sorted(written)]


def _portions(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Some texts of bounded size at a time (one at least), with the number of the first."""
    held, size, at = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size > PORTION:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (runs of hit words: start, length) and ``items`` (sorted ids with an occurrence)."""
    files = write_blocks(benchmark, window)

    def run(c):
        texts = as_bytes(c["text"])
        out = {"n_words": [0] * len(texts), "hits": [[] for _ in texts], "items": [[] for _ in texts]}
        for first, portion in _portions(texts):
            words = Words(portion)
            out["n_words"][first:first + len(portion)] = words.sizes.tolist()
            found: dict[int, tuple[set[tuple[int, int]], set[str]]] = {}
            for file in files:
                for group in _block(file):
                    for place, item in group.search(words):
                        text = int(np.searchsorted(words.starts, place, side="right")) - 1
                        spans, names = found.setdefault(text, (set(), set()))
                        spans.add((place - int(words.starts[text]), group.length))
                        names.add(item)
            for text, (spans, names) in found.items():
                out["hits"][first + text], out["items"][first + text] = _runs(sorted(spans)), sorted(names)
        return out

    return add_columns(docs, ["text"], run, "n_words bigint, hits array<struct<start:int,length:int>>, items array<string>", rows=2_000)


def _runs(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The union of (start, length) spans in order."""
    found: list[list[int]] = []
    for start, length in spans:
        if found and start <= found[-1][1]:
            found[-1][1] = max(found[-1][1], start + length)
        else:
            found.append([start, start + length])
    return [{"start": a, "length": b - a} for a, b in found]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without an occurrence of a benchmark window, all their columns as they were."""
    aside = {c: f"__own_{c}" for c in docs.columns if c in ("n_words", "hits", "items")}
    found = find_contamination(docs.withColumnsRenamed(aside), benchmark, window).where(F.size("hits") == 0)
    return found.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
