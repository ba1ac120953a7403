"""LM scoring with an Elias-Fano n-gram trie of words, kept in memory-mapped levels.

Words become 64-bit hashes; the sorted hashes of the training words are the vocabulary, and a word's id is its rank.
Bigrams and trigrams are counted by context: batches of texts send blocks of sorted (context, word, count) to the shards of
their contexts' hashes, and a shard merges its blocks into one level file:

* the contexts as a monotone sequence (ids of bigram contexts; for trigrams the number of the pair of ids);
* monotone pointers to each context's first successor;
* the successors, relative to their context: ``context rank * vocabulary + word id`` is monotone over the shard.

All three are Elias-Fano coded: low bits packed, high bits in unary. A query finds its context's rank, then the successor
of ``rank * vocabulary + id`` at or after its place, which is the n-gram if it is equal. Once all counts of counts are
known, each shard's counts become quantised smoothed probabilities of 8 bits (modified absolute discounting, interpolated
with the lower order); they lie in arrays of their own beside the structure. The steps go from the least to the greatest value of
the shard, so the model is the same at every size but for the rounding (half a step in log10).

Scoring is one pass over the texts; every batch asks for its distinct n-grams in sorted order. A task holds its batch and maps files.

Defined cases: null and empty texts have the end token alone; repeated rows count and score each; without training texts
every word is unknown and the model is uniform over the one unknown word; columns named like a new one are replaced.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import add_columns, map_rows, read_arrays, send_code, shared_folder, write_arrays

END = xxhash.xxh3_64_intdigest(b"\n")  # no word is a line end
START = xxhash.xxh3_64_intdigest(b"\n\n")
#: Tokens counted for one shard of a level, and tokens whose n-grams are sorted at a time.
SHARD, PORTION = 2_000_000, 2_000_000
#: Steps of the quantised log10 values, from the least to the greatest of a shard's level.
STEPS = 255
U64 = np.uint64


# Elias-Fano sequences -------------------------------------------------------------------------------------------------

def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """``values`` of ``bits`` bits each, one after the other, in 64-bit words."""
    out = np.zeros(len(values) * bits // 64 + 2, U64)
    if bits:
        place = np.arange(len(values), dtype=np.int64) * bits
        word, shift = place >> 6, (place & 63).astype(U64)
        np.bitwise_or.at(out, word, values << shift)
        over = np.flatnonzero((place & 63) + bits > 64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (U64(64) - shift[over]))
    return out


def _unpacked(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), U64)
    place = at * bits
    word, shift = place >> 6, (place & 63).astype(U64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << (U64(64) - np.maximum(shift, U64(1))), U64(0))
    return (low | high) & U64((1 << bits) - 1)


def ef_write(name: str, values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a monotone sequence of integers below ``universe``."""
    n = len(values)
    bits = max(0, (universe // max(1, n)).bit_length() - 1)
    values = values.astype(U64)
    ones = (values >> U64(bits)).astype(np.int64) + np.arange(n)
    last = (universe >> bits) + n + 1
    high = np.zeros(last // 64 + 1, U64)
    np.bitwise_or.at(high, ones >> 6, U64(1) << (ones & 63).astype(U64))
    zeros_before = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))[:-1]])
    return {f"{name}_low": _packed(values & U64((1 << bits) - 1), bits), f"{name}_high": high, f"{name}_zeros": zeros_before,
            f"{name}_head": np.array([n, bits], np.int64)}


class EliasFano:
    """Access to and successor search in a sequence of ``ef_write``."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.low, self.high, self.zeros = (arrays[f"{name}_{k}"] for k in ("low", "high", "zeros"))
        self.n, self.bits = map(int, arrays[f"{name}_head"])

    def decoded(self) -> np.ndarray:
        """All entries."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[:self.n]
        at = np.arange(self.n)
        return ((ones - at) << self.bits) | _unpacked(self.low, self.bits, at).astype(np.int64)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) of the high bits."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        left = (k - self.zeros[word]).astype(np.uint8)
        bits, place = ~self.high[word], np.zeros(len(k), np.uint8)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(bits & U64((1 << width) - 1))
            later = left >= ones
            left -= ones * later
            step = later * np.uint8(width)
            place += step
            bits >>= step.astype(U64)
        return word * 64 + place

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the rank of the first entry not below it, and whether that entry is equal."""
        x = x.astype(U64)
        part, low = (x >> U64(self.bits)).astype(np.int64), x & U64((1 << self.bits) - 1)
        before = np.where(part > 0, self._zero(np.maximum(part - 1, 0)), -1)
        start = before - (part - 1)
        # The next zero is mostly in the same word of the high bits.
        place = before + 1
        rest = ~self.high[place >> 6] >> (place & 63).astype(U64)
        end = start + np.bitwise_count((rest & (~rest + U64(1))) - U64(1)).astype(np.int64)
        further = np.flatnonzero(rest == 0)
        end[further] = self._zero(part[further]) - part[further]
        stop = end.copy()
        # The entries with these high bits lie between; the low bits among them are found by halving.
        while True:
            open_ = np.flatnonzero(start < stop)
            if not len(open_):
                break
            middle = (start[open_] + stop[open_]) >> 1
            below = _unpacked(self.low, self.bits, middle) < low[open_]
            start[open_] = np.where(below, middle + 1, start[open_])
            stop[open_] = np.where(below, stop[open_], middle)
        equal = np.zeros(len(x), bool)
        inside = np.flatnonzero(start < end)
        equal[inside] = _unpacked(self.low, self.bits, start[inside]) == low[inside]
        return start, equal


# Words ----------------------------------------------------------------------------------------------------------------

def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased (A-Z) texts, ends included: distinct hashes, the number of the hash of each token, and the tokens of each text."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # a copy that is no slice of another array
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat, ends = words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py()
    full = pc.not_equal(pc.binary_length(flat), 0)  # texts that begin or end with a space have empty parts
    sizes = np.add.reduceat(np.append(full.to_numpy(zero_copy_only=False), False).astype(np.int64), ends[:-1]) * (np.diff(ends) > 0)
    coded = pc.dictionary_encode(flat.filter(full))
    distinct = [xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    which = np.insert(coded.indices.to_numpy().astype(np.int64), np.cumsum(sizes), len(distinct))
    return np.array([*distinct, END], U64), which, sizes + 1


@dataclass(frozen=True)
class Vocabulary:
    """Sorted word hashes in files: ``(first hash, rank of it, file)`` of each, with the training count of each word."""

    files: tuple[tuple[int, int, str], ...]
    words: int
    tokens: int

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (the number of words where unknown) and counts of the words."""
        ids, counts = np.full(len(hashes), self.words, np.int64), np.zeros(len(hashes), np.int64)
        if self.files:
            shard = np.searchsorted(np.array([f for f, _, _ in self.files], U64), hashes, side="right") - 1
            for k in np.unique(shard[shard >= 0]).tolist():
                own, (_, rank, name) = np.flatnonzero(shard == k), self.files[k]
                arrays = _mapped(name)
                at = np.minimum(np.searchsorted(arrays["h"], hashes[own]), len(arrays["h"]) - 1)
                hit = arrays["h"][at] == hashes[own]
                ids[own[hit]], counts[own[hit]] = rank + at[hit], arrays["n"][at[hit]]
        return ids, counts


@lru_cache(maxsize=256)
def _mapped(name: str) -> dict[str, np.ndarray]:
    return read_arrays(name)


def vocabulary(docs: DataFrame, folder: str) -> Vocabulary:
    """Counts all tokens of ``docs(text)`` and writes the sorted vocabulary."""
    def count(c):
        distinct, which, _ = token_hashes(c["text"])
        return {"h": (distinct ^ U64(1 << 63)).view(np.int64), "n": np.bincount(which, minlength=len(distinct))}

    counted = map_rows(docs, ["text"], count, "h bigint, n bigint", rows=4000).groupBy("h").agg(F.sum("n").alias("n"))
    counted.write.parquet(f"{folder}/words")
    rows = docs.sparkSession.read.parquet(f"{folder}/words")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            own = pa.Table.from_batches(parts)
            name = f"{folder}/words-{TaskContext.get().partitionId():06d}.arrow"
            h = own["h"].to_numpy().view(U64) ^ U64(1 << 63)
            write_arrays(name, {"h": h, "n": own["n"].to_numpy()})
            yield pa.record_batch([pa.array([int(own["h"][0].as_py())]), pa.array([len(h)]), pa.array([name])], names=["first", "n", "name"])

    words, tokens = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    dealt = rows.repartitionByRange(1 + words // 4_000_000, "h").sortWithinPartitions("h")
    files, rank = [], 0
    for r in sorted(dealt.mapInArrow(write, "first bigint, n bigint, name string").collect()):
        files.append((r["first"] + (1 << 63), rank, r["name"]))
        rank += r["n"]
    return Vocabulary(tuple(files), words, tokens or 0)


def _ids(texts: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and counts of the tokens, whether the token is its text's first, and its text."""
    distinct, which, sizes = token_hashes(texts)
    order = np.argsort(distinct)
    ids, counts = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
    ids[order], counts[order] = vocab.find(distinct[order])
    text = np.repeat(np.arange(len(sizes)), sizes)
    first = np.zeros(len(which), bool)
    first[np.cumsum(sizes) - sizes] = True
    return ids[which], counts[which], first, text


def _contexts(ids: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of each token: the id before it, and the two ids before it (``start`` before a text) as one number,
    which is exact while the square of the vocabulary is below 2**63; ``train`` refuses a larger one."""
    one = np.concatenate([[start], ids[:-1]])
    one[first] = start
    two = np.concatenate([[start], one[:-1]])
    two[first] = start
    pair = (two.astype(U64) * U64(start + 1) + one.astype(U64)) & U64((1 << 63) - 1)
    return one, pair.astype(np.int64)


def spread(contexts: np.ndarray) -> np.ndarray:
    """A hash that deals contexts to shards."""
    h = contexts.astype(U64) * U64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> U64(32))) >> U64(1)).astype(np.int64)


# Counting and levels --------------------------------------------------------------------------------------------------

def _combined(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((word, context))
    context, word, n = context[order], word[order], n[order]
    new = np.concatenate([[True], (np.diff(context) != 0) | (np.diff(word) != 0)]) if len(word) else np.empty(0, bool)
    start = np.flatnonzero(new)
    return context[start], word[start], np.add.reduceat(n, start) if len(start) else n


def _block(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted counts as a compressed block: distinct contexts by difference, their numbers of words, words, counts."""
    new = np.flatnonzero(np.concatenate([[True], np.diff(context) != 0]))
    runs = np.diff(np.append(new, len(context)))
    columns = [np.diff(context[new], prepend=0), runs.astype(np.int32), word.astype(np.int64 if word.max(initial=0) >> 31 else np.int32),
               n.astype(np.int32 if n.max(initial=0) < 1 << 31 else np.int64)]
    batch = pa.record_batch([pa.array([len(new), len(context)]), *(pa.array([_planes(c), c.dtype.str.encode()]) for c in columns)], names=list("scrwn"))
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def _planes(column: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: the high ones compress to nothing."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T.tobytes()


def _unblock(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    batch = pa.ipc.open_stream(block).read_next_batch()
    sizes = batch.column(0).to_pylist()
    columns = []
    for k, size in zip(range(1, 5), (sizes[0], sizes[0], sizes[1], sizes[1]), strict=True):
        planes, kind = batch.column(k).to_pylist()
        columns.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(-1, size).T).view(kind.decode()).ravel())
    c, r, w, n = columns
    return np.repeat(np.cumsum(c), r), w.astype(np.int64), n.astype(np.int64)


def count_levels(docs: DataFrame, vocab: Vocabulary, shards: int) -> DataFrame:
    """``level, shard, block``: sorted counts of bigrams (level 2) and trigrams (3) of ``docs(text)``, by shard of the context."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            word = np.concatenate([h[0] for h in held])
            for level in (2, 3):
                context = np.concatenate([h[level - 1] for h in held])
                rows = [(s, _block(*_combined(context[own], word[own], np.ones(len(own), np.int64))))
                        for s, own in _by_shard(context, shards)]
                yield pa.record_batch([pa.array([level] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()),
                                       pa.array([r[1] for r in rows], pa.binary())], names=["level", "shard", "block"])

        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                ids, _, first, _ = _ids(batch.column(0).slice(i, 2000), vocab)
                held.append((ids, *_contexts(ids, first, vocab.words + 1)))
                size += len(ids)
                if size >= PORTION:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    send_code(docs.sparkSession)
    return docs.select("text").mapInArrow(count, "level int, shard int, block binary")


def _write_level(folder: str, vocab: Vocabulary):
    """Merges the blocks of one shard of a level into its file; returns the counts of counts."""
    def write(key: tuple, rows: pa.Table) -> pa.Table:
        level, shard = key[0].as_py(), key[1].as_py()
        merged = (np.empty(0, np.int64),) * 3
        waiting, size = [merged], 0
        for block in rows["block"].to_pylist():
            waiting.append(_unblock(block))
            size += len(waiting[-1][0])
            if size > 2 * PORTION:
                waiting, size = [_combined(*map(np.concatenate, zip(*waiting, strict=True)))], 0
        context, word, n = _combined(*map(np.concatenate, zip(*waiting, strict=True)))
        start = np.flatnonzero(np.concatenate([[True], np.diff(context) != 0]))
        rank = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(context))))
        arrays = ef_write("contexts", context[start], min((vocab.words + 2) ** (level - 1), 1 << 63))
        arrays |= ef_write("pointers", np.append(start, len(context)), len(context) + 1)
        arrays |= ef_write("successors", rank * (vocab.words + 1) + word, len(start) * (vocab.words + 1))
        write_arrays(f"{folder}/trie-{level}-{shard:06d}.arrow", arrays)
        write_arrays(f"{folder}/counts-{level}-{shard:06d}.arrow", {"n": n}, compressed=True)
        seen = [int((n == k).sum()) for k in range(1, 5)]
        return pa.table({"level": pa.array([level], pa.int32()), "shard": pa.array([shard], pa.int32()), "n": pa.array([seen], pa.list_(pa.int64()))})

    return write


def _discounts(n: np.ndarray) -> list[float]:
    """Modified discounts from the counts of counts; 0.75 where these give none."""
    found = []
    for k in (1, 2, 3):
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0
        found.append(float(d) if 0 < d < k else 0.75)
    return found


def quantised(name: str, log10: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of values in 8 bits, with what each of them stands for: the range is that of the data, so none is clipped."""
    low, high = (float(log10.min()), float(log10.max())) if len(log10) else (0.0, 0.0)
    step = (high - low) / STEPS or 1.0
    return {name: np.round((log10 - low) / step).astype(np.uint8), f"{name}_values": 10.0 ** (np.arange(STEPS + 1) * step + low)}


def _write_weights(folder: str, discounts: dict[int, list[float]]):
    """Turns a shard's counts into quantised log10 probabilities and context weights."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = read_arrays(f"{folder}/counts-{level}-{shard:06d}.arrow")["n"].astype(np.float64)
                pointers = EliasFano(read_arrays(f"{folder}/trie-{level}-{shard:06d}.arrow"), "pointers").decoded()
                start = pointers[:-1]
                taken = np.array([0.0, *discounts[level]])[np.minimum(n, 3).astype(np.int64)]
                total = np.add.reduceat(n, start)
                own = (n - taken) / np.repeat(total, np.diff(pointers))
                write_arrays(f"{folder}/weights-{level}-{shard:06d}.arrow",
                             quantised("p", np.log10(own)) | quantised("w", np.log10(np.add.reduceat(taken, start) / total)))
            yield batch.select(["shard"])

    return write


@dataclass(frozen=True)
class Trie:
    """The trie's levels in the shared folder."""

    folder: str
    vocab: Vocabulary
    shards: int
    present: frozenset[tuple[int, int]]

    def _level(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probability of each n-gram (0 if unseen) and the weight of the lower order (1 if the context is),
        for sorted contexts."""
        p, w = np.zeros(len(word)), np.ones(len(word))
        for s, own in _by_shard(context, self.shards):
            if (level, s) in self.present:
                sequences, weights = _shard(self.folder, level, s)
                # Contexts come sorted: each distinct one is looked up once.
                asked = context[own]
                new = np.concatenate([[True], asked[1:] != asked[:-1]])
                rank, known = sequences["contexts"].successor(asked[new])
                which = np.cumsum(new) - 1
                hit = own[known[which]]
                rank = rank[which[known[which]]]
                w[hit] = weights["w_values"][weights["w"][rank]]
                place, found = sequences["successors"].successor(rank * (self.vocab.words + 1) + word[hit])
                p[hit[found]] = weights["p_values"][weights["p"][place[found]]]
        return p, w

    def probabilities(self, ids: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Interpolated probability of each token after the two before it."""
        words, tokens = self.vocab.words, self.vocab.tokens
        one, two = _contexts(ids, first, words + 1)
        p = (counts + words / (words + 1)) / (tokens + words) if tokens else np.ones(len(ids))
        # Bigrams repeat within a batch: each distinct one is looked up once.
        _, some, which = np.unique(one * (words + 2) + ids, return_index=True, return_inverse=True)
        own, weight = self._level(2, one[some], ids[some])
        p = own[which] + weight[which] * p
        order = np.argsort(two)
        own, weight = self._level(3, two[order], ids[order])
        found = np.empty(len(ids))
        found[order] = own + weight * p[order]
        return found


def _by_shard(context: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places of its contexts, in order."""
    shard = (spread(context) % shards).astype(np.uint16 if shards < 65_536 else np.int64)
    order = np.argsort(shard, kind="stable")
    starts = np.flatnonzero(np.diff(shard[order], prepend=shard[order[:1]] + 1)) if len(order) else order
    for own in np.split(order, starts[1:]) if len(order) else []:
        yield int(shard[own[0]]), own


@lru_cache(maxsize=512)
def _shard(folder: str, level: int, shard: int) -> tuple[dict[str, EliasFano], dict[str, np.ndarray]]:
    arrays = read_arrays(f"{folder}/trie-{level}-{shard:06d}.arrow")
    return ({k: EliasFano(arrays, k) for k in ("contexts", "successors")},
            read_arrays(f"{folder}/weights-{level}-{shard:06d}.arrow"))


def train(docs: DataFrame) -> Trie:
    """The trie of all texts of ``docs(text)``."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "lm-trie")
    vocab = vocabulary(docs, folder)
    if (vocab.words + 2) ** 2 >= 1 << 63:
        raise ValueError(f"{vocab.words} distinct words: pairs of ids no longer fit 63 bits")
    shards = 1 + vocab.tokens // SHARD
    send_code(spark)
    levels = count_levels(docs, vocab, shards).groupBy("level", "shard").applyInArrow(
        _write_level(folder, vocab), "level int, shard int, n array<bigint>")
    levels.write.parquet(f"{folder}/levels")
    written = spark.read.parquet(f"{folder}/levels")
    sums = written.groupBy("level").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(4)]).collect()
    discounts = {r["level"]: _discounts(np.array([r[f"n{k}"] for k in range(4)], float)) for r in sums}
    done = written.select("level", "shard").mapInArrow(_write_weights(folder, discounts), "shard int")
    done.agg(F.count(F.lit(1))).collect()
    return Trie(folder, vocab, shards, frozenset((r["level"], r["shard"]) for r in written.select("level", "shard").collect()))


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one unigram) and ``score`` (the trie's), in log10."""
    def run(c):
        ids, counts, first, text = _ids(c["text"], trie.vocab)
        n, base_total = len(c["text"]), trie.vocab.tokens + trie.vocab.words + 1
        return {"n_tokens": np.bincount(text, minlength=n), "n_known": np.bincount(text, counts > 0, n).astype(np.int64),
                "train_tokens": np.full(n, trie.vocab.tokens), "base_score": np.bincount(text, np.log10((counts + 1) / base_total), n),
                "score": np.bincount(text, np.log10(trie.probabilities(ids, counts, first)), n)}

    return add_columns(docs, ["text"], run,
                       "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double", rows=2000)
