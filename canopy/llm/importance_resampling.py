"""Target-distribution importance resampling: documents that look like a target set are drawn more often.

Features are the runs of 1 to ``max_n`` consecutive words of a text, each counted in the bucket of its CRC-32. A bucket's
gain is 1000 times the log of its smoothed share in the target over its smoothed share in all documents, a document's weight
the mean gain of its features, and the draw takes the highest sums of weight and Gumbel noise, which is the same as
drawing without replacement in proportion to exp(weight / 1000).

Plan.

1. Batch concatenation: a task joins the texts of a batch with a sentinel that no word can hold. One regex pass finds all words
   and sentinels of the batch, ``searchsorted`` in the texts' offsets tells the document of each word, which masks the n-grams that
   would cross from one document into the next. CRC-32 states run over all words at once, byte position by byte position;
   an n-gram's state goes on from that of its first n-1 words. ``bincount`` adds the buckets up.
2. A task gives one count a bucket (at most ``buckets`` rows), the counts are summed by bucket, and the gains, ``buckets``
   numbers, go to the second pass over the texts, which makes the weights. Nothing but these numbers is held per task.
3. Scores are native. The ranks come from a range-partitioned sort with offsets, so no task holds the whole order.

A batch's texts are cut into portions of ``PORTION`` bytes between words, so memory is bounded for very long texts too
(by the longest word); the last words of a portion go before the next one, so that no n-gram is lost.

Defined cases: a null or empty text has no words, no features and weight 0; a null ``doc_id`` draws its noise as
the empty string and comes after all others in ties; rows that share a ``doc_id`` are rows of their own (ties between them
fall by their order in the table); an empty table gives an empty result, an empty target gives gains against a uniform target;
columns that have the name of a new one are replaced by it in ``resample``; ``draw`` returns every column as it was.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import _sliced, add_columns, as_bytes, send_code
from canopy.operators.windows import row_number_split
from canopy.session import written

#: A sentinel between texts, a byte that UTF-8 never holds, and the words of a lower-cased text: digits, a-z and all that is not ASCII.
SENTINEL = b"\xff"
TOKEN = re.compile(rb"[0-9a-z\x80-\xf4]+|\xff")
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xf4]")
#: A-Z to a-z; bytes that no valid text holds to a space.
LOWER = bytes.maketrans(bytes(range(65, 91)) + bytes(range(0xF5, 0x100)), bytes(range(97, 123)) + b" " * 11)
PORTION = 1 << 21
#: Rows of an Arrow batch that are turned into Python bytes at a time.
ROWS = 1_000
#: Longer words leave the common steps, so that one very long word doesn't need a step a byte.
LONG_WORD = 64
POLYNOMIAL, ONES = 0xEDB88320, np.uint32(0xFFFFFFFF)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 by its rule. The steps of a state over one byte, and over n zero bytes for n up to ``LONG_WORD``, by byte of the state."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)
    zeros = [np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(LONG_WORD):
        zeros.append(byte[zeros[-1] & 0xFF] ^ (zeros[-1] >> 8))
    return byte, np.concatenate(zeros)


CRC, ZEROS = _tables()


class _Words:
    """The words of a portion. A CRC state goes on over a word as it would over as many zero bytes, xor the word's own part:
    that part is made once for each word, whatever the n-grams that the word ends."""

    def __init__(self, flat: bytes, starts: np.ndarray, sizes: np.ndarray):
        self.flat, self.starts, self.sizes = flat, starts, sizes
        self.base = np.minimum(sizes, LONG_WORD) * 1024
        data = np.frombuffer(flat, np.uint8)
        order = np.argsort((LONG_WORD - np.minimum(sizes, LONG_WORD)).astype(np.uint8), kind="stable")
        more = len(sizes) - np.cumsum(np.bincount(np.minimum(sizes, LONG_WORD), minlength=LONG_WORD + 1))  # words with more than j bytes
        at, part = starts[order], np.zeros(len(sizes), np.uint32)
        for j in range(LONG_WORD):
            if not (k := int(more[j])):
                break
            part[:k] = CRC[(part[:k] ^ data[at[:k] + j]) & 0xFF] ^ (part[:k] >> 8)
        self.part = np.empty_like(part)
        self.part[order] = part

    def after(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The states after the given words."""
        base, out = self.base[words], self.part[words]
        for k in range(4):
            out ^= ZEROS[base + (256 * k) + ((states >> np.uint32(8 * k)) & 0xFF)]
        for i in np.flatnonzero(self.sizes[words] > LONG_WORD):
            at = self.starts[words[i]]
            out[i] = zlib.crc32(self.flat[at:at + self.sizes[words[i]]], int(states[i] ^ ONES)) ^ 0xFFFFFFFF
        return out


def _pieces(texts: list[bytes], portion: int) -> Iterator[tuple[int, bytes]]:
    """(document, part of its lower-cased text), cut between words where a text is longer than a portion."""
    for doc, text in enumerate(texts):
        text, at = text.translate(LOWER), 0
        while at < len(text):
            cut = BETWEEN.search(text, at + portion) if len(text) - at > portion else None
            end = cut.start() if cut else len(text)
            yield doc, text[at:end]
            at = end


def _portions(texts: list[bytes], portion: int) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    for doc, piece in _pieces(texts, portion):
        held.append((doc, piece))
        size += len(piece) + 1
        if size >= portion:
            yield held
            held, size = [], 0
    if held:
        yield held


def ngrams(texts: list[bytes], max_n: int, portion: int = PORTION) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, document of each n-gram, its CRC-32) for n from 1 to ``max_n``, portion by portion."""
    carry: list[tuple[int, bytes]] = []
    for pieces in _portions(texts, portion):
        carry = [x for x in carry if x[0] == pieces[0][0]]  # the last words of a text that goes on here
        tokens = TOKEN.findall(SENTINEL.join(p for _, p in carry + pieces))
        flat = b" ".join(tokens)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(sizes + 1) - sizes - 1
        border = np.frombuffer(flat, np.uint8)[starts] == SENTINEL[0] if tokens else np.zeros(0, bool)
        offsets, starts, sizes = starts[border], starts[~border], sizes[~border]
        owners = np.array([d for d, _ in carry + pieces])
        docs = owners[np.searchsorted(offsets, starts)]
        words = _Words(flat, starts, sizes)
        firsts, states, known = np.arange(len(docs)), np.full(len(docs), ONES), len(carry)
        for n in range(1, max_n + 1):
            if n > 1:  # n-grams of one document only
                firsts, states = (x[firsts + n - 1 < len(docs)] for x in (firsts, states))
                firsts, states = (x[docs[firsts + n - 1] == docs[firsts]] for x in (firsts, states))
                states = CRC[(states ^ 0x20) & 0xFF] ^ (states >> 8)
            states = words.after(states, firsts + n - 1)
            new = firsts + n - 1 >= known  # n-grams of carried words alone were given with the portion before
            yield n, docs[firsts[new]], states[new] ^ ONES
        last = range(max(0, len(docs) - max_n + 1), len(docs))
        carry = [(int(docs[i]), flat[starts[i]:starts[i] + sizes[i]]) for i in last if docs[i] == pieces[-1][0]]


def bucket_counts(texts: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """``(bucket, n)`` over the column ``text``: the features of all rows by bucket, added up in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in _sliced(batches, ROWS):
            for _, _, crc in ngrams(as_bytes(batch.column(0)), max_n):
                total += np.bincount(crc % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    send_code(texts.sparkSession)
    counted = texts.select("text").mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, max_n: int = 2, buckets: int = 10_000) -> DataFrame:
    """``(bucket, gain)`` for every bucket: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), in doubles."""
    s = bucket_counts(docs, max_n, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t"))
    t = bucket_counts(target, max_n, buckets).select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t"))
    none = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t"))
    both = written(s.unionByName(t).unionByName(none).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    more = lambda c, n: c.cast("double") + F.lit(float(n))
    ratio = ((more(F.col("t"), 1) * more(both.agg(F.sum("s")).scalar(), buckets))
             / (more(F.col("s"), 1) * more(both.agg(F.sum("t")).scalar(), buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def weights(texts: DataFrame, gains: np.ndarray, max_n: int) -> DataFrame:
    """``texts`` without ``text`` and with ``__n_words``, ``__n_features`` and ``__weight``."""
    def run(columns: dict[str, pa.Array]) -> dict[str, np.ndarray]:
        batch = as_bytes(columns["text"])
        words, features, total = (np.zeros(len(batch), np.int64) for _ in range(3))
        for n, owners, crc in ngrams(batch, max_n):
            counts = np.bincount(owners, minlength=len(batch))
            words += counts if n == 1 else 0
            features += counts
            # Sums of whole numbers below 2**53 are exact in doubles.
            total += np.bincount(owners, weights=gains[crc % len(gains)], minlength=len(batch)).astype(np.int64)
        return {"__n_words": words, "__n_features": features, "__weight": np.floor_divide(total, np.maximum(features, 1))}

    return add_columns(texts, ["text"], run, "__n_words bigint, __n_features bigint, __weight bigint", drop=["text"], rows=ROWS)


def resample(docs: DataFrame, target: DataFrame, columns: list[str] | None = None, percent: int = 25, min_words: int = 20, max_n: int = 2,
             buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """``columns`` of ``docs`` (all, unless given) with ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the documents with at least ``min_words`` words, ``percent`` of a hundred are drawn, the highest scores first
    (ties: smaller ``doc_id``); ``rank`` is null for all others.
    """
    new = ["n_features", "weight", "score", "rank"]
    columns = [c for c in columns or docs.columns if c not in new]
    # A bounded number of gains (``buckets``) reaches the driver and goes with the tasks.
    found = bucket_gains(docs, target, max_n, buckets).collect()
    gains = np.zeros(buckets)
    gains[[r["bucket"] for r in found]] = [r["gain"] for r in found]
    carried = F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in columns])
    texts = docs.select(carried.alias("__row"), F.col("doc_id").alias("__id"), "text")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(weights(texts, gains, max_n).withColumn("__score", F.col("__weight") + noise)
                     .withColumn("__rid", F.monotonically_increasing_id()), "scored")
    entered = scored.where(F.col("__n_words") >= min_words)
    quota = percent * entered.count() // 100
    order = [F.col("__score").desc(), F.col("__id").asc_nulls_last(), F.col("__rid")]
    ranked = row_number_split(entered, [], order, "__rank")
    ranked = ranked.withColumn("__rank", F.when(F.col("__rank") <= quota, F.col("__rank")).cast("bigint"))
    rest = scored.where(F.col("__n_words") < min_words).withColumn("__rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select(*[F.col(f"__row.`{c}`").alias(c) for c in columns], F.col("__n_features").alias("n_features"),
                                           F.col("__weight").alias("weight"), F.col("__score").alias("score"), F.col("__rank").alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with their columns as they were."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__whole"), "doc_id", "text")
    found = resample(whole, target, columns=["__whole"], **options).where(F.col("rank").isNotNull())
    return found.select(*[F.col(f"__whole.`{c}`").alias(c) for c in docs.columns])
