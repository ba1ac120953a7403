"""Modified Kneser-Ney model over the characters of words, one for each language, in sorted hash arrays.

Characters, not words, are the symbols: the number of distinct n-grams then hardly grows with the corpus, and no word is
unknown. A word is read with start marks before it and an end mark after it.

* Counting: each batch of texts counts its distinct words, and these words' n-grams weighted by that; Spark sums the
  n-grams of all documents, and derives continuation counts, discounts and interpolated probabilities by grouped
  aggregates and joins over n-grams.
* Storing: n-grams and contexts become 64-bit hashes of language and characters, range-partitioned and sorted. Each
  partition writes one array file to the shared folder. Tasks memory-map the files and look hashes up by
  binary search, so no task holds the model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import as_bytes, map_rows, read_arrays, send_code, shared_folder, write_arrays

START, END = "\x02", "\x03"
#: Distinct words that are cut into n-grams at a time.
PART = 100_000
#: Entries of an array file.
SHARD = 4_000_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def language_seed(lang: str) -> np.uint64:
    """The hash that a language's n-grams start from."""
    h = np.array([0x5851F42D4C957F2D], np.uint64)
    for b in lang.encode():
        h = _mixed(h + np.uint64(b + 1))
    return h[0]


def hashes(seeds: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hash of each row of character codes, after the row's seed."""
    h = seeds.copy()
    for k in range(codes.shape[1]):
        h = _mixed(h + codes[:, k].astype(np.uint64) + np.uint64(1))
    return h


def _windows(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each character and at the end of each word, and the number of them by word."""
    pad = START * (order - 1)
    text = "".join([f"{pad}{w.decode('utf-8', 'replace')}{END}" for w in words]).replace("\0", "\1")
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(codes == ord(END))
    # An end mark inside a word would end it early: such rare words count as several.
    if len(ends) != len(words):
        return _windows([w.replace(END.encode(), b"\1") for w in words], order)
    sizes = np.diff(ends, prepend=-1)
    windows = np.lib.stride_tricks.sliding_window_view(codes, order)
    first = np.repeat(ends - sizes + 1, sizes - order + 1)
    rank = np.arange(len(first)) - np.repeat(np.cumsum(sizes - order + 1) - (sizes - order + 1), sizes - order + 1)
    return windows[first + rank], sizes - order + 1


def words_by_language(langs: list[str | None], texts: list[bytes]) -> dict[str, Counter]:
    found: dict[str, Counter] = {}
    for lang, text in zip(langs, texts, strict=True):
        found.setdefault(lang or "", Counter()).update(text.split())
    return found


def ngram_counts(docs: DataFrame, order: int) -> DataFrame:
    """``lang, gram, n`` over all texts; a gram has ``order`` characters, start marks included."""
    def count(c):
        out = {"lang": [], "gram": [], "n": []}
        for lang, words in words_by_language(c["lang"].to_pylist(), as_bytes(c["text"])).items():
            own = list(words)
            for i in range(0, len(own), PART):
                part = own[i:i + PART]
                windows, sizes = _windows(part, order)
                weights = np.repeat(np.fromiter((words[w] for w in part), np.int64, len(part)), sizes)
                _, first, which = np.unique(hashes(np.zeros(len(windows), np.uint64), windows), return_index=True, return_inverse=True)
                grams = np.ascontiguousarray(windows[first]).view(f"<U{order}").ravel().tolist()
                out["lang"] += [lang] * len(grams)
                out["gram"] += grams
                out["n"] += np.bincount(which, weights).astype(np.int64).tolist()
        return out

    rows = map_rows(docs, ["lang", "text"], count, "lang string, gram string, n bigint", rows=4000)
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> DataFrame:
    """The three discounts of a language and order from the counts of counts; 0.75 where these give none."""
    n1, n2, n3, n4 = (F.count_if(F.col("n") == k).cast("double") for k in range(1, 5))
    counted = grams.groupBy("lang").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        value = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.coalesce(F.when((value > 0) & (value < k), value), F.lit(0.75)).alias(f"d{k}")

    return counted.select("lang", discount(1), discount(2), discount(3))


def _level(grams: DataFrame, lower: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interpolated probabilities ``lang, gram, p`` of one order and the contexts' weights ``lang, context, w``."""
    cut = grams.withColumn("context", F.expr("left(gram, length(gram) - 1)")).withColumn("suffix", F.expr("substring(gram, 2)"))
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    own = cut.join(_discounts(grams), "lang").withColumn("taken", taken)
    contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("taken").alias("freed"))
    levels = own.join(contexts, ["lang", "context"]).join(
        lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
    p = (F.col("n") - F.col("taken") + F.col("freed") * F.col("lower")) / F.col("total")
    return (levels.select("lang", "gram", p.alias("p")),
            contexts.select("lang", "context", (F.col("freed") / F.col("total")).alias("w")))


def _hash_rows(rows: DataFrame) -> DataFrame:
    """``lang, gram, v`` -> ``h, v`` with the hashes as signed longs in the order of the unsigned ones."""
    def run(c):
        langs, grams = c["lang"].to_pylist(), c["gram"].to_pylist()
        seeds = {lang: language_seed(lang) for lang in set(langs)}
        found = np.array([seeds[lang] for lang in langs], np.uint64)
        for size in {len(g) for g in grams} - {0}:
            at = np.flatnonzero(np.fromiter((len(g) == size for g in grams), bool, len(grams)))
            codes = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le"), np.uint32).reshape(-1, size)
            found[at] = hashes(found[at], codes)
        return {"h": (found ^ np.uint64(1 << 63)).view(np.int64), "v": c["v"]}

    return map_rows(rows, ["lang", "gram", "v"], run, "h bigint, v float")


def write_sorted(rows: DataFrame, folder: str, kind: str, values: list[str]) -> list[tuple[int, str]]:
    """Sorted array files of ``h`` with float ``values``; returns each file's first hash and name, in order."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        name = f"{folder}/{kind}-{TaskContext.get().partitionId():06d}.arrow"
        h = rows["h"].to_numpy()
        write_arrays(name, {"h": h.view(np.uint64) ^ np.uint64(1 << 63)} | {v: rows[v].to_numpy().astype(np.float32) for v in values})
        yield pa.record_batch([pa.array([int(h[0])]), pa.array([name])], names=["first", "name"])

    send_code(rows.sparkSession)
    n = 1 + rows.count() // SHARD
    dealt = rows.select("h", *values).repartitionByRange(n, "h").sortWithinPartitions("h")
    return [(r["first"] + (1 << 63), r["name"]) for r in sorted(dealt.mapInArrow(write, "first bigint, name string").collect())]


class SortedArrays:
    """Look-ups by hash in the files of ``write_sorted``."""

    def __init__(self, files: list[tuple[int, str]]):
        self.files = files

    @property
    def first(self) -> np.ndarray:
        return np.array([f for f, _ in self.files], np.uint64)

    def find(self, wanted: np.ndarray, value: str = "v") -> np.ndarray:
        """The value of each hash, NaN where there is none."""
        found = np.full(len(wanted), np.nan, np.float32)
        if not self.files:
            return found
        shard = np.searchsorted(self.first, wanted, side="right") - 1
        for k in np.unique(shard[shard >= 0]).tolist():
            own = np.flatnonzero(shard == k)
            arrays = _mapped(self.files[k][1])
            at = np.minimum(np.searchsorted(arrays["h"], wanted[own]), len(arrays["h"]) - 1)
            hit = arrays["h"][at] == wanted[own]
            found[own[hit]] = arrays[value][at[hit]]
        return found


@lru_cache(maxsize=64)
def _mapped(name: str) -> dict[str, np.ndarray]:
    return read_arrays(name)


class Model:
    """Log10 probabilities of words from the stored arrays."""

    def __init__(self, order: int, grams: list[tuple[int, str]], contexts: list[tuple[int, str]]):
        self.order, self.grams, self.contexts = order, SortedArrays(grams), SortedArrays(contexts)

    def words(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Log10 probability of each word, its end included."""
        parts = [self._part(lang, words[i:i + PART]) for i in range(0, len(words), PART)]
        return np.concatenate([np.empty(0), *parts])

    def _part(self, lang: str, words: list[bytes]) -> np.ndarray:
        windows, sizes = _windows(words, self.order)
        _, first, which = np.unique(hashes(np.zeros(len(windows), np.uint64), windows), return_index=True, return_inverse=True)
        own = windows[first]
        seeds = np.full(len(own), language_seed(lang), np.uint64)
        score, todo = np.zeros(len(own)), np.arange(len(own))
        for size in range(self.order, -1, -1):
            cut = own[todo][:, self.order - size:]
            value = self.grams.find(hashes(seeds[todo], cut))
            hit = ~np.isnan(value)
            score[todo[hit]] += value[hit]
            todo, cut = todo[~hit], cut[~hit]
            if not len(todo) or not size:
                break
            weight = self.contexts.find(hashes(seeds[todo], cut[:, :-1]))
            score[todo] += np.where(np.isnan(weight), 0, weight)
        return np.add.reduceat(score[which], np.cumsum(sizes) - sizes)


def train(docs: DataFrame, order: int = 4) -> Model:
    """The model of ``docs(lang, text)``, every document counted (a null language is the empty name)."""
    spark: SparkSession = docs.sparkSession
    folder = shared_folder(spark, "char-kn")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    grams = {order: written(ngram_counts(docs, order), f"grams-{order}")}
    for k in range(order - 1, 0, -1):
        kept = grams[k + 1].select("lang", F.expr("substring(gram, 2)").alias("gram"))
        grams[k] = written(kept.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), f"grams-{k}")
    lower = grams[1].groupBy("lang").agg((1 / (F.count(F.lit(1)) + 1)).alias("p")).select("lang", F.lit("").alias("gram"), "p")
    probabilities, contexts = lower, None
    for k in range(1, order + 1):
        level, weights = _level(grams[k], lower)
        lower = written(level, f"p-{k}")
        probabilities = probabilities.unionByName(lower)
        weights = written(weights, f"w-{k}")
        contexts = weights if contexts is None else contexts.unionByName(weights)
    stored = probabilities.select("lang", "gram", F.log10("p").cast("float").alias("v"))
    backoff = contexts.select("lang", F.col("context").alias("gram"), F.log10("w").cast("float").alias("v"))
    return Model(order, write_sorted(_hash_rows(stored), folder, "grams", ["v"]),
                 write_sorted(_hash_rows(backoff), folder, "contexts", ["v"]))


def mean_log10(model: Model, langs: list[str | None], texts: list[bytes]) -> list[float | None]:
    """Mean log10 probability of a word of each text, null without words; 10 to the negative of it is the perplexity."""
    scores = {}
    for lang, words in words_by_language(langs, texts).items():
        own = list(words)
        scores[lang] = dict(zip(own, model.words(lang, own).tolist(), strict=True))
    found: list[float | None] = []
    for lang, text in zip(langs, texts, strict=True):
        words = text.split()
        found.append(math.fsum(map(scores[lang or ""].__getitem__, words)) / len(words) if words else None)
    return found
