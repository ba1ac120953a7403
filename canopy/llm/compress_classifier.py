"""Compression classifier: which of two zstandard dictionaries, of good or of bad text, makes a text smaller.

A bounded sample of labelled texts is cut into blocks. Some documents' blocks build one dictionary for each label; the others
calibrate. A text's blocks are compressed with either dictionary, the whole text whatever its length, and the normalised
difference of the two sizes, ``(bad - good) / (bad + good)``, goes through a logistic curve fitted on the calibration
documents, weighted to the labels' frequencies. Scoring is one pass over the texts, without a shuffle.

The sample is a documented bound: ``per_label`` documents of each label (those with the smallest hash of their id)
and ``blocks_per_label`` blocks for a dictionary. Only the text enters a score.

Defined cases: null and empty texts have difference 0 and the score of that; labels other than 0 and 1 and labels without
a document are left out; repeated labels count each; without both labels all scores are the share of label 1 (0.5
without any); an empty table gives an empty result; columns named like a new one are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import add_columns, as_bytes, map_rows
from canopy.session import written

BLOCK = 4096
LEVEL = 3
DICTIONARY = 64 << 10


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes, trained: bool) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


@dataclass(frozen=True)
class Classifier:
    """Two dictionaries and the logistic curve over the normalised size difference."""

    good: bytes = b""
    bad: bytes = b""
    trained: bool = False
    slope: float = 0.0
    offset: float = 0.0

    def difference(self, text: bytes) -> float:
        if not text or not self.good or not self.bad:
            return 0.0
        blocks = [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]
        good, bad = (sum(len(c.compress(b)) for b in blocks)
                     for c in (_compressor(self.good, self.trained), _compressor(self.bad, self.trained)))
        return (bad - good) / (bad + good)

    def score(self, text: bytes) -> float:
        z = self.slope * self.difference(text) + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _dictionary(blocks: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary, or the blocks themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:], False


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, lightly held to 0, on the scaled differences."""
    scale = float(np.abs(x).max()) or 1.0
    a, b = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - 1e-3 * b
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-3 * np.eye(2), gradient)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1500, blocks_per_label: int = 3000) -> Classifier:
    """A classifier of ``docs(doc_id, text)`` by ``labels(doc_id, label)``, learnt from the bounded sample."""
    spark = docs.sparkSession
    known = labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        share = float(sum(k * n for k, n in total.items()) / sum(total.values())) if total else 0.5
        return Classifier(offset=math.log((share + 1e-9) / (1 - share + 1e-9)))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # A bound on the hash leaves some 4 * per_label rows of a label before they are put in order.
    bound = {k: min((1 << 63) - 1, int(min(1.0, 4 * per_label / total[k]) * (1 << 64)) - (1 << 63)) for k in (0, 1)}
    chosen = [known.where((F.col("label") == k) & (F.xxhash64("doc_id") <= bound[k])).orderBy(*order).limit(per_label).collect() for k in (0, 1)]
    ids = spark.createDataFrame([r for rows in chosen for r in rows], "doc_id bigint, label int")
    sampled = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "labelled")  # at most 2 * per_label rows

    def cut(c):
        out = {"label": [], "place": [], "block": []}
        for label, key, text in zip(c["label"].to_pylist(), c["key"].to_pylist(), as_bytes(c["text"]), strict=True):
            for i in range(0, len(text), BLOCK):
                out["label"].append(label)
                out["place"].append(key ^ (i * 0x9E3779B1))
                out["block"].append(text[i:i + BLOCK])
        return out

    learn = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2)) == 0
    pieces = map_rows(sampled.where(learn).select("label", F.xxhash64("doc_id").alias("key"), "text"), ["label", "key", "text"],
                      cut, "label int, place bigint, block binary")
    made = []
    for k in (1, 0):
        blocks = [bytes(r["block"]) for r in pieces.where(F.col("label") == k).orderBy("place", "block").limit(blocks_per_label).collect()]
        made.append(_dictionary(blocks) if blocks else (b"", False))
    trained = made[0][1] and made[1][1]
    dictionaries = [d if t == trained or not d else d[-DICTIONARY:] for d, t in made]
    raw = Classifier(dictionaries[0], dictionaries[1], trained)

    def measure(c):
        return {"x": [raw.difference(t) for t in as_bytes(c["text"])], "label": c["label"]}

    held = map_rows(sampled.where(~learn), ["text", "label"], measure, "x double, label int").orderBy("x", "label").collect()
    x, y = np.array([r["x"] for r in held]), np.array([r["label"] for r in held], float)
    if not len(x) or y.min() == y.max():
        return Classifier(offset=math.log(total[1] / total[0]))
    seen = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.array([total[0], total[1]])[y.astype(int)] / seen[y.astype(int)]
    return Classifier(*dictionaries, trained, *_logistic(x, y, weight * len(y) / weight.sum()))


def classify(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: good likelier)."""
    def run(c):
        return {"score": [model.score(t) for t in as_bytes(c["text"])]}

    return add_columns(docs, ["text"], run, "score double")
