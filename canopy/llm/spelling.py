"""Spelling variants: each word with the words one edit away, its likely right form and the root of the chain of forms.

Words are points: their vector of letter counts. One inserted or deleted letter moves a word by an L1 distance of 1, one
replaced letter by 2 at most, so the words near a word of length L lie within 2 among those of length L, and within 1
among those of length L - 1. These two range searches are made for each length pair in k-d trees.

Plan.

1. For each length a k-d tree is fitted on a sample of the vocabulary (``SAMPLE`` words by hash, a fixed bound), down to leaves
   of some ``LEAF`` words of the whole vocabulary. All words are then dealt: each is a resident of the one leaf of its
   length that holds it, and a visitor of every other leaf whose box its ball reaches (same length: leaves after its own
   only, so that a pair is found once). A leaf that came out larger than ``2 * LEAF`` (a vocabulary beyond the sample's reach, or very
   many anagrams) is cut into blocks by hash: its visitors go to each block, its residents also visit the blocks after theirs.
2. Each (length, leaf, block) is one sorted run of rows in a task, residents first. They get a k-d tree of their own; the
   visitors pass it batch by batch. The search prunes by boxes, compares the parities of the letter counts in the last
   leaves, and verifies the order of the letters of every pair left: exactly one inserted, deleted or replaced code point.
3. Near words are reduced by word (count, largest), and chains of forms are followed by pointer doubling: a form has at least
   ``ratio`` times the occurrences of its word, so the length of a chain is bounded by the logarithm of the largest count.

Letters a to z and the 64 code points from U+00C0 have counts of their own; other code points share these 64. Counts above 255
count as 255. Both only make points come closer, so no pair is lost, and the verification is exact.

Defined cases: null and empty words are dropped; repeated rows of a word are added up; words of any length are compared whole; ties of the
largest count fall to the smallest word in code-point order; an empty vocabulary gives an empty result; only the columns
``word`` and ``n`` are read, so other columns and their names don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import send_code
from canopy.session import written

#: Words that the trees over the whole vocabulary are fitted on, at most (in the mean, as the choice goes by hash).
SAMPLE = 1 << 17
#: Words of the vocabulary in a leaf of these trees, and words of the sample that a leaf needs at least.
LEAF, LEAST = 1 << 14, 16
#: Words in a last leaf of a task's tree.
SMALL = 48
LETTERS = 26 + 64
#: Bytes of letters that one step of the verification compares.
CHUNK = 1 << 24


def _codes(words: list[str]) -> np.ndarray:
    """Code points, one row a word; all words have the same length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts, one row a letter and one column a word."""
    letter = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % 64).astype(np.int64)
    rows = np.arange(len(codes))[:, None] * LETTERS
    counts = np.bincount((rows + letter).ravel(), minlength=len(codes) * LETTERS).reshape(-1, LETTERS)
    return np.ascontiguousarray(np.minimum(counts, 255).astype(np.int16).T)


class Tree:
    """A k-d tree. ``nodes``: (letter, border, left, right), or (-1, leaf, 0, 0); counts up to the border go left."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.members: list[np.ndarray] = []
        self._grow(points, np.arange(points.shape[1]), leaf)

    def _grow(self, points: np.ndarray, members: np.ndarray, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, len(self.members), 0, 0))
        split = self._border(points[:, members]) if len(members) > leaf else None
        if split is None:
            self.members.append(members)
            return me
        letter, border = split
        low = points[letter, members] <= border
        left = self._grow(points, members[low], leaf)
        self.nodes[me] = (letter, border, left, self._grow(points, members[~low], leaf))
        return me

    @staticmethod
    def _border(points: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that split the points most evenly; None if all are alike."""
        best, found = 0, None
        for border in range(int(points.max())):
            low = (points <= border).sum(axis=1)
            even = np.minimum(low, points.shape[1] - low)
            if even.max() > best:
                best, found = int(even.max()), (int(even.argmax()), border)
        return found

    def leaves(self) -> int:
        return len(self.members)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf whose box holds each point."""
        out, todo = np.empty(points.shape[1], np.int64), [(0, np.arange(points.shape[1]))]
        while todo:
            node, some = todo.pop()
            letter, border, left, right = self.nodes[node]
            if letter < 0:
                out[some] = border
            else:
                low = points[letter, some] <= border
                todo += [(left, some[low]), (right, some[~low])]
        return out

    def reach(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points whose ball reaches its box). A branch goes on with the points that are within the radius of its box."""
        todo = [(0, np.arange(points.shape[1]), np.zeros(points.shape[1], np.int16), {})]
        while todo:
            node, some, far, box = todo.pop()
            letter, border, left, right = self.nodes[node]
            if letter < 0:
                yield border, some
                continue
            low, high = box.get(letter, (0, 255))
            c = points[letter, some]
            rest = far - np.maximum(low - c, 0) - np.maximum(c - high, 0)
            for child, a, b in ((left, low, border), (right, border + 1, high)):
                distance = rest + np.maximum(a - c, 0) + np.maximum(c - b, 0)
                held = distance <= radius
                if held.any():
                    todo.append((child, some[held], distance[held], {**box, letter: (a, b)}))


def _parities(points: np.ndarray) -> np.ndarray:
    bits = np.packbits((points & 1).astype(np.uint8), axis=0)
    padded = np.zeros((16, points.shape[1]), np.uint8)
    padded[:len(bits)] = bits
    return np.ascontiguousarray(padded.T).view(np.uint64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows of ``a`` and ``b`` (code points) differ by exactly one replaced code point or, where ``b`` is
    longer by one, by one inserted code point."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    ends = np.ones((len(a), 1), bool)
    prefix = np.hstack([a != b[:, :n], ends]).argmax(axis=1)
    suffix = np.hstack([(a != b[:, 1:])[:, ::-1], ends]).argmax(axis=1)
    return prefix + suffix >= n


class _Residents:
    """The residents of a leaf with their tree."""

    def __init__(self, words: list[str]):
        self.codes = _codes(words)
        points = vectors(self.codes)
        self.tree = Tree(points, SMALL)
        self.parities = _parities(points)
        self.points = points

    def near(self, codes: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(resident, visitor) numbers of near pairs; without visitors, pairs among the residents, each once."""
        points = self.points if codes is None else vectors(codes)
        parities = self.parities if codes is None else _parities(points)
        visitors = self.codes if codes is None else codes
        step = max(1, CHUNK // (8 * visitors.shape[1]))
        for leaf, some in self.tree.reach(points, radius):
            members = self.tree.members[leaf]
            for at in range(0, len(some), 1 << 14):
                part = some[at:at + (1 << 14)]
                for cut in range(0, len(members), 1 << 10):  # anagrams share a point, so a last leaf may be large
                    own = members[cut:cut + (1 << 10)]
                    differ = np.bitwise_count(self.parities[own, 0][:, None] ^ parities[part, 0][None, :])
                    differ += np.bitwise_count(self.parities[own, 1][:, None] ^ parities[part, 1][None, :])
                    i, j = np.nonzero(differ <= radius)
                    i, j = own[i], part[j]
                    if codes is None:
                        i, j = i[i < j], j[i < j]
                    for k in range(0, len(i), step):
                        a, b = i[k:k + step], j[k:k + step]
                        held = one_edit(self.codes[a], visitors[b])
                        if held.any():
                            yield a[held], b[held]


def _fit(vocabulary: DataFrame, total: int) -> dict[int, Tree]:
    """A tree for each length with more than one leaf, from the sample. The driver receives the sample only."""
    share = min(1.0, SAMPLE / max(1, total))
    chosen = vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("word")
    by_length: dict[int, list[str]] = {}
    for batch in chosen.toArrow().to_batches():
        for w in batch.column(0).to_pylist():
            by_length.setdefault(len(w), []).append(w)
    leaf = max(LEAST, round(LEAF * share))
    trees = {}
    for length, words in by_length.items():
        if len(words) > leaf:
            tree = Tree(vectors(_codes(sorted(words))), leaf)
            tree.members = [None] * tree.leaves()
            trees[length] = tree
    return trees


_ROUTE = "length int, leaf int, block int, kind int, word string, n bigint"
RESIDENT, SAME, LONGER = 0, 1, 2


def _by_length(words: list[str]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        found.setdefault(len(w), []).append(i)
    return found


def _homes(vocabulary: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, at in _by_length(words).items():
                leaf = trees[length].home(vectors(_codes([words[i] for i in at]))) if length in trees else np.zeros(len(at), np.int64)
                kinds, counts = np.unique(leaf, return_counts=True)
                yield pa.record_batch([pa.array([length] * len(kinds), pa.int32()), pa.array(kinds, pa.int32()), pa.array(counts, pa.int64())],
                                      names=["length", "leaf", "n"])

    return vocabulary.select("word").mapInArrow(run, "length int, leaf int, n bigint").groupBy("length", "leaf").agg(F.sum("n").alias("n"))


def _routes(vocabulary: DataFrame, trees: dict[int, Tree], blocks: dict[tuple[int, int], int]) -> DataFrame:
    """One row for each leaf and block that a word lives in or visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, at in _by_length(words).items():
                own = [words[i] for i in at]
                points = vectors(_codes(own))
                hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in own])
                home = trees[length].home(points) if length in trees else np.zeros(len(own), np.int64)
                columns = pa.record_batch([pa.array(own), batch.column(1).take(pa.array(at))], names=["word", "n"])

                def rows(target, leaf, some, kind, block):
                    keys = [pa.array(np.broadcast_to(v, len(some)), pa.int32()) for v in (target, leaf, block, kind)]
                    return pa.record_batch([*keys, *columns.take(pa.array(some))], names=["length", "leaf", "block", "kind", "word", "n"])

                for target, radius in ((length, 2), (length - 1, 1)):
                    reached = trees[target].reach(points, radius) if target in trees else iter([(0, np.arange(len(own)))])
                    for leaf, some in reached:
                        n_blocks = blocks.get((target, leaf), 1)
                        if target < length:
                            for block in range(n_blocks):
                                yield rows(target, leaf, some, LONGER, block)
                            continue
                        mine, later = some[home[some] == leaf], some[home[some] < leaf]
                        yield rows(target, leaf, mine, RESIDENT, hashes[mine] % n_blocks)
                        for block in range(n_blocks):
                            yield rows(target, leaf, later, SAME, block)
                            if block:
                                yield rows(target, leaf, mine[hashes[mine] % n_blocks < block], SAME, block)

    return vocabulary.select("word", "n").mapInArrow(run, _ROUTE)


def _edges(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Borders of the runs of rows with the same length, leaf, block and kind."""
    keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
    cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows])


def _pairs(own: pa.Table, other: pa.Table, near: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for a, b in near:
        left, right = own.take(pa.array(a)), other.take(pa.array(b))
        both = pa.concat_tables([left, right]), pa.concat_tables([right, left])
        yield from pa.table([both[0]["word"], both[1]["word"], both[1]["n"]], names=["word", "near", "near_n"]).to_batches()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each leaf: its residents come first and are held, the visitors pass by."""
    place, held, residents = None, [], None

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal held, residents
        held = pa.concat_tables(held)
        residents = _Residents(held["word"].to_pylist())
        yield from _pairs(held, held, residents.near(None, 2))

    for batch in batches:
        for at, end in _edges(batch):
            *key, kind = (batch.column(i)[at].as_py() for i in range(4))
            some = pa.Table.from_batches([batch.slice(at, end - at).select(["word", "n"])])
            if key != place:
                if held and residents is None:
                    yield from settle()
                place, held, residents = key, [], None
            if kind == RESIDENT:
                held.append(some)
            elif held:
                if residents is None:
                    yield from settle()
                yield from _pairs(held, some, residents.near(_codes(some["word"].to_pylist()), 2 if kind == SAME else 1))
    if held and residents is None:
        yield from settle()


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``(word, near, near_n)``, both ways, for the distinct words of ``vocabulary(word, n)`` that differ by exactly one edit."""
    spark = vocabulary.sparkSession
    send_code(spark)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trees = _fit(vocabulary, vocabulary.count())
    # The driver receives a row for each leaf that is too large; the number of leaves is bounded by the sample.
    large = _homes(vocabulary, trees).where(F.col("n") > 2 * LEAF).collect()
    blocks = {(r["length"], r["leaf"]): math.ceil(r["n"] / LEAF) for r in large}
    dealt = _routes(vocabulary, trees, blocks).repartition(slices, "length", "leaf", "block")
    return dealt.sortWithinPartitions("length", "leaf", "block", "kind").mapInArrow(_search, "word string, near string, near_n bigint")


def spelling_forms(vocabulary: DataFrame, ratio: int = 10) -> DataFrame:
    """For ``vocabulary(word, n)``: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word with the largest count, if that is at least ``ratio`` (2 or more) times the word's; ``root`` follows
    forms to the last, or is the word itself.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, else chains of forms may not end")
    words = written(vocabulary.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").cast("bigint").alias("n")), "vocabulary")
    near = (near_pairs(words).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("back"), "near")).alias("best")))
    is_form = -F.col("best.back") >= ratio * F.col("n")
    found = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.back")).alias("form_n")), "forms")
    roots = found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    span = words.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    longest = math.log(max(1, span["most"] or 1) / max(1, span["least"] or 1), ratio)  # steps that a chain can have
    for _ in range(math.ceil(math.log2(max(1.0, longest)))):
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return (found.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
