"""SentencePiece encoding and decoding by a merge-type prefix table.

For each prefix of a stretch of text the encoder stores the last token of the prefix's own encoding. It is
unique, and follows from shorter prefixes: among the vocabulary entries that end at a place (matches of an
automaton) it is the one that is compatible with the last token of the prefix before it, where two tokens are
compatible if merging their joined text gives just these two. The ids are then read backwards from the end.

The work is linear in the text. Stretches are cut where no token can span: before a space mark that follows another character
(if the vocabulary has no entry across such a place), and around characters that no entry holds.
Stretches repeat, so each worker keeps a bounded number of their encodings.

Defined cases: null counts as empty; an empty text is the end id alone and decodes to an empty text; characters
outside the vocabulary become byte tokens; other columns pass through, columns named like a new one are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from canopy.llm.common import add_columns

SPACE = "▁"
#: Texts that a worker holds ids of at a time.
ROWS = 1000
#: Bytes of the caches of a worker's encoder (stretches and their ids), and known pairs of its compatibility test.
CACHE_BYTES, KNOWN_PAIRS = 192 << 20, 1_500_000


def _bytes(stretch: str, ids: str) -> int:
    """About what an entry of a cache takes: two texts and a place in the table."""
    return 4 * len(stretch) + len(ids) + 200


class Encoder:
    """Encodes and decodes with the merge type (BPE) of a SentencePiece model whose normaliser keeps the text as it is."""

    def __init__(self, model_path: str, cached: int = CACHE_BYTES, known: int = KNOWN_PAIRS):
        model = SentencePieceProcessor(model_file=model_path)
        if model.normalize("a  ﬁ\tb ") != f"{SPACE}a{SPACE}{SPACE}ﬁ\tb{SPACE}":
            raise ValueError("the model's normaliser changes texts; only identity with a space mark before the text is built")
        self.end_id = model.eos_id()
        self.pieces, self.scores = {}, {}
        self.byte_ids, self.text_of = [0] * 256, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                byte = bytes([int(piece[3:5], 16)])
                self.text_of[i] = byte.decode() if byte.isascii() else byte  # ASCII stands alone in any run of bytes
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece], self.scores[piece] = i, model.get_score(i)
                self.text_of[i] = piece
        self.text_of_written = {str(i): self.text_of.get(i, "") for i in range(model.get_piece_size())}
        self.alphabet = set("".join(self.pieces))
        # Entries of the table: the vocabulary, and characters that occur only inside longer entries.
        self.entries = [*self.pieces, *sorted(self.alphabet - set(self.pieces))]
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(self.entries):
            self.automaton.add_word(piece, number)
        self.automaton.make_automaton()
        self.cuts = not any(a != SPACE and b == SPACE for p in self.pieces for a, b in zip(p, p[1:], strict=False))
        self.number = {p: n for n, p in enumerate(self.entries)}
        self.sizes = [len(p) for p in self.entries]
        #: Ids of an entry as text: its own, or those of its bytes.
        self.written = [f" {self.pieces[p]}" if p in self.pieces else "".join(f" {self.byte_ids[b]}" for b in p.encode())
                        for p in self.entries]
        #: Known answers of the compatibility test by the token before; the last one is for no token before.
        self.fits: list[dict[int, bool]] = [{} for _ in range(len(self.entries) + 1)]
        self.most_known, self.n_known = known, 0
        #: Ids of what follows a space mark (by the text after it), in two halves, and of other stretches; each of the three has
        #: a third of the bytes, and a stretch that would take a sixteenth of that isn't kept.
        self.limit, self.young, self.old, self.inner = cached // 3, {}, {}, {}
        self.young_bytes = self.inner_bytes = 0

    def merged(self, text: str) -> list[str]:
        """The merges themselves, best score first and leftmost first, for the short texts of compatibility tests."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before`` (-1: can start)."""
        pair = [self.entries[token]] if before < 0 else [self.entries[before], self.entries[token]]
        if self.n_known >= self.most_known:
            for answers in self.fits:
                answers.clear()
            self.n_known = 0
        self.n_known += 1
        known = self.fits[before][token] = self.merged("".join(pair)) == pair
        return known

    def _tokens(self, stretch: str) -> list[int]:
        """Entry numbers of a stretch within the alphabet, from its prefix table."""
        size = len(stretch)
        last = [-1] * (size + 1)
        sizes, fits = self.sizes, self.fits
        done = 0
        for end, token in self.automaton.iter(stretch):
            if end < done:
                continue
            start = end + 1 - sizes[token]
            before = last[start]
            if before < 0 and start:
                continue
            ok = fits[before].get(token)
            if ok is None:
                ok = self._compatible(before, token)
            if ok:
                done = end + 1
                last[done] = token
        found, end = [], size
        while end:
            token = last[end]
            found.append(token)
            end -= sizes[token]
        return found[::-1]

    def _ids(self, stretch: str) -> str:
        """Ids of a stretch as text; characters that no entry holds are bytes, and tokens end beside them."""
        if self.alphabet.issuperset(stretch):
            return "".join([self.written[t] for t in self._tokens(stretch)])
        found, inside = [], ""
        for c in stretch:
            if c in self.alphabet:
                inside += c
            else:
                found += [self.written[t] for t in self._tokens(inside)] + [f" {self.byte_ids[b]}" for b in c.encode()]
                inside = ""
        return "".join(found + [self.written[t] for t in self._tokens(inside)])

    def _word(self, word: str) -> str:
        """Ids, as text, of a space mark with ``word`` after it, from the older half of the cache or made anew."""
        ids = self.old.get(word)
        if ids is None:
            # Lines meet at line ends, which no entry holds: their parts are cached by themselves.
            first, *lines = word.split("\n") if "\n" not in self.alphabet else [word]
            ids = self._inner(SPACE + first) if lines else self._ids(SPACE + word)
            ids += "".join(self._inner("\n") + (self._inner(line) if line else "") for line in lines)
        size = _bytes(word, ids)
        if 16 * size <= self.limit:
            if self.young_bytes + size > self.limit:
                self.old, self.young, self.young_bytes = self.young, {}, 0
            self.young[word] = ids
            self.young_bytes += size
        return ids

    def _inner(self, stretch: str) -> str:
        ids = self.inner.get(stretch)
        if ids is None:
            ids = self._ids(stretch)
            size = _bytes(stretch, ids)
            if 16 * size <= self.limit:
                if self.inner_bytes + size > self.limit:
                    self.inner.clear()
                    self.inner_bytes = 0
                self.inner[stretch] = ids
                self.inner_bytes += size
        return ids

    def coded(self, text: str) -> tuple[str, int]:
        """Ids of a text as decimal numbers joined by spaces, the end id included, and the number of ids."""
        if not text:
            return str(self.end_id), 1
        text = text.replace(SPACE, " ")
        if not self.cuts:
            ids = self._ids(SPACE + text.replace(" ", SPACE))
            return f"{ids[1:]} {self.end_id}", ids.count(" ") + 1
        parts, young, run = [], self.young, 0
        words = text.split(" ")
        if "" not in words:
            for word in words:
                ids = young.get(word)
                if ids is None:
                    ids = self._word(word)
                    young = self.young
                parts.append(ids)
        else:
            for word in words:
                if not word:
                    run += 1
                else:
                    parts.append(self._inner(SPACE * (run + 1) + word) if run else self.young.get(word) or self._word(word))
                    run = 0
            if run:
                parts.append(self._inner(SPACE * run))
        ids = "".join(parts)
        return f"{ids[1:]} {self.end_id}", ids.count(" ") + 1

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.coded(text or "")[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Entries with space marks as spaces, without the mark before the text; runs of byte tokens as UTF-8, each
        wrong byte as U+FFFD; ids without a text (the end id) give none."""
        return self._joined([self.text_of.get(i, "") for i in ids])

    def decode_written(self, ids: str) -> str:
        """``decode`` of ids written as decimal numbers with one space between."""
        return self._joined([self.text_of_written[i] for i in ids.split(" ")])

    def _joined(self, pieces: list[str | bytes]) -> str:
        try:
            text = "".join(pieces)
        except TypeError:
            text = self._decode_bytes(pieces)
        first = next(filter(None, pieces), "")
        text = text.replace(SPACE, " ")
        return text[1:] if isinstance(first, str) and first.startswith(SPACE) else text

    def _decode_bytes(self, pieces: list[str | bytes]) -> str:
        found, run = [], b""
        for piece in [*pieces, ""]:
            if isinstance(piece, bytes):
                run += piece
                continue
            if run:
                found.append(_utf8(run))
                run = b""
            found.append(piece)
        return "".join(found)


def _utf8(run: bytes) -> str:
    """UTF-8 with U+FFFD for each wrong byte."""
    found = []
    while run:
        try:
            found.append(run.decode())
            break
        except UnicodeDecodeError as e:
            found.append(run[:e.start].decode() + "\ufffd")
            run = run[e.start + 1:]
    return "".join(found)


@lru_cache(maxsize=2)
def encoder(model_path: str) -> Encoder:
    """One encoder for each model and worker."""
    return Encoder(model_path)


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int, end id included) in place of the text column."""
    def run(c):
        own = encoder(model_path)
        ids = [np.fromstring(own.coded(t or "")[0], np.int32, sep=" ") for t in c[text].to_pylist()]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return {"ids": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))}

    return add_columns(docs, [text], run, "ids array<int>", drop=[text], rows=ROWS)


def decode(encoded: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``encoded`` with the decoded text in place of ``ids`` (null: empty)."""
    def run(c):
        return {text: [encoder(model_path).decode(i or []) for i in c["ids"].to_pylist()]}

    return add_columns(encoded, ["ids"], run, f"`{text}` string", drop=["ids"], rows=ROWS)


def coded_texts(docs: DataFrame, model_path: str, fn, new: str, text: str = "text") -> DataFrame:
    """``docs`` with columns ``new`` made by ``fn(ids as text, decoded text, number of ids)`` in place of the text.

    The ids are read back from their text and decoded.
    """
    names = [part.split()[0] for part in new.split(",")]

    def run(c):
        own, rows = encoder(model_path), []
        for t in c[text].to_pylist():
            ids, n = own.coded(t or "")
            rows.append(fn(ids, own.decode_written(ids), n))
        return {n: [r[k] for r in rows] for k, n in enumerate(names)}

    return add_columns(docs, [text], run, new, drop=[text], rows=ROWS)
