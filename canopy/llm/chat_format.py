"""Chat formatting: conversations as budgeted windows of whole turns with a loss mask.

A turn is ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end. A ``<|`` within a role or text gets a
backslash after its ``<`` (one more if it has some), so no text can open or close a turn, and reading takes the
backslash away again.

Turns are counted in tokens of a SentencePiece model (op8's encoder). A window is the leading system turn, then up to
``history`` tokens of turns that were in the window before, then as many new turns as the rest of the budget holds. The
oldest history goes where the first new turn would not fit, so only a turn that is over the budget with the system turn
alone makes a longer window, without history. Loss is on the texts of new assistant turns only; repeated
turns are masked, so that each assistant text counts once.

Rows are dealt by conversation and sorted by turn, and each task reads its rows as a stream: it holds the system turn,
the window and the limited history, whatever the length of a conversation.

Defined cases: null and empty texts are empty turns; a null role is empty; a system turn counts as such only at the start
of its conversation (elsewhere it is a turn like others); ties of a turn number are ordered by role, then text, and
repeated rows stay; rows with a null conversation are one conversation; an empty table gives no windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopy.llm.common import send_code
from canopy.llm.sentencepiece_bpe import encoder

TOKENIZER = "piece_bpe_32k.model"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
WINDOWS = ("conv_id bigint, window int, first_turn bigint, n_history int, n_new int, n_tokens bigint, text string, "
           "loss array<struct<start:int,length:int>>")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line: backslashes and line ends are written as two characters."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted(role: str, text: str) -> str:
    return f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}\n"


def tokens(text: str, tokenizer: str) -> int:
    """Length of a formatted turn in tokens of the model file ``tokenizer``, without the end id."""
    return encoder(tokenizer).coded(text)[0].count(" ")


@dataclass
class Windows:
    """The windows of one conversation, made as its turns come."""

    conv_id: int | None
    budget: int
    history: int
    tokenizer: str
    n: int = 0
    seen: int = 0
    system: tuple[str, int] | None = None
    past: list[tuple[str, int]] = field(default_factory=list)
    new: list[tuple[str, int, int, int]] = field(default_factory=list)
    past_tokens: int = 0
    new_tokens: int = 0

    def add(self, role: str, text: str) -> dict | None:
        """Takes a turn; returns the window that it closes, if any."""
        turn = formatted(role, text)
        size = tokens(turn, self.tokenizer)
        self.seen += 1
        if self.seen == 1 and role == "system":
            self.system = turn, size
            return None
        fixed = self.system[1] if self.system else 0
        closed = self.close() if self.new and fixed + self.past_tokens + self.new_tokens + size > self.budget else None
        while self.past and not self.new and fixed + self.past_tokens + size > self.budget:
            self.past_tokens -= self.past.pop(0)[1]
        head = len(OPEN) + len(escape_role(role)) + 1
        mask = (head, len(turn) - head - len(CLOSE) - 1) if role == "assistant" else (0, -1)
        self.new.append((turn, size, *mask))
        self.new_tokens += size
        return closed

    def close(self) -> dict | None:
        """The window of what is new, which then becomes history."""
        if not self.new and (self.n or not self.system):
            return None
        parts = [self.system[0]] if self.system else []
        parts += [t for t, _ in self.past]
        at, loss = sum(map(len, parts)), []
        for turn, _, start, length in self.new:
            if length >= 0:
                loss.append({"start": at + start, "length": length})
            at += len(turn)
            parts.append(turn)
        total = (self.system[1] if self.system else 0) + self.past_tokens + self.new_tokens
        row = {"conv_id": self.conv_id, "window": self.n, "first_turn": self.seen - len(self.new), "n_history": len(self.past),
               "n_new": len(self.new), "n_tokens": total, "text": "".join(parts), "loss": loss}
        kept = self.past + [t[:2] for t in self.new]
        size = self.past_tokens + self.new_tokens
        while kept and size > self.history:
            size -= kept.pop(0)[1]
        self.past, self.past_tokens, self.new, self.new_tokens, self.n = kept, size, [], 0, self.n + 1
        return row


def format_windows(conversations: DataFrame, budget: int = 2048, history: int = 256, tokenizer: str | None = None) -> DataFrame:
    """Windows ``conv_id, window, first_turn, n_history, n_new, n_tokens, text, loss`` of ``conversations(conv_id, turn,
    role, text)``; ``loss`` has the runs of code points of ``text`` that count. ``tokenizer`` is the
    path of the model that the budget is counted with. A task's windows come in order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, model = to_arrow_schema(StructType.fromDDL(WINDOWS)), tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one: Windows | None = None
        for batch in batches:
            rows, size = [], 0
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                done = []
                if open_one is None or open_one.conv_id != conv:
                    if open_one:
                        done.append(open_one.close())
                    open_one = Windows(conv, budget, history, model)
                done.append(open_one.add(role, text))
                for row in filter(None, done):
                    rows.append(row)
                    size += len(row["text"])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)
        if open_one and (row := open_one.close()):
            yield pa.RecordBatch.from_pylist([row], schema)

    send_code(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, WINDOWS)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    found = []
    for part in text.split(OPEN)[1:]:
        role, _, rest = part.removesuffix(f"{CLOSE}\n").partition("\n")
        found.append((unescape_role(role), unescape(rest)))
    return found


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_windows(windows: DataFrame) -> DataFrame:
    """Each conversation read back from its windows, as ``format_windows`` gave them (one task has a conversation's windows
    in order): digests of its turns and of the text under the loss mask, and the formatted length."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def result() -> pa.RecordBatch:
            n, turns, chars, loss, size = state
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size),
                                                         strict=True))], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or conv != row["conv_id"]:
                    if state is not None:
                        yield result()
                    conv, state = row["conv_id"], [0, sha256(), 0, sha256(), 0]
                read = read_turns(row["text"])
                repeated = len(read) - row["n_new"] if row["window"] else 0
                for role, text in read[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for run_ in row["loss"]:
                    text = unescape(row["text"][run_["start"]:run_["start"] + run_["length"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(row["text"])
        if state is not None:
            yield result()

    send_code(windows.sparkSession)
    return windows.mapInArrow(run, READ)
