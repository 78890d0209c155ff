"""Chat formatting into budgeted, turn-aligned windows.

Prefix sums of turn tokens choose the span of new turns that fits a window; the system turn stays at the head of
every window, a limited history is repeated before the new turns, and repeated turns carry no loss.

Defined results
- null text or role: empty; null conv_id: one conversation of its own; null turn: first.
- ties and repeated rows: every row is a turn; order is (turn, role, text).
- a turn over the budget: a window of its own, never cut. Tokens are those of the vocabulary's tokenizer, by turn.
- empty table: no windows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices
from .packing import encoder

# fixed values: marks of the template, then control strings of other templates that texts may hold
TURN, SEP, END = "<|turn|>", "\n", "<|end|>\n"
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_CONTROL = re.compile("|".join(re.escape(x) for x in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(TURN) + r"((?:\\.|[^\\\n])*)\n(.*?)" + re.escape(END), re.S)

WINDOWS = "conv_id long, window long, formatted string, loss array<struct<start:int,end:int>>, repeated int, turns int, tokens long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def escape(text: str) -> str:
    """Double backslashes, then break each control string by a backslash after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def written(role: str, text: str) -> tuple[str, str]:
    """A turn's head and body as the template has them; END follows."""
    return TURN + escape_role(role) + SEP, escape(text)


def count_tokens(turns: Iterable[tuple[str, str]], path: str | None = None) -> list[int]:
    """Tokens of each written turn, its marks among them, by the tokenizer that packing uses."""
    return [len(ids) // 4 for ids in encoder(path).encode(["".join(written(*t)) + END for t in turns])]


class Windower:
    """Streams one conversation; holds the turns of one window and its history only."""

    def __init__(self, budget: int, history_turns: int, history_tokens: int):
        self.budget, self.history_turns, self.history_tokens = budget, history_turns, history_tokens
        self.system = None
        self.seen = 0
        self.window = 0
        self.history: list[tuple[str, str, int]] = []
        self.fresh: list[tuple[str, str, int]] = []
        self.prefix = [0]  # prefix sums of the fresh turns' tokens

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        turn = (role, text, tokens)
        self.seen += 1
        if self.seen == 1 and role == "system":
            self.system = turn
        self.fresh.append(turn)
        self.prefix.append(self.prefix[-1] + turn[2])
        while self.prefix[-1] > self.budget and len(self.fresh) > 1:
            yield self.emit()

    def emit(self) -> tuple:
        head = [self.system] if self.system and self.window else []
        room = self.budget - sum(t[2] for t in head)
        sums, past = [0], []
        for t in reversed(self.history[-self.history_turns :] if self.history_turns else []):
            sums.append(sums[-1] + t[2])
            past.append(t)
        # no more history than leaves room for the first new turn
        kept = bisect_right(sums, max(0, min(self.history_tokens, room - self.fresh[0][2]))) - 1
        past = past[:kept][::-1]
        room -= sum(t[2] for t in past)
        n = max(1, bisect_right(self.prefix, room) - 1)
        new, self.fresh = self.fresh[:n], self.fresh[n:]
        base = self.prefix[n]
        self.prefix = [p - base for p in self.prefix[n:]]
        keep = new if self.window or not self.system else new[1:]
        self.history = (self.history + keep)[-max(1, self.history_turns) :]
        out, at, loss = [], 0, []
        for k, (role, text, _) in enumerate([*head, *past, *new]):
            lead, body = written(role, text)
            if k >= len(head) + len(past) and role == "assistant":
                loss.append({"start": at + len(lead), "end": at + len(lead) + len(body)})
            out.append(lead + body + END)
            at += len(out[-1])
        self.window += 1
        return self.window - 1, "".join(out), loss, len(head) + len(past), len(new), sum(t[2] for t in (*head, *past, *new))

    def close(self) -> Iterator[tuple]:
        while self.fresh:
            yield self.emit()


def format_windows(df: DataFrame, budget: int = 512, history_turns: int = 4, history_tokens: int = 128, path: str | None = None) -> DataFrame:
    """Rows of WINDOWS, sorted by conversation and window inside each partition.

    loss: character spans of the formatted text that carry loss; repeated: turns at the head that earlier windows
    have already. Rows of a conversation meet in one task, as its turns have an order, but stream through it: a task
    holds one window at a time, however long the conversation is.
    """
    turns = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the session's number of shuffle partitions holds; rows with one key are in one partition
    turns = turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("repeated", pa.int32()), ("turns", pa.int32()), ("tokens", pa.int64())])
        current, windower, rows, size = None, None, [], 0

        def table():
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))), schema=schema)

        for batch in slices(batches):
            said = list(zip(batch["role"].to_pylist(), batch["text"].to_pylist()))
            for conv, (role, text), n in zip(batch["conv_id"].to_pylist(), said, count_tokens(said, path)):
                if windower is None or conv != current:
                    if windower is not None:
                        rows += [(current, *w) for w in windower.close()]
                    current, windower = conv, Windower(budget, history_turns, history_tokens)
                for w in windower.add(role, text, n):
                    rows.append((conv, *w))
                    size += len(w[1])
                if len(rows) > 2000 or size > 8 << 20:
                    yield table()
                    rows, size = [], 0
        if windower is not None:
            rows += [(current, *w) for w in windower.close()]
        if rows:
            yield table()

    return turns.mapInArrow(windows, WINDOWS)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """DIGESTS per conversation, from the formatted windows and their masks alone; needs format_windows' row order."""

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        rows, current, state = [], None, None

        def close():
            if state is not None:
                rows.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        def table():
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=pa.schema(list(zip(names, types))))

        for batch in batches:
            for w in batch.to_pylist():
                if state is None or w["window"] == 0:
                    close()
                    current, state = w["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse(w["formatted"])[w["repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in w["loss"]:
                    text = unescape(w["formatted"][span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(w["formatted"])
                state[5] += 1
            if len(rows) > 2000:
                yield table()
                rows = []
        close()
        if rows:
            yield table()

    return windows.mapInArrow(digests, DIGESTS)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_windows(turns.unionByName(extra)))


QUERIES = {"op7_chat_format": op7_chat_format}
ORACLES: dict[str, str] = {}
