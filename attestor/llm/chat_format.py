"""Chat formatting by a grammar round trip.

`rendered(turns)` renders each turn, reads the rendered text back with a deterministic parser and compares the turn it
recovers with the source; content that conflicts with the grammar is escaped one level further until both are
identical. `digests(turns)` puts the rendered turns of each conversation together in order and reads everything back
from that output.

Grammar: turn = START role [ESCAPED] "\n" body END "\n". The parser takes START, the role up to the first "\n", and the
body up to the first END. At level 0 role and body stand as they are. At level 1 the header carries the ESCAPED mark,
and in role and body a backslash is written "\\\\", "<|" is written "<\\|" and in the role a newline is written "\\n".
Escaped content holds no "<|" but those of the grammar, so level 1 always round-trips.

Defined results: null texts and roles count as empty; rows are ordered by turn (nulls first), and those of one
turn by their rendered text; repeated rows all count; texts of any length are read whole; a null conversation id is a conversation of its own; an empty table gives an empty result;
other columns are ignored. A conversation may hold any share of all rows: rendering, checking and escaping are done row
by row before the shuffle, and what follows streams over sorted rows with a constant amount of memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import map_arrow, record_batch

START, END, ESCAPED = "<|im_start|>", "<|im_end|>", "<|escaped|>"
ASSISTANT = "assistant"


def escape(content: str) -> str:
    return content.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(content: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], content, flags=re.DOTALL)


def render_at(role: str, text: str, level: int) -> str:
    if level == 0:
        return f"{START}{role}\n{text}{END}\n"
    return f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}{ESCAPED}\n{escape(text)}{END}\n"


def parse(output: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in rendered text. Raises ValueError where the text leaves the grammar."""
    place = 0
    while place < len(output):
        head = output.find("\n", place)
        if not output.startswith(START, place) or head < 0:
            raise ValueError(f"no turn begins at {place}")
        role, end = output[place + len(START) : head], output.find(END, head)
        if end < 0 or not output.startswith("\n", end + len(END)):
            raise ValueError(f"the turn at {place} doesn't end")
        text = output[head + 1 : end]
        yield (unescape(role.removesuffix(ESCAPED)), unescape(text)) if role.endswith(ESCAPED) else (role, text)
        place = end + len(END) + 1


def render(role: str, text: str) -> tuple[str, int]:
    """The rendered turn and the level of escaping at which it reads back as it was."""
    for level in (0, 1):
        output = render_at(role, text, level)
        try:
            if list(parse(output)) == [(role, text)]:
                return output, level
        except ValueError:
            pass
    raise ValueError("a turn can't be rendered")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted (the rendered turn) and level (escaping needed) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [render(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield record_batch(conv_id=batch.column(0), turn=batch.column(1), formatted=pa.array([x for x, _ in out], pa.string()), level=pa.array([k for _, k in out], pa.int32()))

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return map_arrow(rows, run, "conv_id long, turn long, formatted string, level int")


class _Conversation:
    """What is read back of one conversation so far."""

    def __init__(self):
        self.turns = self.loss_chars = self.formatted_chars = self.escaped = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, output: str, level: int) -> None:
        self.formatted_chars += len(output)
        self.escaped += level
        for role, text in parse(output):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            if role == ASSISTANT:
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "replace"))

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.escaped


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted text: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_escaped (turns that needed escaping)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for conv, output, level in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, *state.row()))
                    now, state = conv, _Conversation()
                state.read(output, level)
            if done:
                yield _rows(done)
                done = []
        if state is not None:
            yield _rows([(now, *state.row())])

    # rows of the same turn need an order of their own, whatever it is
    ordered = rendered(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return map_arrow(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    conv, n, every, chars, loss, formatted, escaped = zip(*rows, strict=True)
    return record_batch(
        conv_id=pa.array(conv, pa.int64()), n_turns=pa.array(n, pa.int64()), turns_sha256=pa.array(every, pa.string()), loss_chars=pa.array(chars, pa.int64()), loss_sha256=pa.array(loss, pa.string()), formatted_chars=pa.array(formatted, pa.int64()), n_escaped=pa.array(escaped, pa.int64())
    )
