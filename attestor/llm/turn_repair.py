"""Repair of the order of conversations by weighted CYK parsing.

Wanted is the cheapest list of edits after which the initials of the roles read `(s?(ua)+)?`; of equally cheap ones the
list whose initials come first in ASCII.

Grammar, in Chomsky normal form: a nonterminal <p, q> stands for the spans that lead from state p of that pattern to
state q. Rules: <p, q> -> <p, r> <r, q>; <p, q> -> one row, edited; and empty spans, which lead from p to q by inserted
turns alone (the insertion closure, put around each row). A cell holds for each nonterminal the least (cost, audit).

A span's cell is the same whichever place it is split at, since every <p, r> <r, q> is a rule. So one split of a span is
enough, and the chart needs only spans that double in length: n cells instead of n * n, combined bottom-up by length. Of
two audits of one cell of equal cost neither is a prefix of the other (they edit the same rows, and what one has more are
paid insertions), so the least audit of a span is made of the least audits of its parts.

On Spark: rows are sorted by range, so a conversation of any length is dealt over tasks; each task parses its pieces of
conversations to one cell each, pieces are combined in order for each conversation, and the repaired rows stream through
the digest in order. That digest is one sequence, so the rows of one conversation pass one task there, in memory that
holds its audit (a byte a row) but none of its texts.

Defined results: a null text or role is one space, as is a null turn in the key of the damage; null turns come first,
rows of one turn are sorted by role and text; repeated rows are rows like others, so duplicates; a null conv_id is a
conversation of its own; a conversation without rows after the damage has zeros, an empty audit and the digest of the
empty string; an empty role has no initial; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import map_arrow, materialize, record_batch, shared_dir

#: States of the pattern: nothing yet, after s, after u, after a. From each, the state to which an initial leads.
START, SYSTEM, USER, ANSWER = range(4)
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ANSWER}, ANSWER: {"u": USER}}
ENDS = (START, ANSWER)
#: Costs of the edits; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
ROLES = {"u": "user", "a": "assistant"}

Cell = dict[tuple[int, int], tuple[int, str]]


def _better(cell: Cell, key: tuple[int, int], found: tuple[int, str]) -> None:
    if key not in cell or found < cell[key]:
        cell[key] = found


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two spans that follow each other."""
    out: Cell = {}
    starts: dict[int, list[tuple[int, tuple[int, str]]]] = {}
    for (r, q), found in right.items():
        starts.setdefault(r, []).append((q, found))
    for (p, r), (cost, audit) in left.items():
        for q, (more, rest) in starts.get(r, ()):
            key, total = (p, q), cost + more
            if key not in out or total < out[key][0] or (total == out[key][0] and audit + rest < out[key][1]):
                out[key] = (total, audit + rest)
    return out


def closure() -> Cell:
    """The cell of an empty span: insertions alone, each path of states taken as far as it gets somewhere new."""
    cell: Cell = {(p, p): (0, "") for p in STEPS}
    one: Cell = {(p, q): (INSERT, "I") for p, to in STEPS.items() for initial, q in to.items() if initial in ROLES}
    for _ in STEPS:
        for key, found in combine(cell, one).items():
            _better(cell, key, found)
    return cell


EMPTY = closure()


def row_cell(initial: str, fault: str) -> Cell:
    """The cell of one row. fault: "blank", "duplicate", "truncated" or ""."""
    own: Cell = {(p, p): (DELETE, "D") for p in STEPS}
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        for p, to in STEPS.items():
            for letter, q in to.items():
                if letter == initial:
                    _better(own, (p, q), (extra, "K"))
                if letter in ROLES:
                    _better(own, (p, q), (extra + REROLE, "R"))
    return combine(combine(EMPTY, own), EMPTY)


class Chart:
    """Cells of spans that double in length, as rows come in order: the spans of a chart of n rows are those of the
    binary digits of n."""

    def __init__(self):
        self.spans: list[tuple[int, Cell]] = []

    def add(self, cell: Cell, length: int = 1) -> None:
        self.spans.append((length, cell))
        while len(self.spans) > 1 and self.spans[-2][0] <= self.spans[-1][0]:
            (n, left), (m, right) = self.spans[-2:]
            self.spans[-2:] = [(n + m, combine(left, right))]

    def whole(self) -> Cell:
        """The cell of all rows."""
        cell = None
        for _, left in reversed(self.spans):
            cell = left if cell is None else combine(left, cell)
        return EMPTY if cell is None else cell


def best(cell: Cell) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(cell[START, q] for q in ENDS if (START, q) in cell)


def packed(cell: Cell) -> str:
    return json.dumps([[p, q, cost, audit] for (p, q), (cost, audit) in cell.items()])


def unpacked(text: str) -> Cell:
    return {(p, q): (cost, audit) for p, q, cost, audit in json.loads(text)}


class Repaired:
    """The repaired turns of a conversation, made from its rows in order and its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _turn(self, initial: str) -> None:
        self.state = STEPS[self.state][initial]

    def _next(self) -> str:
        (initial,) = (x for x in STEPS[self.state] if x in ROLES)  # one initial only can be inserted or given in any state
        self._turn(initial)
        return ROLES[initial]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._next(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The turns that stand for the next row, after what is inserted before it."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._turn(role[:1])
            yield role, text
        elif edit == "R":
            yield self._next(), text


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that each row's key decides."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


#: The rows of a conversation in order.
ORDER = ["conv_id", "dated", "turn", "role", "text", "copy"]


def faults(rows: DataFrame) -> DataFrame:
    """The rows of damaged() with the place among equal rows (copy) and each one's first fault. Equal rows are counted
    before anything is joined, so that a text repeated any number of times is one row of the join."""
    said = ["role", "text"]
    counted = rows.groupBy("conv_id", "turn", *said).agg(F.sum("copies").alias("copies")).withColumn("dated", F.col("turn").isNotNull())
    # role and text by digest, so that the shuffle of first uses carries no texts
    counted = counted.withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    first = counted.groupBy(F.col("conv_id").alias("of"), F.col("said").alias("what")).agg(F.min(F.struct("dated", "turn")).alias("first"))
    joined = counted.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("what")))
    earlier = ~(F.struct("dated", "turn").eqNullSafe(F.col("first")))
    listed = joined.select("conv_id", "dated", "turn", *said, earlier.alias("earlier"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    fault = (
        F.when(trimmed == "", "blank")
        .when(F.col("earlier") | (F.col("copy") > 1), "duplicate")
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    return listed.select(*ORDER, fault.alias("fault"))


_PIECE = "conv_id long, piece long, length long, blank long, duplicate long, truncated long, illegal long, first string, last string, cell string"
_PIECE_TYPES = [pa.int64()] * 7 + [pa.string()] * 3
_NAMES = [c.split()[0] for c in _PIECE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return record_batch(**{n: pa.array(c, t) for n, c, t in zip(_NAMES, zip(*rows, strict=True), _PIECE_TYPES, strict=True)})


class _Piece:
    """What is known of a stretch of one conversation's rows: counts, its first and last initials, its chart."""

    def __init__(self):
        self.chart, self.length, self.illegal = Chart(), 0, 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = None

    def join(self, cell: Cell, length: int, counts: dict[str, int], illegal: int, first: str, last: str) -> None:
        if self.length:
            illegal += (self.last, first) not in LEGAL
        else:
            self.first = first
        self.last, self.length, self.illegal = last, self.length + length, self.illegal + illegal
        for name, n in counts.items():
            self.counts[name] += n
        self.chart.add(cell, length)

    def out(self, conv_id: int | None, piece: int) -> tuple:
        return conv_id, piece, self.length, *self.counts.values(), self.illegal, self.first, self.last, packed(self.chart.whole())


def pieces(rows: DataFrame) -> DataFrame:
    """One row for each stretch of a conversation that a task has read."""
    dealt = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("conv_id", F.substring("role", 1, 1).alias("initial"), "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = TaskContext.get().partitionId(), {}
        now, piece = None, None
        for batch in batches:
            done = []
            for conv_id, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece is None or conv_id != now:
                    if piece:
                        done.append(piece.out(now, number))
                    now, piece = conv_id, _Piece()
                if (initial, fault) not in known:
                    known[initial, fault] = row_cell(initial, fault)
                piece.join(known[initial, fault], 1, {fault: 1} if fault else {}, 0, initial, initial)
                if len(known) > 10_000:  # initials are any characters
                    known.clear()
            if done:
                yield _batch(done)
        if piece:
            yield _batch([piece.out(now, number)])

    return map_arrow(dealt, run, _PIECE)


def combined(parts: DataFrame) -> DataFrame:
    """One row for each conversation: counts, cost and audit."""
    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole = None, None

        def line() -> tuple:
            return now, *whole.counts.values(), whole.illegal, *best(whole.chart.whole())

        def out(rows: list[tuple]) -> pa.RecordBatch:
            names = ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
            kinds = [pa.int64()] * 6 + [pa.string()]
            return record_batch(**{n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})

        for batch in batches:
            done = []
            for conv_id, _, length, blank, duplicate, truncated, illegal, first, last, cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if whole is None or conv_id != now:
                    if whole:
                        done.append(line())
                    now, whole = conv_id, _Piece()
                whole.join(unpacked(cell), length, {"blank": blank, "duplicate": duplicate, "truncated": truncated}, illegal, first, last)
            if done:
                yield out(done)
        if whole:
            yield out([line()])

    return map_arrow(dealt, run, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def digests(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the repaired `role:text` lines of each conversation, streamed in order behind its audit."""
    nothing = {"dated": "boolean", "turn": "long", "role": "string", "text": "string", "copy": "long"}
    heads = parsed.select("conv_id", F.lit(0).alias("part"), *(F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()), "audit")
    lines = rows.select("conv_id", F.lit(1).alias("part"), *nothing, F.lit(None).cast("string").alias("audit"))
    dealt = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER[1:]).select("conv_id", "part", "role", "text", "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, repaired, sha, any_yet = None, None, None, False

        def put(turns: Iterator[tuple[str, str]]) -> None:
            nonlocal any_yet
            for role, text in turns:
                sha.update((f"\n{role}:{text}" if any_yet else f"{role}:{text}").encode())
                any_yet = True

        def last() -> tuple:
            put(repaired.inserted())
            return now, sha.hexdigest()

        def out(done: list[tuple]) -> pa.RecordBatch:
            ids, shas = zip(*done, strict=True)
            return record_batch(conv_id=pa.array(ids, pa.int64()), repaired_sha256=pa.array(shas, pa.string()))

        for batch in batches:
            done = []
            for conv_id, part, role, text, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    if repaired:
                        done.append(last())
                    now, repaired, sha, any_yet = conv_id, Repaired(audit), hashlib.sha256(), False
                else:
                    put(repaired.row(role, text))
            if done:
                yield out(done)
        if repaired:
            yield out([last()])

    return map_arrow(dealt, run, "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of turns (conv_id, turn, role, text): gaps, the faults after the damage, the cheapest
    repair and the digest of the repaired turns."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    folder = shared_dir(turns.sparkSession)
    hurt = damaged(turns)
    rows = materialize(faults(hurt), folder, "rows")
    parsed = materialize(combined(pieces(rows)), folder, "parsed")
    turned = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    gaps = turned.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    every = turns.select("conv_id").distinct()
    out = every
    for part in (gaps, parsed, digests(rows, parsed)):
        named = part.withColumnRenamed("conv_id", "of")
        out = out.join(named, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
