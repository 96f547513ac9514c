"""Token counts without identifiers: byte-pair merging over a heap and a linked list.

`count_tokens(docs, vocabulary)` counts, for every whole text, the tokens that the vocabulary's own library returns for
it without begin, end or added special tokens. Each pre-token starts as one symbol per byte; a heap holds the adjacent
pairs by (rank, position), a doubly linked list holds the symbols still alive, and the lowest pair is popped and merged
until none is left. The count is the number of initial symbols minus the number of merges; no identifier is made.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text are one token each, as
the library does by default; any length is processed whole; rows are independent, so repeated rows, ties and an empty
table need no special case; further columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import map_arrow, record_batch

#: Distinct pre-tokens whose counts one Python worker remembers.
CACHE_ENTRIES = 600_000
#: The Unicode White_Space characters, which \s stands for in the vocabulary files' patterns.
WHITE = r"\t-\r \x85\xa0  -     　"

_COUNTERS: dict[str, Callable[[str], int]] = {}


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others are numbered from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


def merge_ranks(merges: list) -> dict[tuple[str, str], int]:
    return {tuple(m) if not isinstance(m, str) else tuple(m.split(" ")): k for k, m in enumerate(merges)}


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges: len(symbols) minus the merges done."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    after, before, alive, left = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, n
    heap = [(ranks[pair], i, pair) for i in range(n - 1) if (pair := (symbols[i], symbols[i + 1])) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or (symbols[i], symbols[j]) != pair:
            continue  # one of the two was merged meanwhile
        symbols[i] += symbols[j]
        alive[j] = False
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (pair := (symbols[i], symbols[k])) in ranks:
                heapq.heappush(heap, (ranks[pair], i, pair))
        h = before[i]
        if h >= 0 and (pair := (symbols[h], symbols[i])) in ranks:
            heapq.heappush(heap, (ranks[pair], h, pair))
    return left


class _Counts(dict):
    """Pre-token -> number of tokens, filled on demand and emptied when full."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        n = self[piece] = self.count(piece)
        return n


def lower_each(text: str) -> str:
    """Lower case character by character (a capital sigma never becomes a final sigma)."""
    if "Σ" not in text:
        return text.lower()
    return "σ".join(part.lower() for part in text.split("Σ"))


def counter(path: str) -> Callable[[str], int]:
    """A function from a text to its number of tokens, for a lower-casing word-end vocabulary file."""
    if path in _COUNTERS:
        return _COUNTERS[path]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks, symbols = merge_ranks(spec["model"]["merges"]), byte_symbols()
    end = spec["model"].get("end_of_word_suffix") or ""
    split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    pieces = regex.compile(split.replace(r"[^\s", f"[^{WHITE}")).findall
    white = regex.compile(f"[{WHITE}]+")
    special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))

    def one(piece: str) -> int:
        chars = [symbols[b] for b in piece.encode("utf-8", "replace")]
        chars[-1] += end
        return merged_length(chars, ranks)

    counts = _Counts(one)

    def count(text: str) -> int:
        specials = special.findall(text) if "<|" in text else ()
        total = len(specials)
        for part in special.split(text) if specials else (text,):
            part = part if part.isascii() else unicodedata.normalize("NFC", part)
            total += sum(map(counts.__getitem__, pieces(lower_each(white.sub(" ", part)))))
        return total

    _COUNTERS[path] = count
    return count


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, UTF-8 bytes, tokens and whether the tokens exceed `limit`, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            tokens = [count(t) if t else 0 for t in texts]
            yield record_batch(
                doc_id=ids,
                n_bytes=pa.array([len(t.encode("utf-8")) if t else 0 for t in texts], pa.int64()),
                n_tokens=pa.array(tokens, pa.int64()),
                over_limit=pa.array([n > limit for n in tokens], pa.bool_()),
            )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
