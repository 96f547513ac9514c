"""Quality rules: tokeniser fertility in bands per language, on top of plain word rules.

Public vocabularies tokenise every word of every whole text: a BPE with byte fallback (sentencepiece) and a byte-level
BPE (tiktoken). Of each, three measures are taken, to DIGITS decimals: characters per token, the share of byte-fallback
tokens (of the byte-level vocabulary: tokens that aren't whole characters), and token entropy in windows of WINDOW
tokens, as a share of the largest entropy that a window of its length can have, so that it doesn't depend on a text's
length. Spark takes the quartiles of each measure over all documents of a language that pass the base rules, exactly: the
measures have few values, whose counts are added up. A text is rejected where a measure leaves the fences, FENCE
interquartile ranges beyond the quartiles (MARGIN at least).

Base rules: base_failed if fewer than `least_words` words, or if more than `most_repeats` percent of the words lie in
windows of eight words that occur twice or more in the text.

Defined results: a null, empty or blank text has no words, fails the base rules and isn't kept; texts of any length are
read whole; repeated rows get the same verdict; a language is a two-letter code, everything else (null too) counts as
"und", so there are at most 677 languages; a vocabulary's unknown characters count as byte fallback; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import map_arrow, materialize, record_batch, shared_dir

WINDOW, CACHE_ENTRIES, FENCE, DIGITS = 256, 300_000, 4.0, 4
#: The least distance of a fence from its quartile, for each measure, and on which sides it has fences: a short window
#: has a large share of its largest entropy by nature, and no fallback at all is fine. A byte-level vocabulary has no
#: fallback as such: a quotation in another language alone makes a good share of tokens that aren't whole characters.
MARGIN = {"chars_per_token": 0.35, "byte_share": 0.02, "entropy": 0.05}
BYTE_LEVEL_MARGIN = 0.15
SIDES = {"chars_per_token": (-1, 1), "byte_share": (1,), "entropy": (-1,)}
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"

_VOCABULARIES: dict[str, "Vocabulary"] = {}


class Vocabulary(dict):
    """Word -> identifiers of its tokens (32-bit), filled on demand and emptied when full; which tokens are fallback."""

    def __init__(self, path: str):
        super().__init__()
        self.encode: Callable[[str], list[int]]
        if path.endswith(".model"):
            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = pieces.encode
            self.fallback = np.array([pieces.is_byte(k) or pieces.is_unknown(k) for k in range(pieces.get_piece_size())])
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            # a word begins with a space in the texts that such a vocabulary was made from
            self.encode = lambda word: model.encode_ordinary(f" {word}")
            self.fallback = np.zeros(max(ranks.values()) + 1, bool)
            self.fallback[[rank for token, rank in ranks.items() if "\ufffd" in token.decode("utf-8", "replace")]] = True

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self[word] = np.asarray(self.encode(word.decode("utf-8", "replace")), np.int32).tobytes()
        return ids

    def measures(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        """Tokens, characters per token, share of fallback tokens and entropy of a text's words."""
        ids = np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32)
        n = max(1, len(ids))
        return len(ids), round(chars / n, DIGITS), round(float(self.fallback[ids].sum()) / n, DIGITS), round(window_entropy(ids), DIGITS)


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def margins(models: list[str]) -> list[float]:
    """The least distance of a fence for each of measure_names."""
    return [m if name != "byte_share" or model.endswith(".model") else BYTE_LEVEL_MARGIN for model in models for name, m in MARGIN.items()]


def measure_names(models: list[str]) -> list[str]:
    """The columns of measures: those of the first vocabulary have plain names, further ones a number."""
    return [m if k == 0 else f"{m}_{k + 1}" for k in range(len(models)) for m in MARGIN]


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in windows of `width` (a power of two) words found twice or more."""
    if len(words) <= width:
        return 0
    numbers: dict[bytes, int] = {}
    rank = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    span = 1
    while span < width:
        pairs = rank[:-span] * (rank.max() + 1) + rank[span:]
        seen, rank = np.unique(pairs, return_inverse=True)
        if len(seen) == len(pairs):
            return 0
        span *= 2
    again = np.bincount(rank)[rank] >= 2
    edge = np.zeros(len(words) + 1, np.int64)
    places = np.flatnonzero(again)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip(WHITE)]
    return len(lines) - len(set(lines))


def window_entropy(ids: np.ndarray) -> float:
    """Mean entropy of windows of WINDOW tokens (a shorter text is one window) over the largest one possible. Where the
    windows don't end with the text, one more does, so that every token counts."""
    width = min(WINDOW, len(ids))
    if width < 2:
        return 1.0
    rows = ids[: len(ids) // width * width].reshape(-1, width)
    if len(ids) % width:
        rows = np.vstack([rows, ids[-width:]])
    rows = np.sort(rows, axis=1)
    starts = np.ones(rows.shape, bool)
    starts[:, 1:] = rows[:, 1:] != rows[:, :-1]
    first = np.flatnonzero(starts.ravel())
    runs = np.diff(np.append(first, rows.size))
    return float(np.log(width) - (runs * np.log(runs)).sum() / rows.size) / float(np.log(width))


def measured(docs: DataFrame, models: list[str]) -> DataFrame:
    """doc_id, language, the base counts, and the tokens and measures by each vocabulary of each row."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *["n_tokens" if k == 0 else f"n_tokens_{k + 1}" for k in range(len(models))])
    names = measure_names(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = [vocabulary(m) for m in models]
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "replace")
                words = raw.split()
                chars = len(text) - (len(raw) - len(raw.translate(None, WHITE))) if text else 0
                found = [v.measures(words, chars) for v in vocabularies]
                base = (len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), duplicate_lines(raw), repeated_words(words))
                out.append((*base, *[f[0] for f in found], *[v for f in found for v in f[1:]]))
            columns = list(zip(*out, strict=True)) if out else [()] * (len(counts) + len(names))
            kinds = [pa.int64()] * len(counts) + [pa.float64()] * len(names)
            yield record_batch(doc_id=batch.column(0), language=batch.column(2), **{k: pa.array(c, t) for k, c, t in zip((*counts, *names), columns, kinds, strict=True)})

    code = F.lower(F.col("lang").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.when(code.rlike("^[a-z]{2}$"), code).otherwise("und").alias("language"))
    return map_arrow(rows, run, ", ".join(["doc_id long", "language string", *[f"{c} long" for c in counts], *[f"{m} double" for m in names]]))


def base_failed(least_words: int, most_repeats: int) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def quartiles(rows: DataFrame, names: list[str]) -> DataFrame:
    """language, measure, low and high: the smallest values that at least a quarter and three quarters of a language's
    rows don't exceed. Each distinct value of a measure is one row of counts, so none of this grows with the corpus."""
    long = rows.select("language", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in names])).alias("m")).select("language", "m.*")
    counts = long.groupBy("language", "measure", "value").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("language", "measure")
    up_to, total = F.sum("n").over(by.orderBy("value")), F.sum("n").over(by)
    least = lambda share: F.min(F.when(F.col("up_to") >= share * F.col("total"), F.col("value")))
    return counts.withColumns({"up_to": up_to, "total": total}).groupBy("language", "measure").agg(least(0.25).alias("low"), least(0.75).alias("high"))


def bands(rows: DataFrame, names: list[str], least: list[float]) -> DataFrame:
    """One row for each language: the least and the largest value of each measure that is let through. least: the least
    distance of each measure's fences from its quartiles."""
    found = quartiles(rows, names).groupBy("language").pivot("measure", names).agg(F.first(F.struct("low", "high")))

    def fence(name: str, margin: float, side: int) -> Column:
        low, high = F.col(name)["low"], F.col(name)["high"]
        width = F.greatest(FENCE * (high - low), F.lit(margin))
        return low - width if side < 0 else high + width

    kinds = [*MARGIN] * (len(names) // len(MARGIN))
    sides = [(name, margin, side) for name, kind, margin in zip(names, kinds, least, strict=True) for side in SIDES[kind]]
    return found.select("language", *[fence(*s).alias(f"{'least' if s[2] < 0 else 'most'}_{s[0]}") for s in sides])


def judge(docs: DataFrame, models: list[str], least_words: int = 20, most_repeats: int = 30) -> DataFrame:
    """doc_id, base counts, base_failed, kept, language, and the tokens and measures by each vocabulary of each row."""
    names = measure_names(models)
    rows = materialize(measured(docs, models), shared_dir(docs.sparkSession), "measures").withColumn("base_failed", base_failed(least_words, most_repeats))
    # at most 677 languages, so the table of bands is small whatever the input
    limits = bands(rows.where(~F.col("base_failed")), names, margins(models))
    judged = rows.join(F.broadcast(limits), "language", "left")
    within = [F.col(c.removeprefix("least_")) >= F.col(c) if c.startswith("least_") else F.col(c.removeprefix("most_")) <= F.col(c) for c in limits.columns[1:]]
    inside = reduce(lambda a, b: a & F.coalesce(b, F.lit(True)), within, F.lit(True))
    tokens = [c for c in rows.columns if c.startswith("n_tokens")]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "language", *tokens, *names)
