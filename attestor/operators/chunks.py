"""Cutting long texts: sentence-aligned chunks with overlap, and fixed windows with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.session import ship_package

_SENTENCE = re.compile(r"[^.!?…]+(?:[.!?…]+|$)")
_HEADING = re.compile(r"^#{1,6}\s+(.*)$")


def sentence_tail(text: str, most: int) -> str:
    """The last whole sentences of at most `most` characters; empty if not even one fits."""
    kept: list[str] = []
    for s in reversed([m.strip() for m in _SENTENCE.findall(text) if m.strip()]):
        if len(s) + sum(map(len, kept)) + len(kept) > most:
            break
        kept.insert(0, s)
    tail = " ".join(kept)
    return "" if tail == text.strip() else tail


def cut(text: str, size: int, overlap: int) -> list[tuple[str, str]]:
    """(section, chunk) in order. Headings set the section; sentences are gathered up to `size` characters; a chunk
    begins with the tail of the one before; a sentence longer than `size` is a chunk of its own; repeats of the
    previous chunk are dropped."""
    out: list[tuple[str, str]] = []
    section, now, fresh = "", "", False

    def flush() -> None:
        nonlocal now, fresh
        if fresh and now and (not out or out[-1] != (section, now)):
            out.append((section, now))
        now, fresh = sentence_tail(now, overlap) if fresh else now, False

    for line in text.split("\n"):
        heading = _HEADING.match(line)
        if heading:
            flush()
            section, now = heading[1].strip(), ""
            continue
        for sentence in (m.strip() for m in _SENTENCE.findall(line)):
            if not sentence:
                continue
            if now and len(now) + 1 + len(sentence) > size:
                flush()
                if len(now) + 1 + len(sentence) > size:
                    now = ""
            now, fresh = f"{now} {sentence}".strip(), True
    flush()
    return out


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1100, overlap: int = 180) -> DataFrame:
    """(id, pos, section, chunk): each document on its own; a document is read whole, all others in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, s, c) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, (s, c) in enumerate(cut(t or "", size, overlap))]
            ids, pos, sections, texts = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(pos, pa.int32()), pa.array(sections, pa.string()), pa.array(texts, pa.string())], names=[id_col, "pos", "section", "chunk"])

    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, pos int, section string, chunk string")


def windows(docs: DataFrame, id_col: str, text_col: str, size: int = 18000, overlap: int = 700) -> DataFrame:
    """(id, pos, start, text): windows of `size` characters, cut after the last sentence end in their second half if
    there is one, the next one beginning `overlap` (a quarter of size at most) before the cut. Built from expressions:
    the starts are a fold over a bounded number of steps for each text."""
    back = min(overlap, size // 4)
    text, length = F.col(text_col), F.length(text_col)
    half = size // 2

    def end_of(start):
        piece = F.substring(text, start + 1, F.lit(size))
        tail = F.substring(piece, F.lit(half + 1), F.lit(size))
        last = F.length(F.regexp_extract(tail, r"(?s)^(.*[.!?;]\s)", 1))
        return F.when(start + size >= length, length).otherwise(start + F.when(last > 0, half + last).otherwise(F.lit(size)))

    first = F.array(F.struct(F.lit(0).alias("start"), end_of(F.lit(0)).cast("int").alias("end")))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(length / (half - back)).cast("int")))

    def step(acc, _):
        last = F.element_at(acc, -1)
        start = F.greatest(last["end"] - back, last["start"] + 1)
        return F.when(last["end"] >= length, acc).otherwise(F.array_append(acc, F.struct(start.cast("int").alias("start"), end_of(start).cast("int").alias("end"))))

    cuts = docs.where(length > 0).select(id_col, text_col, F.posexplode(F.aggregate(steps, first, step)).alias("pos", "w"))
    return cuts.select(id_col, "pos", F.col("w.start").alias("start"), F.substring(text, F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("window"))
