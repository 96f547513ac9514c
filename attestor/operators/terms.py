"""Term statistics and term joins: the inverted index that retrieval and detection stand on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.session import ship_package, spread, written


def term_counts(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf): each distinct token of each text with its count. Stop words are none."""
    words = docs.select(id_col, F.explode(T.words(text)).alias("term"))
    return words.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def counts_in_rows(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, length, term, tf): term_counts and the number of words of each row. A row's words are counted where they are cut,
    so nothing is shuffled or held beyond a batch; rows that share an id are counted apart."""
    kind = docs.schema[id_col].dataType.simpleString()
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            sizes = np.asarray(words.value_lengths().fill_null(0)).astype(np.int64)
            coded = words.flatten().dictionary_encode()
            if not len(coded):
                continue
            width = len(coded.dictionary)
            pairs, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + np.asarray(coded.indices), return_counts=True)
            row = pa.array(pairs // width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(sizes).take(row), coded.dictionary.take(pa.array(pairs % width)), pa.array(counts)], names=[id_col, "length", "term", "tf"])

    return docs.select(id_col, T.words(text).alias("words")).mapInArrow(run, f"{id_col} {kind}, length long, term string, tf long")


def document_frequency(terms: DataFrame, id_col: str) -> DataFrame:
    """(term, df) of term_counts: its rows are distinct already, so a plain count does."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def deletion_keys(word: Column) -> Column:
    """The word and all its forms with one letter left out: words at one edit or swap share a key."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.array_append(shorter, word))


def fuzzy_pairs(words: DataFrame, col: str = "term") -> DataFrame:
    """Pairs (a, b), a < b, of distinct words of at least five letters at one edit or swap, by an equi-join on
    deletion keys and an exact check."""
    keyed = words.select(F.col(col).alias("word")).where(F.length("word") >= 5).distinct().select("word", F.explode(deletion_keys(F.col("word"))).alias("key"))
    pairs = keyed.withColumnRenamed("word", "a").join(keyed.withColumnRenamed("word", "b"), "key").where("a < b").select("a", "b").distinct()
    return pairs.where(T.edit_or_swap(F.col("a"), F.col("b")))


def phrase_pairs(texts: DataFrame, phrases: DataFrame, text_id: str, phrase_id: str, least_words: int = 3) -> DataFrame:
    """(phrase_id, text_id) where the normalised phrase is contained at word borders. The rarest word of a phrase is
    its anchor: an equi-join on anchors replaces the nested loop. Phrases shorter than least_words words are anchored
    like others; empty ones match nothing.

    Texts are cut once, and only words of phrases are kept; the phrases are looked for only in texts that hold an anchor."""
    p = phrases.select(phrase_id, T.norm(F.col("text")).alias("phrase")).where("phrase <> ''")
    inside = p.select(phrase_id, "phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word"))
    cut = spread(texts.select(text_id, "text")).select(text_id, F.explode(F.array_distinct(F.split(T.norm(F.col("text")), " "))).alias("word"))
    index = written(cut.join(inside.select("word").distinct(), "word", "left_semi"))
    frequency = index.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    anchors = inside.join(frequency, "word", "left").groupBy(phrase_id, "phrase").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    candidates = written(index.join(anchors, "word").select(phrase_id, "phrase", text_id).distinct())
    likely = texts.select(text_id, "text").join(candidates.select(text_id).distinct(), text_id, "left_semi").select(text_id, T.norm(F.col("text")).alias("body"))
    return candidates.join(likely, text_id).where(T.contains_phrase(F.col("body"), F.col("phrase"))).select(phrase_id, text_id)


def quote_pairs(texts: DataFrame, quotes: DataFrame, text_id: str, quote_id: str, most_words: int | None = None) -> DataFrame:
    """(quote_id, text_id) where a quote occurs verbatim but for white space and case. The rarest inner word is the
    anchor (the outer two may be parts of words); quotes of fewer than three words are compared through their longest
    word's presence inside any word only if they are whole words. most_words leaves out longer quotes."""
    flat = lambda c: F.lower(T.compact(c))
    t = texts.select(text_id, flat(F.col("text")).alias("body"))
    q = quotes.select(quote_id, flat(F.col("text")).alias("quote")).where("quote <> ''")
    if most_words is not None:
        q = q.where(F.size(F.split("quote", " ")) <= most_words)
    index = t.select(text_id, F.explode(F.array_distinct(F.split("body", " "))).alias("word"))
    frequency = index.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    inner = F.split("quote", " ")
    inner = F.when(F.size(inner) >= 3, F.slice(inner, 2, F.size(inner) - 2)).otherwise(inner)
    anchors = (
        q.select(quote_id, F.explode(F.array_distinct(inner)).alias("word"))
        .join(frequency, "word", "left")
        .groupBy(quote_id)
        .agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    )
    candidates = anchors.join(index, "word").select(quote_id, text_id)
    return candidates.join(q, quote_id).join(t, text_id).where(F.contains(F.col("body"), F.col("quote"))).select(quote_id, text_id)
