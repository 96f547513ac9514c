"""The training-data pipeline: stages over the whole documents table, each a Spark job over what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm import bpe_codec, mixing, near_dup, quality_cnn, toxicity
from attestor.llm.common import free_name, materialize, shared_dir, table

#: Scores at which a document counts as good, and as toxic.
LEAST_QUALITY, LEAST_TOXICITY = 0.3, 0.3
#: Token shares of the mixture.
TARGETS = {"en": 0.5, "fr": 0.2, "de": 0.15, "es": 0.15}


# Every stage: an empty table gives an empty one; texts of any length are read whole; columns that documents has beyond
# its usual ones are kept as they are (by all stages but the last), whatever their names.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts are scored like others, repeated rows
    alike; rows without a doc_id are scored too, but never learned from."""
    network, score = quality_cnn.fit(docs, table(spark, sf_dir, "labels")), free_name(docs, "score")
    return quality_cnn.scored(docs, network, score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. Null and empty texts have no features and are scored like
    others, repeated rows alike; rows without a doc_id are scored too, but never learned from."""
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), free_name(docs, "score")
    return toxicity.scored(docs, model, score).where(F.col(score) < LEAST_TOXICITY).drop(score)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest doc_id,
    once. Of repeated rows of that doc_id, one stays: that of the smallest text (null before all others). Null and empty
    texts are near nothing and stay, as do rows without a doc_id."""
    kept = near_dup.near_duplicates(docs, size=5, threshold=80).where("kept and doc_id is not null").select("doc_id").distinct()
    place = free_name(docs, "place")
    first = Window.partitionBy("doc_id").orderBy("text")
    rows = docs.where("doc_id is not null").join(kept.hint("merge"), "doc_id", "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return rows.unionByName(docs.where("doc_id is null"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the expected token totals of the languages meet TARGETS. A null or another
    language teaches the classifier nothing; null and empty texts have no tokens and the rate of an empty text; rows of
    one doc_id have the same copies."""
    return mixing.mixed(docs, docs.select("doc_id", F.col("lang").alias("domain")), TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The identifiers of each whole text, and whether they decode to it. A null text counts as empty; each row is
    encoded for itself, repeated ones too."""
    coded = bpe_codec.encoded(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), ids_col="token_ids", decoded_col="decoded")
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", clean),
    ("near_duplicates", distinct),
    ("mixing", mixture),
    ("bpe", encode),
]

#: The classifiers and the tokeniser can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, folder, name)
    return docs
