"""A bounded sample of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label rows looked up for each row of a sample, since some have no document or one that is left out.
SPARE = 4


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, most_bytes: int | None = None, classes: int = 2) -> DataFrame:
    """doc_id, text and label (0 to classes - 1) of at most `rows` labelled documents, those with the smallest hash of
    doc_id, among the label rows for which `usable` (a condition on doc_id) holds. most_bytes leaves out longer texts,
    which bounds what a driver collects; it concerns the fitting only. At most SPARE * rows label rows are looked up, by
    their ids alone; the first `rows` ids that have a document are the sample, and only their texts are moved. Rows of
    one doc_id, of labels or of documents, count once (the least of them is taken), so at most `rows` rows reach the
    driver. Null ids and labels outside the classes are left out; empty tables give an empty sample; other columns are
    ignored."""
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(usable & F.col("doc_id").isNotNull() & F.col("label").between(0, classes - 1))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(*order)
        .limit(SPARE * rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if most_bytes is not None:
        texts = texts.where(F.octet_length("text") <= most_bytes)
    found = texts.select("doc_id").join(F.broadcast(chosen), "doc_id").distinct().orderBy(*order).limit(rows)
    return texts.join(F.broadcast(found), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("doc_id", "text", "label")
