from pyspark.sql import functions as F

from attestor.llm.labelled import labelled_sample


def test_repeated_ids_count_once_in_a_sample(spark):
    docs = spark.createDataFrame([(1, "hot")] * 50 + [(k, f"text {k}") for k in range(2, 8)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 20 + [(k, k % 2) for k in range(2, 8)], "doc_id long, good int")
    rows = labelled_sample(docs, labels, "good", F.lit(True), 5).collect()
    assert len(rows) == 5 == len({r.doc_id for r in rows})
    assert len(labelled_sample(docs, labels, "good", F.lit(True), 100).collect()) == 7


def test_a_hot_id_is_one_row(spark):
    docs = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, good int")
    assert [tuple(r) for r in labelled_sample(docs, labels, "good", F.lit(True), 10).collect()] == [(1, "t0", 1)]


def test_the_cap_counts_rows_that_the_sample_can_use(spark):
    docs = spark.createDataFrame([(k, "long " * 100 if k % 2 else "short") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(60)] + [(None, 1), (3, None), (4, 7)], "doc_id long, good int")  # 20 have no document
    rows = labelled_sample(docs, labels, "good", F.lit(True), 18, most_bytes=50).collect()
    assert len(rows) == 18 and {r.text for r in rows} == {"short"}
    assert labelled_sample(docs.limit(0), labels, "good", F.lit(True), 5).count() == labelled_sample(docs, labels.limit(0), "good", F.lit(True), 5).count() == 0
