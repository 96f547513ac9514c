"""The term index is counted row by row: only statistics of terms and lengths are shuffled."""

from pyspark.sql import functions as F

from attestor.operators import retrieval as R
from attestor.operators import terms


def plans_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_counts_need_no_shuffle_and_equal_grouped_ones(spark):
    docs = spark.createDataFrame([(1, "chats chat chien 2 000"), (2, None), (3, ""), (4, "chien"), (5, "a de la")], "doc_id long, text string")
    rows = terms.counts_in_rows(docs, "doc_id", F.col("text"))
    assert "Exchange" not in plans_of(rows)
    assert {(r.doc_id, r.term, r.tf) for r in rows.collect()} == {tuple(r) for r in terms.term_counts(docs, "doc_id", F.col("text")).collect()}
    assert {(r.doc_id, r.length) for r in rows.collect()} == {(1, 4), (4, 1)}


def test_postings_are_neither_shuffled_nor_joined_with_lengths(spark):
    index = R.build_index(spark.createDataFrame([(1, "un deux deux"), (2, "deux")], "doc_id long, text string"))
    plan = plans_of(index.terms)
    assert "Join" not in plan and "hashpartitioning" not in plan
    assert {(r.doc_id, r.term, r.tf) for r in index.terms.collect()} == {(1, "deux", 2), (2, "deux", 1)}
    assert {(r.doc_id, r.length) for r in index.lengths.collect()} == {(1, 2), (2, 1)}


def test_rows_that_share_an_id_are_one_text(spark):
    index = R.build_index(spark.createDataFrame([(1, "trois quatre"), (1, "quatre cinq"), (2, "cinq")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.term, r.tf) for r in index.terms.collect()) == [(1, "cinq", 1), (1, "quatre", 2), (1, "trois", 1), (2, "cinq", 1)]
    assert {r.term: r.df for r in index.df.collect()} == {"cinq": 2, "quatre": 1, "trois": 1}
    assert {(r.doc_id, r.length) for r in index.lengths.collect()} == {(1, 4), (2, 1)}
