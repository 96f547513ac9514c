"""Verbatim quotes of any length are found."""

from attestor.plans import text_queries as Q


def test_long_quotes_are_found_too(spark, tmp_path):
    words = [f"word{k}" for k in range(60)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:30])), (3, None)]
    quotes = [(1, " ".join(words[2:20])), (2, " ".join(words[2:21]).upper()), (3, " ".join(words[5:55])), (4, " ".join(reversed(words)))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(quotes, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted((r.item_id, r.doc_id) for r in Q.exact_quote_gate(spark, str(tmp_path)).collect())
    assert found == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]
