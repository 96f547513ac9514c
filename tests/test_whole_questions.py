from attestor.operators import retrieval as R


def test_terms_beyond_the_twelfth_count(spark):
    words = [f"word{k:02d}" for k in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words[:5])), (2, " ".join(words[20:])), (3, " ".join(words[5:20]))], "doc_id long, text string")
    questions = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "martian", "word29"]))], "item_id long, text string")
    index = R.build_index(docs)
    asked = R.question_terms(questions)
    assert {r.item_id: r["count"] for r in asked.groupBy("item_id").count().collect()} == {1: 30, 2: 31}
    assert {(r.item_id, r.doc_id): r.hits for r in R.bm25(index, asked).collect()} == {(q, d): n for q in (1, 2) for d, n in ((1, 5), (2, 10), (3, 15))}
    assert {r.item_id: r.reason for r in R.diagnostics(questions, asked, index, R.bm25(index, asked)).collect()} == {1: "answerable", 2: "unknown_qualifier"}
