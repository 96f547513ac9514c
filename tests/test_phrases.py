"""Phrases are looked for by their own anchors, in texts that hold these."""

from attestor.operators import terms


def test_each_phrase_of_an_id_has_its_own_anchor(spark):
    texts = spark.createDataFrame([(1, "Un alpha beta, deux"), (2, "trois gamma delta"), (3, "alpha gamma"), (4, None), (5, "alpha-beta")], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, "alpha beta"), (1, "gamma delta"), (2, "deux"), (3, ""), (4, "absent"), (5, None)], "item_id long, text string")
    assert sorted(tuple(r) for r in terms.phrase_pairs(texts, phrases, "doc_id", "item_id").collect()) == [(1, 1), (1, 2), (1, 5), (2, 1)]
