"""Texts scored in blocks against all questions give what scoring every pair gives, and no pair is shuffled."""

import random

import numpy as np
import pytest

from attestor.operators import retrieval as R


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    words = [f"mot{k:02d}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    texts = [(d, " ".join(rng.choices(words, weights, k=rng.randint(3, 40)))) for d in range(150)]
    texts += [(1000 + d, texts[d % 3][1]) for d in range(60)]  # large groups of ties
    questions = [(f"q{q}", " ".join(rng.choices(words, weights, k=rng.randint(1, 12))) + (" inconnu" if q % 5 == 0 else "")) for q in range(40)] + [("empty", ""), ("none", "inconnu")]
    questions += [("same", texts[0][1])]
    index = R.build_index(spark.createDataFrame(texts, "doc_id long, text string"))
    return index, R.question_terms(spark.createDataFrame(questions, "item_id string, text string")).cache()


@pytest.mark.parametrize("held", [5, 1_000_000])
@pytest.mark.parametrize("k", [1, 8])
def test_best_of_blocks_equal_best_of_all_gated(corpus, monkeypatch, k, held):
    monkeypatch.setattr(R, "HELD_ROWS", held)
    index, asked = corpus
    rows = lambda df: {(r.item_id, r.rank, r.doc_id, r.hits): r.score for r in R.top(df, k).collect()}
    want, got = rows(R.gated(R.bm25(index, asked), asked)), rows(R.gated_best(index, asked, k))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_a_task_gives_no_more_than_the_best_of_its_texts(corpus):
    index, asked = corpus
    blocks = asked.sparkSession.sparkContext.defaultParallelism
    counts = R.gated_best(index, asked, 1).groupBy("item_id").count().collect()
    assert counts and all(r["count"] <= blocks for r in counts)


def test_rows_that_round_to_the_same_score_are_kept():
    item, doc, score = np.array([0, 0, 0, 0, 1]), np.array([5, 4, 3, 2, 1]), np.array([1.0000001, 1.0, 0.5, 1.0000001, 0.1])
    assert sorted(R._best_rows(item, doc, score, 1)) == [1, 3, 4]


def test_the_ontology_is_counted_without_a_join(spark):
    from attestor.operators import detect

    docs = spark.createDataFrame([(1, "fr", "a", "un deux trois deux"), (2, "fr", None, "deux trois"), (3, None, "a", None)], "doc_id long, lang string, source string, text string")
    rows = detect.derived_ontology(docs)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in rows.collect()} == {("fr", "deux"), ("fr", "trois"), ("a", "un deux"), ("a", "deux trois"), ("a", "trois deux")}


def test_best_by_rarity_equal_best_of_all(corpus):
    index, asked = corpus
    rows = lambda df: {(r.item_id, r.rank, r.doc_id): r.score for r in R.top(df, 5).collect()}
    want, got = rows(R.rarity(index, asked)), rows(R.rarity_best(index, asked, 5))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_a_whole_passage_counts_though_others_score_higher(spark, tmp_path, monkeypatch):
    from attestor.operators import retrieval
    from attestor.plans import gate_queries

    def only_blocks(*_):
        raise AssertionError("pairs are shuffled")

    monkeypatch.setattr(gate_queries.detect, "by_fields", only_blocks)
    monkeypatch.setattr(retrieval, "bm25", only_blocks)
    docs = [(k, f"Vert bleu{k} rouge vert. Bleu jaune rouge.") for k in range(8)] + [(20, "Noir blanc. Vert rouge bleu jaune"), (21, "jaune")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "vert rouge bleu jaune"), (2, "inconnu"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = sorted((r.item_id, r.rank, r.doc_id) for r in gate_queries.rank_fields(spark, str(tmp_path)).collect())
    assert rows == [(1, 1, 20), (1, 2, 0), (1, 3, 1), (1, 4, 2), (1, 5, 3)]
