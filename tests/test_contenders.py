"""Pruned ranking gives what scoring every text gives, and looks at few texts."""

from __future__ import annotations

import random

import pytest

from attestor.operators import retrieval as R


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    words = [f"mot{k:03d}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    texts = [(d, " ".join(rng.choices(words, weights, k=rng.randint(3, 120)))) for d in range(400)]
    texts += [(1000 + d, texts[d][1]) for d in range(40)]  # ties
    questions = [(q, " ".join(rng.choices(words, weights, k=rng.randint(1, 25))) + (" inconnu" if q % 5 == 0 else "")) for q in range(40)]
    questions += [(100 + q, texts[q][1]) for q in range(10)] + [(200, ""), (201, "inconnu"), (202, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return R.build_index(docs), R.question_terms(spark.createDataFrame(questions, "item_id long, text string")).cache()


@pytest.mark.parametrize("seed", [1, 60, 5000])
@pytest.mark.parametrize("k", [1, 7])
def test_best_equals_top_of_all(corpus, monkeypatch, seed, k):
    monkeypatch.setattr(R, "SEED_POSTINGS", seed)
    index, asked = corpus
    want = {(r.item_id, r.rank, r.doc_id, r.hits): r.score for r in R.top(R.bm25(index, asked), k).collect()}
    got = {(r.item_id, r.rank, r.doc_id, r.hits): r.score for r in R.best(index, asked, k).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_floor_equals_floor_of_all(corpus):
    index, asked = corpus
    key = lambda df: {(r.item_id, r.doc_id) for r in df.collect()}
    assert key(R.above_floor(R.contenders(index, asked, 1, 0.4), 0.4)) == key(R.above_floor(R.bm25(index, asked), 0.4))


def test_most_pairs_are_not_scored(corpus):
    index, asked = corpus
    passages = asked.where("item_id between 100 and 199")
    assert R.contenders(index, passages, 3).count() * 3 < R.bm25(index, passages).count()


def test_kept_index_is_built_once_and_its_key_holds_the_rules(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "un deux trois"), (2, "deux")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    read = lambda: spark.read.parquet(f"{tmp_path}/d")
    files = lambda index: sorted(index.terms.inputFiles())
    first, again = R.kept_index(read()), R.kept_index(read())
    assert files(first) == files(again) and R._rules() == R._rules()
    monkeypatch.setattr(R, "B", 0.5)
    assert files(R.kept_index(read())) != files(first)
    assert {r.term: r.df for r in R.kept_index(spark.createDataFrame([(1, "un deux")], "doc_id long, text string")).df.collect()} == {"deux": 1}


def test_a_failed_build_is_not_taken(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "quatre cinq")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    with monkeypatch.context() as m:
        m.setattr(R, "_with_impact", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            R.kept_index(docs)
    assert R.kept_index(docs).df.count() == 2
