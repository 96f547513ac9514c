"""Groups, caps and few hits within blocks: what scoring every pair and cutting afterwards gives."""

import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import detect
from attestor.operators import retrieval as R
from attestor.plans import gate_queries, retrieval_queries


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(21)
    words = [f"mot{k:02d}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = [(d, " ".join(rng.choices(words, weights, k=rng.randint(3, 40))), rng.choice(["a", "b", "c", None])) for d in range(200)]
    rows += [(1000 + d, rows[d % 4][1], rng.choice(["a", "b"])) for d in range(60)]  # copies
    rows += [(5, rows[7][1], "a"), (2000, None, "a"), (None, rows[0][1], "b")]  # one id twice, no text, no id
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    asked = [(q, " ".join(rng.choices(words, weights, k=rng.randint(1, 14)))) for q in range(40)] + [(100, rows[0][1]), (101, ""), (102, "inconnu")]
    questions = spark.createDataFrame(asked, "item_id long, text string")
    return docs, R.build_index(docs), R.question_terms(questions).cache()


def _rows(df):
    return {(r.item_id, r["rank"], r.doc_id): round(r.score, 5) for r in df.collect()}


def _no_pairs(monkeypatch):
    def shuffled(*_):
        raise AssertionError("pairs are shuffled")

    monkeypatch.setattr(R, "bm25", shuffled)


@pytest.mark.parametrize("held", [5, 1_000_000])
def test_limits_within_blocks(corpus, monkeypatch, held):
    docs, index, asked = corpus
    want = _rows(R.diversified(R.bm25(index, asked), docs))
    monkeypatch.setattr(R, "HELD_ROWS", held)
    _no_pairs(monkeypatch)
    assert _rows(R.diverse_best(index, asked, docs)) == want and len(want) > 200


def test_groups_within_blocks(corpus, monkeypatch):
    docs, index, asked = corpus
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(q, g) for q in range(0, 30, 2) for g in (q % 5, 7)] + [(1, 99), (100, 3)], "item_id long, group int")
    groups = docs.where("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("group")).distinct()
    scored = R.bm25(index, asked).where("doc_id is not null")
    free = scored.join(wanted, "item_id", "left_anti")
    held = scored.join(wanted, "item_id").join(groups, ["doc_id", "group"], "left_semi").drop("group").distinct()
    want = _rows(R.top(free.unionByName(held.select(free.columns)), 5))
    _no_pairs(monkeypatch)
    assert _rows(R.best_of(index, asked, wanted, groups, 5)) == want
    assert not any(q == 1 for q, *_ in want) and len(want) > 100


def _tables(spark, folder):
    docs = [(k, f"Of the vert bleu{k % 4} rouge vert.", f"s{k % 2}") for k in range(12)] + [(20, "Vert rouge bleu1 jaune", "s9"), (21, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "of the vert jaune"), (2, "vert jaune"), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0,), (1,)], "n_nationkey int").write.parquet(f"{folder}/nation.parquet")


def test_an_entity_bars_texts_that_would_be_better(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path)
    _no_pairs(monkeypatch)
    rows = sorted((r.item_id, r["rank"], r.doc_id) for r in gate_queries.bm25_entity(spark, str(tmp_path)).collect())
    assert [r for r in rows if r[0] == 1] == [(1, k + 1, k) for k in range(5)] and (2, 1, 20) in rows


def test_the_query_of_limits_shuffles_no_pairs(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path)
    _no_pairs(monkeypatch)
    rows = retrieval_queries.diversified_topk(spark, str(tmp_path)).where("item_id = 1").collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3, 4, 5, 6, 7, 20} and len(rows) == 9


@pytest.mark.parametrize("rare", [1, 3, 100])
def test_places_of_held_terms_are_told(corpus, monkeypatch, rare):
    monkeypatch.setattr(R, "RARE_HITS", rare)
    docs, index, asked = corpus
    numbered = asked.withColumn("place", F.when(F.col("term") != "mot00", (F.crc32("term") % 1000).cast("int")))
    rows = R.top(R.gated_best(index, numbered, 4), 4).where("doc_id is not null").collect()
    want = _rows(R.top(R.gated(R.bm25(index, asked), asked).where("doc_id is not null"), 4))
    assert {(r.item_id, r["rank"], r.doc_id): round(r.score, 5) for r in rows} == want
    terms, numbers = {}, {}
    for r in index.terms.collect():
        terms.setdefault(r.doc_id, set()).add(r.term)
    for r in numbered.where("place is not null").collect():
        numbers.setdefault(r.item_id, {})[r.term] = r.place
    assert all(sorted(r.held) == sorted(p for t, p in numbers[r.item_id].items() if t in terms[r.doc_id]) for r in rows)


def test_words_and_pairs_of_the_ontology_are_no_rows(corpus, monkeypatch):
    docs, _, _ = corpus
    seen, real = [], detect.written
    monkeypatch.setattr(detect, "written", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    detect.derived_ontology(docs.withColumn("lang", F.lit("fr"))).collect()
    assert not any("Generate explode" in plan for plan in seen)
