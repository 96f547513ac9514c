"""The best texts are found in blocks, from postings of asked terms alone, and no text is shuffled to be found."""

import random
import re

from pyspark.sql import functions as F

from attestor.operators import retrieval as R
from attestor.plans import provenance_queries

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def test_best_deals_out_only_postings_of_asked_terms(spark, monkeypatch):
    docs = [(k, f"vert bleu{k} rouge autre{k % 3}") for k in range(30)] + [(None, "vert vert rouge"), (40, "rouge vert"), (41, None)]
    index = R.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = R.question_terms(spark.createDataFrame([(1, "vert rouge"), (2, "bleu7 rouge"), (3, "inconnu"), (4, None)], "item_id long, text string")).cache()
    want = sorted(tuple(r) for r in R.top(R.bm25(index, asked).where("doc_id is not null"), 4).select("item_id", "rank", "doc_id", "score", "hits").collect())
    dealt, real = [], R.block_best
    monkeypatch.setattr(R, "block_best", lambda postings, *a, **b: dealt.append(postings) or real(postings, *a, **b))
    got = sorted(tuple(r) for r in R.best(index, asked, 4).select("item_id", "rank", "doc_id", "score", "hits").collect())
    assert got == want and {r[:3] for r in got} >= {(1, 1, 40), (2, 1, 7)}
    assert {r.term for r in dealt[0].select("term").distinct().collect()} == {"vert", "rouge", "bleu7"}


def test_ranked_rows_go_to_the_texts(spark, tmp_path):
    rng = random.Random(4)
    docs = [(k, f"Un chat dort sur le mur numero {k}." + "".join(f" Mot{rng.randrange(10**9)} dit mot{rng.randrange(10**9)}." for _ in range(60))) for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    # of unknown size to Spark, as ranks over all texts are
    ranked = spark.range(10**7).where("id < 2").select(F.lit(1).alias("item_id"), F.col("id").alias("doc_id"), (F.col("id") + 1).alias("rank"))
    asked = spark.createDataFrame([(1, "chat"), (1, "mur")], "item_id int, term string")
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "16k")
    try:
        found = R.extract_sentences(ranked, spark.read.parquet(f"{tmp_path}/d"), asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(THRESHOLD, before)
    assert "BroadcastHashJoin [doc_id" in plan and not re.search(r"SortMergeJoin \[(doc_)?id", plan)
    assert [(r.place, r.doc_id) for r in found.orderBy("place").collect()] == [(1, 0), (2, 1)]


def test_cited_records_go_to_the_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    docs = [(k, " ".join(f"Mot{rng.randrange(10**9)} dit nombre {k}." for _ in range(60)), "fr", f"s{k % 4}") for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(q, docs[q][1][:60]) for q in range(40)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    plans, real, before = [], provenance_queries.written, spark.conf.get(THRESHOLD)

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(provenance_queries, "written", seen)
    spark.conf.set(THRESHOLD, "16k")
    try:
        rows = provenance_queries.evidence_depth(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(THRESHOLD, before)
    chunks = next(p for p in plans if "LeftSemi" in p)
    assert re.search(r"BroadcastHashJoin .*LeftSemi", chunks) and not re.search(r"SortMergeJoin .*LeftSemi", chunks)
    assert {(r.item_id, r.record) for r in rows if r.place == 1} == {(q, q) for q in range(40)}
    assert {r.record for r in rows if r.item_id == 7 and r.origin == "cited" and r.claim == 7} <= {6}  # 8 is a note
