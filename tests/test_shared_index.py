"""Queries on concepts read the kept index: texts aren't cut into terms once more."""

import pytest

from attestor.operators import terms
from attestor.plans import dedupe_queries


@pytest.mark.parametrize("name", ["suggest_pairs", "concept_tag", "ontology_coverage"])
def test_concepts_come_from_the_index(spark, tmp_path, monkeypatch, name):
    def cut(*_):
        raise AssertionError("texts are cut again")

    monkeypatch.setattr(terms, "term_counts", cut)
    docs = [(k, f"Verre{k} soleil" if k % 2 else "Soleil jardin jardin", f"s{k % 3}") for k in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "Un jardin")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {tuple(r) for r in dedupe_queries.registry.queries[name](spark, str(tmp_path)).collect()}
    tags = {(k, "soleil") for k in range(6)} | {(k, "jardin") for k in (0, 2, 4)}
    assert rows == {"suggest_pairs": {(f"s{k}", "soleil") for k in range(3)}, "concept_tag": tags, "ontology_coverage": {(6, 6)}}[name]
