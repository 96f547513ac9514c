"""The gated retrieval on a small corpus in which every reason occurs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attestor.operators import chain
from attestor.operators import fields as P

RECORDS = [
    (1, "Nous voulons construire 5000 kilometres de pistes cyclables et un plan velo pour les villes.", "Plan velo national", "transport", "p-vert", "proposal"),
    (2, "La retraite a 60 ans pour tous les travailleurs avec une pension minimale.", "Retraite a 60 ans", "social", "c-martin", "proposal"),
    (3, "Notre document parle de la retraite et de la pension des agriculteurs en mars.", "Programme retraite", "social", "c-martin", "document"),
    (4, "Energie solaire sur tous les toits publics et renovation.", "Energie solaire", "energie", "c-durand", "proposal"),
    (5, "Jeanne Durand est candidate declaree.", "Candidature declaree", "", "c-durand", "candidate_status"),
    (6, "Le parti veut une police municipale et la securite dans les villes, sans la caisse agirc.", "Securite locale", "securite", "p-bleu", "proposal"),
    (7, "Une energie solaire et de la police.", "Energie de demain", "energie", "p-bleu", "document"),
]
ONTOLOGY = {"transport": ["velo", "pistes cyclables", "transport"], "pension": ["retraite", "pension"], "energie": ["energie solaire", "energie", "nucleaire"], "securite": ["securite", "police municipale"]}
ENTITIES = [("c-durand", "jeanne durand", "candidate", "p-vert"), ("c-durand", "durand", "candidate", "p-vert"), ("c-martin", "paul martin", "candidate", None), ("p-vert", "parti vert", "party", None), ("p-bleu", "union bleue", "party", None)]
#: Question, reason, tries, documents of its evidence.
CASES = {
    "q01": ("", "empty", 1, []),
    "q02": ("Qui ne propose pas de retraite ?", "unsupported_absence", 1, []),
    "q03": ("Quel est le meilleur plan velo ?", "unsupported_ranking", 1, []),
    "q04": ("Recette de tarte aux pommes", "out_of_scope", 1, []),
    "q05": ("retraite des zorglubs", "unknown_qualifier", 1, []),
    "q06": ("transprt velo", "evidence", 2, [1]),
    "q07": ("Que propose Paul Martin sur la retraite des agriculteurs ?", "unmatched_qualifier", 1, []),
    "q08": ("Que propose Jeanne Durand sur le velo ?", "with_party_evidence", 1, [1]),
    "q09": ("energie solaire", "evidence", 1, [4]),
    "q10": ("Que propose union bleue sur energie solaire ?", "unmatched_specific_concept", 1, []),
    "q11": ("retraite Agirc", "unmatched_specific_qualifier", 1, []),
    "q12": ("Quel candidat propose le velo ?", "no_candidate_evidence", 1, []),
    "q13": ("Que veut le parti sur la retraite ?", "no_party_evidence", 1, []),
    "q14": ("Jeanne Durand : Energie solaire, que veut dire cela ?", "exact_title", 1, [4]),
    "q15": ("securite police municipale", "evidence", 1, [6]),
    "q16": ("Que propose Jeanne Durand sur la securite ?", "insufficient_relevance", 1, []),
    "q17": ("retraite vraiment", "evidence", 2, [2, 3]),
}


@pytest.fixture(scope="module")
def world(spark):
    rows = [(d, text, title, "", topics, entity, entity, kind, "current", "high", "tier_1_primary_official", "https://e.fr", f"{entity}/{d}") for d, text, title, topics, entity, kind in RECORDS]
    records = spark.createDataFrame(rows, "doc_id long, text string, title string, section string, topics string, entity_label string, entity string, kind string, status string, confidence string, tier string, source_url string, path string")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    return chain.World(
        P.field_index(records),
        table([(c, a) for c, aliases in ONTOLOGY.items() for a in aliases], "concept string, alias string").cache(),
        table([("energie", "energie")], "concept string, term string"),
        table([("energie", [["solaire", "eolien"], ["toits"]])], "concept string, groups array<array<string>>"),
        table(ENTITIES, "entity string, alias string, type string, party string").cache(),
        table([(x,) for x in ("programme", "retraite")], "term string"),
        table([("vraiment",)], "term string"),
    )


def test_every_reason(spark, world):
    questions = spark.createDataFrame([(k, q) for k, (q, *_) in CASES.items()], "item_id string, text string")
    evidence, reasons = chain.retrieve(world, questions)
    assert {r.item_id: (r.reason, r.tries) for r in reasons.collect()} == {k: (reason, tries) for k, (_, reason, tries, _) in CASES.items()}
    rows = evidence.orderBy("item_id", "rank").collect()
    found = {}
    for r in rows:
        found.setdefault(r.item_id, []).append(r.doc_id)
    assert {k: sorted(v) for k, v in found.items()} == {k: docs for k, (*_, docs) in CASES.items() if docs}
    by_item = {r.item_id: r for r in rows if r.rank == 1}
    assert (by_item["q14"].score, by_item["q14"].origin) == (1_000_000.0, "title")
    assert (by_item["q08"].entity, by_item["q08"].origin) == ("c-durand", "party")
    # the party's own score for the derived question, times 0.94
    derived = spark.createDataFrame([("x", "Que propose parti vert sur velo velo")], "item_id string, text string")
    own = chain.one_pass(world, derived, 14).found.where("doc_id = 1").first().score
    assert abs(by_item["q08"].score - 0.94 * own) < 1e-5


def test_no_questions(spark, world):
    evidence, reasons = chain.retrieve(world, spark.createDataFrame([], "item_id string, text string"))
    assert evidence.collect() == [] and reasons.collect() == []
