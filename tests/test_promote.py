from pyspark.sql import functions as F

from attestor.functions.numbers import number_words
from attestor.operators import promote as P


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_number_words(spark):
    cases = {"retraite a soixante quatre ans": "retraite a 64 ans", "quatre vingt dix ans": "90 ans", "deux mille euros": "2000 euros", "soixante et onze jours": "71 jours", "trois cent mille logements": "300000 logements", "deux candidats": "deux candidats", "64 ou 65 et deux ans": "64 ou 65 et deux ans", "un million cinq cent mille euros et rien": "1500000 euros et rien", "": ""}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string").orderBy("i")
    assert [r.v for r in df.select(number_words(F.col("x")).alias("v")).collect()] == list(cases.values())


def test_verdicts_and_dates(spark):
    claims = spark.createDataFrame([("u", 0, k, d) for k, d in enumerate(["2026-01-02", "2026-01-01", "2026-01-01", None])] + [("v", 0, 0, None), ("w", 0, 0, None)], "source_url string, window int, idx int, date string")
    verdicts = spark.createDataFrame([("u", 0, 0, "CONFIRMED", None, None), ("u", 0, 1, "DUPLICATE", None, None), ("u", 0, 2, "CONFIRMED", "SUPERSEDES", None), ("u", 0, 3, "CONFIRMED", "SUPERSEDES", "c")], "source_url string, window int, idx int, verdict string, relation string, target_id string")
    assert [r.idx for r in P.verdict_filter(claims, verdicts).orderBy("idx").collect()] == [0, 3]
    feed = spark.createDataFrame([("v", "2026-02-02")], "source_url string, date string")
    assert rows(P.resolve_date(claims, feed, F.lit("2026-09-09")), "source_url") == [("u", "2026-01-01", "source_publication"), ("v", "2026-02-02", "source_publication"), ("w", "2026-09-09", "capture_fallback")]


def test_support_upsert_is_idempotent(spark):
    kind = "document_id string, topics array<string>, statements array<string>"
    old, new = spark.createDataFrame([("d", ["b"], ["s1"])], kind), spark.createDataFrame([("d", ["a", "b"], ["s1", "s2"]), ("e", ["c"], ["s3"])], kind)
    once = P.support_upsert(old, new)
    assert rows(once, "document_id") == rows(P.support_upsert(once, new), "document_id") == [("d", ["a", "b"], ["s1", "s2"]), ("e", ["c"], ["s3"])]


def test_repair_and_report(spark):
    prints = spark.createDataFrame([("f", "a"), ("g", "b"), ("h", "c")], "fingerprint string, claim_id string")
    claims = spark.createDataFrame([("a", "current"), ("b", "old")], "claim_id string, scope string")
    assert [r.fingerprint for r in P.state_repair(prints, claims).collect()] == ["f"]
    out = spark.createDataFrame([("inserted",), ("inserted",), ("rejected",)], "outcome string")
    assert tuple(P.run_report(out).first()) == (3, 2, 0, 0, 1, 0)


def test_party_cards_join_their_person(spark):
    cards = spark.createDataFrame([(1, "alice", "person", "A", 5.0), (1, "p1", "party", "P1", 3.0), (1, "p2", "party", "P2", 2.0), (1, "p3", "party", "P3", 1.0)], "question_id int, entity_id string, kind string, text string, score double")
    members = spark.createDataFrame([("p1", "alice", 2), ("p1", "zoe", 1), ("p2", "bob", 1), ("p2", "carl", 2), ("p3", "dan", 1), ("p3", "eve", 1)], "party_id string, entity_id string, status_rank int")
    assert rows(P.group_by_actor(cards, members), "entity_id") == [(1, "alice", ["A", "P1"], 5.0, 1), (1, "bob", ["P2"], 2.0, 1), (1, "p3", ["P3"], 1.0, 1)]


def test_gates(spark):
    evidence = spark.createDataFrame([(1, "alice", "La taxe Zucman"), (1, "p1", "La taxe"), (2, "alice", "x"), (2, "p1", "y")], "question_id int, entity_id string, text string")
    questions = spark.createDataFrame([(1, "Que dit la taxe Zucman ?"), (2, "Quels partis ?")], "question_id int, text string")
    entities = spark.createDataFrame([("alice", "person"), ("p1", "party")], "entity_id string, type string")
    assert rows(P.actor_type_filter(evidence, questions, entities).select("question_id", "entity_id"), "question_id", "entity_id") == [(1, "alice"), (1, "p1"), (2, "p1")]
    known = spark.createDataFrame([], "term string")
    assert rows(P.named_qualifier(evidence, questions, known).select("question_id", "entity_id"), "question_id", "entity_id") == [(1, "alice"), (2, "alice"), (2, "p1")]
    matches = spark.createDataFrame([(1, "a", "age de depart"), (1, "b", "depart"), (2, "c", "impot"), (2, "d", "taxe")], "question_id int, concept string, alias string")
    assert rows(P.dominant_concepts(matches).select("question_id", "concept"), "question_id", "concept") == [(1, "a"), (2, "c"), (2, "d")]
    tagged = spark.createDataFrame([("a", "taxe sur la fortune"), ("a", "taxe"), ("b", "rien")], "concept string, text string")
    groups = spark.createDataFrame([("a", [["taxe", "impot"], ["fortune"]])], "concept string, groups array<array<string>>")
    assert rows(P.strict_groups(tagged, groups), "concept", "text") == [("a", "taxe sur la fortune"), ("b", "rien")]
