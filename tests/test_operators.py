from pyspark.sql import functions as F

from attestor.operators import claims as C
from attestor.operators import monitor as M
from attestor.operators import retrieval as R


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_content_changes_ignore_invalid_snapshots(spark):
    log = spark.createDataFrame([("u", 1, "a", 200), ("u", 2, "x", 403), ("u", 3, "a", 200), ("u", 4, "b", 200), ("v", 1, "x", 403), ("v", 2, "a", 200)], "key string, seq int, sha string, status int")
    assert rows(M.content_changes(log, "key", "seq", "sha", F.col("status") < 400).select("key", "seq", "sha", "previous"), "key") == [("u", 4, "b", "a")]


def test_failure_streaks(spark):
    log = spark.createDataFrame([("u", k, k != 5) for k in range(1, 7)], "key string, at int, failed boolean")
    assert rows(M.failure_streaks(log, "key", "at", "at", F.col("failed")), "first_failure") == [("u", 4, 1, 4, True), ("u", 1, 6, 6, False)]


def test_recovered_needs_a_later_check(spark):
    errors = spark.createDataFrame([("u", 5), ("v", 5)], "k string, at int")
    checks = spark.createDataFrame([("u", 6), ("v", 4)], "k string, at int")
    assert rows(M.recovered(errors, checks, "k", "at"), "k") == [("u", 5, True), ("v", 5, False)]


def test_retry(spark):
    df = spark.createDataFrame([(0,), (1,), (5,), (9,)], "n int")
    assert [r[0] for r in df.orderBy("n").select(M.retry_hours(F.col("n"))).collect()] == [0, 6, 336, 336]
    jobs = spark.createDataFrame([("a", "technical_error", "2026-01-01 00:00:00"), ("b", "technical_error", "2027-01-01 00:00:00"), ("c", "done", None), ("d", "technical_error", "?")], "k string, status string, next_retry_at string")
    assert [r.k for r in M.retry_due(jobs, ("done",), F.lit("2026-06-01").cast("timestamp")).orderBy("k").collect()] == ["a", "d"]


def test_coverage_keeps_empty_cells(spark):
    claims = spark.createDataFrame([("alice", "retraites", True, "2026-01-01")], "actor string, topic string, explicit boolean, date string")
    actors, topics = spark.createDataFrame([("alice",), ("bob",)], "actor string"), spark.createDataFrame([("retraites",), ("ecole",)], "topic string")
    assert rows(C.coverage_cells(claims, actors, topics), "actor", "topic") == [("alice", "ecole", 0, 0, None), ("alice", "retraites", 1, 1, "2026-01-01"), ("bob", "ecole", 0, 0, None), ("bob", "retraites", 0, 0, None)]


def test_provenance_merge_is_idempotent(spark):
    claims = spark.createDataFrame([("c", ["doc-1"], ["u1"])], "claim_id string, doc_ids array<string>, urls array<string>")
    new = spark.createDataFrame([("c", ["doc-2", "doc-1"], ["u2"])], "claim_id string, doc_ids array<string>, urls array<string>")
    once = C.provenance_merge(claims, new)
    twice = C.provenance_merge(once.drop("confirmation_count"), new)
    assert rows(once, "claim_id") == rows(twice, "claim_id") == [("c", ["doc-1", "doc-2"], ["u1", "u2"], 2)]


def test_supersede_and_chronology(spark):
    claims = spark.createDataFrame([("a", "current", None), ("b", "current", None)], "claim_id string, status string, superseded_by string")
    verdicts = spark.createDataFrame([("SUPERSEDES", "n", "a"), ("CONFIRMED", "m", "b"), ("SUPERSEDES", "k", None)], "verdict string, claim_id string, target_id string")
    assert rows(C.supersede(claims, verdicts), "claim_id") == [("a", "superseded", "n"), ("b", "current", None)]
    updates = spark.createDataFrame([("a", "2024-06-03", None), ("b", "2027-01-15", "source"), ("c", "2027-01-15", "capture_fallback")], "claim_id string, date string, date_basis string")
    current = spark.createDataFrame([("a", "2026-06-01"), ("b", "2026-06-01"), ("c", "2026-06-01")], "claim_id string, date string")
    assert [r.claim_id for r in C.chronology_guard(updates, current).collect()] == ["b"]


def test_sanitize_keeps_only_supported_claims(spark):
    text = spark.createDataFrame([("u", "Alice  propose la retraite à 64 ans pour tous.")], "source_url string, text string")
    allowed = spark.createDataFrame([("alice", "candidate")], "actor_id string, actor_type string")
    statement = "La retraite serait fixée à 64 ans."
    claims = spark.createDataFrame([("u", 0, "bob", "candidate", statement, "retraite à 64 ans"), ("u", 1, "alice", "candidate", statement, "retraite à 60 ans"), ("u", 2, "alice", "candidate", statement, "alice propose la retraite")], "source_url string, idx int, actor_id string, actor_type string, statement string, quote string")
    assert [r.idx for r in C.sanitize(claims, allowed, text).collect()] == [2]


def test_closure_and_history(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "a int, b int")
    assert rows(C.closure(links, "a", "b", 5), "node") == [(1, 2), (2, 1), (3, 0)]
    status = spark.createDataFrame([("k", "x", 1), ("k", "x", 2), ("k", "y", 3)], "k string, s string, at int")
    assert rows(C.validity_intervals(status, "k", "s", "at", "at"), "valid_from") == [("k", "x", 1, 3), ("k", "y", 3, None)]


def test_retrieval_refuses_unknown_qualifiers(spark):
    docs = spark.createDataFrame([(k, f"retraite pension cotisation mesure{k} logement") for k in range(6)], "doc_id long, text string")
    questions = spark.createDataFrame([(1, "retraite pension"), (2, "retraite martienne"), (3, "")], "item_id long, text string")
    index = R.build_index(docs)
    asked = R.question_terms(questions)
    assert dict(rows(R.diagnostics(questions, asked, index, R.bm25(index, asked)), "item_id")) == {1: "answerable", 2: "unknown_qualifier", 3: "empty"}


def test_near_sentences_are_dropped(spark):
    said = ["La retraite passe à 64 ans pour tous.", "la retraite passe a 64 ans pour tous", "La retraite passe à 64 ans pour tous les salariés.", "Les impôts baissent."]
    df = spark.createDataFrame([(1, k, 10 + k, s) for k, s in enumerate(said)], "item_id int, place int, doc_id int, sentence string")
    assert rows(R.without_near_sentences(df, 6), "place") == [(1, 1, 10, said[0]), (1, 2, 13, said[3])]
    assert rows(R.without_near_sentences(df, 1), "place") == [(1, 1, 10, said[0])]


def test_rejections_by_reason(spark):
    frame = spark.createDataFrame
    ranked = frame([(1, 10, 1), (2, 20, 6), (2, 21, 1), (5, 50, 1)], "item_id int, doc_id int, rank int")
    truth = frame([(1, 10), (2, 20), (3, 30), (6, 60)], "item_id int, doc_id int")
    reasons = frame([(1, "answerable"), (2, "answerable"), (3, "empty"), (4, "empty"), (5, "answerable"), (6, "empty")], "item_id int, reason string")
    variant = frame([(1, "x"), (2, "x"), (3, "x"), (6, "y")], "item_id int, variant string")
    got = rows(R.rejections(ranked, truth, reasons, variant), "part", "variant", "reason")
    assert got == [("missed", "x", "answerable", 1, 0.333333), ("missed", "x", "empty", 1, 0.333333), ("missed", "y", "empty", 1, 1.0), ("refused", None, "answerable", 1, 0.5), ("refused", None, "empty", 1, 0.5)]
    assert R.rejections(ranked.where("false"), truth.where("false"), reasons.where("false"), variant.where("false")).count() == 0
