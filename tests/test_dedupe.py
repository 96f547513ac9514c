import random
from itertools import combinations

from attestor.operators import dedupe as D
from attestor.plans import dedupe_queries as Q


def says_the_same(x, y):
    """y is the newer claim, by whose terms coverage is measured."""
    (w, n), (v, m) = x, y
    shared = len(w & v)
    return not (n and m and not n & m) and shared >= (2 if len(v) <= 4 else 3) and (shared >= 4 or shared >= 0.4 * len(v))


def test_claims_with_different_rarest_words_match(spark):
    rnd = random.Random(5)
    claims = {k: (set(rnd.sample("abcdefghijklmnopqrstuvwxyz", rnd.randint(1, 12))), set(rnd.sample("123", rnd.randint(0, 2)))) for k in range(120)}
    claims |= {200: ({"school", "age", "sixteen", "yellow"}, set()), 201: ({"school", "age", "amber"}, set())}
    df = spark.createDataFrame([(k, k % 2, list(w), list(n)) for k, (w, n) in claims.items() if k < 200] + [(k, 2, list(claims[k][0]), []) for k in (200, 201)], "doc_id long, block int, tokens array<string>, numbers array<string>")
    want = {(a, b) for a, b in combinations(claims, 2) if (a < 200) == (b < 200) and a % 2 == b % 2 and says_the_same(claims[a], claims[b])} | {(200, 201)}
    got = [tuple(r) for r in D.claim_pairs(df, "doc_id", ["block"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_holders_of_a_frequent_token_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(D, "HOLDERS", 7)
    rnd = random.Random(6)
    sets = {k: set(rnd.sample("abcdefgh", rnd.randint(3, 7))) for k in range(80)}
    df = spark.createDataFrame([(k, list(w)) for k, w in sets.items()], "doc_id long, tokens array<string>")
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {(r.a, r.b): r.similarity for r in D.pairs_by_rare_token(df, "doc_id", [], 0.6).collect()} == want


def test_near_copies_are_found_across_sources_and_languages(spark, tmp_path):
    words = [f"word{k}" for k in range(20)]
    texts = [("a", "en", " ".join(words)), ("b", "en", " ".join(words[:-1])), ("c", "fr", " ".join(words[1:])), ("b", "de", " ".join(reversed(words))), ("a", "en", "another text")]
    spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id long, source string, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.a, r.b) for r in Q.neardup_pairs(spark, str(tmp_path)).collect()) == [(0, 1), (0, 2), (1, 2)]
    assert {r.doc_id: r.representative for r in Q.neardup_members(spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4}
