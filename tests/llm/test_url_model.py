"""The url filter's parts against plain forms of themselves."""

import itertools
import math
import random

import public_tokenizers
import pytest

from attestor.llm import url_filter as U

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def split():
    return U.segmenter(VOCABULARY)


def test_viterbi_equals_all_splits(split):
    rnd = random.Random(1)
    names = ["".join(rnd.choice(["the", "bet", "in", "g", "q", "casino", "s"]) for _ in range(rnd.randint(1, 4)))[:11] for _ in range(40)]
    cost = lambda part: split.cost.get(part, U.UNKNOWN[0] + U.UNKNOWN[1] * len(part))
    for name in names:
        best = max(sum(cost(name[a:b]) for a, b in itertools.pairwise((0, *cuts, len(name)))) for n in range(len(name)) for cuts in itertools.combinations(range(1, len(name)), n))
        assert sum(map(cost, split.words(name))) == pytest.approx(best) and "".join(split.words(name)) == name


def test_very_long_names_are_searched_whole(split):
    name = "gardenmusic" * 3000
    assert split.words(name) == ("garden", "music") * 3000


def urls(n=40):
    """Hosts whose words and paths tell their class: half of the blocked ones have no seed word."""
    rnd = random.Random(5)
    bad, good = ["lucky", "bonus", "instant"], ["garden", "kitchen", "museum", "library"]
    out = []
    for k in range(n):
        seed = ["casino", "jackpot"][k % 2] if k < n // 2 else ""
        out.append(f"http://{seed}{bad[k % 3]}{bad[(k + 1) % 3]}.example.com/play/spin/{k}")
        out.extend(f"http://{good[k % 4]}{good[(k + j) % 4]}{'abcdefgh'[j]}.example.com/recipes/{rnd.choice(['soup', 'bread'])}/{k}" for j in range(1, 4))
    return out


def test_evidence_goes_beyond_the_seed_words(spark):
    rows = [*urls(), "http://luckyinstant.example.org/play/spin/7", "http://spamgardenkitchenlibrary.example.com/recipes/soup/1", "http://museumgarden.example.org/recipes/bread/2"]
    got = [r.verdict for r in U.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), [], VOCABULARY).orderBy("page_id").collect()]
    assert got[-3:] == ["block", "allow", "allow"]  # without a seed word; with an innocent one; without
    assert all(v == ("allow" if "recipes" in u else "block") for u, v in zip(rows, got, strict=True))


def test_the_model_equals_a_plain_one(spark, split):
    """Expectation maximisation with dictionaries over the distinct shapes."""
    rows = urls(12) + urls(12)[:3] + ["http://x.example.com/1/2", "http://x.example.com/3/4"]
    df = spark.createDataFrame([(k, u, "h", "p", 0.0, "v") for k, u in enumerate(rows)], "page_id long, url string, host string, path string, score double, verdict string")
    got = {r.page_id: r.score for r in U.judge(df, [], VOCABULARY).collect()}
    shape = lambda u: (u.split("/")[2], "/" + "/".join("0" if p.isdigit() else p for p in u.split("/")[3:]))
    own = lambda u: [U.bucket(t) for t in U.tokens(*shape(u), split)[0]]
    seeds = {U.bucket(f"h {s}") for s in U.SEEDS}
    examples = [([U.bucket(t) for t in toks], seeded) for toks, seeded in (U.tokens(h, p, split) for h, p in {shape(u) for u in rows})]
    score = None
    for _ in range(U.ROUNDS):
        counts, classes = {}, [0.0, 0.0]
        for toks, seeded in examples:
            s = 0.0 if score is None else score(toks)
            block = U.SEEDED if seeded else 0.0 if s < U.SURE else 1 / (1 + math.exp(-s))
            for cell in (classes, *[counts.setdefault(b, [0.0, 0.0]) for b in toks]):
                cell[0] += block
                cell[1] += 1 - block
        used = {b for b, c in counts.items() if sum(c) >= 2 - 1e-9} | seeds
        mass = [sum(counts.get(b, (0, 0))[k] for b in used) + U.SMOOTHING * len(used) for k in (0, 1)]

        def score(toks, counts=counts, used=used, mass=mass, classes=classes):
            weight = lambda b: math.log((counts.get(b, (0, 0))[0] + U.SMOOTHING + U.SEED_WEIGHT * (b in seeds)) / mass[0]) - math.log((counts.get(b, (0, 0))[1] + U.SMOOTHING) / mass[1])
            return math.log((classes[0] + 1) / (classes[1] + 1)) + sum(weight(b) for b in toks if b in used)

    for k, u in enumerate(rows):
        assert got[k] == pytest.approx(score(own(u)), abs=1e-4)


def test_rules_equal_plain_matching(spark):
    rnd = random.Random(2)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    hosts = ["net", "a.net", "example.net", "x.example.net", "myexample.net", "example.com", "org", "b.org", "borg", "EXAMPLE.com"]
    rows = [f"http://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en', '/de/x', '/fr/', '/FR/'])}{rnd.choice(['', '?a=/en/', '#/fr/'])}" for _ in range(200)]
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules, VOCABULARY).collect()}
    for k, u in enumerate(rows):
        rest = u.split("://", 1)[1].split("?")[0].split("#")[0]
        host, path = (rest + "/").split("/", 1)[0].lower(), rest[len((rest + "/").split("/", 1)[0]) :]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[k][0] == (max(fits)[1] if fits else None)
        if fits:
            assert got[k][1] == max(fits)[2]
