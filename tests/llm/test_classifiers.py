import random
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from attestor.llm import mixing, quality_cnn, quality_rules, toxicity, url_filter

WORDS = "river stone garden window letter music paper bread summer winter bottle market".split()


def labelled(spark, n=240, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        bad, toxic = i % 3 == 0, i % 4 == 0
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(15, 60))]
        if bad:
            words = [w + rnd.choice(["###", "$$$", "&&&"]) for w in words]
        if toxic:
            words.insert(rnd.randrange(len(words)), "moron")
            words.insert(rnd.randrange(len(words)), "scum")
        rows.append((i, " ".join(words), int(not bad), int(toxic)))
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _, _ in rows], "doc_id long, text string, score double")
    return docs, spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")


def accuracy(out, labels, name):
    rows = out.join(labels, "doc_id").where("held_out").collect()
    return np.mean([r.predicted == r[name] for r in rows]), rows


def test_quality_network(spark):
    docs, labels = labelled(spark)
    out = quality_cnn.classify(docs, labels)
    share, rows = accuracy(out, labels, "quality")
    assert share >= 0.95 and all(0 <= r.score <= 1 for r in rows)
    extra = docs.limit(0).unionByName(spark.createDataFrame([(-1, None, 1.0), (-2, "", 1.0), (None, "x", 1.0), (-3, "word " * 40000, 1.0)], "doc_id long, text string, score double"))
    network = quality_cnn.fit(docs, labels)
    scores = {r.doc_id: r.score for r in quality_cnn.scored(extra, network).collect()}
    assert len(scores) == 4 and scores[-1] == scores[-2]
    assert quality_cnn.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_cnn.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_trees(spark):
    docs, labels = labelled(spark)
    share, rows = accuracy(toxicity.classify(docs, labels), labels, "toxic")
    assert share >= 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}
    model = toxicity.fit(docs, labels)
    odd = model.scores([None, "", "moron " * 30000])
    assert odd[0] == odd[1] and odd[2] >= 0


def test_isotonic_rises():
    x, y = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1, 1]))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= -1e-12).all()


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_urls(spark):
    urls = ["http://A.net/x?y#z", "https://www.example.net/en/1", "https://m.example.com/de/", "http://notexample.com/de/", "x.org/fr/", None, "", "http://x.org", "http://y.org/fr/?q://z", "ftp://h.net#f", "https://bestcasinobets.example.com/en/1", "https://gardenmusic.example.com/en/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, RULES, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("m.example.com", "/de/", "example.com/de/", "block") and got[3][2] is None
    assert got[4][:3] == got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7] == ("x.org", "", None, "allow") and got[8] == ("y.org", "/fr/", "org/fr/", "allow") and got[9] == ("h.net", "", None, got[9][3])
    assert got[10][3] == "block" and got[11][3] == "allow"
    assert url_filter.judge(df.limit(0), RULES, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_segmentation():
    split = url_filter.segmenter(public_tokenizers.path("word_bpe_49k.json"))
    assert split.words("onlinecasino") == ("online", "casino") and "".join(split.words("q" * 300)) == "q" * 300


VOCABULARIES = [public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")]


def test_repeated_words_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        words = [rnd.choice([b"a", b"b"] if rnd.random() < 0.5 else [b"c"]) for _ in range(rnd.randint(0, 60))]
        seen: dict = {}
        for k in range(len(words) - 7):
            seen.setdefault(tuple(words[k : k + 8]), []).append(k)
        marked = {p for places in seen.values() if len(places) > 1 for k in places for p in range(k, k + 8)}
        assert quality_rules.repeated_words(words) == len(marked)


def test_rules(spark):
    rnd = random.Random(5)
    clean = [" ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(rnd.randint(25, 80))) for _ in range(60)]
    odd = ["a\nb\na\n\n\u00a0\nb", None, "", " ".join(chr(0x12000 + k) + chr(0x12001) for k in range(40)), "# $ x|y <b>"]
    rows = [(i, t, "en", 1) for i, t in enumerate(clean)] + [(100 + i, t, "en", 1) for i, t in enumerate(odd)] + [(200, clean[0], None, 1)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, entropy int"), VOCABULARIES).collect()}
    assert all(got[i].kept for i in range(60)) and got[200].kept and len(got) == 66
    assert (got[100].n_words, got[100].word_chars, got[100].n_dup_lines, got[100].base_failed) == (5, 5, 2, True)
    assert got[101].n_words == got[102].n_words == 0 and got[101].base_failed
    assert not got[103].base_failed and not got[103].kept and got[103].byte_share > 0.5
    assert got[104].n_symbols == len(re.findall(r"[#*$%&|<>]", odd[4]))


def test_mixing_meets_targets(spark):
    rnd = random.Random(6)
    texts = {"en": "the river and the stone of summer", "fr": "le vin et la rue des élèves où", "de": "der Fluß und die Straße für uns"}
    rows = []
    for i in range(600):
        lang = rnd.choice(["en"] * 6 + ["fr"] * 3 + ["de"])
        rows.append((i, " ".join(rnd.choice(texts[lang].split()) for _ in range(rnd.randint(20, 60))), lang, 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string, rate int")
    targets = {"en": 0.4, "fr": 0.3, "de": 0.3}
    out = mixing.rates(docs, docs.select("doc_id", "domain"), targets).collect()
    total = sum(r.n_tokens for r in out)
    shares = [sum(r.n_tokens * r.rate * r.posterior[d] for r in out) / total for d in range(3)]
    assert np.allclose(shares, list(targets.values()), atol=0.005) and all(r.rate >= 0 for r in out)
    mixed = mixing.mixed(docs, docs.select("doc_id", "domain"), targets)
    assert mixed.columns == docs.columns
    got = {r.domain: r.n for r in mixed.withColumn("w", F.size(F.split("text", " "))).groupBy("domain").agg(F.sum("w").alias("n")).collect()}
    assert all(abs(got[d] / sum(got.values()) - t) < 0.05 for d, t in targets.items())
    odd = spark.createDataFrame([(1, None, "en", 1), (None, "", None, 1), (2, "x", "zz", 1)], docs.schema)
    assert mixing.rates(odd, odd.select("doc_id", "domain"), targets).count() == 3
    assert mixing.rates(docs.limit(0), docs.select("doc_id", "domain").limit(0), targets).count() == 0


def test_rates_equal_a_plain_projected_gradient(spark):
    rnd = np.random.default_rng(3)
    p = np.round(rnd.dirichlet([0.3] * 3, 25) * 64) / 64
    p[:, 0] += 1 - p.sum(axis=1)
    tokens, targets = rnd.integers(1, 100, 25), np.array([0.6, 0.3, 0.1])
    cells = spark.createDataFrame([(x.tolist(), int(n)) for x, n in zip(p, tokens, strict=True)], "posterior array<double>, tokens long")
    got = {tuple(r.posterior): r.r for r in cells.withColumn("r", mixing.rate(F.col("posterior"), mixing.fit_rates(cells, targets))).collect()}
    w, r = tokens / tokens.sum(), np.ones(25)
    step = 1 / ((p**2 / targets).sum(axis=1).max() + mixing.RIDGE)
    for _ in range(200_000):  # in the metric of the tokens
        r = np.maximum(0, r - step * (p @ (((w * r) @ p - targets) / targets) + mixing.RIDGE * (r - 1)))
    assert np.allclose([got[tuple(x)] for x in p.tolist()], r, atol=1e-4) and (r == 0).any()


def test_mixing_reads_long_texts_whole(spark):
    docs = spark.createDataFrame([(1, "the river " * 100_000, "en", "x"), (2, "le vin", "fr", "x")], "doc_id long, text string, domain string, n_tokens string")
    out = {r.doc_id: r for r in mixing.rates(docs, docs.select("doc_id", "domain"), {"en": 0.5, "fr": 0.5}).collect()}
    assert out[1].n_tokens == 200_000 and out[2].n_tokens == 2
    assert set(mixing.mixed(docs, docs.select("doc_id", "domain"), {"en": 0.5, "fr": 0.5}).columns) == set(docs.columns)
