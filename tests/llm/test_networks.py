"""The quality network and the toxicity model against plain forms of themselves."""

import random

import numpy as np
import pytest

from attestor.llm import quality_cnn, toxicity


def random_texts(seed=3):
    rnd = random.Random(seed)
    words = ["river", "stone", "élève", "a", "Und", "$$$", "THE!!", "漢字"]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 200))) for _ in range(25)]
    return out + ["x", "ab", "Und " * 40 + "end", "ab" * 300, "a b c d e f g h"]


def plain_pooled(net, text):
    """All responses of all filters at all places of the whole text, one by one."""
    data, w = net.prepared(text), net.weights
    byte = [sum(w["filters"][k, data[i + k]] for k in range(quality_cnn.WIDTH)) for i in range(len(data) - quality_cnn.WIDTH + 1)]
    strides = -(-len(data) // quality_cnn.STRIDE)
    channel = np.zeros(strides + quality_cnn.TAPS - 1)
    for s in range(strides):
        for lag in range(1, quality_cnn.LAGS + 1):
            places = range(s * quality_cnn.STRIDE, (s + 1) * quality_cnn.STRIDE)
            channel[s] = max(channel[s], sum(i + lag < len(data) and data[i] == data[i + lag] for i in places) / quality_cnn.STRIDE)
    echo = [sum(w["echo"][k] * channel[s + k] for k in range(quality_cnn.TAPS)) for s in range(strides)]
    return np.maximum(np.concatenate((np.max(byte, axis=0) + w["bias"], np.max(echo, axis=0) + w["echo_bias"])), 0)


@pytest.mark.parametrize("chunk", [16, 64, 4096])
def test_chunked_pooling_equals_one_pass_over_the_whole_text(monkeypatch, chunk):
    monkeypatch.setattr(quality_cnn, "CHUNK", chunk)
    net = quality_cnn.Network(seed=1)
    for text in random_texts():
        assert np.allclose(net.pooled(text), plain_pooled(net, text), atol=1e-4)


def test_gradients_are_those_of_finite_differences():
    """One step on a tiny sample moves the loss in the way that the gradients say."""
    texts, labels = random_texts(5)[:16], [1, 0] * 8
    before, after = quality_cnn.Network(seed=2), quality_cnn.Network(seed=2).fit(texts, labels)
    loss = lambda net: -np.mean(np.log(np.clip(np.where(np.array(labels) > 0, net.scores(texts), 1 - net.scores(texts)), 1e-9, 1)))
    assert loss(after) < 0.5 * loss(before)


def test_a_very_long_text_is_read_to_its_end():
    net = quality_cnn.Network(seed=1)
    net.weights["filters"][:] = -1.0
    for k, b in enumerate(b"@@end@"):
        net.weights["filters"][k, b] = 1.0
    text = "quiet words " * 400_000
    assert net.pooled(text + "@@end@")[0] == pytest.approx(quality_cnn.WIDTH) and net.pooled(text)[0] < quality_cnn.WIDTH


def test_repetition_is_learned_from_the_second_channel():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8)))
    good = [" ".join(word() for _ in range(60)) for _ in range(120)]
    bad = [" ".join([word() for _ in range(30)] + [word()] * 30) for _ in range(120)]
    net = quality_cnn.Network().fit(good[:90] + bad[:90], [1] * 90 + [0] * 90)
    assert (net.scores(good[90:]) >= 0.5).mean() > 0.9 and (net.scores(bad[90:]) < 0.5).mean() > 0.9


def test_features_equal_plain_counts():
    lexicon = {" fiend ": 3.0, " vill": 2.5, " scum ": 2.8}
    extractor = toxicity.Extractor(lexicon)
    text = "You fiend! The VILLAGE villains, scum; v1lla1n you s-cum sc0m."
    row = dict(zip(toxicity.FEATURES, extractor.row(text), strict=True))
    flat = toxicity.plain(text)
    words = flat.split()
    assert row["word_density"] == pytest.approx(sum(w in ("fiend", "scum") for w in words) / len(words))
    assert row["begin_density"] == pytest.approx(sum(w.startswith("vill") for w in words) / len(words))
    assert row["log_odds"] == pytest.approx((3.0 + 2.8 + 2 * 2.5) / len(words))
    assert row["insult_density"] == pytest.approx(sum(w in toxicity.INSULTS for w in words) / len(words))
    assert row["second_person"] == pytest.approx(words.count("you") / len(words))
    assert row["capitals"] == pytest.approx(sum(c.isupper() for c in text) / len(text))
    assert row["exclamations"] == pytest.approx(text.count("!") / len(text)) and row["digits"] == pytest.approx(3 / len(text))
    assert row["hidden_hits"] > 0 and row["obfuscated"] > 0 and row["proximity"] == 1.0
    assert extractor.row(None) == extractor.row("") == [0.0] * len(toxicity.FEATURES)


def test_a_tree_makes_the_best_first_split():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 6, (300, 4)).astype(float)
    y = ((x[:, 2] > 2) ^ (rnd.random(300) < 0.1)).astype(float)
    forest = toxicity.Forest().fit(x, y)
    binned, p = forest.binned(x), np.full(300, y.mean())
    g, h = p - y, p * (1 - p)

    def gain(f, b):
        left = binned[:, f] <= b
        if min(left.sum(), (~left).sum()) < forest.LEAST:
            return 0.0
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + forest.SHRINK)
        return part(left) + part(~left) - part(np.ones(300, bool))

    best = max(((gain(f, b), -f, -b) for f in range(4) for b in range(forest.BINS)))
    feature, cut, _ = forest.trees[0]
    assert (feature[0], cut[0]) == (-best[1], -best[2]) == (2, cut[0])
    # margins are the sum of the leaves that each row falls into
    def plain(row):
        total = forest.start
        for feature, cut, value in forest.trees:
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += value[node - len(feature)]
        return total

    assert np.allclose(forest.margins(x), [plain(r) for r in binned])


def test_isotonic_equals_the_min_max_formula():
    rnd = np.random.default_rng(2)
    margins, y = rnd.permutation(40).astype(float), (rnd.random(40) < 0.4).astype(float)
    x, p = toxicity.isotonic(margins, y)
    v = y[np.argsort(margins)]
    fit = np.array([max(min(v[i : j + 1].mean() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)])
    # the blocks of equal fitted values, each drawn towards the share by one row
    sizes = {f: (fit == f).sum() for f in set(fit.tolist())}
    want = [(f * sizes[f] + y.mean()) / (sizes[f] + 1) for f in fit.tolist()]
    assert np.allclose(np.interp(np.sort(margins), x, p), want)


def test_a_rows_own_label_does_not_shape_its_features(spark):
    rows = [(k, f"common words here rare{k % 7}", int(k % 7 == 0), k % toxicity.FOLDS) for k in range(210)]
    lexicons = toxicity.learned_lexicons(spark.createDataFrame(rows, "doc_id long, text string, label int, part int"))
    assert " rare0 " in lexicons[0] and all(" rare0 " in x for x in lexicons[1:])
    only = [(k, "secret" if k < 9 else "plain", int(k < 9), 0 if k < 9 else k % toxicity.FOLDS) for k in range(60)] + [(99, "other", 1, 1)]
    lexicons = toxicity.learned_lexicons(spark.createDataFrame(only, "doc_id long, text string, label int, part int"))
    assert " secret " in lexicons[0] and " secret " not in lexicons[1] and " secret " in lexicons[2]


def test_odd_rows_and_clashing_names(spark):
    rnd = random.Random(7)
    words = "river stone garden window letter music".split()
    docs = [(k, " ".join(rnd.choice(words) for _ in range(30)) + (" you moron" if k % 3 == 0 else ""), 1, "q") for k in range(90)] + [(None, "you moron", 1, "q"), (1000, None, 1, "q"), (0, None, 1, "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string, label int, x string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 != 0), "t") for k in range(90)] + [(None, 1, 0, "t")], "doc_id long, toxic int, quality int, text string")
    for out in (toxicity.classify(df, labels), quality_cnn.classify(df, labels)):
        got = out.collect()
        assert len(got) == len(docs) and out.columns == ["doc_id", "held_out", "score", "predicted"]
        assert all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
