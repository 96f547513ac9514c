"""The prefix-tree join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from attestor.llm import ngram_join as J
from attestor.llm import shingles


def plain_set(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def plain_groups(rows, size, threshold):
    """rows: (id, text). id -> smallest id that links reach; by all pairs."""
    held = [(i, plain_set(t, size)) for i, t in rows if i is not None]
    root = {i: i for i, _ in held}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(held):
        for j, b in held[:k]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(plain_set(t, size)), find(i) if i is not None else None) for i, t in rows), key=repr)


def corpus(rng):
    """Families of copies with changed words, chains that drift, texts of shared passages, short texts, odd rows."""
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(rng.randint(30, 60))] for _ in range(4)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(5, 160))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
            if rng.random() < 0.3:
                base = copy
    for _ in range(25):
        texts.append(rng.choice(passages) + [word() for _ in range(rng.randint(0, 25))] + rng.choice(passages)[: rng.randint(0, 40)])
    texts += [[w for w in "a b c d e f g".split()[: rng.randint(1, 7)]] for _ in range(10)]
    rows = [(k, " ".join(w.upper() if rng.random() < 0.1 else w for w in t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    long = " ".join(f"v{k}" for k in range(9000))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5003, "one"), (5004, "ONE"), (None, rows[0][1]), (None, None)]
    rows += [(5005, rows[1][1]), (5005, rows[2][1]), (5006, long), (5007, long + " more"), (5008, "\x1c one"), (5009, "a b c"), (5010, "a\tb\nc")]
    return rows


@pytest.mark.parametrize(("size", "threshold", "block", "walkers"), [(4, 85, 512, 2048), (4, 85, 2, 3), (5, 80, 3, 4), (1, 60, 4, 5)])
def test_join_equals_all_pairs(spark, monkeypatch, size, threshold, block, walkers):
    monkeypatch.setattr(J, "BLOCK_SETS", block)
    monkeypatch.setattr(J, "WALKERS", walkers)
    rows = corpus(random.Random(size * threshold + block))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, member string").repartition(6)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.ngram_join(docs, size, threshold).collect()), key=repr)
    assert got == plain_groups(rows, size, threshold)


def test_small_buckets_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(J, "BUCKET_ENTRIES", 50)
    rows = corpus(random.Random(77))[:120]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, J.ngram_join(docs, 4, 85).collect()), key=repr) == plain_groups(rows, 4, 85)
    assert J.ngram_join(docs.limit(0), 4, 85).collect() == []


def test_trie_finds_all_similar_sets():
    rng = random.Random(4)
    for threshold in (50, 85):
        for _ in range(40):
            base = [rng.randrange(60) for _ in range(30)]
            sets = [np.array(sorted({x if rng.random() < 0.9 else rng.randrange(60) for x in base[: rng.randint(1, 30)]}), np.uint64) for _ in range(rng.randint(2, 25))]
            trie = J.Trie(sets, threshold, rng.choice([1, 2]))
            walkers, n = [trie.ranked(s) for s in sets], trie.n
            assert all(sorted(a.tolist()) == sorted(b.tolist()) for a, b in zip(walkers, trie.own, strict=True))
            who, of = trie.similar(walkers, n, np.arange(len(sets)), np.arange(len(sets)))
            similar = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * shingles.common(a, b) >= threshold * (len(a) + len(b) - shingles.common(a, b))}
            assert set(zip(who.tolist(), of.tolist(), strict=True)) == similar
            groups = J.Groups(list(range(len(sets))))
            for a, b in J.links(trie, trie.own, trie.n, groups, 0):
                assert (a, b) in similar
            assert all(groups.find(a) == groups.find(b) for a, b in similar)


def test_others_walk_past_a_trie():
    rng = random.Random(6)
    draw = lambda: [np.array(sorted(rng.sample(range(40), rng.randint(20, 40))), np.uint64) for _ in range(9)]
    for _ in range(30):
        sets, others = draw(), draw()
        trie = J.Trie(sets, 60)
        n = np.array([len(s) for s in others])
        who, of = trie.similar([trie.ranked(s) for s in others], n, np.arange(9), np.arange(9, 18))
        want = {(i, j) for i, a in enumerate(others) for j, b in enumerate(sets) if 100 * shingles.common(a, b) >= 60 * (len(a) + len(b) - shingles.common(a, b))}
        assert set(zip(who.tolist(), of.tolist(), strict=True)) == want


def test_windows_of_similar_sets_share_enough():
    rng = random.Random(5)
    for _ in range(400):
        t, n = rng.choice([60, 80, 85]), rng.randint(1, 200)
        a = sorted(rng.sample(range(1000), n))
        b = sorted({x if rng.random() < 0.95 else rng.randrange(1000) for x in a})
        common = len(set(a) & set(b))
        if 100 * common < t * (len(a) + len(b) - common):
            continue
        x, y = a[: J.window(len(a), t)], b[: J.window(len(b), t)]
        assert len(set(x) & set(y)) >= J.asked(min(len(a), len(b))) >= max(J.asked(J.fewest(len(a), t)), J.asked(J.fewest(len(b), t)))
