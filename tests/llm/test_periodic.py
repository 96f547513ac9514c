"""Runs found by recompression against a search that tries every period at every word."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np

from attestor.llm import periodic


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(12, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def text_of(rng, n):
    words = [f"w{rng.randrange(rng.choice([1, 2, 3, 6, 40]))}" for _ in range(n)]
    if n > 6 and rng.random() < 0.7:
        p, a = rng.randint(1, n // 3), rng.randrange(n)
        words = [words[min(a + (i - a) % p, n - 1)] if i >= a else words[i] for i in range(n)]
    return words


def test_runs_equal_a_plain_search():
    rng = random.Random(5)
    for _ in range(60):
        docs = [text_of(rng, rng.randint(0, 150)) for _ in range(rng.randint(0, 7))]
        number = {}
        coded = [np.array([number.setdefault(w, len(number)) for w in d], np.int64) for d in docs]
        for words, found in zip(docs, periodic.runs(coded, len(number)), strict=True):
            assert [tuple(r) for r in found.tolist()] == plain_runs(words)


def test_extensions_equal_word_by_word():
    rng = random.Random(6)
    letters = np.array([-1] + [rng.randrange(3) for _ in range(200)] + [-2], np.int64)
    grammar = periodic.Grammar(letters, 3)
    pairs = [(i, j) for i in range(1, 200, 7) for j in range(i + 1, 201, 5)]
    i, j = (np.array(c) for c in zip(*pairs, strict=True))
    ahead, back = grammar.extend(i, j)
    for x, y, f, b in zip(i.tolist(), j.tolist(), ahead.tolist(), back.tolist(), strict=True):
        assert all(letters[x + k] == letters[y + k] for k in range(f)) and letters[x + f] != letters[y + f]
        assert all(letters[x - 1 - k] == letters[y - 1 - k] for k in range(b)) and letters[x - 1 - b] != letters[y - 1 - b]


def test_levels_spell_the_sequence():
    rng = random.Random(7)
    letters = np.array([-1] + [rng.randrange(4) for _ in range(300)] + [-2] + [0] * 40 + [-3], np.int64)
    grammar = periodic.Grammar(letters, 4)
    assert len(grammar.top) == 5
    for level in grammar.levels:
        assert (np.diff(level.first) > 0).all() and level.first[-1] == len(level.letters)
        assert (level.parent == np.searchsorted(level.first, np.arange(len(level.letters)), "right") - 1).all()


def expected(doc_id, text):
    words = [w.encode() for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_query_equals_a_plain_search(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(text_of(rng, rng.randint(0, 90))), f"x{k}") for k in range(150)]
    rows += [(200, None, ""), (201, "", ""), (202, " \t\n", ""), (203, "a b c " * 20, ""), (None, "z " * 15, ""), (204, "a b c " * 400, "")]
    rows += [(205, "a " * 12, ""), (205, "a " * 12, ""), (206, "a " * 11, ""), (207, "\x1c a b" * 9, "")]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs string").write.parquet(f"{tmp_path}/documents.parquet")
    from attestor.llm.queries import op13_periodic_runs

    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r[c] for c in columns) for r in op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([expected(i, t) for i, t, _ in rows], key=repr)


def test_empty_table(spark):
    assert periodic.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_blocks_of_texts_change_nothing(monkeypatch, spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, " ".join(text_of(rng, 80))) for k in range(40)], "doc_id long, text string")
    one = sorted(map(repr, periodic.find_runs(docs.coalesce(1)).collect()))
    many = sorted(map(repr, periodic.find_runs(docs.repartition(7)).collect()))
    assert one == many
    monkeypatch.setattr(periodic, "BLOCK_CELLS", 3)
    number = [np.array([0, 1] * 30, np.int64), np.array([2] * 20, np.int64)]
    assert [r.tolist() for r in periodic.runs(number, 3)] == [[[0, 60, 2]], [[0, 20, 1]]]
