import random
import re

import pytest

from attestor.llm import near_dup, shingles


def brute(rows, size, threshold):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    rows = []
    for _ in range(4):  # families with copies at all distances, so that links need other members than the centre
        base = [word() for _ in range(rnd.randint(60, 200))]
        for _ in range(35):
            copy = list(base)
            for _ in range(rnd.randint(0, 14)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append(" ".join(copy).replace("a", rnd.choice("aA")))
        current = list(base)
        for _ in range(15):  # a chain: each close to the one before
            current[rnd.randrange(len(current))] = word()
            current[rnd.randrange(len(current))] = word()
            rows.append("\t".join(current))
    rows += ["", "  \n", "one", "One", "one two", "one two", "one\u00a0two"] + [" ".join(word() for _ in range(50)) for _ in range(30)]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("size", "threshold"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, monkeypatch, size, threshold):
    monkeypatch.setattr(near_dup, "INDEX_BLOCK", 8)
    monkeypatch.setattr(near_dup, "CENTRE_BLOCK", 5)
    monkeypatch.setattr(near_dup, "PASSING_BLOCK", 7)
    rows = corpus(size)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, size, threshold).collect()}
    assert got == brute(rows, size, threshold)


def test_odd_rows(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, "A b C d e"), (None, "a b c d e"), (7, None), (8, ""), (9, "x " * 60000)]
    got = sorted((tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()), key=str)
    assert got == sorted([(5, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (None, 3, None, True), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True)], key=str)
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 3, 85).count() == 0


def test_needed_overlap_is_exact():
    for t in (80, 85):
        for a in range(1, 25):
            for b in range(1, 25):
                for common in range(min(a, b) + 1):
                    # the differences of a and b to an empty centre are the sets themselves
                    assert (common >= near_dup._needed(a, b, a, b, t)) == (100 * common >= t * (a + b - common))


def test_band_keys_agree_for_equal_sets():
    m = shingles.permutations(36, 1)
    a, b = shingles.shingle_set("a b c d e f g", 3), shingles.shingle_set("A  b c\nd e f g", 3)
    assert (shingles.bands(shingles.min_max(a, *m), 4) == shingles.bands(shingles.min_max(b, *m), 4)).all()


def test_an_id_with_several_texts_is_one_document(spark):
    rnd = random.Random(9)
    base = [[f"w{rnd.randrange(5000)}" for _ in range(120)] for _ in range(3)]

    def near(k):
        words = list(base[k])
        words[rnd.randrange(len(words))] = "changed"
        return " ".join(words)

    rows = [(1, " ".join(base[0])), (1, " ".join(base[1])), (2, near(0)), (3, near(1)), (5, " ".join(base[2])), (5, near(0)), (6, near(2)), (7, None), (7, near(2)), (8, "alone")]
    for ordered in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, t, "x", "y") for i, t in ordered], "doc_id long, text string, digest string, bands string")
        got = sorted({(r.doc_id, r.component_id) for r in near_dup.near_duplicates(df, 3, 85).collect()})
        assert got == [(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (7, 1), (7, 7), (8, 8)]
