import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestor.llm import chat_format as C
from attestor.llm import topk

PARTS = st.lists(st.sampled_from([C.START, C.END, C.ESCAPED, "\\", "\\n", "\n", "<|", "|>", "<\\|", "user", "a", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
def test_round_trip(turns):
    output = "".join(C.render(r, t)[0] for r, t in turns)
    assert list(C.parse(output)) == turns


def test_plain_text_is_not_escaped():
    assert C.render("user", "a \\ b <b>") == ("<|im_start|>user\na \\ b <b><|im_end|>\n", 0)
    assert C.render("user", C.END)[1] == 1


def test_digests(spark):
    rows = [(1, 1, "assistant", "B" + C.END), (1, 0, "user", "a"), (1, 2, "assistant", "C"), (1, 2, "assistant", "C"), (2, 0, None, None), (None, None, "user", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in C.digests(df).collect()}
    order = [("user", "a"), ("assistant", "B" + C.END), ("assistant", "C"), ("assistant", "C")]
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()
    assert got[1].loss_chars == len("B" + C.END) + 2 and got[1].loss_sha256 == hashlib.sha256(("B" + C.END + "CC").encode()).hexdigest()
    assert got[1].formatted_chars == sum(len(C.render(r, t)[0]) for r, t in order) and got[1].n_escaped == 1
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].n_turns == 1
    assert C.digests(df.where("false")).count() == 0


def brute(rows, k, every):
    vectors = {i: [int(1024 * x // 1) for x in v] for i, v in rows if v is not None and all(x is not None and abs(x) != float("inf") and x == x for x in v)}
    out = []
    for q in sorted(i for i in vectors if i % every == 0):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], vectors[c], strict=False)), c) for c in vectors if c != q)[:k]
        out.extend((q, n, c, -s) for n, (s, c) in enumerate(best, 1))
    return out


@pytest.mark.parametrize(("values", "block"), [(300, 8), (4_000_000, 8192)])
def test_top_k_equals_brute_force(spark, monkeypatch, values, block):
    monkeypatch.setattr(topk, "TASK_VALUES", values)  # so that many tasks and blocks meet
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    rnd = random.Random(1)
    rows = [(i, [round(rnd.uniform(-1, 1), 1) if rnd.random() < 0.7 else 0.0 for _ in range(6)]) for i in range(230)]
    rows += [(300, rows[0][1]), (301, None), (302, [None] * 6), (303, [float("nan")] * 6), (304, [float("inf")] + [0.0] * 5), (400, [0.0] * 6), (500, []), (501, [1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = sorted(tuple(r) for r in topk.top_k(df, 7, 10).collect())
    assert got == brute(rows, 7, 10)
    assert topk.top_k(df.where("vec_id in (10, 11)"), 7, 10).count() == 1
    assert topk.top_k(df.where("false")).count() == 0


def test_wide_scores_stop_at_the_largest_long(spark):
    df = spark.createDataFrame([(0, [1e15, 1e15]), (1, [1e15, 1e15])], "vec_id long, embedding array<double>")
    assert [r.score for r in topk.top_k(df).collect()] == [2**63 - 1]


def test_rows_of_one_id_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(topk, "TASK_VALUES", 200)
    rows = [(7, [float(k), 1.0]) for k in range(400)] + [(0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id, r.score) for r in topk.top_k(df, 3, 100).orderBy("rank").collect()] == [(k, 7, 1024 * 1024 * (400 - k)) for k in (1, 2, 3)]


def test_sums_are_as_wide_as_they_must_be():
    for largest in (3, 40_000, 3_000_000_000, 2**40):
        rows = [np.array([largest, -largest, 0]), np.array([largest, 0, 1])]
        block = topk.Block([1, 2], rows)
        want = [[min(2**63 - 1, max(-(2**63), sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in rows] for x in rows]
        assert topk.accumulate(block, block).tolist() == want
