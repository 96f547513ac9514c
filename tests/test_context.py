"""Follow-up turns against a plain walk over each conversation."""

from __future__ import annotations

import random

from attestor.operators import context


def walk(turns):
    out, before = [], None
    for t in turns:
        entities = t["entities"] or (before["entities"] if before and t["short"] else [])
        topic = t["topic"] or (before["topic"] if before and t["short"] else [])
        linked, mode = before and t["short"], None
        if t["compares"]:
            mode = "comparison"
        elif linked and before["mode"] == "comparison" and ((not t["entities"] and before["entities"]) or len(before["entities"]) >= 2):
            mode = "comparison"
        elif linked and before["topic"] and not t["status"]:
            mode = "measures"
        inherited = (not t["entities"] and bool(entities)) + (not t["topic"] and bool(topic)) + (mode is not None and not t["compares"])
        before = {"entities": entities, "topic": topic, "mode": mode}
        out.append((t["conv_id"], t["turn"], entities, topic, mode, inherited))
    return out


def test_chains_equal_a_walk(spark):
    rng = random.Random(4)
    conversations = []
    for conv in [*range(40), None, 99]:
        size = 600 if conv == 99 else rng.randint(1, 12)  # one conversation that many tasks share
        some = lambda: [] if rng.random() < 0.6 else sorted(rng.sample("abcd", rng.randint(1, 3)))
        conversations.append([{"conv_id": conv, "turn": k, "short": rng.random() < 0.75, "entities": some(), "topic": some(), "compares": rng.random() < 0.2, "status": rng.random() < 0.2} for k in range(size)])
    frame = spark.createDataFrame([t for c in conversations for t in c], "conv_id long, turn long, short boolean, entities array<string>, topic array<string>, compares boolean, status boolean")
    got = sorted(map(tuple, context.carried(frame.repartition(5)).collect()), key=repr)
    want = sorted((r for c in conversations for r in walk(c)), key=repr)
    assert got == want
    assert max(r[5] for r in want) == 3
