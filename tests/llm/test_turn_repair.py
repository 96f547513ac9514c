"""Repairs of conversations against a search over all edits, and against a plain pass over the rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

from attestor.llm import turn_repair as R

PATTERN = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"


def all_edits(rows):
    """The least (cost, audit, turns) over every list of edits with at most two insertions at each place. rows: role, text, fault."""
    found = []
    gaps = ["", "u", "a", "ua", "au"]
    edits = [["D"] if fault in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for _, _, fault in rows]
    for chosen in product(*edits):
        for inserted in product(gaps, repeat=len(rows) + 1):
            turns, audit, cost = [], "", 0
            for k in range(len(rows) + 1):
                for x in inserted[k]:
                    turns.append((R.ROLES[x], ""))
                    audit, cost = audit + "I", cost + 2
                if k == len(rows):
                    break
                role, text, fault = rows[k]
                audit += chosen[k][0]
                if chosen[k] == "D":
                    cost += 3
                    continue
                cost += (2 if chosen[k][0] == "R" else 0) + (fault == "truncated")
                turns.append((R.ROLES[chosen[k][1]], text) if chosen[k][0] == "R" else (role, text))
            if PATTERN.match("".join(role[:1] or "?" for role, _ in turns)):
                found.append((cost, audit, turns))
    return min(found, key=lambda f: f[:2])


def by_pass(rows):
    """The same by a pass over the rows that keeps the least (cost, audit) of each state."""
    steps = {"0": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for p, (cost, audit) in list(states.items()):
                for q in steps[p].replace("s", ""):
                    if q not in states or (cost + 2, audit + "I") < states[q]:
                        states[q] = (cost + 2, audit + "I")
        return states

    states = inserted({"0": (0, "")})
    for role, _, fault in rows:
        after = {}

        def put(q, cost, audit, after=after):
            if q not in after or (cost, audit) < after[q]:
                after[q] = (cost, audit)

        for p, (cost, audit) in states.items():
            put(p, cost + 3, audit + "D")
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            for q in steps[p]:
                if role[:1] == q:
                    put(q, cost + extra, audit + "K")
                if q != "s":
                    put(q, cost + 2 + extra, audit + "R")
        states = inserted(after)
    return min(states[q] for q in "0a" if q in states)


def parsed(rows):
    chart = R.Chart()
    for role, _, fault in rows:
        chart.add(R.row_cell(role[:1], fault))
    return R.best(chart.whole())


def random_rows(rng, n):
    return [(rng.choice(["system", "user", "assistant", "tool", "", "user", "assistant"]), f"t{k}", rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for k in range(n)]


def test_cells_equal_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(0, 3))
        cost, audit, turns = all_edits(rows)
        assert parsed(rows) == (cost, audit)
        repaired = R.Repaired(audit)
        made = [t for role, text, _ in rows for t in repaired.row(role, text)] + list(repaired.inserted())
        assert made == turns


def test_chart_equals_a_pass_and_any_split():
    rng = random.Random(2)
    for _ in range(150):
        rows = random_rows(rng, rng.randint(0, 60))
        want = by_pass(rows)
        assert parsed(rows) == want
        cut = rng.randint(0, len(rows))
        cells = []
        for part in (rows[:cut], rows[cut:]):
            chart = R.Chart()
            for role, _, fault in part:
                chart.add(R.row_cell(role[:1], fault))
            cells.append(R.unpacked(R.packed(chart.whole())))
        assert R.best(R.combine(*cells)) == want


def expected(rows):
    """conv_id -> the row of the query, in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        hurt = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            hurt += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        judged, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in hurt:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault))
        dated = [t for t, _, _ in hurt if t is not None]
        gaps = max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0
        initials = [role[:1] for role, _, _ in judged]
        illegal = sum(x + y not in ("su", "ua", "au") or not (x and y) for x, y in zip(initials, initials[1:], strict=False))
        cost, audit = by_pass(judged) if judged else (0, "")
        repaired = R.Repaired(audit)
        made = [t for role, text, _ in judged for t in repaired.row(role, text)] + list(repaired.inserted())
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
        out[conv] = (conv, gaps, *counts.values(), illegal, cost, audit, sha)
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_equals_plain_python(spark, tmp_path):
    rng = random.Random(3)
    texts = ["Hi there.", "No end", "", " \t", "ok!", "ok!", "Why?\n", "x. ", None, "a b c", "é ü. "]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, None if rng.random() < 0.08 else turn * rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool", ""]), rng.choice(texts)))
    rows += [(500, k, rng.choice(["user", "assistant"]), rng.choice(texts) if k % 3 else f"line {k}.") for k in range(900)]  # one conversation that many tasks share
    rows += [(600, 1, "user", "same."), (600, 1, "user", "same."), (600, 1, "assistant", "same.")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, cost string")
    frame.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    from attestor.llm.queries import op12_turn_repair

    was = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for adaptive in ("true", "false"):  # without it every range stays a task of its own
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in op12_turn_repair(spark, str(tmp_path)).collect()}
            assert got == expected(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_nothing_left(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = R.repair(spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert R.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
