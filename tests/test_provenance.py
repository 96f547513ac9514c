import random

from pyspark.sql import functions as F

from attestor.operators import expansion as E
from attestor.operators import propagate as P

RECORD, LINK = "id string, basis string, captured string", "id string, source string"


def spread_by_hand(records, links):
    """The rule of propagate, record by record."""
    basis, date = {}, {}
    for i in {r[0] for r in records if r[0] is not None}:
        stated = {b for k, b, _ in records if k == i and b}
        basis[i] = stated.pop() if len(stated) == 1 else None
        date[i] = min((d for k, _, d in records if k == i and d), default=None)
    out = {i: (basis[i], date[i], "own", 0) if basis[i] else (None, date[i], "unknown", None) for i in basis}
    step = 0
    while True:
        step, change = step + 1, {}
        for i, (_, own, state, _) in out.items():
            seen = {s for k, s in links if k == i and s in out}
            known = {out[s][0] for s in seen if out[s][0]}
            if state == "unknown" and known:
                first = min((out[s][1] for s in seen if out[s][1]), default=None)
                change[i] = (known.pop(), first, "inherited", step) if len(known) == 1 else (None, own, "conflict", step)
        if not change:
            return sorted((i, *row) for i, row in out.items())
        out |= change


def test_propagate_by_hand(spark):
    dice = random.Random(5)
    for size in (0, 8, 60):
        ids = [f"r{k:02d}" for k in range(size)]
        records = [(i, dice.choice(["a", "b", None, None, None]), dice.choice(["2026-01-01", "2026-01-02", "2026-02-01", None])) for i in ids]
        records += [(None, "a", None)] + records[:2]
        links = [(i, dice.choice(ids)) for i in ids for _ in range(dice.randrange(3))] + [("r00", "none"), ("none", "r00"), (None, "r00"), ("r01", None)]
        links += [(i, ids[0]) for i in ids[: size // 3]]
        got = P.propagate(spark.createDataFrame(records, RECORD), spark.createDataFrame(links, LINK))
        assert got.columns == ["id", "basis", "captured", "state", "round"]
        assert sorted(tuple(r) for r in got.collect()) == spread_by_hand(records, links)


def test_propagate_long_chain_cycle_and_conflict(spark):
    chain = [("c0", "a", "d0")] + [(f"c{k}", None, None) for k in range(1, 9)]
    links = [(f"c{k}", f"c{k - 1}") for k in range(1, 9)] + [("x", "y"), ("y", "x"), ("y", "c8"), ("z", "c1"), ("z", "b")]
    records = chain + [("x", None, "dx"), ("y", None, "dy"), ("b", "b", "d1"), ("z", None, "dz")]
    rows = {r.id: tuple(r)[1:] for r in P.propagate(spark.createDataFrame(records, RECORD), spark.createDataFrame(links, LINK)).collect()}
    assert rows["c8"] == ("a", "d0", "inherited", 8)
    # the nearest record decides: b is known a round before c1, whose own link reaches z too late
    assert rows["z"] == ("b", "d1", "inherited", 1)
    assert rows["y"] == ("a", "d0", "inherited", 9) and rows["x"] == ("a", "d0", "inherited", 10)
    both = spark.createDataFrame([("p", "a", "1"), ("q", "b", "2"), ("r", None, "3")], RECORD)
    assert {r.id: r.state for r in P.propagate(both, spark.createDataFrame([("r", "p"), ("r", "q")], LINK)).collect()}["r"] == "conflict"


def test_freshness(spark):
    kind = "kind string, status string, basis string, captured string, published string"
    rows = [("document", "Superseded", None, None, "2027-01-01"), ("proposal", None, "capture_fallback", "2026-03-01", "2026-05-01"), ("document", "current", "publication", "2026-09-01", "2026-02-01"), ("status", "current", None, None, "2028-01-01")]
    got = P.freshness(spark.createDataFrame(rows, kind), F.lit("2026-02-15")).collect()
    assert [tuple(r) for r in got] == [("2026-03-01", "2026-09-01", "2026-02-15")]
    nothing = P.freshness(spark.createDataFrame([], kind), F.lit("2026-02-15")).collect()
    assert [tuple(r) for r in nothing] == [("2026-02-15", None, "2026-02-15")]


EVIDENCE = "item_id string, rank int, record string, score double, entity string, path string, section string, title string, text string, sources array<string>"
CHUNKS = "record string, chunk int, kind string, entity string, path string, section string, title string, text string"


def test_expand(spark):
    evidence = [
        ("q", 1, "claim", 4.0, "ann", "p1", "s", "Retraite", "Porter la retraite minimale a 1200 euros", ["doc", "other", "doc"]),
        ("q", 2, "claim", 0.1, "ann", "p1", "s", "Retraite", "Porter la retraite minimale a 1200 euros", ["doc"]),
        ("q", 3, None, 1.0, "bob", None, None, None, None, None),
    ]
    chunks = [
        ("claim", 0, "proposal", "ann", "p1", "s", "Retraite", " Porter la retraite minimale a 1200 euros\n"),
        ("claim", 1, "proposal", "ann", "p1", "t", "Retraite", "Le financement"),
        ("doc", 0, "document", "led", "p2", "a", "Bulletin", "La retraite minimale passe a 1200 euros"),
        ("doc", 1, "document", "led", "p2", "b", "Bulletin", "La retraite minimale"),
        ("doc", 2, "document", "led", "p2", "c", "Bulletin", "La retraite"),
        ("doc", 3, "note", "led", "p2", "d", "Bulletin", "La retraite minimale passe a 1200 euros"),
        ("other", 0, "document", "led", "p3", "a", "Rien", "Autre chose"),
        ("other", 1, "document", "led", "p3", "a", None, None),
        (None, 0, "document", "led", "p3", "a", "Rien", "La retraite minimale passe a 1200 euros"),
    ]
    frames = spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame(chunks, CHUNKS)
    got = [tuple(r) for r in E.expand(*frames).orderBy("item_id", "place").collect()]
    # one text at rank 1 and 2 has one key; its first chunk has the same key; the best supporting chunk comes first
    assert got == [
        ("q", 1, "base", None, "claim", None, "ann", None, 4.0),
        ("q", 2, "base", None, None, None, "bob", None, 1.0),
        ("q", 3, "record", None, "claim", 1, "ann", None, 2.2),
        ("q", 4, "cited", "claim", "doc", 0, "ann", "led", 2.0),
        ("q", 5, "cited", "claim", "doc", 1, "ann", "led", 2.0),
    ]
    assert E.expand(*frames, most=2).count() == 2
    assert E.expand(*frames, per_source=1).count() == 3
    assert E.expand(frames[0].where("false"), frames[1]).count() == 0


def test_support_weighs_terms_numbers_and_overlap(spark):
    row = spark.range(1).select(
        E.support(F.lit(1), F.lit(9), F.lit(5), F.lit(5)).alias("one"),
        E.support(F.lit(2), F.lit(1), F.lit(4), F.lit(10)).alias("number"),
        E.support(F.lit(3), F.lit(7), F.lit(4), F.lit(3)).alias("most"),
    )
    assert tuple(row.first()) == (0.0, 4.0, 7.0)
