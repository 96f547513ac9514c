"""The greedy choice under caps equals a walk over all records, also where records of one path have different caps."""

import random

from pyspark.sql import functions as F

from attestor.operators import fields as P


def _walk(rows, limit):
    out, now, taken = [], None, []
    for r in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        if r[0] != now:
            now, taken = r[0], []
        if len(taken) < limit and sum(t[3] == r[3] for t in taken) < r[5] and sum(t[4] == r[4] for t in taken) < r[6]:
            taken.append(r)
            out.append((r[0], len(taken), r[1]))
    return out


def test_records_of_a_higher_cap_stand_behind_those_of_a_lower_one(spark):
    rng = random.Random(6)
    # a record of cap 1 that is left out takes no place from those of cap 3
    rows = [(0, d, 9.0 - d, "p", "e", 1 if d in (1, 2) else 3, 5) for d in range(6)]
    rows += [(q, d, float(rng.randint(1, 9)), rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.choice([1, 3]), (3, 5)[q % 2]) for q in range(1, 60) for d in range(40)]
    ranked = spark.createDataFrame(rows, "item_id long, doc_id long, score double, path string, entity string, p int, e int")
    got = P.diversify(ranked, F.col("p"), F.col("e"), 8).select("item_id", "rank", "doc_id").collect()
    assert sorted(tuple(r) for r in got) == _walk(rows, 8)
    assert [r.doc_id for r in sorted(got) if r.item_id == 0] == [0, 3, 4]
