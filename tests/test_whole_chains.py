from attestor.operators import claims as C


def test_long_chains_and_cycles(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(60, None), (70, 71), (71, 72), (72, 71), (80, 999), (90, 90)]
    df = spark.createDataFrame(links, "a int, b int")
    got = {r.node: (r.length, r.cycle) for r in C.chains(df, "a", "b").collect()}
    assert got == {**{k: (60 - k, False) for k in range(1, 61)}, **{k: (None, True) for k in (70, 71, 72, 90)}, 80: (1, False)}
    assert {r.node: r.length for r in C.closure(df, "a", "b").collect()}[1] == 59
