import numpy as np
import pytest

from attestor.llm import mixing

TARGETS = np.array([0.5, 0.2, 0.15, 0.15])


@pytest.mark.parametrize("shares", [(0.02, 0.02, 0.02, 0.94), (0.97, 0.01, 0.01, 0.01)])
def test_rare_domains_reach_their_targets(spark, shares):
    cells = spark.createDataFrame([([float(d == k) for d in range(4)], round(1e6 * s)) for k, s in enumerate(shares)], "posterior array<double>, tokens long")
    rates = cells.withColumn("r", mixing.rate(cells.posterior, mixing.fit_rates(cells, TARGETS))).collect()
    reached = np.array([next(r.r for r in rates if r.posterior[d]) for d in range(4)]) * shares / TARGETS
    # with one domain a text, the optimum is known
    want = np.array([(1 + 1e-3) / (s / t + 1e-3) * s / t for s, t in zip(shares, TARGETS, strict=True)])
    assert np.abs(reached - want).max() < 1e-5 and reached.min() > 0.97


@pytest.mark.parametrize("targets", [(0.6, 0.4, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0), (0.9999, 0.0001, 0.0, 0.0)])
def test_zero_targets(spark, targets):
    rng = np.random.default_rng(3)
    p = np.vstack([np.eye(4), rng.dirichlet(np.ones(4) * 0.3, 60)])
    p = np.floor(p * 64) / 64
    p[:, 0] += 1 - p.sum(axis=1)
    tokens = rng.integers(1, 1000, len(p))
    cells = spark.createDataFrame([(row.tolist(), int(n)) for row, n in zip(p, tokens, strict=True)], "posterior array<double>, tokens long")
    t = np.array(targets)
    got = {tuple(r.posterior): r.r for r in cells.withColumn("r", mixing.rate(cells.posterior, mixing.fit_rates(cells, t))).collect()}
    w, v, r = tokens / tokens.sum(), np.maximum(t, mixing.LEAST_TARGET), np.array([got[tuple(row)] for row in p.tolist()])
    shares = (w * r) @ p
    # the optimum of the rates: no gradient where a rate is above 0, and none that would raise a rate of 0
    gradient = p @ ((shares - t) / v) + mixing.RIDGE * (r - 1)
    assert np.abs(gradient[r > 0]).max() < 1e-5 and gradient[r == 0].min(initial=0) > -1e-5
    assert shares[t == 0].max() < 2e-3  # the ridge keeps the rest from being met exactly where a domain has few tokens


def test_impossible_targets(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for targets in ({"a": 0.0, "b": 0.0}, {"a": 1.5, "b": -0.5}):
        with pytest.raises(ValueError):
            mixing.rates(docs, docs.selectExpr("doc_id", "'a' AS domain"), targets)
