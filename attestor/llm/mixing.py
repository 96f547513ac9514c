"""Mixing sources to target weights with soft membership.

1. A labelled table (doc_id, domain) teaches a softmax classifier over hashed byte trigrams; every whole text gets its
   posterior over the domains, in steps of 1 / STEPS that add up to 1.
2. With w_i the share of all tokens that document i holds and p_i its posterior, a nonnegative rate r_i for each
   document is fitted by least squares: the expected token shares s = sum w_i r_i p_i shall meet the targets t,
       minimise  1/2 sum_d (s_d - t_d)^2 / v_d  +  RIDGE/2 sum_i w_i (r_i - 1)^2,   r >= 0,
   with v_d = t_d, or LEAST_TARGET where the target is smaller (or 0, a domain that shall have no tokens).
   This is done by projected gradient steps that are scaled by the second derivatives (projected Newton): the rates go
   along the scaled gradient and are projected on r >= 0. After any such step the rates are max(0, 1 - p_i . c / RIDGE)
   for one residual c_d per domain, c = (s - t) / v at the optimum, so a vector over the domains is all the state. The
   steps are halved until they descend on the convex function of c whose minimum is the optimum,
       RIDGE/2 sum_i w_i r_i(c)^2 + sum_d (t_d c_d + v_d c_d^2 / 2).
   Each step is one Spark aggregation over the distinct posteriors with their tokens; nothing but a vector and a matrix
   over the domains reaches the driver. The steps end when every share meets its optimum within TOLERANCE of its target;
   if they can't get there, in MOST_ROUNDS or at all, it is an error. So are negative targets and targets that are all 0.
3. `mixed` repeats each document floor(rate + u) times, u in [0, 1) from a hash of its id: expected totals follow the
   rates, and the same input gives the same result.

Tokens are words between ASCII white space. The targets are weights of a fixed list of domains.

Defined results: null and empty texts have no tokens and get the posterior of an empty text and its rate; without
labelled rows all posteriors are uniform; a domain that no document belongs to can't be met and is left; an empty table
gives an empty result; texts of any length are read whole; repeated rows get the same rate; a null id counts as one id;
other columns, whatever their names, are kept by `mixed`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import map_arrow, materialize, shared_dir
from attestor.llm.labelled import labelled_sample

BUCKETS, STEPS, TRAIN_ROWS, TRAIN_BYTES, EPOCHS = 2048, 64, 3000, 20_000, 60
RIDGE, TOLERANCE, LEAST_TARGET, MOST_ROUNDS = 1e-3, 1e-7, 1e-3, 200


def features(text: str | None) -> np.ndarray:
    """Square roots of hashed byte-trigram counts, of length 1."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if len(data) < 3:
        return np.zeros(BUCKETS, np.float32)
    counts = np.zeros(BUCKETS, np.int64)
    for k in range(0, len(data) - 2, 1 << 16):
        part = data[k : k + (1 << 16) + 2].astype(np.uint32)
        code = (part[:-2] * np.uint32(65599) + part[1:-1] * np.uint32(257) + part[2:]) * np.uint32(2654435769)
        counts += np.bincount(code >> np.uint32(21), minlength=BUCKETS)
    out = np.sqrt(counts.astype(np.float32))
    return out / np.linalg.norm(out)


class DomainClassifier:
    """Softmax regression fitted by Adam steps over all rows of a bounded sample."""

    def __init__(self, domains: int):
        self.weights, self.bias = np.zeros((BUCKETS, domains), np.float32), np.zeros(domains, np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> DomainClassifier:
        if not len(y):
            return self
        target = np.eye(len(self.bias), dtype=np.float32)[y]
        moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (self.weights, self.bias)]
        for step in range(1, EPOCHS + 1):
            out = (self.probabilities(x) - target).astype(np.float32) / len(y)
            for value, grad, m in zip((self.weights, self.bias), (x.T @ out + 1e-5 * self.weights, out.sum(axis=0)), moments, strict=True):
                m[0] += 0.1 * (grad - m[0])
                m[1] += 0.01 * (grad * grad - m[1])
                value -= 0.3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        """Rows of whole steps, as doubles: what rounding leaves over goes to the largest."""
        p = self.probabilities(np.stack([features(t) for t in texts])) if texts else np.empty((0, len(self.bias)))
        steps = np.floor(p * STEPS).astype(int)
        steps[np.arange(len(p)), p.argmax(axis=1)] += STEPS - steps.sum(axis=1)
        return steps / STEPS


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DomainClassifier:
    """labelled: (doc_id, domain). At most TRAIN_ROWS texts of at most TRAIN_BYTES reach the driver."""
    numbered = labelled.select("doc_id", (F.array_position(F.array(*map(F.lit, domains)), F.col("domain").cast("string")) - 1).alias("number"))
    rows = labelled_sample(docs, numbered, "number", F.lit(True), TRAIN_ROWS, TRAIN_BYTES, len(domains)).orderBy("doc_id", "label", "text").collect()
    return DomainClassifier(len(domains)).fit(np.stack([features(r.text) for r in rows]) if rows else np.empty((0, BUCKETS)), np.array([r.label for r in rows], int))


def with_posteriors(docs: DataFrame, classifier: DomainClassifier, tokens_col: str, posterior_col: str) -> DataFrame:
    kept = docs.drop(tokens_col, posterior_col)
    place, width = kept.columns.index("text"), len(classifier.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            ends = np.arange(len(texts) + 1, dtype=np.int32) * width
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(classifier.posteriors(texts).ravel(), pa.float64()))
            tokens = pa.array([len(t.encode("utf-8", "replace").split()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens, lists], names=[*batch.schema.names, tokens_col, posterior_col])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{tokens_col}` long", f"`{posterior_col}` array<double>"])
    return map_arrow(kept, run, schema)


def rate(posterior: Column, residuals: np.ndarray) -> Column:
    """The rate of a posterior for one residual per domain."""
    pull = F.aggregate(F.zip_with(posterior, F.array(*[F.lit(float(c)) for c in residuals]), lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.greatest(F.lit(0.0), 1 - pull / F.lit(RIDGE))


def fit_rates(cells: DataFrame, targets: np.ndarray) -> np.ndarray:
    """The residual of each domain at the optimum; zeros without tokens. cells: posterior, tokens."""
    width = len(targets)
    p = [F.col("posterior")[d] for d in range(width)]
    total = cells.agg(F.sum("tokens").alias("t")).first().t
    if not total:
        return np.zeros(width)
    scale = np.maximum(targets, LEAST_TARGET)
    share = F.col("tokens") / F.lit(float(total))

    def measured(c: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The function at c, its gradient and its second derivatives."""
        rows = cells.withColumn("r", rate(F.col("posterior"), c)).withColumn("w", share)
        found = rows.agg(
            F.sum(F.col("w") * F.col("r") * F.col("r")),
            *[F.sum(F.col("w") * F.col("r") * p[d]) for d in range(width)],
            *[F.sum(F.when(F.col("r") > 0, F.col("w") * p[a] * p[b]).otherwise(0.0)) for a in range(width) for b in range(width)],
        ).first()
        numbers = np.array(list(found))
        value = RIDGE / 2 * numbers[0] + float((targets * c + scale * c * c / 2).sum())
        return value, targets + scale * c - numbers[1 : width + 1], numbers[width + 1 :].reshape(width, width) / RIDGE + np.diag(scale)

    c = np.zeros(width)
    value, gradient, second = measured(c)
    for _ in range(MOST_ROUNDS):
        if (np.abs(gradient) / scale).max() <= TOLERANCE:
            return c
        way, size = np.linalg.solve(second, -gradient), 1.0
        slope = float(gradient @ way)
        while True:
            new = measured(c + size * way)
            # near the optimum the function's change is lost in rounding, but the gradient still shrinks
            if new[0] <= value + 1e-4 * size * slope or np.abs(new[1]).max() < 0.5 * np.abs(gradient).max():
                break
            size /= 2
            if not size > 1e-9:
                break
        if not (size > 1e-9 and np.isfinite(new[0])):
            break
        c = c + size * way
        value, gradient, second = new
    raise ArithmeticError(f"mixing: the rates don't converge; gradient {gradient.tolist()} at residuals {c.tolist()}")


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (doc_id if not given) with n_tokens, posterior, rate and copies."""
    domains = list(targets)
    weights = np.array([targets[d] for d in domains], float)
    if not (weights >= 0).all() or not weights.sum() > 0:
        raise ValueError(f"mixing: targets must be 0 or more, and not all 0: {targets}")
    classifier = fit(docs, labelled, domains)
    folder = shared_dir(docs.sparkSession)
    rows = with_posteriors(docs.select(*(keep or ["doc_id"]), *([] if keep and "text" in keep else ["text"])), classifier, "__tokens", "__posterior")
    narrow = materialize(rows.select(*[c for c in rows.columns if c != "text" or "text" in (keep or [])]), folder, "posteriors")
    cells = materialize(narrow.groupBy(F.col("__posterior").alias("posterior")).agg(F.sum("__tokens").alias("tokens")), folder, "cells")
    residuals = fit_rates(cells, weights / weights.sum())
    # 53 bits of a hash of the id, as a number in [0, 1)
    u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("copies")), 11) / F.lit(float(1 << 53))
    return (
        narrow.withColumn("__rate", rate(F.col("__posterior"), residuals))
        .withColumn("__copies", F.floor(F.col("__rate") + u).cast("int"))
        .withColumnsRenamed({"__tokens": "n_tokens", "__posterior": "posterior", "__rate": "rate", "__copies": "copies"})
    )


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """docs with each row as often as its copies say."""
    plain = [f"c{k}" for k in range(len(docs.columns))]  # input columns may have any names
    names = [c if c in ("doc_id", "text") else new for c, new in zip(docs.columns, plain, strict=True)]
    counted = rates(docs.toDF(*names), labelled, targets, keep=names)
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).where("copies > 0").select(*names).toDF(*docs.columns)
