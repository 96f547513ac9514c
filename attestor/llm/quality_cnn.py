"""Quality classifier: a byte-level convolutional network in numpy.

The input is a text's UTF-8 bytes, seen through two kinds of channels. In the first, WIDTH consecutive bytes meet each
of FILTERS learned filters (one weight for each byte value at each place). The second shows repetition, which a filter
over byte values can't: whether a byte equals the one `lag` places later, averaged over strides of STRIDE bytes and
max-pooled over LAGS lags; TAPS strides meet each of ECHO_FILTERS learned filters. All responses are taken over
overlapping chunks that together cover the whole document, and max-pooled over all chunks. A hidden layer combines the
pooled values into one probability.

Fitting is done on the driver over a bounded sample (TRAIN_ROWS rows of at most TRAIN_BYTES each); scoring is spread by
Spark and reads whole texts. Max pooling passes each gradient to one place of a document, so that a step costs little.

Defined results: a null or empty text is scored like any other (all pooled values are 0); texts shorter than a filter
are padded with zero bytes, and what a stride or a filter lacks at a text's end counts as no repetition; texts of any
length are read whole; without labelled rows of both classes every score is the share of label 1 (0.5 without any);
repeated rows get the same score; an empty table gives an empty result; other input columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import crc32_mod, map_arrow, record_batch
from attestor.llm.labelled import labelled_sample

WIDTH, FILTERS, HIDDEN = 6, 16, 12
LAGS, STRIDE, TAPS, ECHO_FILTERS = 24, 8, 6, 4
#: Bytes of a chunk, a multiple of STRIDE. What a filter needs of the next chunk belongs to both.
CHUNK = 4096
TRAIN_ROWS, TRAIN_BYTES, BATCH = 4000, 20_000, 32
#: Passes over the sample, and optimiser steps at least (small samples are passed over more often).
EPOCHS, LEAST_STEPS = 8, 800


class Network:
    def __init__(self, seed: int = 5):
        random = np.random.default_rng(seed)
        pooled = FILTERS + ECHO_FILTERS
        self.weights = {
            "filters": random.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "echo": random.normal(0, TAPS**-0.5, (TAPS, ECHO_FILTERS)).astype(np.float32),
            "echo_bias": np.zeros(ECHO_FILTERS, np.float32),
            "w1": random.normal(0, pooled**-0.5, (pooled, HIDDEN)).astype(np.float32),
            "b1": np.full(HIDDEN, 0.1, np.float32),
            "w2": random.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def convolve(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each byte filter over all chunks, and the place where it is."""
        filters, places = self.weights["filters"], len(data) - WIDTH + 1
        best, at = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
        for start in range(0, places, CHUNK):
            n = min(CHUNK, places - start)
            out = filters[0][data[start : start + n]]
            for k in range(1, WIDTH):
                out += filters[k][data[start + k : start + k + n]]
            top = out.max(axis=0)
            better = np.flatnonzero(top > best)
            if len(better):
                at[better] = out[:, better].argmax(axis=0) + start
                best[better] = top[better]
        return best, at

    @staticmethod
    def prepared(text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        return data if len(data) >= WIDTH else np.concatenate((data, np.zeros(WIDTH - len(data), np.uint8)))

    @staticmethod
    def echoes(data: np.ndarray) -> np.ndarray:
        """The repetition channel: for each stride, the largest share of its bytes that equal the byte `lag` later, over
        all lags. TAPS - 1 strides of zeros follow the end."""
        best = np.zeros(-(-len(data) // STRIDE) + TAPS - 1, np.uint8)
        for lag in range(1, min(LAGS, len(data) - 1) + 1):
            counts = np.bitwise_count(np.packbits(data[:-lag] == data[lag:]))
            np.maximum(best[: len(counts)], counts, out=best[: len(counts)])
        return best.astype(np.float32) / STRIDE

    def resound(self, channel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each echo filter to a repetition channel, and what it met there."""
        echo, places = self.weights["echo"], len(channel) - TAPS + 1
        out = np.multiply.outer(echo[0], channel[:places])
        for k in range(1, TAPS):
            out += np.multiply.outer(echo[k], channel[k : k + places])
        at = out.argmax(axis=1)
        return out[np.arange(ECHO_FILTERS), at], channel[at[:, None] + np.arange(TAPS)]

    def echo(self, data: np.ndarray) -> np.ndarray:
        """The largest response of each echo filter over all chunks. A chunk reaches over its end as far as the filters
        and the largest lag do."""
        best = np.full(ECHO_FILTERS, -np.inf, np.float32)
        for start in range(0, len(data), CHUNK):
            strides = -(-min(CHUNK, len(data) - start) // STRIDE)
            channel = self.echoes(data[start : start + CHUNK + (TAPS - 1) * STRIDE + LAGS])[: strides + TAPS - 1]
            np.maximum(best, self.resound(channel)[0], out=best)
        return best

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        hidden = np.maximum(pooled @ w["w1"] + w["b1"], 0)
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ w["w2"] + w["b2"][0], -30, 30)))

    def pooled(self, text: str | None) -> np.ndarray:
        data = self.prepared(text)
        if not data.any():
            return np.zeros(FILTERS + ECHO_FILTERS, np.float32)
        return np.maximum(np.concatenate((self.convolve(data)[0] + self.weights["bias"], self.echo(data) + self.weights["echo_bias"])), 0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.empty(0)
        return self.head(np.stack([self.pooled(t) for t in texts]))[1].astype(float)

    def fit(self, texts: list[str], labels: list[int], seed: int = 11) -> Network:
        y = np.asarray(labels, np.float32)
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        random, data = np.random.default_rng(seed), [self.prepared(t) for t in texts]
        channels = [self.echoes(d) for d in data]
        share = y.mean()
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        step = 0
        batches = max(1, len(y) // BATCH)
        epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for rows in np.array_split(random.permutation(len(y)), batches):
                w = self.weights
                found, heard = [self.convolve(data[i]) for i in rows], [self.resound(channels[i]) for i in rows]
                raw = np.concatenate((np.stack([f[0] for f in found]) + w["bias"], np.stack([h[0] for h in heard]) + w["echo_bias"]), axis=1)
                pooled = np.maximum(raw, 0)
                hidden, p = self.head(pooled)
                out = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                g = {"b2": np.array([out.sum()], np.float32), "w2": hidden.T @ out}
                back = out[:, None] * w["w2"] * (hidden > 0)
                g["b1"], g["w1"] = back.sum(axis=0), pooled.T @ back
                back = (back @ w["w1"].T) * (raw > 0)
                sounded, back = back[:, FILTERS:], back[:, :FILTERS]
                g["echo_bias"], g["echo"] = sounded.sum(axis=0), np.einsum("rf,rft->tf", sounded, np.stack([h[1] for h in heard]))
                g["bias"], g["filters"] = back.sum(axis=0), np.zeros_like(w["filters"])
                for i, (_, at), b in zip(rows, found, back, strict=True):
                    for k in range(WIDTH):
                        g["filters"][k, data[i][at + k], np.arange(FILTERS)] += b
                step += 1
                for name, grad in g.items():
                    grad = grad + 1e-5 * w[name]
                    first[name] += 0.1 * (grad - first[name])
                    second[name] += 0.001 * (grad * grad - second[name])
                    w[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Network:
    """A network fitted on the labelled documents outside the held-out fold."""
    rows = labelled_sample(docs, labels, "quality", crc32_mod("doc_id", folds) != held_out, TRAIN_ROWS, TRAIN_BYTES).orderBy("doc_id", "label", "text").collect()
    return Network().fit([r.text for r in rows], [r.label for r in rows])


def scored(docs: DataFrame, network: Network, column: str = "score") -> DataFrame:
    """docs with a column of scores; a column of that name is replaced."""
    kept = docs.drop(column)
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(network.scores(batch.column(place).to_pylist()), pa.float64())], names=[*batch.schema.names, column])

    return map_arrow(kept, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{column}` double"]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    network = fit(docs, labels, folds, held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(doc_id=batch.column(0), score=pa.array(network.scores(batch.column(1).to_pylist()), pa.float64()))

    return map_arrow(rows, run, "doc_id long, score double").select("doc_id", F.coalesce(crc32_mod("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
