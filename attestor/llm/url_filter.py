"""URL filter: segmented host and path tokens scored by multinomial naive Bayes, below explicit rules.

Concatenated names are split into words by a unigram Viterbi search; the words and their order of frequency are those
of a public word-end vocabulary file (rank r stands for a probability in proportion to 1 / (r + RANK_SHIFT)). Path
tokens have their digits replaced by 0. Tokens are hashed into BUCKETS buckets, so that the model has a fixed size.

There are no labelled urls, so the model is learned from weak examples by expectation maximisation. The examples are
all distinct pairs of host and path shape (a path with its digits replaced), so a host that holds a third of all pages
doesn't outweigh the others. At first an example is of class block with weight SEEDED if a word of its host is a seed
word, and of class allow otherwise. In each of ROUNDS rounds Spark counts the tokens of all examples by class, and the
examples without a seed word get the class probabilities that these counts give them, so that words which go with seeds
(free, cheap, a path that only such hosts have) become evidence themselves. A seed word counts through its bucket like
any other word: a host with one whose other words and paths are those of allowed hosts is allowed, and a host without
one whose words are those of blocked hosts is blocked. Buckets seen once are not used.

A rule (host, path, verdict) fits its host and all its subdomains if the url's path starts with the rule's; the longest
rule wins over the score.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and has no tokens, so the
classes' shares decide; repeated urls get the same verdict; ties between rules of equal length go to the earlier one;
an empty table gives an empty result; names of any length are searched whole, in time in proportion to it; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import drop_dir, map_arrow, materialize, record_batch, shared_dir

BUCKETS, RANK_SHIFT, CACHE_ENTRIES = 1 << 16, 20, 200_000
#: Log probability of an unknown stretch: for each stretch and for each of its letters.
UNKNOWN = -12.0, -2.5
#: Pseudo-count of a seed word in class block, and of any bucket in either class.
SEED_WEIGHT, SMOOTHING = 3.0, 0.5
#: Probability of class block of a seeded example, rounds of expectation maximisation, and the least difference of log
#: odds between classes at which a round takes an example for block at all (half and half isn't evidence).
SEEDED, ROUNDS, SURE = 0.9, 4, 2.0
SEEDS = "casino poker jackpot roulette slots bet bets betting gambling lottery adult porn porno xxx sex nude escort ads adserver advert banner popup tracker doubleclick affiliate viagra cialis pills payday warez crack torrent malware phishing spam".split()

_SEGMENTERS: dict[str, "Segmenter"] = {}


class Segmenter:
    """Unigram Viterbi over the words of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        words = [t.removesuffix("</w>") for t in sorted(vocab, key=vocab.get) if t.endswith("</w>")]
        words = [*dict.fromkeys([w for w in words if w.isascii() and w.isalpha() and len(w) > 1] + SEEDS)]
        mass = math.log(sum(1 / (r + RANK_SHIFT) for r in range(len(words))))
        self.cost = {w: -math.log(r + RANK_SHIFT) - mass for r, w in enumerate(words)}
        self.longest = max(map(len, words))
        self.known: dict[str, tuple[str, ...]] = {}

    def words(self, name: str) -> tuple[str, ...]:
        """The most probable split of a name of letters into words."""
        if name not in self.known:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[name] = tuple(self._best(name))
        return self.known[name]

    def _best(self, name: str) -> list[str]:
        n = len(name)
        score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                part = name[start:end]
                s = score[start] + self.cost.get(part, UNKNOWN[0] + UNKNOWN[1] * (end - start))
                if s > score[end]:
                    score[end], back[end] = s, start
        out = []
        while n:
            out.append(name[back[n] : n])
            n = back[n]
        return out[::-1]


def segmenter(path: str) -> Segmenter:
    if path not in _SEGMENTERS:
        _SEGMENTERS[path] = Segmenter(path)
    return _SEGMENTERS[path]


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://"."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; empty without "://"."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule (host, path, verdict) that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for h, p, _ in ordered]
    nothing = F.lit(None).cast("string")
    return tuple(F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)], nothing) for values in ([h + p for h, p, _ in ordered], [v for _, _, v in ordered]))


def tokens(host: str, path: str, split: Segmenter) -> tuple[list[str], bool]:
    """Tokens of a url and whether a word of its host is a seed."""
    words = [w for part in regex.findall(r"[^\W\d_]+|\d+", host) for w in (split.words(part) if not part.isdigit() else ("0",))]
    own = [f"h {w}" for w in words]
    for part in regex.findall(r"[^\W\d_]+|\d+", path.lower()):
        own.extend(f"p {w}" for w in (("0",) if part.isdigit() else split.words(part)))
    return own, not set(SEEDS).isdisjoint(words)


def bucket(token: str) -> int:
    return xxhash.xxh32_intdigest(token.encode("utf-8", "replace")) % BUCKETS


class Bayes:
    """Weights of buckets: log odds of block against allow, 0 where a bucket isn't used."""

    def __init__(self, rows: list[tuple[int, float, float]], blocked: float, allowed: float):
        counts = np.zeros((BUCKETS, 2))
        for b, block, allow in rows:
            counts[b] = block, allow
        used, seeds = counts.sum(axis=1) >= 2 - 1e-9, [bucket(f"h {seed}") for seed in SEEDS]
        used[seeds] = True
        mass = counts[used].sum(axis=0) + SMOOTHING * used.sum()  # without the pseudo-counts of the many seeds
        counts[seeds, 0] += SEED_WEIGHT
        self.weights = np.where(used, np.log((counts[:, 0] + SMOOTHING) / mass[0]) - np.log((counts[:, 1] + SMOOTHING) / mass[1]), 0.0)
        self.prior = math.log((blocked + 1) / (allowed + 1))

    def score(self, own: list[str]) -> float:
        return self.of_buckets([bucket(t) for t in own])

    def of_buckets(self, own: list[int]) -> float:
        return self.prior + float(sum(self.weights[b] for b in own))


def belief(model: Bayes | None, own: list[int], seeded: bool) -> float:
    """The probability of class block with which an example is counted."""
    if seeded:
        return SEEDED
    score = model.of_buckets(own) if model else 0.0
    return 0.0 if score < SURE else 1 / (1 + math.exp(-min(score, 30.0)))


def fit(parts: DataFrame, vocabulary: str) -> Bayes:
    """A model of all urls. At most BUCKETS rows of counts reach the driver in each round."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = segmenter(vocabulary)
        for batch in batches:
            found = [tokens(host, path, split) for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield record_batch(buckets=pa.array([[bucket(t) for t in own] for own, _ in found], pa.list_(pa.int32())), seeded=pa.array([s for _, s in found], pa.bool_()))

    shapes = parts.where("host <> ''").select("host", F.regexp_replace("path", "[0-9]+", "0").alias("path")).distinct()
    folder = shared_dir(parts.sparkSession)
    examples = materialize(map_arrow(shapes, read, "buckets array<int>, seeded boolean"), folder, "examples")
    model = None
    for _ in range(ROUNDS):

        def count(batches: Iterator[pa.RecordBatch], model: Bayes | None = model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts: dict[int, list[float]] = {-1: [0.0, 0.0]}
                for own, seeded in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    block = belief(model, own, seeded)
                    for b in (-1, *own):
                        cell = counts.setdefault(b, [0.0, 0.0])
                        cell[0] += block
                        cell[1] += 1 - block
                yield record_batch(bucket=pa.array(list(counts), pa.int32()), block=pa.array([c[0] for c in counts.values()], pa.float64()), allow=pa.array([c[1] for c in counts.values()], pa.float64()))

        rows = map_arrow(examples, count, "bucket int, block double, allow double").groupBy("bucket").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).collect()
        classes = next(((r.block, r.allow) for r in rows if r.bucket < 0), (0.0, 0.0))
        # sums of doubles in any order: rounded, so that the order doesn't show
        model = Bayes([(r.bucket, round(r.block, 6), round(r.allow, 6)) for r in rows if r.bucket >= 0], *(round(c, 6) for c in classes))
    drop_dir(parts.sparkSession, folder)
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], vocabulary: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of block) for each row of pages."""
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    model = fit(parts, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = segmenter(vocabulary)
        for batch in batches:
            scores = [model.score(tokens(h, p, split)[0]) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=["page_id", "host", "path", "score"])

    scored = map_arrow(parts, run, "page_id long, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
