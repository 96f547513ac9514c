"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (term, weight): its components that are not zero. Candidates are cut into blocks; within a
block, every term has its postings (places of the candidates that hold it, their weights). A block of query rows walks
its terms one at a time and scatters weight times posting into a dense score array; partition selection keeps the best
k of each query in the block, and a second selection merges the blocks. Scores are whole numbers, so every result is
exact and ties go to the smaller id.

Queries are those rows whose id is divisible by `every`. Every block of candidates meets every block of queries once: a
stated query set against all rows. Candidates are dealt to tasks by row, whatever their ids, so that every task holds
about the same number, at most TASK_VALUES components in all; each task gets one copy of the queries, which stream past
in blocks of a fixed number of rows. No block and no task grows with the data.

Defined results: a vector takes no part if it is null or holds a null, NaN or infinity; an empty vector takes part and
scores 0; vectors of unequal length, of any length, share the terms that both have; rows with a null id take no part; a query never
meets its own id; each row of a repeated id is a candidate, and its k best over all these rows as a query are kept, its
own rows left out; sums beyond 64 bits stop at the largest long; an empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import map_arrow, record_batch

#: Rows in a block of queries and in a block of candidates (their scores stay in a core's cache).
QUERY_BLOCK, CANDIDATE_BLOCK = 32, 8192
#: Components of the candidates that one task holds while queries stream past, and rows below which a table isn't dealt
#: out to more tasks. A sparse vector's zeros count, so tasks hold this much at most.
TASK_VALUES, LEAST_ROWS = 4_000_000, 1024
_INT32, _INT64 = np.iinfo(np.int32), np.iinfo(np.int64)


def quantised(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and weights (array<long>: floor(scale * x)) of the vectors that take part."""
    x = F.col("vector")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(fine).select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("weights"))


class Block:
    """Rows in compressed sparse form, ordered by term: for each posting its row's place and its weight, and for each
    term the span of its postings."""

    def __init__(self, ids: list[int], rows: list[np.ndarray]):
        self.ids = np.asarray(ids, np.int64)
        places = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        terms = np.concatenate([np.arange(len(r)) for r in rows])
        weights = np.concatenate(rows)
        held = np.flatnonzero(weights)
        held = held[np.argsort(terms[held], kind="stable")]
        self.places, self.weights, terms = places[held], weights[held], terms[held]
        starts = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else terms
        self.terms = dict(zip(terms[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(terms)], strict=True), strict=True))
        self.largest = max(abs(int(self.weights.max())), abs(int(self.weights.min()))) if len(terms) else 0


def accumulate(queries: Block, candidates: Block) -> np.ndarray:
    """The dense score array of two blocks, one term at a time, in the narrowest whole numbers that hold every sum."""
    most = queries.largest * candidates.largest * max(1, len(queries.terms))
    kind = np.int32 if most <= _INT32.max else np.int64 if most <= _INT64.max else object
    scores = np.zeros((len(queries.ids), len(candidates.ids)), kind)
    part = np.empty_like(scores)
    for term, (a, b) in queries.terms.items():
        if term not in candidates.terms:
            continue
        c, d = candidates.terms[term]
        weights, postings = queries.weights[a:b].astype(kind), candidates.weights[c:d].astype(kind)
        if (b - a, d - c) == scores.shape:  # every row holds the term, in the order of its place
            np.multiply.outer(weights, postings, out=part)
            scores += part
        else:
            scores[np.ix_(queries.places[a:b], candidates.places[c:d])] += np.multiply.outer(weights, postings)  # a row holds a term once
    return np.clip(scores, _INT64.min, _INT64.max).astype(np.int64) if kind is object else scores


def select(query_id: int, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of one query's best k by partition selection; ties go to the smaller id, its own id is left out."""
    other = ids != query_id
    ids, scores = ids[other], scores[other]
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        equal = equal[np.argsort(ids[equal], kind="stable")]
        keep = np.concatenate((above, equal[: k - len(above)]))
        ids, scores = ids[keep], scores[keep]
    return ids, scores


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, is_query, vec_id, weights) in order: a group's candidates are held in blocks, its queries pass."""
    now, held, ids, rows, querying = None, [], [], [], False

    def flush() -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        block = Block(ids, rows)
        ids.clear()
        rows.clear()
        if not querying:
            held.append(block)
            return
        best = [[(np.empty(0, np.int64),) * 2] for _ in block.ids]
        for candidates in held:
            scores = accumulate(block, candidates)
            for place, query in enumerate(block.ids):
                best[place].append(select(query, candidates.ids, scores[place], k))
        merged = [select(q, *map(np.concatenate, zip(*found, strict=True)), k) for q, found in zip(block.ids, best, strict=True)]
        yield record_batch(query_id=pa.array(np.repeat(block.ids, [len(m[0]) for m in merged])), vec_id=pa.array(np.concatenate([m[0] for m in merged])), score=pa.array(np.concatenate([m[1] for m in merged]).astype(np.int64)))

    for batch in batches:
        lists = batch.column(3)
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for place, (group, is_query, vec_id) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            if group != now or is_query != querying or len(ids) == (QUERY_BLOCK if querying else CANDIDATE_BLOCK):
                yield from flush()
                if group != now:
                    held = []
                now, querying = group, is_query
            ids.append(vec_id)
            rows.append(values[ends[place] : ends[place + 1]].astype(np.int64))
    yield from flush()


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products among all other rows."""
    rows = quantised(vectors, scale, id_col, vector_col)
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("weights")), F.lit(0)).alias("values")).first()
    tasks = max(1, -(-size["values"] // TASK_VALUES), min(vectors.sparkSession.sparkContext.defaultParallelism, size["rows"] // LEAST_ROWS))
    # a row's number depends on its place in its file only, so a task that is run again deals in the same way
    dealt_to = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tasks)).cast("int")
    candidates = rows.select(dealt_to.alias("group"), F.lit(False).alias("is_query"), "vec_id", "weights")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("group"), F.lit(True).alias("is_query"), "vec_id", "weights")
    dealt = candidates.unionByName(queries).repartitionById(tasks, "group").sortWithinPartitions("group", "is_query")
    best = map_arrow(dealt, lambda batches: _search(batches, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
