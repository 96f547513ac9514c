"""Batch retrieval: a table of questions against an inverted index of texts.

Nothing scans all texts for each question: questions and texts meet by an equi-join on terms. The term index of a corpus is
written once and read by every query over the same files."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import terms
from attestor.session import shared_base, ship_package, spread, written


#: The free parameters of BM25: saturation of term counts, and how far lengths count.
K1, B = 1.2, 0.72


@dataclass(frozen=True)
class Index:
    """Term counts, df, and lengths of a corpus. impact: the saturated term count, to be multiplied by idf; peak: its largest value
    for a term, so idf * peak is the most that the term adds to any text's score."""

    terms: DataFrame  # doc_id, term, tf, impact
    df: DataFrame  # term, df, peak
    lengths: DataFrame  # doc_id, length


def _with_impact(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Postings: an expression over the kept counts, so that they are neither shuffled to their lengths nor written again."""
    mean = lengths.agg(F.avg("length")).scalar()
    rows = counts.withColumn("mean", mean)
    return rows.select("doc_id", "term", "tf", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))).alias("impact"))


def _kept_parts(docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """counts (doc_id, length, term, tf) and lengths. Rows that share a doc_id are one text; only then are counts shuffled."""
    counted = terms.counts_in_rows(spread(docs.select("doc_id", "text")), "doc_id", F.col("text"))
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not shared.isEmpty():
        counted = counted.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
        counted = counted.withColumn("length", F.sum("tf").over(Window.partitionBy("doc_id")))
    counts = keep(counted.select("doc_id", "length", "term", "tf"), "counts")
    return counts, keep(counts.groupBy("doc_id").agg(F.first("length").alias("length")), "lengths")


def _built(docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> Index:
    """Texts are cut into terms once; the counts are kept, and all statistics read them from there."""
    counts, lengths = _kept_parts(docs, keep)
    postings = _with_impact(counts, lengths)
    return Index(postings, keep(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("peak")), "df"), lengths)


def build_index(docs: DataFrame) -> Index:
    return _built(docs, lambda df, _: written(df))


def _rules() -> str:
    """A digest of everything that decides an index's content: how words are cut, what impact is made of, and its tables."""
    cut = re.sub(r"_\d+", "", str(T.words(F.col("text"))))  # without the numbers of lambda variables
    return hashlib.sha256(f"{cut} {K1} {B} counts, df, lengths".encode()).hexdigest()[:16]


def kept_index(docs: DataFrame) -> Index:
    """The index of a table of files, from the shared folder if there is one of the same files (path, size and time of
    change) and the same rules already; otherwise it is built and kept. Each build has its own folder and is ready when
    its mark is written, so builds at the same time don't meet; one that fails is removed. What isn't made of files gets
    an index of its own."""
    spark = docs.sparkSession
    try:
        file = docs.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("f"))
    except AnalysisException:
        return build_index(docs)
    version = file.distinct().agg(F.coalesce(F.bit_xor("f"), F.lit(0)).alias("x"), F.count(F.lit(1)).alias("n")).first()
    base = f"{shared_base(spark)}/attestor-index-{_rules()}-{version.n}-{version.x & (1 << 64) - 1:016x}"
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = to_path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    builds = [s.getPath() for s in files.listStatus(to_path(base))] if files.exists(to_path(base)) else []
    ready = sorted(p.toString() for p in builds if files.exists(to_path(p, "_ready")))
    path = ready[0] if ready else f"{base}/{uuid.uuid4().hex}"
    if not ready:

        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")

        try:
            _built(docs, keep)
            files.create(to_path(path, "_ready")).close()
        except BaseException:
            files.delete(to_path(path), True)
            raise
    counts, df, lengths = (spark.read.parquet(f"{path}/{name}") for name in ("counts", "df", "lengths"))
    return Index(_with_impact(counts, lengths), df, lengths)


def question_terms(questions: DataFrame) -> DataFrame:
    """(item_id, term): all distinct tokens of each question."""
    return questions.select("item_id", F.explode(T.tokens(F.col("text"))).alias("term"))


def weighed(index: Index, asked: DataFrame) -> DataFrame:
    """(item_id, term, df, idf, ceiling, and further columns) of the asked terms that some text has."""
    texts = index.lengths.agg(F.count(F.lit(1))).scalar()
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(index.df, "term").withColumn("n", texts).withColumn("idf", idf).select("item_id", "term", "df", "idf", (F.col("idf") * F.col("peak")).alias("ceiling"), *(c for c in asked.columns if c not in ("item_id", "term")))


def _summed(weights: DataFrame, postings: DataFrame, *on: str) -> DataFrame:
    found = weights.join(postings, list(on))
    return found.groupBy("item_id", "doc_id").agg(F.sum(F.col("idf") * F.col("impact")).alias("score"), F.count(F.lit(1)).alias("hits"))


def bm25(index: Index, asked: DataFrame) -> DataFrame:
    """(item_id, doc_id, score, hits): the sum over shared terms of idf and saturated term frequency, for every text that shares one."""
    return _summed(weighed(index, asked), index.terms, "term").withColumn("score", F.round("score", 6))


#: A question's rarest terms, until they have so many postings, name its leaders; so many times k of them are scored whole for the threshold.
SEED_POSTINGS, LEADERS = 50, 4
#: What optional terms may add at most, as a share of the threshold: less makes more terms needed, but leaves fewer texts to look up.
OPTIONAL = 0.5
#: Scores are compared after rounding to six places, so a bound must fall short by more than that.
SLACK = 1e-5


def contenders(index: Index, asked: DataFrame, k: int = 1, share: float = 1.0) -> DataFrame:
    """As bm25, but only texts that can reach `share` times their question's k-th best score; all that do are there.

    The rarest terms of a question name some texts. The best of these are scored whole, and `share` of the k-th best is a
    threshold. A question's terms of the least ceilings whose sum stays below it are optional: a text that has only those
    can't reach it. So the postings of the other terms, the needed ones, name all texts in question; those that even with
    the ceilings of all optional terms stay below the threshold are left out, and only for the rest the optional terms are
    looked up. Frequent words have low ceilings, so their long postings are never joined with questions."""
    weights = weighed(index, asked)
    rising = Window.partitionBy("item_id").orderBy("df", "term")
    weights = weights.withColumn("so_far", F.sum("df").over(rising)).withColumn("place", F.row_number().over(rising))
    weights = written(weights.select("item_id", "term", "idf", "ceiling", (F.col("so_far") - F.col("df") < SEED_POSTINGS).alias("seed")))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")

    def whole(rows: DataFrame, others: DataFrame) -> DataFrame:
        """rows with the terms of `others` looked up in their texts."""
        # written, so that Spark knows its size: while that is small it goes to the postings, else both are shuffled
        wanted = written(rows.select("item_id", "doc_id").join(others.select("item_id", "term", "idf"), "item_id"))
        rest = _summed(wanted, index.terms, "doc_id", "term").select("item_id", "doc_id", F.col("score").alias("rest"), F.col("hits").alias("others"))
        found = rows.join(rest, ["item_id", "doc_id"], "left")
        return found.select("item_id", "doc_id", (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"), (F.col("hits") + F.coalesce("others", F.lit(0))).alias("hits"))

    place = F.row_number().over(order)
    leaders = written(_summed(weights.where("seed"), index.terms, "term").withColumn("place", place).where(F.col("place") <= LEADERS * k).drop("place"))
    least = whole(leaders, weights.where("not seed")).withColumn("place", place).where(F.col("place") == k).select("item_id", (share * F.col("score") - SLACK).alias("least"))
    low = Window.partitionBy("item_id").orderBy("ceiling", "term").rowsBetween(Window.unboundedPreceding, 0)
    split = written(weights.join(least, "item_id", "left").withColumn("optional", F.coalesce(F.sum("ceiling").over(low) < OPTIONAL * F.col("least"), F.lit(False))))
    more = F.sum(F.when(F.col("optional"), F.col("ceiling")).otherwise(0.0))
    bounds = split.groupBy("item_id").agg((F.first("least") - more).alias("part"))
    parts = _summed(split.where("not optional"), index.terms, "term").join(bounds, "item_id")
    open_ = written(parts.where(F.col("part").isNull() | (F.col("score") >= F.col("part"))).drop("part"))
    return whole(open_, split.where("optional")).withColumn("score", F.round("score", 6))


def best(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The k best texts of each question with their rank: top(bm25(...), k), scored in blocks. Lookups in all postings, as
    `contenders` makes them, turn into a shuffle of the whole index once the texts in question are too many to be sent to it;
    here the postings of asked terms are dealt out once, whatever the size."""
    postings, weights = _dealt(index, asked)
    return top(block_best(postings, weights, _any_hit(weights), index.lengths.count(), k), k)


def _dealt(index: Index, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """postings and weights of block_best: the postings of asked terms alone."""
    # written, so that Spark knows how few terms are asked
    weights = written(weighed(index, asked).select("item_id", "term", F.col("idf").alias("weight")))
    postings = index.terms.where("doc_id is not null").join(weights.select("term").distinct(), "term", "left_semi")
    return postings.select("doc_id", "term", F.col("impact").alias("value")), weights


def _any_hit(weights: DataFrame) -> DataFrame:
    return weights.select("item_id").distinct().withColumn("least", F.lit(1))


def best_of(index: Index, asked: DataFrame, wanted: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """best, but a question with rows in `wanted` (item_id, group) takes only texts that are in one of these groups (doc_id, group)."""
    postings, weights = _dealt(index, asked)
    # groups are terms that weigh nothing; the space keeps them apart from words
    mark = F.concat(F.lit("group "), F.col("group").cast("string")).alias("term")
    weights = weights.withColumn("must", F.lit(False)).unionByName(wanted.select("item_id", mark, F.lit(0.0).alias("weight"), F.lit(True).alias("must")).distinct())
    postings = postings.unionByName(groups.where("doc_id is not null").select("doc_id", mark, F.lit(1.0).alias("value")).distinct())
    return top(block_best(postings, weights, _any_hit(weights), index.lengths.count(), k), k)


def diverse_best(index: Index, asked: DataFrame, docs: DataFrame, per_text: int = 2, per_source: int = 5, k: int = 10) -> DataFrame:
    """diversified(bm25(...), docs, per_text, per_source, k), scored in blocks: a block gives what can be among the k best under
    both limits."""
    postings, weights = _dealt(index, asked)
    of = docs.select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    found = block_best(postings, weights, _any_hit(weights), index.lengths.count(), k, of=of, caps=((("source", "digest"), per_text), (("source",), per_source)))
    return diversified(written(found), docs, per_text, per_source, k)


#: Texts of one block, which one task scores against all questions; new rows after which a task keeps only the best; and hits among
#: a question's rarest terms by which texts that can have enough hits are told.
BLOCK_TEXTS, HELD_ROWS, RARE_HITS = 20_000, 500_000, 3


def _best_rows(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of all rows that can be among the k best of their item once scores are rounded to five places or more."""
    key = np.round(score, 9)  # sums of the same numbers in another order are equal
    order = np.lexsort((doc, -key, item))
    i, s = item[order], key[order]
    new = np.r_[True, i[1:] != i[:-1]]
    tied = np.r_[True, new[1:] | (s[1:] != s[:-1])]
    at = np.arange(len(order))
    first, first_tied = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(tied, at, 0))
    ends = np.r_[np.flatnonzero(new)[1:], len(order)][np.cumsum(new) - 1]
    least = s[np.minimum(first + k - 1, ends - 1)]
    return order[(s >= least - SLACK) & (at - first_tied < k)]


def _spans(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each span, one after the other."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - many), many)


def _floors(item: np.ndarray, score: np.ndarray, k: int, n: int) -> np.ndarray:
    """What a further row must reach to be among the k best of each of n items."""
    order = np.lexsort((-score, item))
    ends = np.cumsum(np.bincount(item, minlength=n))
    last = np.r_[0, ends[:-1]] + k - 1
    full = last < ends
    floors = np.full(n, -np.inf)
    floors[full] = score[order][last[full]] - 2 * SLACK
    return floors


def block_best(postings: DataFrame, weights: DataFrame, needed: DataFrame, texts: int, k: int, places: int = 6, of: DataFrame | None = None, caps: tuple[tuple[tuple[str, ...], int], ...] = ()) -> DataFrame:
    """(item_id, doc_id, score, hits) of all texts that can be among their question's k best: score is the sum of weight
    and value over shared terms, and only texts with at least `least` of these count. postings: doc_id, term, value (above 0);
    weights: item_id, term, weight; needed: item_id, least; texts: about how many there are.

    weights may have a column must: of a question's terms so marked, which are no hits, a text must hold one. With a column
    place (the caller's number of a term, or null) rows have the places of the terms that the text holds, as `held`. caps: (columns of
    `of`, most): no more texts of a question than so many agree in these; they bind one after the other, before k.

    Pairs of questions and texts are never rows of a shuffle. Texts are dealt into blocks, each block meets all
    questions in one task, and a task gives no more than the best of its texts for each question. Of m terms a text that
    has enough hits can miss m - least only, so it has some hits among the m - least + RARE_HITS rarest; the others, whose
    postings are nearly all of them, are only looked up for texts that do."""
    spark = postings.sparkSession
    cores = spark.sparkContext.defaultParallelism
    blocks = cores * max(1, -(-texts // (BLOCK_TEXTS * cores)))
    extra = [c for c in ("must", "place") if c in weights.columns]
    asked = weights.join(needed, "item_id").groupBy("item_id", "least").agg(F.collect_list(F.struct("term", "weight", *extra)).alias("t"))
    asked = asked.select("item_id", F.col("least").cast("long").alias("least"), F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), *(F.col(f"t.{c}").alias(c) for c in extra))
    every = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block_of = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    dealt = postings.select(block_of, "doc_id", "term", F.col("value").cast("double").alias("value"))
    grouping = of is not None
    if grouping:
        # what texts are grouped by goes along as rows without a term
        dealt = dealt.unionByName(of.where("doc_id is not null").select(block_of, *of.columns), allowMissingColumns=True)
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("item_id", weights), ("doc_id", postings))}
    ship_package(spark)

    def run(block: pa.Table, questions: pa.Table) -> pa.Table:
        least = np.maximum(1, np.asarray(questions["least"]))
        n, listed = len(least), questions["terms"].combine_chunks()
        coded = listed.flatten().dictionary_encode()
        flat = lambda name: questions[name].combine_chunks().flatten()
        owner, code, weight, width = np.repeat(np.arange(n), np.asarray(listed.value_lengths())), np.asarray(coded.indices), np.asarray(flat("weights")), len(coded.dictionary)
        must = np.asarray(flat("must")).astype(bool) if "must" in extra else np.zeros(len(code), bool)
        place = np.asarray(flat("place").fill_null(-1)) if "place" in extra else None
        # the postings of the block by text and term
        found = pc.index_in(block["term"].combine_chunks(), value_set=coded.dictionary, skip_nulls=True)
        there = np.flatnonzero(np.asarray(found.is_valid()))
        ids, term, value = np.asarray(block["doc_id"].combine_chunks().take(pa.array(there))), np.asarray(found.fill_null(0))[there], np.asarray(block["value"].combine_chunks().fill_null(0))[there]
        order = np.lexsort((term, ids))
        ids, term, value = ids[order], term[order], value[order]
        if len(ids):
            once = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (term[1:] != term[:-1])])
            ids, term, value = ids[once], term[once], np.add.reduceat(value, once)
        cuts = np.r_[np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]), len(ids)] if len(ids) else np.zeros(1, int)
        # each question's terms that some text here holds, the rarest first and those of `must` last
        common, restricted = np.bincount(term, minlength=width), np.bincount(owner[must], minlength=n) > 0
        order = np.lexsort((code, common[code], must, owner))
        order = order[common[code[order]] > 0]
        owner, code, weight, must = owner[order], code[order], weight[order], must[order]
        many = np.bincount(owner, minlength=n)
        start, hit = np.cumsum(many) - many, ~must
        rare = np.minimum(least, RARE_HITS)
        first = hit & (np.arange(len(owner)) - start[owner] < (np.bincount(owner[hit], minlength=n) - least + rare)[owner])
        by_term = np.argsort(code[first], kind="stable")
        holders, weighs, held = owner[first][by_term], weight[first][by_term], np.bincount(code[first], minlength=width)
        # what the other terms can add at most
        peak = np.zeros(width)
        np.maximum.at(peak, term, value)
        others = hit & ~first
        most = np.bincount(owner[others], weights=np.maximum(0, weight * peak[code])[others], minlength=n)
        begin = np.cumsum(held) - held
        groups = _grouped(block, [c for columns, _ in caps for c in columns]) if grouping else None

        def kept(item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> np.ndarray:
            return _best_rows(item, doc, score, k) if groups is None else _capped(item, doc, score, k, groups, caps)

        values, floors = np.zeros(width), np.full(n, -np.inf)
        parts, size = [], 0
        # texts of many terms first: they score high, so that the others needn't be looked at whole
        for d in np.argsort(-np.diff(cuts), kind="stable"):
            a, b = cuts[d], cuts[d + 1]
            t = term[a:b]
            at = _spans(begin[t], held[t])
            who = holders[at]
            near = np.flatnonzero(np.bincount(who, minlength=n) >= rare)
            part = np.bincount(who, weights=weighs[at] * np.repeat(value[a:b], held[t]), minlength=n)
            near = near[part[near] + most[near] >= floors[near]]
            if not len(near):
                continue
            values[t] = value[a:b]
            at, many_near = _spans(start[near], many[near]), many[near]
            edges, found = np.cumsum(many_near) - many_near, values[code[at]]
            values[t] = 0.0
            hits = np.add.reduceat((found != 0) & hit[at], edges, dtype=np.int64)
            score = np.add.reduceat(weight[at] * found, edges)
            enough = (hits >= least[near]) & (score >= floors[near])
            if "must" in extra:
                enough &= ~restricted[near] | (np.add.reduceat((found != 0) & must[at], edges, dtype=np.int64) > 0)
            if not enough.any():
                continue
            parts.append((near[enough], np.full(enough.sum(), ids[a]), score[enough], hits[enough]))
            size += len(parts[-1][0])
            if size > HELD_ROWS:
                rows = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                best_here = kept(*rows[:3])
                parts, size = [tuple(x[best_here] for x in rows)], 0
                if groups is None:
                    floors = _floors(parts[0][0], parts[0][2], k, n)
        rows = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (int, int, float, int)]
        best_here = kept(*rows[:3]) if len(rows[0]) else np.zeros(0, int)
        item, doc, score, hits = (x[best_here] for x in rows)
        out = {"item_id": questions["item_id"].take(pa.array(item)), "doc_id": pa.array(doc, block["doc_id"].type), "score": pa.array(score), "hits": pa.array(hits)}
        if place is not None:
            place = place[order]
            at, row = _spans(start[item], many[item]), np.repeat(np.arange(len(item)), many[item])
            texts_here = ids[cuts[:-1]]
            known = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)) * width + term
            wanted = np.searchsorted(texts_here, doc)[row] * width + code[at]
            has = (place[at] >= 0) & (known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted) if len(known) else np.zeros(0, bool)
            offsets = np.r_[0, np.cumsum(np.bincount(row[has], minlength=len(item)))].astype(np.int32)
            out["held"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[at][has].astype(np.int32)))
        return pa.table(out)

    schema = f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, score double, hits long" + (", held array<int>" if "place" in extra else "")
    # so many partitions that few blocks share one
    apart = lambda df: df.repartition(8 * blocks, "block").groupBy("block")
    return apart(dealt).cogroup(apart(every)).applyInArrow(run, schema).withColumn("score", F.round("score", places))


def _grouped(block: pa.Table, columns: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of the rows of a block without a term: their doc_id, in order, and their values of `columns` as numbers."""
    rows = block.filter(pc.is_null(block["term"])).sort_by("doc_id")
    coded = lambda c: np.asarray(pc.fill_null(c.dictionary_encode().indices, -1)) + 1
    return np.asarray(rows["doc_id"]), {c: coded(rows[c].combine_chunks()).astype(np.int64) for c in dict.fromkeys(columns)}


def _capped(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int, groups: tuple[np.ndarray, dict[str, np.ndarray]], caps: tuple[tuple[tuple[str, ...], int], ...]) -> np.ndarray:
    """Positions of all rows that can be among the k best of their item under the caps. What a better text of another block takes
    the place of is counted by that text there, so no cap leaves out here what it lets pass over all blocks."""
    ids, values = groups
    many = np.searchsorted(ids, doc, "right") - np.searchsorted(ids, doc, "left")
    row, of = np.repeat(np.arange(len(doc)), many), _spans(np.searchsorted(ids, doc, "left"), many)
    for columns, most in (*caps, ((), k)):
        if not len(row):
            break
        group = item[row]
        for c in columns:
            group = group * (values[c].max() + 1) + values[c][of]
            group = np.unique(group, return_inverse=True)[1]
        left = np.sort(_best_rows(group, doc[row], score[row], most))
        row, of = row[left], of[left]
    return np.unique(row)


def gated_best(index: Index, asked: DataFrame, k: int, share: float = 0.45) -> DataFrame:
    """gated(bm25(...)) as far as it can be among the k best of a question. With a column place of asked, also which of these a
    text holds, see block_best."""
    weights = weighed(index, asked).select("item_id", "term", F.col("idf").alias("weight"), *(c for c in asked.columns if c == "place"))
    needed = asked.groupBy("item_id").agg(least_hits(F.count(F.lit(1)), share).alias("least"))
    return block_best(index.terms.select("doc_id", "term", F.col("impact").alias("value")), weights, needed, index.lengths.count(), k)


def rarity(index: Index, asked: DataFrame) -> DataFrame:
    """(item_id, doc_id, score): the sum of ln((N + 1) / (df + 1)) + 1 over shared terms."""
    texts = index.lengths.agg(F.count(F.lit(1))).scalar()
    weighted = asked.join(index.df, "term").withColumn("n", texts).withColumn("w", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    return weighted.join(index.terms, "term").groupBy("item_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))


def rarity_best(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """rarity(...) as far as it can be among the k best of a question."""
    texts = index.lengths.count()
    rare = index.df.select("term", (F.log((F.lit(texts) + 1) / (F.col("df") + 1)) + 1).alias("weight"))
    weights = asked.join(rare, "term").select("item_id", "term", "weight")
    needed = weights.select("item_id").distinct().withColumn("least", F.lit(1))
    return block_best(index.terms.select("doc_id", "term", F.lit(1.0).alias("value")), weights, needed, texts, k).select("item_id", "doc_id", "score")


def top(scored: DataFrame, k: int, by: str = "item_id", id_col: str = "doc_id") -> DataFrame:
    """The k best of each question with their rank; ties go to the smaller id."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def above_floor(scored: DataFrame, share: float, by: str = "item_id") -> DataFrame:
    """Rows of at least a share of their question's best score."""
    return scored.withColumn("best", F.max("score").over(Window.partitionBy(by))).where(F.col("score") >= share * F.col("best")).drop("best")


def least_hits(asked: Column, share: float = 0.45) -> Column:
    """Terms that must hit: 1 of 1, 2 of 2, else the larger of 2 and a share rounded up."""
    return F.when(asked <= 2, asked).otherwise(F.greatest(F.lit(2), F.ceil(asked * share)))


def gated(scored: DataFrame, asked: DataFrame, share: float = 0.45) -> DataFrame:
    """Rows whose hits reach the minimum for their question's number of terms."""
    sizes = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("asked"))
    return scored.join(sizes, "item_id").where(F.col("hits") >= least_hits(F.col("asked"), share)).drop("asked")


def diversified(scored: DataFrame, docs: DataFrame, per_text: int = 2, per_source: int = 5, k: int = 10) -> DataFrame:
    """The best k with at most per_text of one text and per_source of one source, in order of rank. One text has one
    source or is counted apart for each, so the second limit counts among survivors of the first."""
    keyed = scored.join(docs.select("doc_id", "source", F.sha2("text", 256).alias("digest")), "doc_id")
    best = [F.desc("score"), "doc_id"]
    kept = keyed.withColumn("a", F.row_number().over(Window.partitionBy("item_id", "source", "digest").orderBy(*best))).where(F.col("a") <= per_text)
    kept = kept.withColumn("b", F.row_number().over(Window.partitionBy("item_id", "source").orderBy(*best))).where(F.col("b") <= per_source)
    return top(kept, k).select("item_id", "rank", "doc_id", "source", "score")


def diagnostics(questions: DataFrame, asked: DataFrame, index: Index, scored: DataFrame, share: float = 0.45) -> DataFrame:
    """(item_id, reason): the first gate that a question fails, or answerable. empty: no terms; unknown_qualifier: a
    term of four letters or more that isn't in the corpus; insufficient_relevance: no text with enough hits."""
    unknown = asked.where((F.length("term") >= 4) & ~F.col("term").rlike("^[0-9]+$")).join(index.df, "term", "left_anti").select("item_id").distinct().withColumn("unknown", F.lit(True))
    enough = gated(scored, asked, share).select("item_id").distinct().withColumn("enough", F.lit(True))
    some = asked.select("item_id").distinct().withColumn("some", F.lit(True))
    rows = questions.select("item_id").join(some, "item_id", "left").join(unknown, "item_id", "left").join(enough, "item_id", "left")
    return rows.select("item_id", F.when(F.col("some").isNull(), "empty").when(F.col("unknown"), "unknown_qualifier").when(F.col("enough").isNull(), "insufficient_relevance").otherwise("answerable").alias("reason"))


def ranking_metrics(ranked: DataFrame, truth: DataFrame, questions: DataFrame, variant: DataFrame | None = None) -> DataFrame:
    """hit@1, hit@5 and mean reciprocal rank over the questions that have a true answer; with a variant (item_id,
    variant) also by variant, where null stands for all."""
    first = ranked.join(truth, ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("rank").alias("first"))
    asked = truth.select("item_id").distinct().join(questions.select("item_id"), "item_id", "left_semi").join(first, "item_id", "left")
    asked = asked.join(variant, "item_id") if variant is not None else asked.withColumn("variant", F.lit("all"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return asked.rollup("variant").agg(F.count(F.lit(1)).alias("cases"), share(F.col("first") <= 1).alias("hit1"), share(F.col("first") <= 5).alias("hit5"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def rejections(ranked: DataFrame, truth: DataFrame, reasons: DataFrame, variant: DataFrame, within: int = 5) -> DataFrame:
    """(part, variant, reason, cases, share): why questions didn't get what they should. part missed: questions with a true
    answer that isn't among the first `within`, by variant and reason (answerable: let through, but ranked behind or not
    found), as a share of the variant's questions with an answer; part refused: questions without one by reason (answerable:
    let through wrongly), as a share of all of these; their variant is null. ranked: item_id, doc_id, rank; truth: item_id,
    doc_id; reasons: item_id, reason, one row for each question; variant: item_id, variant of those with an answer."""
    first = ranked.join(truth, ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("rank").alias("first"))
    rows = reasons.join(variant, "item_id", "left").join(first, "item_id", "left").join(truth.select("item_id").distinct().withColumn("due", F.lit(True)), "item_id", "left")
    part = F.when(F.col("due"), "missed").otherwise("refused")
    lost = F.when(F.col("due"), F.coalesce(F.col("first") > within, F.lit(True))).otherwise(F.lit(True))
    counted = rows.groupBy(part.alias("part"), "variant", "reason").agg(F.count_if(lost).alias("cases"), F.count(F.lit(1)).alias("all"))
    counted = counted.withColumn("all", F.sum("all").over(Window.partitionBy("part", "variant")))
    return counted.where("cases > 0").select("part", "variant", "reason", "cases", F.round(F.col("cases") / F.col("all"), 6).alias("share"))


def extract_sentences(ranked: DataFrame, docs: DataFrame, asked: DataFrame, most: int = 6) -> DataFrame:
    """The sentences of ranked texts with the most question terms: 3 for each term, less 0.03 for each place from the
    text's start; at most `most` for each question, each taken as it stands in its text."""
    # written, so that the few ranked rows go to the texts and no text is shuffled to be found
    ranked = written(ranked.select("item_id", "doc_id", "rank"))
    sentences = ranked.join(docs.select("doc_id", "text"), "doc_id").select("item_id", "doc_id", "rank", F.posexplode(T.sentences(F.col("text"), 18)).alias("pos", "sentence"))
    words = sentences.select("item_id", "doc_id", "rank", "pos", "sentence", F.explode(T.tokens(F.col("sentence"))).alias("term"))
    hits = words.join(asked, ["item_id", "term"]).groupBy("item_id", "doc_id", "rank", "pos", "sentence").agg(F.count(F.lit(1)).alias("hits"))
    scored = hits.withColumn("score", F.round(3 * F.col("hits") - 0.03 * F.col("pos"), 6))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "rank", "doc_id", "pos")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("item_id", "place", "doc_id", F.col("pos").cast("long").alias("pos"), "sentence", "score")


def near_sentence(a: Column, b: Column, similar: float = 0.68, contained: float = 0.62) -> Column:
    """Whether two sentences say the same: equal when normalised, one contained in the other at a length ratio of
    `contained`, or a Jaccard similarity of their words of three letters and more of at least `similar`."""
    x, y = T.norm(a), T.norm(b)
    long_words = lambda t: F.array_distinct(F.filter(F.split(t, " "), lambda w: F.length(w) >= 3))
    wx, wy = long_words(x), long_words(y)
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y), F.lit(1))
    overlap = F.size(F.array_intersect(wx, wy)) / F.greatest(F.size(F.array_union(wx, wy)), F.lit(1))
    return (x == y) | ((F.contains(x, y) | F.contains(y, x)) & (ratio >= contained)) | (overlap >= similar)


def without_near_sentences(extracted: DataFrame, most: int = 6) -> DataFrame:
    """A greedy pass over each question's extracted sentences in order (a bounded list): a sentence near one that was
    kept is dropped, and `most` are kept. extracted: (item_id, place, doc_id, sentence)."""
    listed = extracted.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "sentence"))).alias("rows"))
    start = F.slice("rows", 1, 0)

    def step(kept: Column, row: Column) -> Column:
        near = F.exists(kept, lambda k: near_sentence(k["sentence"], row["sentence"]))
        return F.when(near | (F.size(kept) >= most), kept).otherwise(F.array_append(kept, row))

    return listed.select("item_id", F.posexplode(F.aggregate("rows", start, step)).alias("n", "r")).select("item_id", (F.col("n") + 1).alias("place"), "r.doc_id", "r.sentence")


def with_concepts(scored: DataFrame, asked: DataFrame, tagged: DataFrame) -> DataFrame:
    """2.7 times the term score, and for texts that share concepts with the question 5.5 and 0.8 for each of at most
    four of them (7 at most). asked: (item_id, concept); tagged: (doc_id, concept)."""
    shared = asked.join(tagged, "concept").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("concepts"))
    bonus = F.when(F.col("concepts") > 0, 5.5 + F.least(F.lit(7.0), 0.8 * F.least(F.lit(4), "concepts"))).otherwise(0.0)
    return scored.join(shared, ["item_id", "doc_id"], "left").fillna(0, ["concepts"]).select("item_id", "doc_id", F.round(2.7 * F.col("score") + bonus, 7).alias("score"), "concepts")
