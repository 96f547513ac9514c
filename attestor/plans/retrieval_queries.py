"""Retrieval over documents, with the benchmark passages as questions (all their terms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import retrieval as R
from attestor.operators import terms
from attestor.plans.registry import Registry, sql_norm, sql_words
from attestor.session import written
from attestor.sources.tables import table

registry = Registry()
query = registry.query

_WITH = f"""
WITH RECURSIVE words AS (SELECT doc_id, unnest({sql_words('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
len AS (SELECT doc_id, sum(tf) AS length FROM tf GROUP BY doc_id),
size AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
asked AS (SELECT DISTINCT item_id, unnest({sql_words('text')}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, count(*) AS hits,
  round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.72 + 0.72 * length / mean))), 6) AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN len USING (doc_id), size GROUP BY item_id, doc_id),
need AS (SELECT item_id, CASE WHEN count(*) <= 2 THEN count(*) ELSE greatest(2, ceil(count(*) * 0.45)) END AS least FROM asked GROUP BY item_id),
ranked AS (SELECT item_id, doc_id, score, hits, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored),
truth AS (SELECT b.item_id, d.doc_id FROM (SELECT item_id, ' ' || {sql_norm('text')} || ' ' AS p FROM benchmark) b
  JOIN (SELECT doc_id, ' ' || {sql_norm('text')} || ' ' AS t FROM documents) d ON contains(d.t, b.p))
"""


def _parts(spark: SparkSession, sf_dir: str):
    docs, questions = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    index = R.kept_index(docs)
    asked = R.question_terms(questions)
    return docs, questions, index, asked


@query(_WITH + "SELECT term, df FROM df")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[2].df.select("term", "df")


@query(_WITH + "SELECT doc_id, term, tf FROM tf")
def term_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[2].terms.select("doc_id", "term", "tf")


@query(_WITH + "SELECT (SELECT count(*) FROM len) AS documents, (SELECT round(mean, 6) FROM size) AS mean_length, (SELECT count(*) FROM df) AS vocabulary")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _parts(spark, sf_dir)[2]
    return index.lengths.agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("length"), 6).alias("mean_length")).withColumn("vocabulary", index.df.agg(F.count(F.lit(1))).scalar())


@query(_WITH + "SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score, hits FROM ranked WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index, asked = _parts(spark, sf_dir)
    return R.best(index, asked, 5)


@query(_WITH + "SELECT item_id, doc_id, score FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM scored) WHERE score >= 0.4 * best")
def score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index, asked = _parts(spark, sf_dir)
    return R.above_floor(R.contenders(index, asked, 1, 0.4), 0.4).select("item_id", "doc_id", "score")


@query(_WITH + "SELECT item_id, doc_id, score, hits FROM scored JOIN need USING (item_id) WHERE hits >= least")
def bm25_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index, asked = _parts(spark, sf_dir)
    return R.gated(R.bm25(index, asked), asked).select("item_id", "doc_id", "score", "hits")


@query(_WITH + """SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
FROM (SELECT item_id, doc_id, round(sum(ln((n + 1) / (df + 1)) + 1), 6) AS score FROM asked JOIN df USING (term) JOIN tf USING (term), size GROUP BY ALL)) WHERE rank <= 5""")
def rank_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index, asked = _parts(spark, sf_dir)
    return R.top(R.rarity_best(index, asked, 5), 5).select("item_id", "rank", "doc_id", "score")


@query(_WITH + """, k AS (SELECT s.*, d.source, sha256(d.text) AS digest FROM scored s JOIN documents d USING (doc_id)),
a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY item_id, source, digest ORDER BY score DESC, doc_id) <= 2),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) <= 5)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM b) WHERE rank <= 10""")
def diversified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, index, asked = _parts(spark, sf_dir)
    return R.diverse_best(index, asked, docs)


@query(_WITH + "SELECT item_id, source, doc_id, score FROM (SELECT s.*, d.source, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, s.doc_id) AS r FROM scored s JOIN documents d USING (doc_id)) WHERE r = 1")
def best_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, index, asked = _parts(spark, sf_dir)
    sourced = R.bm25(index, asked).join(docs.select("doc_id", "source"), "doc_id")
    return sourced.groupBy("item_id", "source").agg(F.min_by(F.struct("doc_id", "score"), F.struct(-F.col("score"), "doc_id")).alias("b")).select("item_id", "source", "b.doc_id", "b.score")


@query(_WITH + """SELECT item_id, CASE WHEN item_id NOT IN (SELECT item_id FROM asked) THEN 'empty'
WHEN item_id IN (SELECT item_id FROM asked WHERE length(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN (SELECT term FROM df)) THEN 'unknown_qualifier'
WHEN item_id NOT IN (SELECT item_id FROM scored JOIN need USING (item_id) WHERE hits >= least) THEN 'insufficient_relevance' ELSE 'answerable' END AS reason FROM benchmark""")
def retrieval_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, questions, index, asked = _parts(spark, sf_dir)
    return R.diagnostics(questions, asked, index, R.gated_best(index, asked, 1))


@query(_WITH + """SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
SELECT s.*, max(score) OVER (PARTITION BY item_id) AS best FROM scored s JOIN need USING (item_id) WHERE hits >= least
AND item_id NOT IN (SELECT item_id FROM asked WHERE length(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN (SELECT term FROM df))) WHERE score >= 0.4 * best) WHERE rank <= 8""")
def retrieve_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused questions are split off before scoring; the others pass the gate, the floor and the limit."""
    _, questions, index, asked = _parts(spark, sf_dir)
    unknown = asked.where((F.length("term") >= 4) & ~F.col("term").rlike("^[0-9]+$")).join(index.df, "term", "left_anti").select("item_id").distinct()
    active = asked.join(unknown, "item_id", "left_anti")
    return R.top(R.above_floor(R.gated_best(index, written(active), 8), 0.4), 8).select("item_id", "rank", "doc_id", "score")


@query(_WITH + "SELECT item_id, term FROM asked WHERE length(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN (SELECT term FROM df)")
def unknown_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index, asked = _parts(spark, sf_dir)
    return asked.where((F.length("term") >= 4) & ~F.col("term").rlike("^[0-9]+$")).join(index.df, "term", "left_anti").select("item_id", "term")


@query(_WITH + "SELECT item_id, term FROM asked a WHERE length(term) >= 4 AND NOT EXISTS (SELECT 1 FROM ranked r JOIN tf USING (doc_id) WHERE r.item_id = a.item_id AND r.rank <= 5 AND tf.term = a.term)")
def qualifier_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question terms that none of the five best texts holds."""
    _, _, index, asked = _parts(spark, sf_dir)
    seen = R.best(index, asked, 5).select("item_id", "doc_id").join(index.terms, "doc_id").select("item_id", "term")
    return asked.where(F.length("term") >= 4).join(seen, ["item_id", "term"], "left_anti")


@query(_WITH + """, lang AS (SELECT item_id, min(lang) AS variant FROM truth JOIN documents USING (doc_id) GROUP BY item_id),
f AS (SELECT item_id, min(rank) AS first FROM ranked JOIN truth USING (item_id, doc_id) WHERE rank <= 10 GROUP BY item_id),
c AS (SELECT l.item_id, variant, first FROM lang l LEFT JOIN f USING (item_id))
SELECT variant, count(*) AS cases, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit5,
round(avg(coalesce(1 / first, 0.0)), 6) AS mrr FROM c GROUP BY ROLLUP (variant)""")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, questions, index, asked = _parts(spark, sf_dir)
    truth = terms.phrase_pairs(docs, questions, "doc_id", "item_id")
    variant = truth.join(docs.select("doc_id", "lang"), "doc_id").groupBy("item_id").agg(F.min("lang").alias("variant"))
    return R.ranking_metrics(R.best(index, asked, 10), truth, questions, variant)


_GATED = """unknown AS (SELECT DISTINCT item_id FROM asked WHERE length(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN (SELECT term FROM df)),
enough AS (SELECT s.*, max(score) OVER (PARTITION BY item_id) AS best FROM scored s JOIN need USING (item_id) WHERE hits >= least),
why AS (SELECT item_id, CASE WHEN item_id NOT IN (SELECT item_id FROM asked) THEN 'empty' WHEN item_id IN (SELECT item_id FROM unknown) THEN 'unknown_qualifier'
  WHEN item_id NOT IN (SELECT item_id FROM enough) THEN 'insufficient_relevance' ELSE 'answerable' END AS reason FROM benchmark),
let AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM enough WHERE item_id NOT IN (SELECT item_id FROM unknown) AND score >= 0.4 * best QUALIFY rank <= 8)"""


@query(_WITH + f""", {_GATED}, f AS (SELECT item_id, min(rank) AS first FROM let JOIN truth USING (item_id, doc_id) GROUP BY item_id),
v AS (SELECT item_id, min(lang) AS variant FROM truth JOIN documents USING (doc_id) GROUP BY item_id),
c AS (SELECT CASE WHEN item_id IN (SELECT item_id FROM truth) THEN 'missed' ELSE 'refused' END AS part, variant, reason, first FROM why LEFT JOIN v USING (item_id) LEFT JOIN f USING (item_id)),
g AS (SELECT part, variant, reason, count(*) FILTER (WHERE part = 'refused' OR first IS NULL OR first > 5) AS cases, count(*) AS n FROM c GROUP BY ALL)
SELECT part, variant, reason, cases, round(cases / total, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY part, variant) AS total FROM g) WHERE cases > 0""")
def ir_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the gated retrieval: why passages that stand in documents were missed, by language, and why the others were refused."""
    docs, questions, index, asked = _parts(spark, sf_dir)
    truth = written(terms.phrase_pairs(docs, questions, "doc_id", "item_id"))
    variant = truth.join(docs.select("doc_id", "lang"), "doc_id").groupBy("item_id").agg(F.min("lang").alias("variant"))
    scored = written(R.bm25(index, asked))
    reasons = written(R.diagnostics(questions, asked, index, scored))
    active = scored.join(reasons.where("reason = 'answerable'"), "item_id", "left_semi")
    ranked = R.top(R.above_floor(R.gated(active, asked), 0.4), 8)
    return R.rejections(ranked, truth, reasons, variant)


_SENTENCES = "list_filter(list_transform(regexp_extract_all(text, '[^.!?…]+(?:[.!?…]+|$)'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) >= 18)"


@query(_WITH + f""", s0 AS (SELECT item_id, doc_id, rank, {_SENTENCES} AS l FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5),
s1 AS (SELECT item_id, doc_id, rank, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM s0),
s2 AS (SELECT DISTINCT item_id, doc_id, rank, pos, sentence, unnest({sql_words('sentence')}) AS term FROM s1),
s3 AS (SELECT item_id, doc_id, rank, pos, sentence, round(3 * count(*) - 0.03 * pos, 6) AS score FROM s2 JOIN asked USING (item_id, term) GROUP BY item_id, doc_id, rank, pos, sentence)
SELECT item_id, CAST(place AS INTEGER) AS place, doc_id, pos, sentence, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank, doc_id, pos) AS place FROM s3) WHERE place <= 6""")
def extractive_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, index, asked = _parts(spark, sf_dir)
    return R.extract_sentences(R.best(index, asked, 5), docs, asked)


@query(_WITH + """, e AS (SELECT DISTINCT item_id, source FROM ranked JOIN documents USING (doc_id) WHERE rank <= 1)
SELECT DISTINCT t.item_id, d.source FROM truth t JOIN documents d USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.item_id = t.item_id AND e.source = d.source)""")
def missing_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested sources without evidence for a question. A question requests the sources whose texts hold its passage;
    its answer is drawn from the best text."""
    docs, questions, index, asked = _parts(spark, sf_dir)
    sources = docs.select("doc_id", "source")
    evidence = R.best(index, asked, 1).join(sources, "doc_id").select("item_id", "source")
    requested = terms.phrase_pairs(docs, questions, "doc_id", "item_id").join(sources, "doc_id").select("item_id", "source").distinct()
    return requested.join(evidence, ["item_id", "source"], "left_anti")


@query(_WITH + """SELECT item_id, source, count(*) AS texts, list_aggregate(list(doc_id ORDER BY rank), 'string_agg', ',') AS doc_ids, max(score) AS best
FROM ranked JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY item_id, source""")
def group_by_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, index, asked = _parts(spark, sf_dir)
    rows = R.best(index, asked, 10).join(docs.select("doc_id", "source"), "doc_id")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x.doc_id.cast("string"))
    return rows.groupBy("item_id", "source").agg(F.count(F.lit(1)).alias("texts"), F.array_join(ids, ",").alias("doc_ids"), F.max("score").alias("best"))


_FIRST = "list_extract(list_filter(list_transform(regexp_extract_all(text, '[^.!?…]+(?:[.!?…]+|$)'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) >= 1), 1)"


@query(_WITH + f""", five AS (SELECT term FROM df ORDER BY df DESC, term LIMIT 5), d AS (SELECT doc_id, {sql_words(f'coalesce({_FIRST}, {chr(39)}{chr(39)})')} AS h, {sql_words('text')} AS w FROM documents),
x AS (SELECT doc_id, sum(2.5 * CAST(list_contains(h, term) AS INT) + CAST(list_contains(w, term) AS INT)) AS score FROM d, five GROUP BY doc_id)
SELECT doc_id, CAST(score AS DOUBLE) AS score FROM x WHERE score >= 1.5""")
def topic_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five terms (the most frequent ones after the stop list) weigh 2.5 in the first sentence and 1 in the text."""
    docs, _, index, _ = _parts(spark, sf_dir)
    five = index.df.orderBy(F.desc("df"), "term").limit(5)
    first = T.tokens(F.coalesce(F.get(T.sentences(F.col("text"), 1), F.lit(0)), F.lit("")))
    weighed = docs.select("doc_id", F.explode(F.concat(F.transform(first, lambda t: F.struct(t.alias("term"), F.lit(2.5).alias("w"))), F.transform(T.tokens(F.col("text")), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("w"))))).alias("x")).select("doc_id", "x.term", "x.w")
    return weighed.join(F.broadcast(five), "term", "left_semi").groupBy("doc_id").agg(F.sum("w").alias("score")).where("score >= 1.5")


@query(_WITH + f""", s0 AS (SELECT item_id, doc_id, rank, {_SENTENCES} AS l FROM ranked JOIN documents USING (doc_id) WHERE rank <= 10),
s1 AS (SELECT item_id, doc_id, rank, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM s0),
s2 AS (SELECT DISTINCT item_id, doc_id, rank, pos, sentence, unnest({sql_words('sentence')}) AS term FROM s1),
s3 AS (SELECT item_id, doc_id, rank, pos, sentence, round(3 * count(*) - 0.03 * pos, 6) AS score FROM s2 JOIN asked USING (item_id, term) GROUP BY item_id, doc_id, rank, pos, sentence)
SELECT item_id, CAST(place AS INTEGER) AS place, doc_id, pos, sentence, CAST(score AS DOUBLE) AS score, regexp_matches(sentence, '[0-9]') AS detail FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank, doc_id, pos) AS place FROM s3) WHERE place <= 10""")
def extractive_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The looser profile: ten texts, ten sentences, and whether a sentence gives a number."""
    docs, _, index, asked = _parts(spark, sf_dir)
    rows = R.extract_sentences(R.best(index, asked, 10), docs, asked, 10)
    return rows.withColumn("detail", F.col("sentence").rlike("[0-9]"))


_NEAR = """k.x = e.x OR ((contains(k.x, e.x) OR contains(e.x, k.x)) AND least(length(k.x), length(e.x)) / greatest(length(k.x), length(e.x), 1) >= 0.62)
    OR len(list_intersect(k.w, e.w)) / greatest(len(list_distinct(list_concat(k.w, e.w))), 1) >= 0.68"""


@query(_WITH + f""", s0 AS (SELECT item_id, doc_id, rank, {_SENTENCES} AS l FROM ranked JOIN documents USING (doc_id) WHERE rank <= 10),
s1 AS (SELECT item_id, doc_id, rank, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM s0),
s2 AS (SELECT DISTINCT item_id, doc_id, rank, pos, sentence, unnest({sql_words('sentence')}) AS term FROM s1),
s3 AS (SELECT item_id, doc_id, rank, pos, sentence, round(3 * count(*) - 0.03 * pos, 6) AS score FROM s2 JOIN asked USING (item_id, term) GROUP BY item_id, doc_id, rank, pos, sentence),
s4 AS (SELECT item_id, doc_id, sentence, {sql_norm('sentence')} AS x, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank, doc_id, pos) AS place FROM s3),
e AS MATERIALIZED (SELECT item_id, place, doc_id, sentence, x, list_distinct(list_filter(string_split(x, ' '), lambda t: length(t) >= 3)) AS w FROM s4 WHERE place <= 20),
g AS (SELECT item_id, 0 AS step, CAST([] AS STRUCT(doc_id BIGINT, sentence VARCHAR, x VARCHAR, w VARCHAR[])[]) AS kept FROM (SELECT DISTINCT item_id FROM e)
  UNION ALL SELECT g.item_id, step + 1, CASE WHEN e.item_id IS NULL OR len(kept) >= 6 OR len(list_filter(kept, lambda k: {_NEAR})) > 0 THEN kept
    ELSE list_append(kept, struct_pack(doc_id := e.doc_id, sentence := e.sentence, x := e.x, w := e.w)) END FROM g LEFT JOIN e ON e.item_id = g.item_id AND e.place = step + 1 WHERE step < 20)
SELECT item_id, place::INTEGER AS place, r.doc_id AS doc_id, r.sentence AS sentence FROM (SELECT item_id, unnest(kept) AS r, unnest(range(1, len(kept) + 1)) AS place FROM g WHERE step = 20)""")
def neardup_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted sentences without those near a better one."""
    docs, _, index, asked = _parts(spark, sf_dir)
    return R.without_near_sentences(R.extract_sentences(R.best(index, asked, 10), docs, asked, 20), 6)
