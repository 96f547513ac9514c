"""Near duplicates, detection and evidence over documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import chunks as K
from attestor.operators import dedupe as D
from attestor.operators import retrieval as R
from attestor.operators import terms
from attestor.plans.registry import Registry, sql_norm, sql_words
from attestor.plans.retrieval_queries import _WITH, _parts
from attestor.session import spread, written
from attestor.sources.tables import table

registry = Registry()
query = registry.query


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens and a digest of the token set of each document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    return docs.withColumn("key", F.sha2(F.array_join(F.array_sort("tokens"), " "), 256))


_SETS = f"""WITH s0 AS (SELECT doc_id, list_sort(list_distinct({sql_words('text')})) AS w FROM documents),
s AS (SELECT min(doc_id) AS doc_id, w, len(w) AS n FROM s0 GROUP BY w)"""


@query(_SETS + """, p AS (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.w, y.w)) AS c, x.n, y.n AS m FROM s x JOIN s y ON x.doc_id < y.doc_id AND least(x.n, y.n) >= 0.68 * greatest(x.n, y.n))
SELECT a, b, round(c / (n + m - c), 6) AS similarity FROM p WHERE n + m > 0 AND c / (n + m - c) >= 0.68""")
def neardup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different token sets of the whole corpus with a similarity of at least 0.68; the first document of a set
    stands for all of them (neardup_members)."""
    keyed = _keyed(spark, sf_dir)
    first = D.representatives(keyed, "doc_id", [], F.col("key"))
    return D.pairs_in_blocks(written(keyed.join(first, "doc_id", "left_semi").select("doc_id", "tokens")), "doc_id", 0.68)


@query(_SETS + " SELECT s0.doc_id, s.doc_id AS representative FROM s0 JOIN s USING (w)")
def neardup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the first one of its token set, which stands for it in neardup_pairs."""
    return D.members(written(_keyed(spark, sf_dir).select("doc_id", "key")), "doc_id", "key")


_FIRST = "list_extract(list_filter(list_transform(regexp_extract_all(text, '[^.!?…]+(?:[.!?…]+|$)'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) >= 12), 1)"


@query(f"""WITH RECURSIVE c AS (SELECT min(doc_id) AS doc_id, source, lang, list_distinct({sql_words('s')}) AS w, list_distinct(regexp_extract_all(s, '[0-9]+')) AS n FROM (SELECT doc_id, source, lang, {_FIRST} AS s FROM documents) WHERE s IS NOT NULL GROUP BY source, lang, s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.w, y.w)) AS shared, len(y.w) AS least FROM c x JOIN c y ON x.source = y.source AND x.lang = y.lang AND x.doc_id < y.doc_id
WHERE len(x.n) = 0 OR len(y.n) = 0 OR len(list_intersect(x.n, y.n)) > 0),
l AS (SELECT a, b FROM p WHERE shared >= CASE WHEN least <= 4 THEN 2 ELSE 3 END AND (shared >= 4 OR shared >= 0.4 * least)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM c UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT c.doc_id, (SELECT count(*) FROM e WHERE e.a = c.doc_id) AS links, (SELECT min(b) FROM reach r WHERE r.a = c.doc_id) AS class_id FROM c""")
def claim_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims (first sentences) of a source and language: with how many others each says the same, whichever terms they
    share, and the smallest doc_id of its class. Equal sentences are one claim, under the smallest doc_id."""
    first = F.get(T.sentences(F.col("text"), 12), F.lit(0))
    said = table(spark, sf_dir, "documents").withColumn("s", first).where("s is not null").groupBy("source", "lang", "s").agg(F.min("doc_id").alias("doc_id"))
    claims = written(said.select("doc_id", "source", "lang", T.tokens(F.col("s")).alias("tokens"), F.array_distinct(F.regexp_extract_all("s", F.lit("[0-9]+"), F.lit(0))).alias("numbers")))
    return D.claim_classes(claims, "doc_id", ["source", "lang"])


_CONCEPTS = _WITH + ", concept AS (SELECT term FROM df WHERE df >= 3 AND length(term) >= 5 ORDER BY df, term LIMIT 50)"


def _concepts(df: DataFrame) -> DataFrame:
    """The 50 rarest terms with a df of at least 3 stand for an ontology: a table of fixed size."""
    return df.where((F.col("df") >= 3) & (F.length("term") >= 5)).orderBy("df", "term").limit(50).select("term")


def _tagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    index = R.kept_index(docs)
    concepts = written(_concepts(index.df))
    return docs, index.terms.join(F.broadcast(concepts), "term").select("doc_id", F.col("term").alias("concept"))


@query(_CONCEPTS + " SELECT term AS concept, count(*) AS documents FROM tf JOIN concept USING (term) GROUP BY term")
def concept_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir)[1].groupBy("concept").agg(F.count(F.lit(1)).alias("documents"))


@query(_CONCEPTS + " SELECT doc_id, term AS concept FROM tf JOIN concept USING (term)")
def concept_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir)[1]


@query(_CONCEPTS + " SELECT count(*) AS documents, count(*) FILTER (WHERE n > 0) AS covered FROM (SELECT d.doc_id, count(c.term) AS n FROM documents d LEFT JOIN (tf JOIN concept c USING (term)) USING (doc_id) GROUP BY d.doc_id)")
def ontology_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tagged = _tagged(spark, sf_dir)
    covered = docs.select("doc_id").join(tagged.select("doc_id").distinct().withColumn("c", F.lit(True)), "doc_id", "left")
    return covered.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("c")).alias("covered"))




def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word names made of each nation's key, so that some occur in the texts."""
    first = F.element_at(F.array(*map(F.lit, ("of", "und", "dans", "the", "que"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    second = F.element_at(F.array(*map(F.lit, ("the", "der", "les", "and", "la"))), (F.floor(F.col("n_nationkey") / 5) % 5 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity"), F.concat_ws(" ", first, second).alias("name"))


_MENTIONS = f"""WITH names AS (SELECT n_nationkey AS entity, list_extract(['of','und','dans','the','que'], CAST(n_nationkey % 5 + 1 AS INTEGER)) || ' ' || list_extract(['the','der','les','and','la'], CAST((n_nationkey // 5) % 5 + 1 AS INTEGER)) AS name FROM nation),
m AS (SELECT doc_id, entity FROM (SELECT doc_id, ' ' || {sql_norm('text')} || ' ' AS t FROM documents) JOIN names ON contains(t, ' ' || name || ' '))"""


@query(_MENTIONS + " SELECT doc_id, entity FROM m")
def mention_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mentions(table(spark, sf_dir, "documents"), "doc_id", _names(spark, sf_dir), "entity")


@query(_MENTIONS + " SELECT entity, count(*) AS documents, min(doc_id) AS first_doc FROM m GROUP BY entity")
def entity_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mention_join(spark, sf_dir).groupBy("entity").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


@query(_MENTIONS + " SELECT entity, doc_id FROM m QUALIFY row_number() OVER (PARTITION BY entity ORDER BY doc_id) <= 3")
def keep_k_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of each entity."""
    return D.keep_first(mention_join(spark, sf_dir), "entity", "doc_id", 3).select("entity", "doc_id")


@query("""SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, string_split(lower(s_name), '#') AS s FROM supplier) JOIN (SELECT c_custkey, string_split(lower(c_name), '#') AS c FROM customer) ON s[2] = c[2]""")
def identity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose identifying tokens are contained in one another: an equi-join on the token that both must share,
    then the sets are compared without the words that name the kind."""
    kinds = F.array(F.lit("supplier"), F.lit("customer"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.array_except(F.split(F.lower("s_name"), "#"), kinds).alias("s"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.array_except(F.split(F.lower("c_name"), "#"), kinds).alias("c"))
    joined = s.withColumn("t", F.explode("s")).join(c.withColumn("t", F.explode("c")), "t")
    return joined.where((F.size(F.array_except("s", "c")) == 0) | (F.size(F.array_except("c", "s")) == 0)).select("s_suppkey", "c_custkey").distinct()


@query(f"SELECT conv_id, list_aggregate(list_sort(list_slice(list_sort(list(DISTINCT term)), 1, 8)), 'string_agg', ' ') AS kept FROM (SELECT conv_id, unnest({sql_words('text')}) AS term FROM conversations WHERE role = 'user') WHERE term IN ('the', 'and', 'of', 'der', 'und', 'die', 'la', 'que', 'de', 'les', 'en', 'el') GROUP BY conv_id")
def session_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a session that are in a catalogue, at most eight."""
    catalogue = ("the", "and", "of", "der", "und", "die", "la", "que", "de", "les", "en", "el")
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", F.explode(T.tokens(F.col("text"))).alias("term")).where(F.col("term").isin(*catalogue))
    return rows.groupBy("conv_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("term")), 1, 8), " ").alias("kept"))


@query(_WITH + f""", qn AS (SELECT item_id, list_distinct(regexp_extract_all(text, '[0-9]+')) AS n FROM benchmark), dn AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+')) AS n FROM documents)
SELECT r.item_id, r.doc_id, len(list_intersect(qn.n, dn.n)) AS shared FROM ranked r JOIN qn USING (item_id) JOIN dn USING (doc_id) WHERE r.rank <= 5 AND (len(qn.n) = 0 OR len(list_intersect(qn.n, dn.n)) >= 1)""")
def number_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked evidence that shares a number with its question, where the question has any."""
    docs, questions, index, asked = _parts(spark, sf_dir)
    numbers = lambda df, k, name: df.select(k, F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias(name))
    rows = R.top(R.bm25(index, asked), 5).join(numbers(questions, "item_id", "q"), "item_id").join(numbers(docs, "doc_id", "d"), "doc_id")
    shared = F.size(F.array_intersect("q", "d")).cast("long")
    return rows.where((F.size("q") == 0) | (shared >= 1)).select("item_id", "doc_id", shared.alias("shared"))


@query(_WITH + """, top1 AS MATERIALIZED (SELECT item_id, r.doc_id, d.source, d.text FROM ranked r JOIN documents d USING (doc_id) WHERE rank = 1),
tt AS MATERIALIZED (SELECT item_id, source, term FROM top1 JOIN tf USING (doc_id)),
held AS MATERIALIZED (SELECT source, term, doc_id FROM tf JOIN documents USING (doc_id)),
x AS (SELECT item_id, doc_id, count(*) AS shared FROM tt JOIN held USING (source, term) GROUP BY ALL)
SELECT item_id, doc_id, shared FROM x WHERE shared >= 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) <= 5""")
def evidence_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the best text of each question, the five texts of its source that share most terms with it (two at least)."""
    docs, _, index, asked = _parts(spark, sf_dir)
    best = R.top(R.bm25(index, asked), 1).select("item_id", "doc_id").join(docs.select("doc_id", "source"), "doc_id")
    wanted = best.join(index.terms, "doc_id").select("item_id", "source", "term")
    held = index.terms.join(docs.select("doc_id", "source"), "doc_id").select("doc_id", "source", "term")
    shared = wanted.join(held, ["source", "term"]).groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2")
    return D.keep_first(shared.withColumn("o", F.struct(-F.col("shared"), "doc_id")), "item_id", "o", 5).select("item_id", "doc_id", "shared")


@query(_CONCEPTS + f""", pair AS (SELECT DISTINCT source, term FROM tf JOIN concept USING (term) JOIN documents USING (doc_id)),
asked2 AS (SELECT DISTINCT term FROM (SELECT unnest({sql_words('text')}) AS term FROM conversations WHERE role = 'user'))
SELECT source, term AS concept FROM pair WHERE term NOT IN (SELECT term FROM asked2)""")
def suggest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, concept) pairs that the corpus has evidence for and nobody has asked about."""
    docs, tagged = _tagged(spark, sf_dir)
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.explode(T.tokens(F.col("text"))).alias("concept")).distinct()
    return tagged.join(docs.select("doc_id", "source"), "doc_id").select("source", "concept").distinct().join(asked, "concept", "left_anti").select("source", "concept")


@query(f"""WITH w AS (SELECT conv_id, term, count(*) AS n FROM (SELECT conv_id, unnest({sql_words('text')}) AS term FROM conversations WHERE role = 'user') GROUP BY ALL)
SELECT conv_id, term AS topic, n AS weight FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, term) <= 4""")
def reading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four topics (terms) that a conversation's user gives most weight to."""
    words = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", F.explode(T.words(F.col("text"))).alias("topic"))
    counted = words.groupBy("conv_id", "topic").agg(F.count(F.lit(1)).alias("weight"))
    return D.keep_first(counted.withColumn("o", F.struct(-F.col("weight"), "topic")), "conv_id", "o", 4).select("conv_id", "topic", "weight")


@query("""WITH a AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations)
SELECT conv_id, turn FROM a WHERE reply IS NOT NULL AND contains(lower(reply), lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)))""")
def mapping_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose first two words, taken as a span, stand verbatim in the turn that follows."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").withColumn("reply", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    span = F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))
    return rows.where(F.col("reply").isNotNull() & F.contains(F.lower("reply"), F.lower(span))).select("conv_id", "turn")


@query(_WITH + f"""SELECT conv_id, turn, bool_and(term IN (SELECT term FROM df)) AS in_scope FROM (SELECT conv_id, turn, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS term FROM (SELECT conv_id, turn, {sql_words('text')} AS w FROM conversations WHERE role = 'user')) WHERE term IS NOT NULL GROUP BY conv_id, turn""")
def question_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every term of a user turn is in the corpus vocabulary."""
    vocabulary = terms.term_counts(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).select("term").distinct().withColumn("known", F.lit(True))
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(T.tokens(F.col("text"))).alias("term")).join(vocabulary, "term", "left")
    return rows.groupBy("conv_id", "turn").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("in_scope"))


@query(f"""WITH first AS (SELECT item_id, {sql_norm(f'coalesce({_FIRST}, {chr(39)}{chr(39)})')} AS title FROM benchmark)
SELECT f.item_id, d.doc_id FROM (SELECT doc_id, ' ' || {sql_norm('text')} || ' ' AS q FROM documents) d JOIN first f ON length(f.title) >= 8 AND contains(d.q, ' ' || f.title || ' ')""")
def title_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that contain the title (first sentence) of a benchmark record as a phrase; the title's rarest word anchors
    the join."""
    first = F.coalesce(F.get(T.sentences(F.col("text"), 12), F.lit(0)), F.lit(""))
    titles = table(spark, sf_dir, "benchmark").select("item_id", first.alias("text")).where(F.length(T.norm(F.col("text"))) >= 8)
    return terms.phrase_pairs(table(spark, sf_dir, "documents"), titles, "doc_id", "item_id")


@query()
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1100, 180)


def _sql_end(start: str) -> str:
    """The end of a window of 4,000 characters: behind the last sentence end in its second half, if there is one."""
    cut = f"length(regexp_extract(substr(text, CAST({start} + 2001 AS INTEGER), 2000), '(?s)^(.*[.!?;]\\s)', 1))"
    return f"CASE WHEN {start} + 4000 >= length(text) THEN length(text) ELSE {start} + CASE WHEN {cut} > 0 THEN 2000 + {cut} ELSE 4000 END END"


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, 0 AS pos, 0::BIGINT AS start, {_sql_end('0')} AS stop, text FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, pos + 1, start, {_sql_end('start')}, text FROM (SELECT doc_id, pos, text, greatest(stop - 700, start + 1) AS start FROM w WHERE stop < length(text)))
SELECT doc_id, pos, start::INTEGER AS start, substr(text, CAST(start + 1 AS INTEGER), CAST(stop - start AS INTEGER)) AS "window" FROM w""")
def overlap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.windows(table(spark, sf_dir, "documents"), "doc_id", "text", 4000, 700)


@query("SELECT source AS entity_id, doc_id, 'document' AS kind FROM documents UNION ALL SELECT DISTINCT source, NULL, 'status' FROM documents")
def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows and one status row for each entity in one index."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("entity_id"), "doc_id", F.lit("document").alias("kind"))
    status = docs.select("entity_id").distinct().withColumn("kind", F.lit("status"))
    return docs.unionByName(status, allowMissingColumns=True)
