"""The two scoring profiles over records, with every field and bonus, and the greedy choice of what is shown.

Records are the documents: the title is the first sentence, the section the second, the topic the language, the entity the
source; kind, status, confidence and tier are read off the labels. Questions are the benchmark passages, of which three in
four begin with a word that shows an intent, and every third names a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import chain as C
from attestor.operators import fields as P
from attestor.plans.gate_queries import _ONTOLOGY, _ontology
from attestor.plans.registry import Registry, _STOP, sql_norm, sql_normalize, sql_words
from attestor.session import written
from attestor.sources.tables import table

registry = Registry()
query = registry.query

_OPENINGS = ("comparaison", "programme", "source", "")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    nth = lambda k: F.coalesce(F.get(T.sentences(F.col("text"), 1), F.lit(k)), F.lit(""))
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "text", nth(0).alias("title"), nth(1).alias("section"), F.coalesce("lang", F.lit("")).alias("topics"), F.col("source").alias("entity_label"), F.col("source").alias("entity"),
        F.when(toxic, "candidate_status").when(good, "proposal").when(F.col("quality") == 0, "document").otherwise("note").alias("kind"),
        F.when(F.col("quality").isNotNull(), "current").otherwise("unknown").alias("status"),
        F.when(good, "high").otherwise("medium").alias("confidence"),
        F.when(F.col("toxic") == 0, "tier_1_primary_official").otherwise("other").alias("tier"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source_url"),
        F.concat_ws("/", "source", "lang").alias("path"),
    )


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    opening = F.element_at(F.array(*map(F.lit, _OPENINGS)), (F.col("item_id") % 4 + 1).cast("int"))
    named = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).otherwise("")
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws(" ", opening, named, F.coalesce("text", F.lit(""))).alias("text"))


def _aliases(records: DataFrame) -> DataFrame:
    """(entity, alias) of the sources."""
    return records.where("entity is not null").select("entity", T.norm(F.col("entity")).alias("alias")).distinct()


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_SENTENCES = "list_filter(list_transform(regexp_extract_all(text, '[^.!?…]+(?:[.!?…]+|$)'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) >= 1)"
_TEXTS = ["text", "title", "section", "topics", "entity_label"]


def _sql_raw(x: str) -> str:
    return f"list_filter(string_split({sql_norm(x)}, ' '), lambda w: w <> '')"


def _sql_plain(x: str) -> str:
    return f"list_distinct(list_filter({_sql_raw(x)}, lambda w: (length(w) > 1 OR regexp_full_match(w, '[0-9]+')) AND w NOT IN ({_STOP})))"


def _sql_intents(patterns: dict[str, str]) -> str:
    return ", ".join(f"regexp_matches(' ' || {sql_normalize('text')} || ' ', '{p.replace('(?:', '(')}') AS {name}" for name, p in patterns.items())


_BASE = f"""
WITH RECURSIVE rec AS MATERIALIZED (SELECT doc_id, text, coalesce({_SENTENCES}[1], '') AS title, coalesce({_SENTENCES}[2], '') AS section, coalesce(lang, '') AS topics, source AS entity_label, source AS entity,
  CASE WHEN toxic = 1 THEN 'candidate_status' WHEN quality = 1 THEN 'proposal' WHEN quality = 0 THEN 'document' ELSE 'note' END AS kind,
  CASE WHEN quality IS NOT NULL THEN 'current' ELSE 'unknown' END AS status, CASE WHEN quality = 1 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN toxic = 0 THEN 'tier_1_primary_official' ELSE 'other' END AS tier, CASE WHEN doc_id % 2 = 0 THEN source END AS source_url, source || '/' || lang AS path
  FROM documents LEFT JOIN labels USING (doc_id)),
questions AS MATERIALIZED (SELECT item_id, CASE item_id % 4 {' '.join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_OPENINGS))} END || ' ' || CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 20) ELSE '' END || ' ' || coalesce(text, '') AS text FROM benchmark),
alias AS (SELECT DISTINCT entity, {sql_norm('entity')} AS alias FROM rec WHERE entity IS NOT NULL)"""

# greedy choice: a walk over the ranks that carries what was taken
_WALK = """
places AS MATERIALIZED (SELECT item_id, doc_id, score, path, entity, path_cap, entity_cap, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM coherent),
walk AS (SELECT item_id, 0::BIGINT AS n, 0 AS taken, false AS took, []::VARCHAR[] AS paths, []::VARCHAR[] AS entities FROM (SELECT DISTINCT item_id FROM places)
  UNION ALL SELECT item_id, n, taken + CAST(take AS INT), take, CASE WHEN take THEN list_append(paths, path) ELSE paths END, CASE WHEN take THEN list_append(entities, entity) ELSE entities END
  FROM (SELECT w.item_id, p.n, taken, paths, entities, p.path, p.entity, taken < {limit} AND len(list_filter(paths, lambda x: x IS NOT DISTINCT FROM p.path)) < path_cap AND len(list_filter(entities, lambda x: x IS NOT DISTINCT FROM p.entity)) < entity_cap AS take
    FROM walk w JOIN places p ON p.item_id = w.item_id AND p.n = w.n + 1 WHERE taken < {limit}))
SELECT item_id, taken AS rank, doc_id, score FROM walk JOIN places USING (item_id, n) WHERE took"""


def _sql_bonus(w: dict[str, float]) -> str:
    return f"""CASE WHEN candidate_status AND kind = 'candidate_status' THEN {w['status_intent']} ELSE 0 END + CASE WHEN programme AND kind IN ('proposal', 'document') THEN {w['programme_intent']} ELSE 0 END
 + CASE WHEN compare AND kind = 'proposal' THEN {w['compare_intent']} ELSE 0 END + CASE WHEN i.source AND source_url IS NOT NULL THEN {w['source_intent']} ELSE 0 END + CASE WHEN kind = 'proposal' THEN {w['proposal']} ELSE 0 END
 + CASE WHEN status = 'current' THEN {w['current']} ELSE 0 END + CASE WHEN confidence = 'high' THEN {w['high']} ELSE 0 END + CASE WHEN tier = 'tier_1_primary_official' THEN {w['primary']} ELSE 0 END"""


_TERM = (
    _BASE
    + ", "
    + _ONTOLOGY.replace("(SELECT conv_id || ':' || turn AS item_id, text FROM conversations WHERE role = 'user')", "questions").strip()
    + f""",
cut AS (SELECT doc_id, f, unnest(w) AS term FROM ({' UNION ALL '.join(f"SELECT doc_id, '{t}' AS f, {sql_words(f'coalesce({t}, {chr(39)}{chr(39)})')} AS w FROM rec" for t in _TEXTS)})),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, bool_or(f = 'title') AS in_title, bool_or(f = 'section') AS in_section, bool_or(f = 'topics') AS in_topics, bool_or(f = 'entity_label') AS in_entity FROM cut GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), len AS (SELECT doc_id, sum(tf) AS length FROM post GROUP BY doc_id),
size AS (SELECT (SELECT count(*) FROM rec) AS n, ((SELECT sum(length) - count(*) FROM len) + (SELECT count(*) FROM rec)) / (SELECT count(*) FROM rec) AS mean),
weight AS MATERIALIZED (SELECT doc_id, term, in_title, in_section, in_topics, in_entity, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.72 + 0.72 * length / greatest(1, mean))) AS bm25 FROM post JOIN df USING (term) JOIN len USING (doc_id), size),
tok AS MATERIALIZED (SELECT DISTINCT item_id, unnest({sql_words('text')}) AS term FROM questions),
ents AS MATERIALIZED (SELECT DISTINCT item_id, entity FROM (SELECT item_id, entity FROM qgram JOIN alias ON gram = alias UNION ALL
  SELECT item_id, entity FROM qgram JOIN alias ON length(gram) >= 5 AND length(alias) >= 5 AND NOT contains(gram, ' ') AND NOT contains(alias, ' ') AND damerau_levenshtein(gram, alias) = 1)),
ent_terms AS (SELECT DISTINCT item_id, unnest({sql_words('alias')}) AS term FROM ents JOIN alias USING (entity)),
subjects AS MATERIALIZED (SELECT item_id, term FROM tok WHERE term NOT IN ({_list(P.GENERIC)}) AND (item_id, term) NOT IN (SELECT (item_id, term) FROM ent_terms)),
numbers AS (SELECT item_id, term FROM tok WHERE regexp_full_match(term, '[0-9]+') AND term <> '2027'),
intent AS (SELECT item_id, {_sql_intents(P.INTENTS)} FROM questions),
terms_of AS (SELECT DISTINCT concept, unnest({sql_words('alias')}) AS term FROM ontology), first_pair AS (SELECT concept, min(alias) AS alias FROM ontology WHERE contains(alias, ' ') GROUP BY concept),
anchors AS (SELECT DISTINCT concept, unnest({sql_words('alias')}) AS term FROM first_pair),
subject_hits AS (SELECT item_id, doc_id, sum(2.7 * bm25 + 2.8 * CAST(in_title AS INT) + 2.2 * CAST(in_section AS INT) + 2.3 * CAST(in_topics AS INT) + 4.5 * CAST(in_entity AS INT)) AS v, count(*) AS direct FROM subjects JOIN weight USING (term) GROUP BY ALL),
number_hits AS (SELECT item_id, doc_id, count(*) AS m FROM numbers JOIN weight USING (term) GROUP BY ALL),
four AS (SELECT item_id, doc_id, concept, bm25 FROM concepts JOIN terms_of USING (concept) JOIN weight USING (term) QUALIFY row_number() OVER (PARTITION BY item_id, doc_id, concept ORDER BY bm25 DESC) <= 4),
per AS (SELECT item_id, doc_id, concept, 5.5 + least(7, 0.8 * sum(bm25)) AS v FROM four f WHERE concept NOT IN (SELECT concept FROM anchors) OR EXISTS (SELECT 1 FROM anchors a JOIN post p USING (term) WHERE a.concept = f.concept AND p.doc_id = f.doc_id) GROUP BY ALL),
concept_hits AS (SELECT item_id, doc_id, sum(v) AS v, count(*) AS c FROM per GROUP BY ALL),
anchor_hits AS (SELECT DISTINCT item_id, doc_id FROM concepts JOIN anchors USING (concept) JOIN post USING (term)),
pairs AS (SELECT item_id, doc_id FROM subject_hits UNION SELECT item_id, doc_id FROM number_hits UNION SELECT item_id, doc_id FROM four UNION SELECT item_id, doc_id FROM anchor_hits),
scored AS MATERIALIZED (SELECT item_id, doc_id, round(coalesce(s.v, 0) + coalesce(c.v, 0) + CASE WHEN e.entity IS NOT NULL THEN 18 ELSE 0 END + 7 * coalesce(m, 0) + {_sql_bonus(P.TERM_BONUS)}, 6) AS score,
  coalesce(direct, 0) AS direct, coalesce(c, 0) AS concepts, e.entity IS NOT NULL AS entity_match, coalesce(m, 0) AS numbers, r.entity, r.path, kind, compare, candidate_status
  FROM pairs JOIN rec r USING (doc_id) JOIN intent i USING (item_id) LEFT JOIN subject_hits s USING (item_id, doc_id) LEFT JOIN concept_hits c USING (item_id, doc_id) LEFT JOIN number_hits USING (item_id, doc_id)
  LEFT JOIN ents e ON e.item_id = pairs.item_id AND e.entity = r.entity),
asked AS (SELECT item_id, (SELECT count(*) FROM subjects s WHERE s.item_id = q.item_id) AS subjects, (SELECT count(*) FROM ents s WHERE s.item_id = q.item_id) AS requested,
  (SELECT count(*) FROM numbers s WHERE s.item_id = q.item_id) AS wanted, (SELECT count(*) FROM concepts s WHERE s.item_id = q.item_id) AS named,
  (SELECT coalesce(bool_or(fuzzy OR contains(alias, ' ')), false) FROM concepts s WHERE s.item_id = q.item_id) AS bridge FROM questions q),
relevant AS (SELECT s.* FROM scored s JOIN asked a USING (item_id) WHERE score >= 2.2 AND (requested = 0 OR entity_match) AND (wanted = 0 OR numbers >= 1)
  AND CASE WHEN named > 0 THEN concepts > 0 AND (subjects = 0 OR direct > 0 OR bridge OR requested > 0)
    WHEN subjects > 0 THEN direct >= CASE WHEN subjects <= 2 THEN subjects ELSE greatest(2, ceil(subjects * 0.45)) END ELSE candidate_status AND kind = 'candidate_status' END)"""
)

_TERM_COHERENT = ", coherent AS (SELECT *, 2 AS path_cap, CASE WHEN compare THEN 4 ELSE 5 END AS entity_cap FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM relevant) WHERE score >= best * CASE WHEN compare THEN 0.25 ELSE 0.4 END),"


def _term_scored(spark: SparkSession, sf_dir: str, of_path: int | None = None) -> DataFrame:
    records = written(_records(spark, sf_dir))
    index, ontology = P.field_index(records), _ontology(spark, sf_dir)
    asked = P.analysed(_questions(spark, sf_dir), ontology, _aliases(records))
    cut = lambda rows: rows.select("concept", F.explode(T.tokens(F.col("alias"))).alias("term")).distinct()
    first = ontology.where(F.contains("alias", F.lit(" "))).groupBy("concept").agg(F.min("alias").alias("alias"))
    return P.term_profile(index, asked, cut(ontology), cut(first), of_path=of_path)


@query(_TERM + " SELECT item_id, doc_id, score, direct, concepts, entity_match, numbers FROM relevant")
def term_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that answers a question, with the whole score of the term profile and what it is made of. A concept's anchors are
    the words of its first pair."""
    columns = ["item_id", "doc_id", "score", "direct", "concepts", "entity_match", "numbers"]
    return _term_scored(spark, sf_dir).select(*columns)


@query(_TERM + _TERM_COHERENT + _WALK.replace("{limit}", "10"))
def term_profile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten records a question at most: those near the best score, two of a path, five of an entity (four where the question compares)."""
    rows = P.coherent(_term_scored(spark, sf_dir, of_path=2))
    return P.diversify(rows, F.lit(2), F.when(F.col("compare"), 4).otherwise(5), 10)


_RARITY = (
    _BASE
    + f""",
cut AS (SELECT doc_id, f, unnest(w) AS term FROM ({' UNION ALL '.join(f"SELECT doc_id, '{t}' AS f, {_sql_raw(f'coalesce({t}, {chr(39)}{chr(39)})')} AS w FROM rec" for t in _TEXTS)})),
post AS MATERIALIZED (SELECT DISTINCT doc_id, term, f FROM cut),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM post WHERE f <> 'section' GROUP BY term),
asked0 AS (SELECT item_id, unnest({_sql_plain('text')}) AS term FROM questions),
asked AS MATERIALIZED (SELECT item_id, term, term NOT IN ({_list(P.FILLER + P.INTENT_ONLY)}) AS signal, ln(((SELECT count(*) FROM rec) + 1) / (coalesce(df, 0) + 1)) + 1 AS rarity FROM asked0 LEFT JOIN df USING (term)),
forms AS (SELECT item_id, term, signal, rarity, unnest(CASE WHEN regexp_full_match(term, '[a-z]{{5,}}') THEN list_distinct([term, CASE WHEN term LIKE '%s' THEN left(term, length(term) - 1) ELSE term || 's' END, CASE WHEN term LIKE '%x' THEN left(term, length(term) - 1) ELSE term END]) ELSE [term] END) AS form FROM asked),
member AS (SELECT doc_id, alias AS term FROM rec JOIN alias USING (entity)),
hit AS MATERIALIZED (SELECT DISTINCT item_id, doc_id, term, signal, rarity, f FROM (SELECT item_id, doc_id, forms.term, signal, rarity, f FROM forms JOIN post ON post.term = form
  UNION ALL SELECT item_id, doc_id, term, signal, rarity, 'entity_label' FROM asked JOIN member USING (term))),
sums AS (SELECT item_id, doc_id, sum(rarity * CASE f {' '.join(f"WHEN '{f}' THEN {w}" for f, w in P.RARITY_FIELDS.items())} END) AS v, count(DISTINCT term) AS matched, count(DISTINCT CASE WHEN signal THEN term END) AS hit FROM hit GROUP BY ALL),
wording AS (SELECT item_id, {sql_norm('text')} AS wording FROM questions),
ordered AS (SELECT item_id, string_agg(w, ' ' ORDER BY k) AS in_a_row FROM (SELECT item_id, w, min(k) AS k FROM (SELECT item_id, unnest(w) AS w, unnest(range(len(w))) AS k FROM (SELECT item_id, {_sql_raw('text')} AS w FROM questions))
  WHERE (length(w) > 1 OR regexp_full_match(w, '[0-9]+')) AND w NOT IN ({_STOP}) AND w NOT IN ({_list(P.FILLER + P.INTENT_ONLY)}) GROUP BY ALL) GROUP BY item_id),
hay AS MATERIALIZED (SELECT doc_id, {sql_norm("title || ' ' || coalesce(entity_label, '') || ' ' || section || ' ' || topics || ' ' || coalesce(text, '')")} AS hay FROM rec),
intent AS (SELECT item_id, {_sql_intents(P.RARITY_INTENTS)} FROM questions),
scored AS MATERIALIZED (SELECT s.item_id, s.doc_id, round(v + CASE WHEN length(wording) > 6 AND contains(hay, wording) THEN 12 ELSE 0 END + CASE WHEN coalesce(in_a_row, '') <> '' AND contains(hay, in_a_row) THEN 4 ELSE 0 END + {_sql_bonus(P.RARITY_BONUS)}, 6) AS score,
  matched, hit, coalesce(in_a_row, '') <> '' AND contains(hay, in_a_row) AS phrase, (SELECT count(*) FROM asked a WHERE a.item_id = s.item_id AND signal) AS signals, coalesce(in_a_row, '') AS in_a_row, r.entity, path, kind, compare, candidate_status, programme, i.source
  FROM sums s JOIN rec r USING (doc_id) JOIN hay USING (doc_id) JOIN intent i USING (item_id) JOIN wording USING (item_id) LEFT JOIN ordered USING (item_id)),
relevant AS (SELECT * FROM scored WHERE score >= 1.8 AND CASE WHEN signals = 0 THEN candidate_status OR compare OR programme OR source
  ELSE hit >= CASE WHEN signals <= 2 THEN signals ELSE greatest(2, ceil(signals * 0.5)) END AND (NOT (signals = 2 AND regexp_matches(in_a_row, '(^|\\s)[0-9]{{1,2}}($|\\s)')) OR phrase) END)"""
)


def _rarity_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = written(_records(spark, sf_dir))
    aliases = _aliases(records).select("entity", F.col("alias").alias("term"))
    return P.rarity_profile(P.word_index(records), _questions(spark, sf_dir), aliases)


@query(_RARITY + " SELECT item_id, doc_id, score, matched, hit, phrase FROM relevant")
def rarity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that answers a question, with the whole score of the rarity profile."""
    return _rarity_scored(spark, sf_dir).select("item_id", "doc_id", "score", "matched", "hit", "phrase")


@query(_RARITY + ", coherent AS (SELECT *, CASE WHEN kind = 'candidate_status' THEN 1 ELSE 3 END AS path_cap, CASE WHEN compare THEN 3 ELSE 5 END AS entity_cap FROM relevant)," + _WALK.replace("{limit}", "8"))
def rarity_profile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight records a question at most: three of a path (one of a candidate's status), five of an entity (three where the question compares)."""
    rows = _rarity_scored(spark, sf_dir)
    return P.diversify(rows, F.when(F.col("kind") == "candidate_status", 1).otherwise(3), F.when(F.col("compare"), 3).otherwise(5), 8)


def _world(spark: SparkSession, sf_dir: str) -> C.World:
    """Sources below 10 stand for candidates, the others for parties; every second candidate has the party ten above it."""
    records, ontology = written(_records(spark, sf_dir)), _ontology(spark, sf_dir)
    number = F.expr("try_cast(regexp_replace(entity, '[^0-9]', '') AS int)")
    person = number < 10
    entities = _aliases(records).select("entity", "alias", F.when(person, "candidate").otherwise("party").alias("type"), F.when(person & (number % 2 == 0), F.concat(F.lit("src"), (number + 10).cast("string"))).alias("party"))
    cut = lambda rows: rows.select("concept", F.explode(T.tokens(F.col("alias"))).alias("term")).distinct()
    first = ontology.where(F.contains("alias", F.lit(" "))).groupBy("concept").agg(F.min("alias").alias("alias"))
    strict = first.select("concept", F.array(F.split("alias", " ")).alias("groups"))
    benign = table(spark, sf_dir, "region").select(T.norm(F.col("r_name")).alias("term"))
    return C.World(P.field_index(records), ontology, cut(first), strict, written(entities), cut(ontology).select("term").distinct(), benign)


@query()
def retrieve_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with its reason and tries, and the evidence of those that have any."""
    questions = _questions(spark, sf_dir).select(F.col("item_id").cast("string").alias("item_id"), "text")
    evidence, reasons = C.retrieve(_world(spark, sf_dir), questions)
    return reasons.join(evidence, "item_id", "left").select("item_id", "reason", "tries", "rank", "doc_id", "entity", "score", "origin")
