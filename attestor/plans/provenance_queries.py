"""Provenance: dates that records take over from what they cite, and evidence in depth.

For dates an order stands for a proposal: its lines' latest shipping is when it was captured, its own date when it was
published. Finished orders state a basis, partly shipped ones state that the date is that of the capture, open ones state
none and cite the customer's last order and the last one of the same priority. A customer cites its latest order. For
evidence a document is a record, its sentences are the chunks, its source is the entity; it cites its neighbours in the
order of ids within its language; one of low quality is a note. In the index a document of known quality is a claim, its
source a candidate, whose status is the best quality of its documents, and its language a party."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import expansion as E
from attestor.operators import index_rows as X
from attestor.operators import propagate as P
from attestor.operators import retrieval as R
from attestor.operators.ordered import Ordered
from attestor.plans.registry import Registry, sql_norm
from attestor.plans.retrieval_queries import _WITH, _parts
from attestor.session import written
from attestor.sources.tables import table

registry = Registry()
query = registry.query

_GRAPH = """WITH RECURSIVE shipped AS (SELECT l_orderkey, max(l_shipdate) AS captured FROM lineitem GROUP BY 1),
o AS (SELECT 'proposal:' || o_orderkey AS id, 'entity:' || o_custkey AS owner, o_orderstatus AS s, o_orderdate AS published, captured,
  lag(o_orderkey) OVER last AS a, lag(o_orderkey) OVER alike AS b, lead(o_orderkey) OVER alike AS newer, lead(o_orderkey) OVER last AS later
  FROM orders LEFT JOIN shipped ON l_orderkey = o_orderkey
  WINDOW last AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), alike AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)),
rec AS (SELECT id, 'proposal' AS kind, CASE s WHEN 'F' THEN 'publication' WHEN 'P' THEN 'capture_fallback' END AS basis, captured, published, CASE WHEN newer IS NULL THEN 'current' ELSE 'superseded' END AS status FROM o
  UNION ALL SELECT 'entity:' || c_custkey, 'entity', NULL, NULL, NULL, 'current' FROM customer),
edge AS (SELECT id, 'proposal:' || a AS source FROM o WHERE a IS NOT NULL UNION SELECT id, 'proposal:' || b FROM o WHERE b IS NOT NULL UNION SELECT owner, id FROM o WHERE later IS NULL),
walk AS (SELECT id, 0 AS step, basis, captured, CASE WHEN basis IS NOT NULL THEN 'own' END AS state, CASE WHEN basis IS NOT NULL THEN 0 END AS round FROM rec
  UNION ALL SELECT id, step + 1, coalesce(basis, CASE WHEN low = high THEN low END), CASE WHEN state IS NULL AND low = high THEN earliest ELSE captured END,
    coalesce(state, CASE WHEN low = high THEN 'inherited' WHEN low <> high THEN 'conflict' END), coalesce(round, CASE WHEN low IS NOT NULL THEN step + 1 END)
  FROM (SELECT w.*, n.low, n.high, n.earliest FROM walk w LEFT JOIN (SELECT e.id, min(s.basis) AS low, max(s.basis) AS high, min(s.captured) AS earliest
    FROM edge e JOIN walk s ON s.id = e.source GROUP BY e.id) n ON n.id = w.id AND w.state IS NULL) WHERE (SELECT max(round) FROM walk) = step),
dated AS (SELECT id, basis, captured, coalesce(state, 'unknown') AS state, round FROM walk WHERE step = (SELECT max(step) FROM walk))
"""


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """records (id, kind, basis, captured, published, status) and links (id, source)."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("captured"))
    at, key = ["o_orderdate", "o_orderkey"], F.col("o_orderkey")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    orders = table(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left")
    orders = Ordered(orders, ["o_custkey"], at).last(key, "a").following(key, "later").done()
    orders = Ordered(orders, ["o_custkey", "o_orderpriority"], at).last(key, "b").following(key, "newer").done()
    basis = F.when(F.col("o_orderstatus") == "F", "publication").when(F.col("o_orderstatus") == "P", "capture_fallback")
    status = F.when(F.col("newer").isNull(), "current").otherwise("superseded")
    orders = written(orders.select(node("proposal", "o_orderkey").alias("id"), node("entity", "o_custkey").alias("owner"), F.lit("proposal").alias("kind"), basis.alias("basis"), "captured", F.col("o_orderdate").alias("published"), status.alias("status"), node("proposal", "a").alias("a"), node("proposal", "b").alias("b"), "later"))
    entities = table(spark, sf_dir, "customer").select(node("entity", "c_custkey").alias("id"), F.lit("entity").alias("kind"), F.lit("current").alias("status"))
    records = orders.select("id", "kind", "basis", "captured", "published", "status").unionByName(entities, allowMissingColumns=True)
    cites = orders.select("id", F.explode(F.array_compact(F.array("a", "b"))).alias("source"))
    return records, cites.unionByName(orders.where("later is null").select(F.col("owner").alias("id"), F.col("id").alias("source")))


@query(_GRAPH + "SELECT id, basis, captured, state, round FROM dated")
def propagate_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's basis and captured date after propagation, with the state and the round that gave it."""
    records, links = _records(spark, sf_dir)
    return P.propagate(records.select("id", "basis", "captured"), links)


_FRESH = """, days AS (SELECT kind, status, published, d.captured, CASE WHEN d.basis = 'capture_fallback' THEN coalesce(d.captured, published) ELSE coalesce(published, d.captured) END AS day FROM rec JOIN dated d USING (id))
SELECT greatest(max(day), TIMESTAMP '1995-01-01') AS corpus_freshness, max(captured) AS latest_captured, TIMESTAMP '1995-01-01' AS status_snapshot FROM days WHERE kind IN ('document', 'proposal') AND status <> 'superseded'"""


@query(_GRAPH + _FRESH)
def propagated_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The freshness of the corpus after propagation: active records count with the day that their basis tells."""
    records, links = _records(spark, sf_dir)
    dated = P.propagate(records.select("id", "basis", "captured"), links)
    return P.freshness(records.select("id", "kind", "status", "published").join(dated, "id"), F.lit("1995-01-01").cast("timestamp"))


_STOP = ", ".join(f"'{w}'" for w in E.SUPPORT_STOP)


def _sql_terms(x: str) -> str:
    return f"list_distinct(list_filter(string_split({sql_norm(x)}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})))"


def _sql_numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '\\b\\d+(?:[.,]\\d+)?\\b'))"


_DEPTH = _WITH + f""", said AS (SELECT doc_id, source, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?…]+(?:[.!?…]+|$)'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) >= 12) AS ss,
  list_filter([lag(doc_id) OVER w, lead(doc_id) OVER w], lambda x: x IS NOT NULL) AS sources FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id)),
grade AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1),
chunk AS MATERIALIZED (SELECT record, c AS chunk, text, title, entity, kind, c // 20 AS section FROM (SELECT doc_id AS record, source AS entity, ss[1] AS title,
  CASE WHEN quality = 0 THEN 'note' ELSE 'document' END AS kind, unnest(ss) AS text, unnest(range(len(ss))) AS c FROM said LEFT JOIN grade USING (doc_id))),
base AS MATERIALIZED (SELECT item_id, rank, doc_id AS record, score, source AS entity, coalesce(text, '') AS text, ss[1] AS title, sources FROM ranked JOIN said USING (doc_id) WHERE rank <= 5),
own AS (SELECT item_id, rank, 0 AS step, 0 AS pos, 0 AS nth, 'base' AS origin, NULL::BIGINT AS claim, record, NULL::BIGINT AS chunk, entity, NULL::VARCHAR AS owner, entity AS path, NULL::BIGINT AS section, score, text FROM base),
same AS (SELECT item_id, rank, 1, 0, c.chunk, 'record', NULL, record, c.chunk, c.entity, NULL, c.entity, c.section, greatest(0.1, round(score * 0.55, 6)), c.text FROM base JOIN chunk c USING (record) WHERE c.chunk < 3),
wants AS MATERIALIZED (SELECT item_id, rank, record AS claim, entity, score, {_sql_terms("text || ' ' || coalesce(title, '')")} AS t, {_sql_numbers('text')} AS n, unnest(sources) AS record, unnest(range(len(sources))) AS pos FROM base),
held AS MATERIALIZED (SELECT *, {_sql_terms("title || ' ' || text")} AS t, {_sql_numbers('text')} AS n FROM chunk WHERE kind = 'document' AND record IN (SELECT record FROM wants)),
met AS (SELECT a.item_id, a.rank, a.claim, a.pos, a.score, a.entity AS speaker, h.record, h.chunk, h.entity, h.section, h.text, len(list_intersect(a.t, h.t)) AS shared, len(list_intersect(a.n, h.n)) AS numbers, len(a.t) AS x, len(h.t) AS y FROM wants a JOIN held h USING (record)),
near AS (SELECT *, row_number() OVER (PARTITION BY item_id, rank, pos ORDER BY round(shared + least(3.0, numbers * 1.5) + shared / greatest(1, least(x, y)), 6) DESC, chunk) AS nth FROM met WHERE shared >= 2),
cited AS (SELECT item_id, rank, 2, pos, nth, 'cited', claim, record, chunk, speaker, entity, entity, section, greatest(0.1, round(score * 0.5, 6)), text FROM near WHERE nth <= 3),
rows_ AS (SELECT *, CASE step WHEN 0 THEN 0 ELSE 1 END AS later FROM (SELECT * FROM own UNION ALL SELECT * FROM same UNION ALL SELECT * FROM cited)),
once AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY item_id, claim, record, path, section, entity, trim(text, ' ' || chr(9) || chr(10) || chr(13)) ORDER BY later, rank, step, pos, nth) = 1)
SELECT item_id, place::INTEGER AS place, origin, claim, record, chunk, entity, owner, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY later, rank, step, pos, nth) AS place FROM once) WHERE place <= 36"""


@query(_DEPTH)
def evidence_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each question, their first sentences and the sentences of their neighbours that support
    them, with lower scores, one row for each key of six fields."""
    docs, _, index, asked = _parts(spark, sf_dir)
    order = Ordered(docs.select("doc_id", "lang"), ["lang"], ["doc_id"])
    beside = order.last(F.col("doc_id"), "before").following(F.col("doc_id"), "after").done()
    beside = beside.select("doc_id", F.array_compact(F.array("before", "after")).alias("sources"))
    grade = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    kind = F.when(F.col("quality") == 0, "note").otherwise("document")
    best = written(R.best(index, asked, 5).select("item_id", "rank", "doc_id", "score"))
    # the few rows of each step are written, so that Spark knows their size and sends them to the texts, not the texts to them
    best = written(best.join(beside, "doc_id"))
    evidence = best.join(docs.select("doc_id", "source", "text"), "doc_id")
    title = F.get(T.sentences(F.col("text")), F.lit(0))
    evidence = written(evidence.select("item_id", "rank", F.col("doc_id").alias("record"), "score", F.col("source").alias("entity"), F.col("source").alias("path"), F.lit(None).cast("long").alias("section"), title.alias("title"), "text", "sources"))
    # only records that the evidence is, or cites, are cut into chunks
    touched = written(best.select(F.explode(F.concat("sources", F.array("doc_id"))).alias("doc_id")).distinct())
    cut = docs.join(touched, "doc_id", "left_semi").join(grade, "doc_id", "left").select("doc_id", "source", kind.alias("kind"), T.sentences(F.col("text")).alias("said"))
    cut = cut.select(F.col("doc_id").alias("record"), F.col("source").alias("entity"), F.col("source").alias("path"), "kind", F.get("said", F.lit(0)).alias("title"), F.posexplode("said").alias("chunk", "text"))
    chunks = cut.withColumn("section", F.floor(F.col("chunk") / 20))
    return E.expand(evidence, written(chunks))


_INDEX = """WITH d AS (SELECT doc_id, lang, source, quality, list_filter(list_transform(regexp_extract_all(text, '[^.!?…]+(?:[.!?…]+|$)'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) >= 12) AS ss,
  coalesce((lag(doc_id) OVER w)::VARCHAR, '') AS a, coalesce((lead(doc_id) OVER w)::VARCHAR, '') AS b FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY doc_id)),
c AS (SELECT source AS id, CASE WHEN max(quality) = 1 THEN 'declared' ELSE 'potential' END AS status, CASE WHEN count(quality) > 0 THEN 'medium' ELSE 'low' END AS confidence, min(lang) AS party FROM d WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT DISTINCT lang AS id FROM d WHERE lang IS NOT NULL),
r AS (SELECT d.*, quality IS NOT NULL AS claim, CASE quality WHEN 1 THEN 'current' WHEN 0 THEN 'withdrawn' ELSE 'unknown' END AS st, unnest(ss) AS text, unnest(range(len(ss))) AS n FROM d)
SELECT 'candidate:' || id AS id, id AS record, 'candidate_status' AS kind, id AS entity, id AS entity_label, 'Statut de ' || id AS title, id || '. Statut : ' || status || '. Confiance : ' || confidence || '. Parti : ' || party || '.' AS text,
  'data/entities.json' AS path, NULL AS source_url, NULL AS source_tier, 'current' AS document_status, NULL AS proposal_status, '' AS supersedes, '' AS superseded_by, '' AS source_documents, status AS candidate_status, '2027-01-01' AS published,
  confidence, NULL AS certainty, 'candidat,candidature,statut,' || status || ',' || party AS topics, 'Statut' AS section, 0::INTEGER AS chunk FROM c
UNION ALL SELECT 'party:' || id, id, 'party_profile', id, id, 'Parti : ' || id, id || ' est un parti ou mouvement du corpus.', 'data/entities.json', 'https://' || id || '.example', 'tier_1_primary_official', 'current', NULL, '', '', '', NULL, '2027-01-01',
  'high', NULL, 'parti,mouvement,programme', 'Profil', 0 FROM p
UNION ALL SELECT doc_id || '#' || (n + 1), doc_id::VARCHAR, CASE WHEN claim THEN 'proposal' ELSE 'document' END, source, coalesce(source, 'Entité inconnue'), ss[1], text, source || '/' || doc_id, NULL, NULL, st, CASE WHEN claim THEN st END, a, b,
  concat_ws(',', nullif(a, ''), nullif(b, '')), c.status, NULL, CASE WHEN quality = 1 THEN 'high' ELSE c.confidence END, CASE WHEN claim THEN 'explicit' END, concat_ws(',', lang, st), (n // 20)::VARCHAR, n FROM r LEFT JOIN c ON c.id = r.source"""


@query(_INDEX)
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole index: statuses, profiles, and every sentence of the corpus as a piece of a document or claim. Lists are
    joined by commas."""
    docs = table(spark, sf_dir, "documents")
    order = Ordered(docs.select("doc_id", "lang"), ["lang"], ["doc_id"]).last(F.col("doc_id"), "before").following(F.col("doc_id"), "after").done().select("doc_id", "before", "after")
    grade = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    graded = docs.select("doc_id", "lang", "source").join(grade, "doc_id", "left")
    named = graded.where("source is not null").groupBy(F.col("source").alias("id")).agg(F.max("quality").alias("best"), F.count("quality").alias("n"), F.min("lang").alias("party"))
    none = F.lit(None).cast("string")
    candidates = named.select("id", F.col("id").alias("name"), F.when(F.col("best") == 1, "declared").otherwise("potential").alias("status"), F.when(F.col("n") > 0, "medium").otherwise("low").alias("confidence"), none.alias("declared"), none.alias("as_of"), "party", none.alias("source_url"), none.alias("source_tier"))
    candidates = written(candidates)
    parties = docs.where("lang is not null").select(F.col("lang").alias("id"), F.col("lang").alias("name"), F.concat(F.lit("https://"), "lang", F.lit(".example")).alias("website")).distinct()
    cut = docs.select("doc_id", T.sentences(F.col("text")).alias("said"))
    titles = cut.select("doc_id", F.get("said", F.lit(0)).alias("title"))
    stated = F.when(F.col("quality") == 1, "current").when(F.col("quality") == 0, "withdrawn").otherwise("unknown")
    claim, ids = F.col("quality").isNotNull(), lambda *c: F.array_compact(F.array(*c)).cast("array<string>")
    records = graded.join(order, "doc_id").join(titles, "doc_id").select(
        F.col("doc_id").cast("string").alias("record"), claim.alias("claim"), F.col("source").alias("entity"), "title", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        none.alias("source_url"), none.alias("primary_url"), none.alias("source_tier"), F.when(~claim, stated).alias("document_status"), F.when(claim, stated).alias("proposal_status"),
        ids("before").alias("supersedes"), ids("after").alias("superseded_by"), ids("before", "after").alias("source_documents"), none.alias("published"), none.alias("first_documented"),
        F.when(F.col("quality") == 1, "verified").alias("verification"), F.when(claim, "explicit").alias("certainty"), F.array("lang").alias("topics"),
    )
    pieces = cut.select(F.col("doc_id").cast("string").alias("record"), F.posexplode("said").alias("chunk", "text")).withColumn("section", F.floor(F.col("chunk") / 20).cast("string"))
    rows = X.assemble(candidates, parties, records, pieces, F.lit("2027-01-01"))
    return rows.select(*(F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in X.FIELDS.items()))
