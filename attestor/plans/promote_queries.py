"""Promotion and dates over the driver's tables: orders stand for claims, customers for sources, line items for
provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import dates as D
from attestor.functions import text as T
from attestor.operators import claims as C
from attestor.operators import promote as P
from attestor.operators import retrieval as R
from attestor.operators import terms
from attestor.plans import claim_queries as Q
from attestor.plans.dedupe_queries import _CONCEPTS, _tagged
from attestor.plans.registry import Registry, sql_norm, sql_words
from attestor.plans.retrieval_queries import _parts
from attestor.sources import pages as S
from attestor.sources.tables import table

registry = Registry()
query = registry.query


@query(f"SELECT e.subject, e.relation, e.object, s.kind AS subject_kind, o.kind AS object_kind FROM ({Q._EDGES}) e JOIN ({Q._NODES}) s ON s.id = e.subject JOIN ({Q._NODES}) o ON o.id = e.object")
def evidence_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the kinds of their ends; edges with a missing end are left out."""
    nodes, edges = Q._nodes(spark, sf_dir), Q._edges(spark, sf_dir)
    ends = edges.join(nodes.select(F.col("id").alias("subject"), F.col("kind").alias("subject_kind")), "subject").join(nodes.select(F.col("id").alias("object"), F.col("kind").alias("object_kind")), "object")
    return ends.select("subject", "relation", "object", "subject_kind", "object_kind")


_MARKDOWN = "text"
for _pattern, _to in ((r"(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"(?m)^#{1,6}\s*", ""), (r"(?m)^\s*(?:[-*+]|\d+\.)\s+", ""), (r"(?m)^>\s?", ""), (r"[*_`~]+", "")):
    _MARKDOWN = f"regexp_replace({_MARKDOWN}, '{_pattern}', '{_to}', 'g')"


@query(f"SELECT doc_id, trim({_MARKDOWN}) AS plain FROM documents")
def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_markdown(F.col("text")).alias("plain"))


_MONTH = f"list_extract([{', '.join(repr(m) for m in D.MONTHS)}], CAST(month(d) AS INTEGER))"
_FORMS = f"[strftime(d, '%Y-%m-%d'), strftime(d, '%d/%m/%Y'), day(d) || '.' || month(d) || '.' || year(d), day(d) || ' ' || {_MONTH} || ' ' || year(d)]"


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), t AS (SELECT o_orderkey, d, 'signé le ' || list_extract({_FORMS}, CAST(o_orderkey % 4 + 1 AS INTEGER)) || ', publié.' AS said FROM o),
n AS (SELECT o_orderkey, CAST(d + 1 AS DATE) AS d, said FROM t)
SELECT o_orderkey, len(list_filter({_FORMS.replace('(d', '(t.d').replace('month(t.d)', 'month(t.d)')}, lambda f: regexp_matches(said, '(^|[^0-9])' || replace(f, '.', '[.]') || '($|[^0-9])'))) > 0 AS own,
(SELECT len(list_filter({_FORMS.replace('(d', '(n.d')}, lambda f: regexp_matches(n.said, '(^|[^0-9])' || replace(f, '.', '[.]') || '($|[^0-9])'))) > 0 FROM n WHERE n.o_orderkey = t.o_orderkey) AS next FROM t""")
def date_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text that gives an order's date in one of four forms supports that date, and the day after."""
    date, day = F.to_date("o_orderdate"), F.dayofmonth("o_orderdate").cast("string")
    month = F.element_at(F.array(*map(F.lit, D.MONTHS)), F.month("o_orderdate"))
    forms = F.array(date.cast("string"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.date_format("o_orderdate", "d.M.yyyy"), F.concat_ws(" ", day, month, F.year("o_orderdate").cast("string")))
    text = F.concat(F.lit("signé le "), F.element_at(forms, (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit(", publié."))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.supported_by(date, text).alias("own"), D.supported_by(F.date_add(date, 1), text).alias("next"))


_WHERE = "lower(url || ' ' || regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"


@query(f"""SELECT page_id, CASE WHEN contains(t, '2027') THEN 'current' WHEN len(y) = 0 THEN 'undated' WHEN list_max(y) <= 2024 THEN 'old' ELSE 'current' END AS scope
FROM (SELECT page_id, {_WHERE} AS t, list_transform(regexp_extract_all({_WHERE}, '\\b(19\\d\\d|20\\d\\d)\\b', 1), lambda x: CAST(x AS INTEGER)) AS y FROM pages)""")
def scope_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", D.scope(F.col("url"), S.title(F.col("html"))).alias("scope"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') WHEN 1 THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')
WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def flexible_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written as a year, a month, a day and in a form that isn't a date."""
    kind = F.col("o_orderkey") % 4
    written = F.when(kind == 0, F.date_format("o_orderdate", "yyyy")).when(kind == 1, F.date_format("o_orderdate", "yyyy-MM")).when(kind == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd MMM"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.flexible(written).cast("string").alias("day"))


@query(_CONCEPTS + f""", qc AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({sql_words('text')}) AS term FROM benchmark) WHERE term IN (SELECT term FROM concept)),
sh AS (SELECT item_id, doc_id, count(*) AS concepts FROM qc JOIN tf USING (term) GROUP BY ALL)
SELECT item_id, doc_id, round(2.7 * score + CASE WHEN coalesce(concepts, 0) > 0 THEN 5.5 + least(7.0, 0.8 * least(4, concepts)) ELSE 0.0 END, 7)::DOUBLE AS score, coalesce(concepts, 0) AS concepts FROM scored LEFT JOIN sh USING (item_id, doc_id)""")
def bm25_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, questions, index, asked = _parts(spark, sf_dir)
    tagged = _tagged(spark, sf_dir)[1]
    named = questions.select("item_id", F.explode(T.tokens(F.col("text"))).alias("concept")).join(tagged.select("concept").distinct(), "concept", "left_semi")
    return R.with_concepts(R.bm25(index, asked), named, tagged)




@query("SELECT l_orderkey AS claim_id, list_aggregate(list_sort(list(DISTINCT l_suppkey::VARCHAR)), 'string_agg', ',') AS doc_ids, count(DISTINCT l_suppkey)::INTEGER AS confirmation_count FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_linenumber % 2 = 1)")
def provenance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order's odd lines are known, those of its even lines are merged in."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").cast("string").alias("d"), (F.col("l_linenumber") % 2 == 1).alias("known"))
    grouped = lambda df: df.groupBy("claim_id").agg(F.array_sort(F.collect_set("d")).alias("doc_ids")).withColumn("urls", F.col("doc_ids"))
    merged = C.provenance_merge(grouped(lines.where("known")), grouped(lines.where("not known")))
    return merged.select("claim_id", F.array_join(F.array_sort("doc_ids"), ",").alias("doc_ids"), "confirmation_count")


@query("""WITH v AS (SELECT o_orderkey AS n, o_orderstatus AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS t FROM orders)
SELECT o_orderkey AS claim_id, CASE WHEN n IS NOT NULL THEN 'superseded' ELSE o_orderstatus END AS status, n AS superseded_by FROM orders LEFT JOIN (SELECT t, min(n) AS n FROM v WHERE s = 'F' AND t IS NOT NULL GROUP BY t) ON t = o_orderkey""")
def supersede_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order of status F supersedes the one before it of its customer and priority."""
    orders = table(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    verdicts = orders.select(F.when(F.col("o_orderstatus") == "F", "SUPERSEDES").otherwise("CONFIRMED").alias("verdict"), F.col("o_orderkey").alias("claim_id"), before.alias("target_id"))
    return C.supersede(orders.select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("long").alias("superseded_by")), verdicts)


@query("""WITH c AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT o_orderkey FROM orders LEFT JOIN c USING (o_custkey) WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND (d IS NULL OR o_orderdate >= d)""")
def chronology_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of status F as updates of their customer's open ones; priority 5-LOW stands for a capture date."""
    orders = table(spark, sf_dir, "orders")
    updates = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("claim_id"), F.col("o_orderdate").alias("date"), F.when(F.col("o_orderpriority") == "5-LOW", "capture_fallback").alias("date_basis"))
    current = orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("claim_id")).agg(F.max("o_orderdate").alias("date"))
    return C.chronology_guard(updates, current).select("o_orderkey")


@query("SELECT o_orderkey AS idx, CASE WHEN o_orderpriority = '1-URGENT' THEN 'SUPERSEDES' END AS relation FROM orders WHERE o_orderstatus = 'F' AND (o_orderpriority <> '1-URGENT' OR o_totalprice > 200000)")
def verdict_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status F stands for a confirmed claim, priority 1-URGENT for one that supersedes, a high price for its target."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_url"), F.lit(0).alias("window"), F.col("o_orderkey").alias("idx"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    verdicts = orders.select("source_url", "window", "idx", F.when(F.col("o_orderstatus") == "F", "CONFIRMED").otherwise("AMBIGUOUS").alias("verdict"), F.when(F.col("o_orderpriority") == "1-URGENT", "SUPERSEDES").alias("relation"), F.when(F.col("o_totalprice") > 200000, F.col("idx")).alias("target_id"))
    return P.verdict_filter(orders.select("source_url", "window", "idx"), verdicts).select("idx", "relation")


@query("SELECT o_custkey AS document_id, list_aggregate(list_sort(list(DISTINCT o_orderpriority)), 'string_agg', ',') AS topics, count(DISTINCT o_orderstatus)::INTEGER AS statements FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey")
def support_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A support document for each customer: topics and statements of its F orders, then those of its O orders."""
    orders = table(spark, sf_dir, "orders")
    part = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("document_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("topics"), F.collect_set("o_orderstatus").alias("statements"))
    return P.support_upsert(part("F"), part("O")).select("document_id", F.array_join("topics", ",").alias("topics"), F.size("statements").alias("statements"))


@query("SELECT DISTINCT l_orderkey AS claim_id FROM lineitem SEMI JOIN (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') o ON o_orderkey = l_orderkey")
def state_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints (orders with lines) whose claim exists and is from 1996 on."""
    prints = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id")).distinct()
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"), "old").alias("scope"))
    return P.state_repair(prints, claims)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS inserted, 0::BIGINT AS superseded, count(*) FILTER (WHERE o_orderstatus = 'O') AS merged, 0::BIGINT AS rejected, count(*) FILTER (WHERE o_orderstatus = 'P') AS deferred FROM orders")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "F", "inserted").when(F.col("o_orderstatus") == "O", "merged").otherwise("deferred")
    return P.run_report(table(spark, sf_dir, "orders").select(outcome.alias("outcome")))


_QUOTE = "list_aggregate(list_slice(string_split(text, ' '), 1, 8), 'string_agg', ' ')"


@query(f"""WITH p AS (SELECT b.item_id, d.doc_id, b.text FROM (SELECT *, ' ' || {sql_norm('text')} || ' ' AS p FROM benchmark) b JOIN (SELECT doc_id, ' ' || {sql_norm('text')} || ' ' AS t FROM documents) d ON contains(d.t, b.p)),
c AS (SELECT item_id, doc_id, {_QUOTE} AS quote FROM p WHERE length(trim(text)) >= 24)
SELECT item_id, c.doc_id FROM c JOIN documents d USING (doc_id) WHERE d.lang = 'en' AND contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(quote, '\\s+', ' ', 'g'))))
QUALIFY row_number() OVER (PARTITION BY c.doc_id ORDER BY item_id) <= 8""")
def claim_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages found in documents as claims of the document's source: the first eight words are the quote, English
    sources are allowed."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = terms.phrase_pairs(docs, items, "doc_id", "item_id").join(items, "item_id").join(docs.select("doc_id", "source", "lang"), "doc_id")
    quote = F.array_join(F.slice(F.split("text", " "), 1, 8), " ")
    claims = found.select(F.col("doc_id").alias("source_url"), F.col("item_id").alias("idx"), F.col("source").alias("actor_id"), F.col("lang").alias("actor_type"), F.col("text").alias("statement"), quote.alias("quote"))
    allowed = docs.where("lang = 'en'").select(F.col("source").alias("actor_id"), F.col("lang").alias("actor_type")).distinct()
    return C.sanitize(claims, allowed, docs.select(F.col("doc_id").alias("source_url"), "text")).select(F.col("idx").alias("item_id"), F.col("source_url").alias("doc_id"))
