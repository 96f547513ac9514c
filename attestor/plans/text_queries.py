"""Text and page expressions over the documents, benchmark and pages tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.functions import urls as U
from attestor.operators import terms
from attestor.plans.registry import Registry, sql_compact, sql_norm, sql_normalize, sql_stem, sql_whole_words, sql_words
from attestor.sources import pages as P
from attestor.sources.tables import table

registry = Registry()
query = registry.query


@query("SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, {sql_normalize('text')} AS normalized FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_words('text')}) AS term FROM documents) GROUP BY ALL")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_counts(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.whole_words(F.col("text")))).alias("term")).distinct()


_TERMS = f"SELECT DISTINCT unnest({sql_whole_words('text')}) AS term FROM documents"


@query(f"SELECT term, {sql_stem('term')} AS stem FROM ({_TERMS})")
def token_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir).select("term", T.stem(F.col("term")).alias("stem"))


@query(f"""SELECT term, term AS variant FROM ({_TERMS}) UNION
SELECT term, CASE WHEN term LIKE '%s' OR term LIKE '%x' THEN left(term, length(term) - 1) ELSE term || 's' END FROM ({_TERMS}) WHERE length(term) >= 5 UNION
SELECT term, term || 's' FROM ({_TERMS}) WHERE length(term) >= 5 AND term NOT LIKE '%s'""")
def token_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir).select("term", F.explode(T.variants(F.col("term"))).alias("variant"))


@query("""SELECT c_custkey, CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: xor(h, b) * 16777619 % 4294967296) AS BIGINT) AS fnv FROM customer""")
def fnv_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotation key of each customer's name."""
    return table(spark, sf_dir, "customer").select("c_custkey", T.fnv1a(F.col("c_name")).alias("fnv"))


_SENTENCES = f"list_filter(list_transform(regexp_extract_all(text, '[^.!?…]+(?:[.!?…]+|$)'), lambda s: {sql_compact('s')}), lambda s: length(s) >= 12)"


@query(f"SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS l FROM documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query("""
SELECT doc_id, CASE WHEN length(text) <= 320 OR e = '' THEN text ELSE left(text, 320) || e END AS excerpt
FROM (SELECT doc_id, text, regexp_extract(substring(text, 321), '^[^.!?…]*[.!?…]') AS e FROM documents)""")
def sentence_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 320).alias("excerpt"))


@query("""
WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^0-9\\p{L}_.,]+')) AS p FROM documents),
n AS (SELECT DISTINCT doc_id, replace(regexp_replace(p, '^[.,]+|[.,]+$', '', 'g'), ',', '.') AS number FROM p
      WHERE regexp_full_match(regexp_replace(p, '^[.,]+|[.,]+$', '', 'g'), '[0-9]+([.,][0-9]+)?'))
SELECT doc_id, number FROM n WHERE NOT regexp_full_match(number, '19[0-9][0-9]|20[0-9][0-9]|2100')""")
def policy_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.policy_numbers(F.col("text"))).alias("number"))


@query("""
SELECT p_partkey, CASE WHEN len(w) >= 2 THEN list_aggregate(list_transform(w, lambda x: left(x, 1)), 'string_agg', '') END AS acronym
FROM (SELECT p_partkey, list_filter(regexp_split_to_array(trim(lower(p_name)), '\\s+'),
      lambda x: x NOT IN ('a','an','and','de','des','du','et','la','le','les','of','the') AND x <> '') AS w FROM part)""")
def acronym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.acronym(F.col("p_name")).alias("acronym"))


@query("""SELECT n_nationkey, regexp_replace('Delegates of ' || n_name || ' met; ' || lower(n_name) || ' agreed.', array_to_string(list_concat([n_name], list_filter(string_split(n_name, ' '), lambda p: length(p) > 3)), '|'), '[...]', 'gi') AS masked FROM nation""")
def mask_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    sentence = F.concat(F.lit("Delegates of "), name, F.lit(" met; "), F.lower(name), F.lit(" agreed."))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.mask(sentence, name).alias("masked"))


@query(f"""
SELECT b.item_id, d.doc_id FROM (SELECT item_id, ' ' || {sql_norm('text')} || ' ' AS p FROM benchmark) b
JOIN (SELECT doc_id, ' ' || {sql_norm('text')} || ' ' AS t FROM documents) d ON contains(d.t, b.p) WHERE b.p <> '  '""")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.phrase_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(f"""
SELECT b.item_id, d.doc_id FROM (SELECT item_id, lower({sql_compact('text')}) AS q FROM benchmark) b
JOIN (SELECT doc_id, lower({sql_compact('text')}) AS t FROM documents) d ON contains(d.t, b.q) WHERE b.q <> ''""")
def exact_quote_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim quotes of any length."""
    return terms.quote_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(f"""
WITH t AS (SELECT DISTINCT unnest({sql_words('text')}) AS term FROM documents),
k AS (SELECT DISTINCT term, unnest(list_append(list_transform(range(length(term)), lambda i: left(term, i) || substr(term, i + 2)), term)) AS key FROM t WHERE length(term) >= 5)
SELECT DISTINCT x.term AS a, y.term AS b FROM k x JOIN k y USING (key) WHERE x.term < y.term AND damerau_levenshtein(x.term, y.term) = 1""")
def fuzzy_token_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.fuzzy_pairs(table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term")))


_CANONICAL = """
CASE WHEN NOT regexp_matches(trim(url), '^(?i)https?://') THEN trim(url) ELSE
  lower(regexp_extract(trim(url), '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#]*)', 1))
  || CASE WHEN regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END
  || coalesce('?' || nullif(list_aggregate(list_sort(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1), '&'),
     lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND split_part(p, '=', 1) NOT IN ('fbclid','gclid','mc_cid','mc_eid','ref','source'))), 'string_agg', '&'), ''), '') END"""
_HOST = "lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#:]*)', 1))"
_FAMILY = f"regexp_replace({_HOST}, '^(www|m|blog)\\.', '')"


@query(f"SELECT page_id, {_CANONICAL} AS canonical_url FROM pages")
def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical_url"))


@query(f"SELECT {_FAMILY} AS family, count(*) AS pages, count(DISTINCT {_HOST}) AS hosts FROM pages GROUP BY 1")
def url_host_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(U.family(F.col("url")).alias("family")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct(U.host(F.col("url"))).alias("hosts"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '://[^/]+/(fr|es)/')")
def keyword_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("url").rlike("://[^/]+/(fr|es)/")).select("page_id", "url")


@query(f"SELECT page_id, {_HOST} AS host FROM pages WHERE {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org'")
def trusted_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = U.host(F.col("url"))
    return table(spark, sf_dir, "pages").where(U.in_domain(host, "example.org")).select("page_id", host.alias("host"))


_PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style|noscript|svg|canvas|template|form)\b[^>]*>.*?</(script|style|noscript|svg|canvas|template|form)\s*>', ' ', 'g'),
  '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, {_PLAIN} AS body, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.page_text(F.col("html")).alias("body"), P.title(F.col("html")).alias("title"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*"([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(P.links(F.col("html"))).alias("href"))


@query(f"SELECT page_id, body AS section FROM (SELECT page_id, {_PLAIN.replace('(html,', '(h,', 1)} AS body FROM (SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</article>', 1) AS h FROM pages)) WHERE length(body) >= 40")
def page_section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = P.page_text(P.between(F.col("html"), "<h1[^>]*>", "</article>"))
    return table(spark, sf_dir, "pages").select("page_id", section.alias("section")).where(F.length("section") >= 40)


@query("SELECT h AS host, count(*) AS urls, min(url) AS first_url FROM (SELECT split_part(url, '/', 3) AS h, url FROM pages) GROUP BY 1")
def sitemap_shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site map of each page, shredded again and counted by host."""
    maps = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>")).alias("payload"))
    shredded = P.shred_sitemap(maps, "payload")
    return shredded.groupBy(F.split_part("loc", F.lit("/"), F.lit(3)).alias("host")).agg(F.count(F.lit(1)).alias("urls"), F.min("loc").alias("first_url"))


_KEY = f"sha256(source || '|' || lang || '|' || {sql_norm('text')})"


@query(f"SELECT doc_id, {_KEY} AS fingerprint FROM documents")
def claim_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("source"), F.col("lang"), T.norm(F.col("text"))).alias("fingerprint"))


@query(f"SELECT {_KEY} AS fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def claim_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(T.fingerprint(F.col("source"), F.col("lang"), T.norm(F.col("text"))).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
