"""Monitoring over events and pages: a user is a source, an event of type error a failed fetch, a page a snapshot of
its host in the order of page_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.functions import urls as U
from attestor.operators import claims as C
from attestor.operators import context as X
from attestor.operators import dedupe as D
from attestor.operators import monitor as M
from attestor.operators import ordered as O
from attestor.plans.registry import Registry, sql_norm, sql_normalize, sql_words
from attestor.plans.text_queries import _CANONICAL, _FAMILY, _HOST
from attestor.sources import pages as P
from attestor.sources.tables import table

registry = Registry()
query = registry.query

_HALF = "TIMESTAMP '2024-01-15'"


def _half() -> Column:
    return F.lit("2024-01-15").cast("timestamp")


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'view' AND json_valid(props)")
def events_promotable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type <> 'view'").select("event_id", "event_type", F.from_json("props", "k bigint").k.alias("k"))


_DAYS = "SELECT DISTINCT CAST(ts AS DATE) AS day, user_id, event_type FROM events"


@query(f"WITH d AS ({_DAYS}) SELECT day, user_id, event_type FROM d EXCEPT SELECT CAST(day + 1 AS DATE), user_id, event_type FROM d")
def append_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day's log adds to that of the day before."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id", "event_type")
    before = days.select(F.date_add("day", 1).alias("day"), "user_id", "event_type")
    return M.append_absent(before, days, ["day", "user_id", "event_type"])


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after two halves of the log: the second half's snapshot over the first's."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    old, new = (M.latest_state(x, ["user_id"], ["ts", "event_id"]) for x in (e.where(F.col("ts") < _half()), e.where(F.col("ts") >= _half())))
    joined = old.alias("o").join(new.alias("n"), "user_id", "full")
    return joined.select("user_id", *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in ("event_id", "event_type", "ts")])


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, min(ts) AS f FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type) = 1")
def mode_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.most_common(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def state_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


_STREAKS = """SELECT user_id, count(*) AS failures, min(ts) AS first_failure, max(ts) AS last_failure, count(*) >= 4 AS persistent FROM
(SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events) WHERE event_type = 'error' GROUP BY user_id, island"""


@query(_STREAKS)
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.failure_streaks(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")


@query(f"""WITH s AS ({_STREAKS}), w AS (SELECT user_id, max(failures) AS streak FROM s GROUP BY user_id),
u AS (SELECT DISTINCT user_id FROM events), h AS (SELECT u.user_id, coalesce(streak, 0) AS streak FROM u LEFT JOIN w USING (user_id))
SELECT a.user_id, a.streak, CASE WHEN a.streak = 0 THEN 'healthy' WHEN coalesce(b.streak, 9) = 0 THEN 'covered_equivalent' WHEN a.user_id % 7 = 0 THEN 'covered_structured'
WHEN a.user_id % 5 = 0 THEN 'covered_feed' WHEN a.streak >= 4 THEN 'persistent' ELSE 'failing' END AS state FROM h a LEFT JOIN h b ON b.user_id = a.user_id + 1""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest streak of each source, and what it counts as; the next id stands for the equivalent source, ids
    divisible by 7 and 5 have structured data and feeds."""
    events = table(spark, sf_dir, "events")
    worst = M.failure_streaks(events, "user_id", "ts", "event_id", F.col("event_type") == "error").groupBy("user_id").agg(F.max("failures").alias("streak"))
    health = events.select("user_id").distinct().join(worst, "user_id", "left").select("user_id", F.coalesce("streak", F.lit(0)).alias("streak"))
    other = health.select((F.col("user_id") - 1).alias("user_id"), F.col("streak").alias("other"))
    state = M.source_state(F.col("streak"), F.coalesce(F.col("other") == 0, F.lit(False)), F.col("user_id") % 7 == 0, F.col("user_id") % 5 == 0)
    return health.join(other, "user_id", "left").select("user_id", "streak", state.alias("state"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'error' AND CAST(json_extract(props, '$.k') AS BIGINT) IN (1, 3, 5, 29)) AS guarded FROM events GROUP BY user_id""")
def protected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures that only show a guarded page; k + 400 stands for the status."""
    k = F.from_json("props", "k bigint").k
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(failed).alias("failures"), F.count_if(failed & M.protected(k + 400)).alias("guarded"))


@query("""SELECT user_id, event_id, ts, coalesce(ts < (SELECT max(ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase'), false) AS recovered FROM events e WHERE event_type = 'error'""")
def recovered_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return M.recovered(e.where("event_type = 'error'").select("user_id", "event_id", "ts"), e.where("event_type = 'purchase'"), "user_id", "ts")


_HEALTH = """SELECT e.user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS events, max(ts) AS last_seen, count(*) FILTER (WHERE event_type = 'error') * 1.0 / count(*) > 0.25 AS noisy,
max(ts) < (SELECT max(ts) FROM events) - INTERVAL 10 HOUR AS stale FROM events e GROUP BY e.user_id"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).scalar()
    rows = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_seen"))
    return rows.withColumn("now", now).select("user_id", "errors", "events", "last_seen", (F.col("errors") / F.col("events") > 0.25).alias("noisy"), (F.col("last_seen") < F.col("now") - F.expr("interval 10 hours")).alias("stale"))


@query(f"SELECT user_id, errors, events, last_seen, CASE WHEN noisy OR stale THEN 'degraded' ELSE 'healthy' END AS state FROM ({_HEALTH})")
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).select("user_id", "errors", "events", "last_seen", F.when(F.col("noisy") | F.col("stale"), "degraded").otherwise("healthy").alias("state"))


@query(f"SELECT user_id, concat_ws(',', CASE WHEN stale THEN 'stale' END, CASE WHEN noisy THEN 'noisy' END) AS reasons FROM ({_HEALTH}) WHERE stale OR noisy")
def deadman_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).where("stale or noisy").select("user_id", F.concat_ws(",", F.when(F.col("stale"), "stale"), F.when(F.col("noisy"), "noisy")).alias("reasons"))


_ATTEMPTS = "SELECT user_id, count(*) AS attempts, max(ts) AS last_error, min(ts) AS first_error FROM events WHERE event_type = 'error' GROUP BY user_id"


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.max("ts").alias("last_error"), F.min("ts").alias("first_error"))


@query(f"SELECT user_id, attempts, CAST(coalesce(list_extract([0, 6, 24, 72, 168, 336], CAST(attempts + 1 AS INTEGER)), 336) AS INTEGER) AS hours FROM ({_ATTEMPTS})")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir).select("user_id", "attempts", M.retry_hours(F.col("attempts")).alias("hours"))


@query(f"SELECT user_id FROM ({_ATTEMPTS}) WHERE last_error + to_hours(CAST(coalesce(list_extract([0, 6, 24, 72, 168, 336], CAST(attempts + 1 AS INTEGER)), 336) AS INTEGER)) <= (SELECT max(ts) FROM events)")
def retry_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "events").agg(F.max("ts")).scalar()
    due = F.col("last_error") + F.make_interval(hours=M.retry_hours(F.col("attempts")))
    return _attempts(spark, sf_dir).where(due <= now).select("user_id")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE attempts >= 6) AS over_budget, max(attempts) AS most_attempts, min(first_error) AS oldest FROM ({_ATTEMPTS})")
def retry_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("attempts") >= 6).alias("over_budget"), F.max("attempts").alias("most_attempts"), F.min("first_error").alias("oldest"))


@query("""SELECT user_id, event_type, first_seen, last_seen FROM (SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL)
JOIN (SELECT user_id, min(ts) AS started FROM events GROUP BY user_id) USING (user_id) WHERE CAST(first_seen AS DATE) > CAST(started AS DATE)""")
def first_seen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_seen(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|svg|canvas|template|form)\b[^>]*>.*?</(script|style|noscript|svg|canvas|template|form)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"""WITH s AS (SELECT page_id, {_HOST} AS host, sha256({_TEXT}) AS digest, NOT contains(url, 'page=2') AS valid FROM pages),
v AS (SELECT page_id, host, digest, lag(digest) OVER (PARTITION BY host ORDER BY page_id) AS previous FROM s WHERE valid)
SELECT page_id, host, digest, previous FROM v WHERE previous IS NOT NULL AND previous <> digest""")
def content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", U.host(F.col("url")).alias("host"), F.sha2(P.page_text(F.col("html")), 256).alias("digest"))
    return M.content_changes(pages, "host", "page_id", "digest", ~F.contains(F.col("url"), F.lit("page=2"))).select("page_id", "host", "digest", "previous")


@query(f"""WITH p AS (SELECT page_id, {_HOST} AS host, {_CANONICAL} AS canonical_url FROM pages), h AS (SELECT host, min(page_id) AS start FROM p GROUP BY host)
SELECT host, canonical_url, min(page_id) AS page_id FROM p JOIN h USING (host) GROUP BY host, canonical_url, start HAVING min(page_id) > start""")
def new_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical urls that their host shows for the first time after its first page."""
    p = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.canonical(F.col("url")).alias("canonical_url"))
    start = p.groupBy("host").agg(F.min("page_id").alias("start"))
    return p.groupBy("host", "canonical_url").agg(F.min("page_id").alias("page_id")).join(start, "host").where("page_id > start").select("host", "canonical_url", "page_id")


@query(f"SELECT page_id, min(page_id) OVER (PARTITION BY {_FAMILY}, split_part(url, '/', 4)) AS equivalent FROM pages QUALIFY equivalent <> page_id")
def equivalent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the same host family and section."""
    p = table(spark, sf_dir, "pages").select("page_id", U.family(F.col("url")).alias("f"), F.split_part("url", F.lit("/"), F.lit(4)).alias("s"))
    first = p.groupBy("f", "s").agg(F.min("page_id").alias("equivalent"))
    return p.join(first, ["f", "s"]).where("equivalent <> page_id").select("page_id", "equivalent")


_SCORE = f"CASE WHEN url LIKE '%/fr/%' THEN 100 ELSE 0 END + CASE WHEN url LIKE 'https://%' THEN 50 ELSE 0 END - CASE WHEN contains(url, '?') THEN 40 ELSE 0 END + CASE WHEN {_HOST} LIKE '%.org' THEN 70 ELSE 0 END"


@query(f"SELECT page_id, {_SCORE} AS score FROM pages ORDER BY score DESC, page_id LIMIT 50")
def priority_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 pages to be read first."""
    url = F.col("url")
    score = F.when(F.contains(url, F.lit("/fr/")), 100).otherwise(0) + F.when(url.startswith("https://"), 50).otherwise(0) - F.when(F.contains(url, F.lit("?")), 40).otherwise(0) + F.when(U.host(url).endswith(".org"), 70).otherwise(0)
    return table(spark, sf_dir, "pages").select("page_id", score.alias("score")).orderBy(F.desc("score"), "page_id").limit(50)


@query("SELECT event_type, user_id, strftime(ts, '%Y-%m-%d') AS day, min(event_id) AS event_id FROM events WHERE event_type IN ('error', 'purchase') OR value > 50 GROUP BY ALL")
def event_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "value")
    union = e.where(F.col("event_type").isin("error", "purchase")).unionByName(e.where("value > 50"))
    return M.first_by(union.drop("value"), ["event_type", "user_id", "day"], ["event_id"])


@query("SELECT user_id, event_type, coalesce(CAST(json_extract(props, '$.k') AS VARCHAR), CAST(ts AS VARCHAR)) AS version, min(event_id) AS event_id FROM events WHERE event_type <> 'view' GROUP BY ALL")
def backlog_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'view'")
    version = F.coalesce(F.get_json_object("props", "$.k"), F.col("ts").cast("string"))
    rows = e.select("user_id", "event_type", version.alias("version"), "event_id")
    half = F.col("event_id") % 2 == 0
    return M.first_by(rows.where(half).unionByName(rows.where(~half)), ["user_id", "event_type", "version"], ["event_id"])


@query(f"SELECT canonical_url, arg_min(owner, (prio, page_id)) AS owner FROM (SELECT {_CANONICAL} AS canonical_url, {_FAMILY} AS owner, CASE WHEN url LIKE 'https:%' THEN 0 ELSE 1 END AS prio, page_id FROM pages) GROUP BY canonical_url")
def target_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(U.canonical(F.col("url")).alias("canonical_url"), U.family(F.col("url")).alias("owner"), F.when(F.col("url").startswith("https:"), 0).otherwise(1).alias("prio"), "page_id")
    return p.groupBy("canonical_url").agg(F.min_by("owner", F.struct("prio", "page_id")).alias("owner"))


@query("SELECT url, CASE WHEN url LIKE '%.html' THEN 'ok' WHEN contains(url, '?') THEN 'protected' WHEN contains(url, '#') THEN 'dead' ELSE 'unknown' END AS status FROM (SELECT DISTINCT url FROM pages)")
def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    status = F.when(url.endswith(".html"), "ok").when(F.contains(url, F.lit("?")), "protected").when(F.contains(url, F.lit("#")), "dead").otherwise("unknown")
    return table(spark, sf_dir, "pages").select("url").distinct().select("url", status.alias("status"))


@query("SELECT user_id, CASE WHEN max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY THEN 'active' ELSE 'stale' END AS state, CASE WHEN max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY THEN 1 ELSE 4 END AS tier FROM events GROUP BY user_id")
def ttl_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.groupBy("user_id").agg(F.max("ts").alias("last")).withColumn("now", e.agg(F.max("ts")).scalar())
    fresh = F.col("last") >= F.col("now") - F.expr("interval 7 days")
    return rows.select("user_id", F.when(fresh, "active").otherwise("stale").alias("state"), F.when(fresh, 1).otherwise(4).alias("tier"))


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)")
def verified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.join(e.where("event_type = 'purchase' and value > 60").select("user_id").distinct(), "user_id", "left_semi").select("event_id")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * i AS start, count(*) AS n FROM events, range(4) t(i) GROUP BY ALL")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


@query("""SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)) GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).drop("w")


@query("""WITH RECURSIVE p AS MATERIALIZED (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT user_id, min(hour) AS moment, 1 AS k FROM p GROUP BY user_id
  UNION ALL SELECT user_id, (SELECT min(hour) FROM p WHERE p.user_id = r.user_id AND p.hour >= r.moment + INTERVAL 48 HOUR) AS moment, k + 1 FROM r WHERE r.moment IS NOT NULL),
e AS (SELECT user_id, max(moment) AS last_release, max(CASE WHEN moment IS NOT NULL THEN k END) AS releases FROM r GROUP BY user_id)
SELECT user_id, releases, last_release, CAST(coalesce((SELECT sum(n) FROM p WHERE p.user_id = e.user_id AND p.hour > e.last_release), 0) AS BIGINT) AS held FROM e""")
def publish_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of each user's changes, 48 hours apart at least."""
    return O.releases(table(spark, sf_dir, "events"), "user_id", "ts", 48)


@query(f"""SELECT d.source, d.doc_id FROM documents d WHERE d.doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 0 AND o.source = d.source AND sha256(o.text) = sha256(d.text))""")
def version_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions (odd ids stand for the current snapshot) that aren't among those processed (even ids)."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    return d.where("doc_id % 2 = 1").join(d.where("doc_id % 2 = 0"), ["source", "sha"], "left_anti").select("source", "doc_id")


_CONTEXT = f"""WITH RECURSIVE names AS (SELECT n_nationkey AS entity, list_extract(['of','und','dans','the','que'], CAST(n_nationkey % 5 + 1 AS INTEGER)) || ' ' || list_extract(['the','der','les','and','la'], CAST((n_nationkey // 5) % 5 + 1 AS INTEGER)) AS name FROM nation),
u AS (SELECT conv_id, turn, text, {sql_normalize('text')} AS said, {sql_norm('text')} AS n FROM conversations WHERE role = 'user'),
a AS MATERIALIZED (SELECT conv_id, turn, len(list_filter(string_split(said, ' '), lambda w: w <> '')) <= 8 OR regexp_matches(said, '^(et|eux|elles|lui|elle|sinon|quid|meme question)') AS short,
  list_sort(coalesce((SELECT list(CAST(entity AS VARCHAR)) FROM names WHERE contains(' ' || n || ' ', ' ' || name || ' ')), [])) AS entities,
  list_sort(list_distinct(list_filter({sql_words('text')}, lambda w: length(w) >= 5))) AS topic, regexp_matches(said, '\\b(compare|versus|vs|than|als)\\b') AS compares, contains(text, '?') AS status,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM u),
f AS (SELECT conv_id, turn, k, entities, topic, CASE WHEN compares THEN 'comparison' END AS mode, 0 AS inherited FROM a WHERE k = 1
  UNION ALL SELECT conv_id, turn, k, e, t, m, CAST(len(own_e) = 0 AND len(e) > 0 AS INT) + CAST(len(own_t) = 0 AND len(t) > 0 AS INT) + CAST(m IS NOT NULL AND NOT compares AS INT) FROM (
    SELECT a.conv_id, a.turn, a.k, a.entities AS own_e, a.topic AS own_t, compares, CASE WHEN len(a.entities) > 0 OR NOT short THEN a.entities ELSE f.entities END AS e, CASE WHEN len(a.topic) > 0 OR NOT short THEN a.topic ELSE f.topic END AS t,
      CASE WHEN compares THEN 'comparison' WHEN short AND f.mode = 'comparison' AND ((len(a.entities) = 0 AND len(f.entities) > 0) OR len(f.entities) >= 2) THEN 'comparison'
        WHEN short AND len(f.topic) > 0 AND NOT status THEN 'measures' END AS m FROM f JOIN a ON a.conv_id = f.conv_id AND a.k = f.k + 1))
SELECT conv_id, turn, array_to_string(entities, ',') AS entities, sha256(array_to_string(topic, ',')) AS topic, mode, inherited FROM f"""


@query(_CONTEXT)
def followup_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user turn stands for after it has inherited: entities are the names it holds, its topic its tokens of five letters
    and more, a question mark asks for a status."""
    from attestor.plans.dedupe_queries import _names

    text = F.col("text")
    users = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("key", F.struct("conv_id", "turn"))
    named = D.mentions(users.select("key", "text"), "key", _names(spark, sf_dir), "entity").groupBy("key").agg(F.array_sort(F.collect_set(F.col("entity").cast("string"))).alias("entities"))
    none = F.array().cast("array<string>")
    topic = F.array_sort(F.filter(T.tokens(text), lambda w: F.length(w) >= 5))
    rows = users.join(named, "key", "left").select("conv_id", "turn", X.follows_up(text).alias("short"), F.coalesce("entities", none).alias("entities"), topic.alias("topic"), T.normalize(text).rlike(r"\b(compare|versus|vs|than|als)\b").alias("compares"), F.contains(text, F.lit("?")).alias("status"))
    found = X.carried(rows)
    return found.select("conv_id", "turn", F.array_join("entities", ",").alias("entities"), F.sha2(F.array_join("topic", ","), 256).alias("topic"), "mode", "inherited")


@query(f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS age, {sql_words('text')} AS w FROM conversations WHERE role = 'user'),
x AS (SELECT conv_id, age, unnest(w) AS term FROM t) SELECT conv_id, term, max(CASE WHEN age = 0 THEN 10 ELSE greatest(2, 7 - age) END)::INTEGER AS weight FROM x GROUP BY ALL""")
def recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) - 1
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("age", age).select("conv_id", "age", F.explode(T.tokens(F.col("text"))).alias("term"))
    return rows.groupBy("conv_id", "term").agg(F.max(F.when(F.col("age") == 0, 10).otherwise(F.greatest(F.lit(2), 7 - F.col("age")))).alias("weight"))


_INTENT = f"""SELECT conv_id, turn, contains(text, '?') AS asks, regexp_matches({sql_norm('text')}, '\\b(compare|versus|vs|than|que|als)\\b') AS compares, length(text) < 60 AS short FROM conversations WHERE role = 'user'"""


@query(_INTENT)
def question_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.contains(text, F.lit("?")).alias("asks"), T.norm(text).rlike(r"\b(compare|versus|vs|than|que|als)\b").alias("compares"), (F.length(text) < 60).alias("short"))


@query(f"SELECT conv_id, turn, CASE WHEN compares THEN 'comparison' WHEN asks THEN 'measures' WHEN short THEN 'candidates' ELSE 'overview' END AS route FROM ({_INTENT})")
def question_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_intent(spark, sf_dir).select("conv_id", "turn", F.when(F.col("compares"), "comparison").when(F.col("asks"), "measures").when(F.col("short"), "candidates").otherwise("overview").alias("route"))
