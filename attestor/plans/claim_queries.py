"""Claims and views over the relational tables: an order is a claim, its customer the actor, its priority the topic,
status F explicit, P not current, a price over 150,000 primary, suppliers of its lines its source documents. A customer's
nation is its party; those of the segments in ELIGIBLE inherit the primary evidence of their party."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.operators import claims as C
from attestor.plans.registry import Registry
from attestor.sources.tables import table

registry = Registry()
query = registry.query

#: Segments whose customers inherit their party's evidence.
ELIGIBLE = ("BUILDING", "MACHINERY")

_WITH = """
WITH claims AS (SELECT o_orderkey, c_custkey AS actor, c_nationkey AS party, o_orderpriority AS topic, o_orderstatus AS status, o_totalprice AS price,
  o_orderdate AS date, o_orderstatus = 'F' AS explicit FROM orders JOIN customer ON o_custkey = c_custkey),
grid AS (SELECT c_custkey AS actor, c_nationkey AS party, c_mktsegment IN ('BUILDING', 'MACHINERY') AS eligible, topic
  FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority AS topic FROM orders)),
cells AS (SELECT g.actor, g.topic, count(c.o_orderkey) AS claims, count(*) FILTER (WHERE c.explicit) AS explicit, max(c.date) AS latest
  FROM grid g LEFT JOIN (SELECT * FROM claims WHERE status <> 'P') c ON c.actor = g.actor AND c.topic = g.topic GROUP BY g.actor, g.topic),
marks AS (SELECT actor, topic, count(*) AS items, count(*) FILTER (WHERE explicit) AS explicit, count(*) FILTER (WHERE price > 150000) AS "primary",
  sum(CASE status WHEN 'F' THEN 4.0 WHEN 'O' THEN 3.0 ELSE 1.0 END) AS score FROM claims GROUP BY actor, topic),
shared AS (SELECT party, topic, count(*) AS inherited FROM claims WHERE explicit AND price > 400000 GROUP BY party, topic),
levels AS (SELECT g.actor, g.topic, coalesce(items, 0) AS items, coalesce(score, 0)::DOUBLE AS score, CASE WHEN g.eligible THEN coalesce(inherited, 0) ELSE 0 END AS inherited,
  CASE WHEN explicit >= 2 OR (items >= 2 AND score >= 5 AND ("primary" >= 1 OR explicit >= 1)) THEN 'documented' WHEN items > 0 THEN 'partial'
    WHEN g.eligible AND inherited > 0 THEN 'party_only' ELSE 'none' END AS level
  FROM grid g LEFT JOIN marks m ON m.actor = g.actor AND m.topic = g.topic LEFT JOIN shared s ON s.party = g.party AND s.topic = g.topic)
"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("actor"), F.col("c_nationkey").alias("party"))
    joined = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    named = {"topic": "o_orderpriority", "status": "o_orderstatus", "price": "o_totalprice", "date": "o_orderdate"}
    return joined.select("o_orderkey", "actor", "party", *[F.col(c).alias(k) for k, c in named.items()], (F.col("o_orderstatus") == "F").alias("explicit"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each actor with its party, whether it inherits, and each topic."""
    actors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("actor"), F.col("c_nationkey").alias("party"), F.col("c_mktsegment").isin(*ELIGIBLE).alias("eligible"))
    return C.scaffold(actors, table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("topic")).distinct())


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    actors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("actor"))
    topics = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("topic")).distinct()
    return C.coverage_cells(_claims(spark, sf_dir).where("status <> 'P'"), actors, topics)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    weight = C.strength(F.col("status"), {"F": 4.0, "O": 3.0})
    count = lambda c, name: F.count_if(c).alias(name)
    marks = claims.groupBy("actor", "topic").agg(F.count(F.lit(1)).alias("items"), count(F.col("explicit"), "explicit"), count(F.col("price") > 150000, "primary"), F.sum(weight).alias("score"))
    shared = claims.where("explicit and price > 400000").groupBy("party", "topic").agg(F.count(F.lit(1)).alias("inherited"))
    numbers = ["items", "explicit", "primary", "score", "inherited"]
    cells = _grid(spark, sf_dir).join(marks, ["actor", "topic"], "left").join(shared, ["party", "topic"], "left").fillna(0, numbers)
    own = F.when(F.col("eligible"), F.col("inherited")).otherwise(0)
    level = C.coverage_level(F.col("explicit"), F.col("items"), F.col("score"), F.col("primary"), own)
    return cells.select("actor", "topic", "items", "score", own.cast("long").alias("inherited"), level.alias("level"))


_LEVELS = ("documented", "partial", "party_only", "none")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('P')")
def active_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(~F.col("o_orderstatus").isin("P")).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'O')")
def current_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderstatus AS status, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS rank, count(*) AS orders FROM orders GROUP BY ALL")
def status_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("orders")).select("status", F.when(F.col("status") == "F", 1).when(F.col("status") == "O", 2).otherwise(3).alias("rank"), "orders")


@query("""SELECT o_orderkey, coalesce(n_name, c_name, 'unknown') AS label, coalesce(r_name, 'unknown') AS region FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def dim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return joined.select("o_orderkey", C.first_known(F.col("n_name"), F.col("c_name")).alias("label"), C.first_known(F.col("r_name")).alias("region"))


@query(_WITH + "SELECT * FROM cells")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(_WITH + "SELECT actor, count(*) FILTER (WHERE claims > 0) AS covered, sum(claims)::BIGINT AS claims, round(count(*) FILTER (WHERE claims > 0) / count(*), 4) AS ratio FROM cells GROUP BY actor")
def coverage_by_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cells(spark, sf_dir).groupBy("actor").agg(F.count_if(F.col("claims") > 0).alias("covered"), F.sum("claims").alias("claims"), F.count(F.lit(1)).alias("cells"))
    return rows.select("actor", "covered", "claims", C.ratio(F.col("covered"), F.col("cells")).alias("ratio"))


@query(_WITH + "SELECT topic, count(*) FILTER (WHERE claims > 0) AS covered, sum(claims)::BIGINT AS claims, sum(explicit)::BIGINT AS explicit, round(count(*) FILTER (WHERE claims > 0) / count(*), 4) AS ratio FROM cells GROUP BY topic")
def coverage_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cells(spark, sf_dir).groupBy("topic").agg(F.count_if(F.col("claims") > 0).alias("covered"), F.sum("claims").alias("claims"), F.sum("explicit").alias("explicit"), F.count(F.lit(1)).alias("cells"))
    return rows.select("topic", "covered", "claims", "explicit", C.ratio(F.col("covered"), F.col("cells")).alias("ratio"))


@query(_WITH + "SELECT count(DISTINCT actor) AS actors, count(*) AS cells, count(*) FILTER (WHERE claims > 0) AS covered, sum(claims)::BIGINT AS claims, round(count(*) FILTER (WHERE claims > 0) / count(*), 4) AS ratio, max(latest) AS latest FROM cells")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cells(spark, sf_dir).agg(F.countDistinct("actor").alias("actors"), F.count(F.lit(1)).alias("cells"), F.count_if(F.col("claims") > 0).alias("covered"), F.sum("claims").alias("claims"), F.max("latest").alias("latest"))
    return rows.select("actors", "cells", "covered", "claims", C.ratio(F.col("covered"), F.col("cells")).alias("ratio"), "latest")


@query(_WITH + "SELECT actor, topic FROM cells WHERE claims = 0")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).where("claims = 0").select("actor", "topic")


@query(_WITH + "SELECT actor, c_name, covered, claims FROM (SELECT actor, count(*) FILTER (WHERE claims > 0) AS covered, sum(claims)::BIGINT AS claims FROM cells GROUP BY actor) JOIN customer ON c_custkey = actor ORDER BY covered, claims, c_name LIMIT 25")
def priority_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the 25 actors with the least coverage."""
    rows = _cells(spark, sf_dir).groupBy("actor").agg(F.count_if(F.col("claims") > 0).alias("covered"), F.sum("claims").alias("claims"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("actor"), "c_name")
    return rows.join(names, "actor").orderBy("covered", "claims", "c_name").limit(25).select("actor", "c_name", "covered", "claims")


@query(_WITH + "SELECT actor, topic, items, score, inherited, level FROM levels")
def coverage_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)


@query(_WITH + "SELECT actor, " + ", ".join(f"count(*) FILTER (WHERE level = '{x}') AS {x}" for x in _LEVELS) + " FROM levels GROUP BY actor")
def coverage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).groupBy("actor").pivot("level", list(_LEVELS)).count().fillna(0)


_PLACE = "CASE level WHEN 'documented' THEN 0 WHEN 'partial' THEN 1 WHEN 'party_only' THEN 2 ELSE 3 END"


def _place(level: Column) -> Column:
    return F.when(level == "documented", 0).when(level == "partial", 1).when(level == "party_only", 2).otherwise(3)


@query(_WITH + f"SELECT topic, actor, level, score, {_PLACE} AS place FROM levels WHERE level <> 'none'")
def topic_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All actors with evidence on a topic, for display in the order of place, score and actor. The order is left to who
    shows a topic, since a topic of all actors can't be numbered in one task."""
    rows = _levels(spark, sf_dir).where("level <> 'none'")
    return rows.select("topic", "actor", "level", "score", _place(F.col("level")).alias("place"))


@query(_WITH + """, compared AS (SELECT c_nationkey AS comparison, c_custkey AS actor FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 4),
signals AS (SELECT comparison, topic, actor, CASE WHEN level = 'documented' THEN 'direct' WHEN level = 'partial' THEN 'attributed' WHEN level = 'party_only' THEN 'party_only' ELSE 'missing' END AS signal FROM levels JOIN compared USING (actor))
SELECT comparison, topic, """ + ", ".join(f"coalesce(string_agg(actor, ',' ORDER BY actor) FILTER (WHERE signal = '{x}'), '') AS {x}" for x in ("direct", "attributed", "party_only", "missing")) + " FROM signals GROUP BY comparison, topic")
def comparison_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of up to four actors (the first of each nation), topic by topic: who has documented evidence, some,
    only the party's, or none."""
    first = Window.partitionBy("comparison").orderBy("actor")
    compared = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("comparison"), F.col("c_custkey").alias("actor")).withColumn("n", F.row_number().over(first)).where("n <= 4")
    signal = {"direct": "documented", "attributed": "partial", "party_only": "party_only", "missing": "none"}
    held = lambda level: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.col("actor")))), lambda x: x.cast("string")), ",")
    return _levels(spark, sf_dir).join(compared, "actor").groupBy("comparison", "topic").agg(*[held(level).alias(name) for name, level in signal.items()])


@query(_WITH + f""", kept AS (SELECT actor, string_agg(topic || ':' || level, ';' ORDER BY topic) AS topics, count(*) FILTER (WHERE level = 'documented') AS documented FROM levels GROUP BY actor),
latest AS (SELECT actor, string_agg(o_orderkey, ',' ORDER BY date DESC, o_orderkey) AS latest FROM (SELECT * FROM claims WHERE status <> 'P' QUALIFY row_number() OVER (PARTITION BY actor ORDER BY date DESC, o_orderkey) <= 5) GROUP BY actor)
SELECT k.actor, k.topics, k.documented, coalesce(l.latest, '') AS latest FROM kept k LEFT JOIN latest l USING (actor)""")
def actor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each actor's level for every topic, the number of documented ones, and the five latest current claims."""
    levels = _levels(spark, sf_dir).groupBy("actor").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "topic", "level"))), ";").alias("topics"), F.count_if(F.col("level") == "documented").alias("documented"))
    order = Window.partitionBy("actor").orderBy(F.desc("date"), "o_orderkey")
    top = _claims(spark, sf_dir).where("status <> 'P'").withColumn("n", F.row_number().over(order)).where("n <= 5")
    latest = top.groupBy("actor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "o_orderkey"))), lambda x: x.o_orderkey.cast("string")), ",").alias("latest"))
    return levels.join(latest, "actor", "left").select("actor", "topics", "documented", F.coalesce("latest", F.lit("")).alias("latest"))


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS sources, count(*) AS lines FROM lineitem GROUP BY l_orderkey")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("sources"), F.count(F.lit(1)).alias("lines"))


@query(_WITH + "SELECT actor, topic, sum(CASE status WHEN 'F' THEN 4.0 WHEN 'O' THEN 3.0 ELSE 1.0 END)::DOUBLE AS score, count(*) FILTER (WHERE price > 150000) AS primary_items FROM claims GROUP BY ALL")
def evidence_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).groupBy("actor", "topic").agg(F.sum(C.strength(F.col("status"), {"F": 4.0, "O": 3.0})).alias("score"), F.count_if(F.col("price") > 150000).alias("primary_items"))


@query("""
WITH own AS (SELECT c_custkey AS actor, c_nationkey AS g, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
grp AS (SELECT c_nationkey AS g, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT actor, CASE WHEN own.n > 0 THEN round(own.n * 1.0, 6) ELSE round(grp.n * 0.94, 6) END::DOUBLE AS score, CASE WHEN own.n > 0 THEN NULL ELSE own.g END AS owner_group FROM own LEFT JOIN grp USING (g) WHERE own.n > 0 OR grp.n > 0""")
def attribution_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("actor"), F.col("c_nationkey").alias("group_id"))
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("actor")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    group = own.join(members, "actor").groupBy("group_id").agg(F.sum("score").alias("score"))
    return C.inherited(own, group, members)


@query("""SELECT c_mktsegment, o_orderkey FROM (SELECT c_mktsegment, o_orderkey, rank() OVER w AS r, count(*) OVER (PARTITION BY c_mktsegment, o_totalprice) AS same
FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC)) WHERE r = 1 AND same = 1""")
def unique_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return C.unique_best(rows, "c_mktsegment", F.desc("o_totalprice"), "o_orderkey")


@query("""SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON split_part(s_name, '#', 2) = split_part(c_name, '#', 2) WHERE s_nationkey <> c_nationkey""")
def own_site_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal identifiers in different nations; those of the same nation are excluded."""
    s = table(spark, sf_dir, "supplier").withColumn("k", F.split_part("s_name", F.lit("#"), F.lit(2)))
    c = table(spark, sf_dir, "customer").withColumn("k", F.split_part("c_name", F.lit("#"), F.lit(2)))
    return s.join(c, "k").where("s_nationkey <> c_nationkey").select("s_suppkey", "c_custkey")


@query("""SELECT s_suppkey, coalesce(c_custkey, -1) AS owner, CASE WHEN c_custkey IS NULL THEN 'none' ELSE 'customer' END AS kind FROM supplier
LEFT JOIN (SELECT split_part(lower(c_name), '#', 2) AS k, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) ON k = split_part(lower(s_name), '#', 2)""")
def owner_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "customer").groupBy(F.split_part(F.lower("c_name"), F.lit("#"), F.lit(2)).alias("k")).agg(F.min("c_custkey").alias("c_custkey"))
    s = table(spark, sf_dir, "supplier").withColumn("k", F.split_part(F.lower("s_name"), F.lit("#"), F.lit(2)))
    return s.join(owners, "k", "left").select("s_suppkey", F.coalesce("c_custkey", F.lit(-1)).alias("owner"), F.when(F.col("c_custkey").isNull(), "none").otherwise("customer").alias("kind"))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS brand, min(l_shipdate) AS earliest FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def inherit_unanimous(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("l_orderkey").agg(F.when(F.min("p_brand") == F.max("p_brand"), F.min("p_brand")).alias("brand"), F.min("l_shipdate").alias("earliest"))


_LINKS = """WITH l AS (SELECT o_orderkey AS id, o_custkey AS actor, o_orderpriority AS topic, o_orderdate AS date,
lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes,
lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS superseded_by FROM orders)"""


@query(_LINKS + """ SELECT a.id, b.id AS other, CASE WHEN b.superseded_by IS DISTINCT FROM a.id THEN 'not_mirrored' WHEN a.actor <> b.actor THEN 'other_actor' WHEN a.topic <> b.topic THEN 'other_topic' WHEN a.date < b.date THEN 'older' END AS rule
FROM l a JOIN l b ON a.supersedes = b.id WHERE b.superseded_by IS DISTINCT FROM a.id OR a.actor <> b.actor OR a.topic <> b.topic OR a.date < b.date""")
def supersession_reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that aren't mirrored, or lead to another actor or topic or to a newer claim. An order claims to supersede the
    customer's last one, and to be superseded by the customer's next one of its own priority, so some links don't match."""
    at = ["o_orderdate", "o_orderkey"]
    last, following = Window.partitionBy("o_custkey").orderBy(*at), Window.partitionBy("o_custkey", "o_orderpriority").orderBy(*at)
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("actor"), F.col("o_orderpriority").alias("topic"), F.col("o_orderdate").alias("date"), F.lag("o_orderkey").over(last).alias("supersedes"), F.lead("o_orderkey").over(following).alias("superseded_by"))
    return C.reciprocity(links)


@query("SELECT o_orderkey AS node, (count(*) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) - 1)::INTEGER AS length FROM orders")
def supersession_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = C.supersession(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", "o_orderdate")
    return C.closure(links, "o_orderkey", "superseded_by")


@query("SELECT o_custkey, o_orderstatus AS status, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NULL OR b <> o_orderstatus")
def status_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.validity_intervals(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'P' THEN 'historical' ELSE 'current' END AS state, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey)::INTEGER AS place FROM orders")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "P", "historical").otherwise("current").alias("state"), F.row_number().over(order).alias("place"))


@query("""SELECT o_orderkey, CASE WHEN lag(o_orderkey) OVER w IS NOT NULL AND o_orderstatus <> 'P' THEN 'replaces' WHEN lead(o_orderkey) OVER w IS NOT NULL THEN 'replaced' WHEN o_orderstatus = 'P' THEN 'historical' ELSE 'current' END AS signal,
lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)""")
def history_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    before, after = F.lag("o_orderkey").over(w), F.lead("o_orderkey").over(w)
    signal = F.when(before.isNotNull() & (F.col("o_orderstatus") != "P"), "replaces").when(after.isNotNull(), "replaced").when(F.col("o_orderstatus") == "P", "historical").otherwise("current")
    return table(spark, sf_dir, "orders").select("o_orderkey", signal.alias("signal"), before.alias("before"), after.alias("after"))


@query("SELECT count(*) AS records, count(*) FILTER (WHERE o_orderstatus <> 'P') AS current, count(*) FILTER (WHERE o_orderstatus = 'P') AS historical, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
def history_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("o_orderstatus") != "P").alias("current"), F.count_if(F.col("o_orderstatus") == "P").alias("historical"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def recent_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed of the 25 latest current documents."""
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", "o_orderdate")


@query(_WITH + "SELECT party, o_orderkey, status <> 'P' AS is_current FROM claims QUALIFY row_number() OVER (PARTITION BY party, status <> 'P' ORDER BY date DESC, o_orderkey) <= CASE WHEN status <> 'P' THEN 20 ELSE 8 END")
def context_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 20 current and 8 historical claims of each party. Two windows with fixed limits, so that each task cuts
    its rows to the limit before they are shuffled."""
    rows, order = _claims(spark, sf_dir), Window.partitionBy("party").orderBy(F.desc("date"), "o_orderkey")
    latest = lambda part, n: part.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
    return latest(rows.where("status <> 'P'"), 20).unionByName(latest(rows.where("status = 'P'"), 8)).select("party", "o_orderkey", (F.col("status") != "P").alias("is_current"))


@query("SELECT greatest(max(o_orderdate) FILTER (WHERE o_orderstatus = 'F'), max(o_orderdate) FILTER (WHERE o_orderstatus = 'O'), TIMESTAMP '1995-01-01') AS freshness FROM orders")
def corpus_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate")))
    return table(spark, sf_dir, "orders").agg(F.greatest(at("F"), at("O"), F.lit("1995-01-01").cast("timestamp")).alias("freshness"))


@query("""SELECT source || '/' || doc_id // 1000 AS record, count(*) AS parts, sha256(list_aggregate(list(sha256(text) ORDER BY doc_id), 'string_agg', chr(10))) AS digest,
list_aggregate(list_sort(list(DISTINCT lang)), 'string_agg', ',') AS labels FROM documents GROUP BY 1""")
def record_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a source merged in order; a record holds the documents of one thousand ids, so it is bounded."""
    record = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"))
    return C.merge_record(table(spark, sf_dir, "documents").withColumn("record", record), "record", "doc_id", F.sha2("text", 256), "lang")


@query("SELECT l_orderkey, count(*) = max(l_linenumber) AND count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AS complete, max(l_linenumber) AS last FROM lineitem GROUP BY l_orderkey")
def sequence_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(((F.count(F.lit(1)) == F.max(n)) & (F.countDistinct(n) == F.count(F.lit(1))) & (F.min(n) == 1)).alias("complete"), F.max(n).alias("last"))


@query("SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS final, count(*) FILTER (WHERE l_returnflag <> 'R') AS done, count(*) AS total FROM lineitem GROUP BY l_orderkey")
def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("l_returnflag") != "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(done).alias("final"), F.count_if(done).alias("done"), F.count(F.lit(1)).alias("total"))


_OF = "SELECT o_custkey AS a, o_orderpriority AS t FROM orders WHERE o_orderstatus"


@query(f"SELECT a, 'minus' AS op, t FROM ({_OF} = 'F' EXCEPT {_OF} = 'P') UNION ALL SELECT a, 'both', t FROM ({_OF} = 'F' INTERSECT {_OF} = 'P') UNION ALL SELECT a, 'either', t FROM ({_OF} = 'F' UNION {_OF} = 'P')")
def set_ops_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of each actor's explicit claims without, and with, those of the historical ones, and of both together."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("t"), "o_orderstatus")
    f, p = (rows.where(F.col("o_orderstatus") == s).select("a", "t") for s in ("F", "P"))
    parts = {"minus": f.subtract(p), "both": f.intersect(p), "either": f.union(p).distinct()}
    named = [df.withColumn("op", F.lit(op)) for op, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


_NODES = """SELECT 'claim:' || o_orderkey AS id, 'claim' AS kind FROM orders UNION ALL SELECT 'entity:' || c_custkey, 'entity' FROM customer UNION ALL SELECT 'document:' || s_suppkey, 'document' FROM supplier"""
_EDGES = """SELECT DISTINCT 'document:' || l_suppkey AS subject, 'supports' AS relation, 'claim:' || l_orderkey AS object FROM lineitem
UNION ALL SELECT 'claim:' || o_orderkey, 'attributed_to', 'entity:' || o_custkey FROM orders"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (("claim", "orders", "o_orderkey"), ("entity", "customer", "c_custkey"), ("document", "supplier", "s_suppkey"))
    parts = [table(spark, sf_dir, t).select(F.concat(F.lit(f"{k}:"), F.col(c).cast("string")).alias("id"), F.lit(k).alias("kind")) for k, t, c in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c).cast("string"))
    supports = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct().select(node("document", "l_suppkey").alias("subject"), F.lit("supports").alias("relation"), node("claim", "l_orderkey").alias("object"))
    attributed = table(spark, sf_dir, "orders").select(node("claim", "o_orderkey").alias("subject"), F.lit("attributed_to").alias("relation"), node("entity", "o_custkey").alias("object"))
    return supports.unionByName(attributed)


@query(_NODES)
def evidence_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir)


@query(_EDGES)
def evidence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(f"SELECT 'nodes' AS part, kind AS name, count(*) AS n FROM ({_NODES}) GROUP BY kind UNION ALL SELECT 'edges', relation, count(*) FROM ({_EDGES}) GROUP BY relation")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda df, part, c: df.groupBy(F.lit(part).alias("part"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return count(_nodes(spark, sf_dir), "nodes", "kind").unionByName(count(_edges(spark, sf_dir), "edges", "relation"))


@query("""WITH c AS (SELECT n_nationkey, n_name, r.r_name AS answer, x.r_name AS other, md5(n_name || x.r_name) AS h FROM nation JOIN region r ON n_regionkey = r.r_regionkey JOIN region x ON x.r_regionkey <> n_regionkey)
SELECT n_nationkey, answer, list_aggregate(list(other ORDER BY h), 'string_agg', ',') AS distractors FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY h) <= 3) GROUP BY ALL""")
def quiz_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each nation: its region and three others in hash order. Regions are one array."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("answer"))
    others = r.agg(F.collect_list("r_name")).scalar()
    keyed = F.array_sort(F.transform(F.filter("names", lambda x: x != F.col("answer")), lambda x: F.struct(F.md5(F.concat(F.col("n_name"), x)).alias("h"), x.alias("r"))))
    return named.withColumn("names", others).select("n_nationkey", "answer", F.array_join(F.transform(F.slice(keyed, 1, 3), lambda x: x.r), ",").alias("distractors"))


@query("""SELECT 'documents' AS tab, doc_id AS id, 'text_length' AS rule FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'documents', doc_id, 'short_text' FROM documents WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) < 80""")
def dq_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bad = {"text_length": F.col("n_chars") != F.length("text"), "short_text": F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) < 80}
    rules = F.filter(F.array(*[F.when(c, k) for k, c in bad.items()]), lambda x: x.isNotNull())
    return docs.select(F.lit("documents").alias("tab"), F.col("doc_id").alias("id"), F.explode(rules).alias("rule"))


@query("SELECT sha256(text) AS key, count(*) AS rows FROM documents GROUP BY 1 HAVING count(*) > 1")
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')")
def dq_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside the allow-lists."""
    orders = table(spark, sf_dir, "orders").where(~F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").where(~F.col("l_returnflag").isin("A", "N")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("o_orderstatus"))
    return orders.unionByName(lines)


@query("SELECT l_orderkey AS id, 'order' AS target FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT d.doc_id, 'label' FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def dq_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, docs, labels = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "documents", "labels"))
    lost = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left_anti").select(F.col("l_orderkey").alias("id"), F.lit("order").alias("target"))
    return lost.unionByName(docs.join(labels, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.lit("label").alias("target")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (o_orderstatus = 'F') <> (l_linestatus = 'F')")
def dq_cross_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).where((F.col("o_orderstatus") == "F") != (F.col("l_linestatus") == "F")).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def dq_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).where("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber")


@query("SELECT t AS tab, n, least, n >= least AS ok FROM (SELECT 'documents' AS t, (SELECT count(*) FROM documents) AS n, 500 AS least UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 20000 UNION ALL SELECT 'events', (SELECT count(*) FROM events), 1000)")
def dq_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    floors = (("documents", 500), ("orders", 20000), ("events", 1000))
    parts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tab"), "n", F.lit(least).alias("least"), (F.col("n") >= least).alias("ok")) for t, least in floors]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT a.doc_id, sha256(a.text) <> sha256(trim(regexp_replace(a.text, '\\s+', ' ', 'g'))) AS mismatch FROM documents a WHERE sha256(a.text) <> sha256(trim(regexp_replace(a.text, '\\s+', ' ', 'g')))")
def dq_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose digest isn't that of their compacted form."""
    differ = F.sha2("text", 256) != F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256)
    return table(spark, sf_dir, "documents").where(differ).select("doc_id", F.lit(True).alias("mismatch"))


@query(_WITH + f"SELECT (SELECT round(count(*) FILTER (WHERE claims > 0) / count(*), 4) FROM cells) >= 0.1 AS coverage_ok, (SELECT count(*) FROM ({_EDGES}) WHERE relation = 'supports') >= (SELECT count(*) FROM orders) AS support_ok")
def dq_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research floors: coverage of a tenth of the cells, and as many supporting edges as claims."""
    share = _cells(spark, sf_dir).agg((F.avg((F.col("claims") > 0).cast("double")) >= 0.1).alias("coverage_ok"))
    supports = _edges(spark, sf_dir).where("relation = 'supports'").agg(F.count(F.lit(1))).scalar()
    return share.select("coverage_ok", (supports >= table(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()).alias("support_ok"))
