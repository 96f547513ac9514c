"""Claims: lookups, coverage, evidence strength, versions, merging and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.session import written


def ratio(a: Column, b: Column) -> Column:
    """a / b with four decimals; 0 where b is 0."""
    return F.coalesce(F.round(a / F.nullif(b.cast("double"), F.lit(0.0)), 4), F.lit(0.0))


def first_known(*labels: Column, default: str = "unknown") -> Column:
    """The first label that is present."""
    return F.coalesce(*labels, F.lit(default))


def scaffold(actors: DataFrame, topics: DataFrame) -> DataFrame:
    """Every actor with every topic of a small taxonomy, so that absent cells stay rows. The taxonomy becomes one
    array, which is exploded for each actor."""
    listed = topics.agg(F.array_sort(F.collect_set("topic"))).scalar()
    return actors.withColumn("__topics", listed).select(*actors.columns, F.explode("__topics").alias("topic"))


def coverage_cells(claims: DataFrame, actors: DataFrame, topics: DataFrame, actor: str = "actor") -> DataFrame:
    """(actor, topic, claims, explicit, latest): one row for each cell; empty cells have 0 claims."""
    counted = claims.groupBy(actor, "topic").agg(F.count(F.lit(1)).alias("claims"), F.count_if("explicit").alias("explicit"), F.max("date").alias("latest"))
    cells = scaffold(actors, topics).join(counted, [actor, "topic"], "left")
    return cells.select(actor, "topic", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("explicit", F.lit(0)).alias("explicit"), "latest")


def strength(certainty: Column, weights: dict[str, float], default: float = 1.0) -> Column:
    out = None
    for name, value in weights.items():
        out = F.when(certainty == name, value) if out is None else out.when(certainty == name, value)
    return out.otherwise(default)


def coverage_level(explicit: Column, items: Column, score: Column, primary: Column, inherited: Column | None = None) -> Column:
    """documented: two explicit items, or two items with a score of 5 and a primary or explicit one; partial: any own
    item; party_only: inherited evidence only; none."""
    documented = (explicit >= 2) | ((items >= 2) & (score >= 5) & ((primary >= 1) | (explicit >= 1)))
    only = F.lit(False) if inherited is None else inherited > 0
    return F.when(documented, "documented").when(items > 0, "partial").when(only, "party_only").otherwise("none")


def validity_intervals(rows: DataFrame, key: str, status: str, at: str, tie: str) -> DataFrame:
    """Status history: repeats of the same status are dropped; each row is valid until the next one."""
    order = Window.partitionBy(key).orderBy(at, tie)
    changed = rows.withColumn("__before", F.lag(status).over(order)).where(F.col("__before").isNull() | (F.col("__before") != F.col(status)))
    return changed.withColumn("valid_to", F.lead(at).over(order)).select(key, F.col(status).alias("status"), F.col(at).alias("valid_from"), "valid_to")


def most_common(rows: DataFrame, key: str, value: str, seen_at: str) -> DataFrame:
    """The most frequent value of each key; the value seen first wins a tie."""
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(seen_at).alias("first"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), "first", value)).alias(value), F.max("n").alias("n"))


def merge_record(rows: DataFrame, key: str, order: str, text: Column, label: str) -> DataFrame:
    """Rows of a key as one record: texts joined in order, distinct labels sorted. Meant for records of bounded size
    (the chunks of one document); a digest stands for the text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x.t)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("parts"), F.sha2(F.array_join(parts, "\n"), 256).alias("digest"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"))


def unique_best(rows: DataFrame, key: str, rank: Column, value: str) -> DataFrame:
    """The value with the best rank of a key, only where it is held by exactly one row."""
    ranked = rows.withColumn("__r", F.rank().over(Window.partitionBy(key).orderBy(rank)))
    return ranked.where("__r = 1").groupBy(key).agg(F.min(value).alias(value), F.count(F.lit(1)).alias("n")).where("n = 1").select(key, value)


def inherited(own: DataFrame, group_evidence: DataFrame, members: DataFrame, share: float = 0.94) -> DataFrame:
    """Evidence of a group counts for a member, at a share of its score, where the member has none itself. The owner
    of the evidence is kept. own: (actor, score); group_evidence: (group_id, score); members: (actor, group_id)."""
    missing = members.join(own.select("actor").distinct(), "actor", "left_anti")
    taken = missing.join(group_evidence, "group_id").select("actor", F.round(F.col("score") * share, 6).alias("score"), F.col("group_id").alias("owner_group"))
    return own.select("actor", F.round("score", 6).alias("score"), F.lit(None).cast(taken.schema["owner_group"].dataType).alias("owner_group")).unionByName(taken)


def supersession(rows: DataFrame, keys: list[str], id_col: str, at: str) -> DataFrame:
    """(id, superseded_by): the next row of the same keys in time."""
    order = Window.partitionBy(*keys).orderBy(at, id_col)
    return rows.select(*keys, id_col, at, F.lead(id_col).over(order).alias("superseded_by"))


def reciprocity(links: DataFrame) -> DataFrame:
    """(id, other, rule) for the links `supersedes` that break a rule, with the first rule that they break: mirrored by
    superseded_by, same actor, same topic, not older. links: id, actor, topic, date, supersedes, superseded_by."""
    other = links.select(F.col("id").alias("other"), F.col("actor").alias("__actor"), F.col("topic").alias("__topic"), F.col("date").alias("__date"), F.col("superseded_by").alias("__by"))
    pairs = links.where("supersedes is not null").join(other, F.col("supersedes") == F.col("other"))
    rule = (
        F.when(~F.col("__by").eqNullSafe(F.col("id")), "not_mirrored")
        .when(F.col("actor") != F.col("__actor"), "other_actor")
        .when(F.col("topic") != F.col("__topic"), "other_topic")
        .when(F.col("date") < F.col("__date"), "older")
    )
    return pairs.select("id", "other", rule.alias("rule")).where("rule is not null")


def chains(links: DataFrame, start: str, to: str) -> DataFrame:
    """(node, length, cycle): the length of the chain from each row along its links to its end, whatever it is; null,
    with cycle true, where the links never end. Pointer doubling: each round joins the steps with themselves and is
    written, so a chain of n links takes about log2(n) rounds. When a round ends no chain, what is left runs in cycles:
    of a chain that ends, some later row would have ended in it."""
    steps = written(links.select(F.col(start).alias("node"), F.col(to).alias("at"), F.when(F.col(to).isNotNull(), 1).otherwise(0).alias("length")))
    before, left = -1, steps.where("at is not null").count()
    while left and left != before:
        further = steps.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("length").alias("more"))
        moved = steps.where("at is not null").join(further, "at", "left").select("node", F.col("next").alias("at"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"))
        steps = written(steps.where("at is null").unionByName(moved))
        before, left = left, steps.where("at is not null").count()
    return steps.select("node", F.when(F.col("at").isNull(), F.col("length")).alias("length"), F.col("at").isNotNull().alias("cycle"))


def closure(links: DataFrame, start: str, to: str, most: int | None = None) -> DataFrame:
    """Chain length from each row along its links, null where they run into a cycle (see chains). Lengths are whole
    unless the caller gives a largest one."""
    length = F.col("length") if most is None else F.when(F.col("length").isNotNull(), F.least("length", F.lit(most)))
    return chains(links, start, to).select("node", length.alias("length"))


def provenance_merge(claims: DataFrame, new: DataFrame) -> DataFrame:
    """Append to each claim the documents and urls it doesn't have yet, in order; replaying adds nothing.
    claims: (claim_id, doc_ids array, urls array); new: (claim_id, doc_ids, urls) with one row per claim."""
    add = new.select("claim_id", F.col("doc_ids").alias("__d"), F.col("urls").alias("__u"))
    empty = F.array().cast("array<string>")
    merged = claims.join(add, "claim_id", "left").select("claim_id", F.array_distinct(F.concat("doc_ids", F.coalesce("__d", empty))).alias("doc_ids"), F.array_distinct(F.concat("urls", F.coalesce("__u", empty))).alias("urls"))
    return merged.withColumn("confirmation_count", F.size("doc_ids"))


def supersede(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Mark the targets of SUPERSEDES verdicts. claims: (claim_id, status, superseded_by); verdicts: (verdict, claim_id,
    target_id). A verdict without a target, or another verdict, changes nothing; the smallest new claim wins."""
    by = verdicts.where("verdict = 'SUPERSEDES' and target_id is not null and claim_id <> target_id").groupBy(F.col("target_id").alias("claim_id")).agg(F.min("claim_id").alias("__by"))
    joined = claims.join(by, "claim_id", "left")
    return joined.select("claim_id", F.when(F.col("__by").isNotNull(), "superseded").otherwise(F.col("status")).alias("status"), F.coalesce("__by", "superseded_by").alias("superseded_by"))


def chronology_guard(updates: DataFrame, current: DataFrame) -> DataFrame:
    """Updates that may replace what is current: with a publication (not a capture) date that isn't older.
    updates: (claim_id, date, date_basis); current: (claim_id, date)."""
    known = current.select("claim_id", F.col("date").alias("__date"))
    kept = updates.where("date is not null and coalesce(date_basis, '') <> 'capture_fallback'").join(known, "claim_id", "left")
    return kept.where("__date is null or date >= __date").drop("__date")


def sanitize(claims: DataFrame, allowed: DataFrame, texts: DataFrame, least_chars: int = 24, most_words: int = 18, most: int = 8) -> DataFrame:
    """Claims about allowed (actor_id, actor_type) pairs with a long enough statement and a short verbatim quote of
    their source, the first `most` of each source. claims: (source_url, idx, actor_id, actor_type, statement, quote);
    texts: (source_url, text)."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    kept = claims.join(allowed, ["actor_id", "actor_type"], "left_semi").where(F.length(F.trim("statement")) >= least_chars)
    kept = kept.where((F.size(F.split(F.trim("quote"), r"\s+")) <= most_words) & (F.trim("quote") != ""))
    kept = kept.join(texts, "source_url").where(F.contains(flat(F.col("text")), flat(F.col("quote")))).drop("text")
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy("source_url").orderBy("idx"))).where(F.col("__n") <= most).drop("__n")
