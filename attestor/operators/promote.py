"""Promotion of extracted claims: verdicts, support documents, state repair, reports; evidence of parties and actors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as T


def verdict_filter(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims with a CONFIRMED verdict; one that supersedes another needs its target. claims: (source_url, window, idx);
    verdicts: the same keys, verdict, relation, target_id."""
    fine = verdicts.where("verdict = 'CONFIRMED' and (coalesce(relation, '') <> 'SUPERSEDES' or target_id is not null)")
    return claims.join(fine.select("source_url", "window", "idx", "relation", "target_id"), ["source_url", "window", "idx"])


def resolve_date(claims: DataFrame, feed: DataFrame, today: Column) -> DataFrame:
    """(source_url, published, date_basis): the date most claims of a source give (the earliest index wins a tie), else
    the feed's, else today as a capture."""
    counted = claims.where("date is not null").groupBy("source_url", "date").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    given = counted.groupBy("source_url").agg(F.min_by("date", F.struct(-F.col("n"), "first")).alias("given"))
    sources = claims.select("source_url").distinct().join(given, "source_url", "left").join(feed.select("source_url", F.col("date").alias("feed_date")), "source_url", "left")
    known = F.coalesce("given", "feed_date")
    return sources.select("source_url", F.coalesce(known, today.cast("string")).alias("published"), F.when(known.isNull(), "capture_fallback").otherwise("source_publication").alias("date_basis"))


def support_upsert(documents: DataFrame, new: DataFrame) -> DataFrame:
    """Support documents with new topics and statements; what is there already isn't repeated. Both have (document_id,
    topics, statements); new rows of one document are one row."""
    empty = F.array().cast("array<string>")
    joined = documents.alias("o").join(new.alias("n"), "document_id", "full")
    merge = lambda c: F.array_distinct(F.concat(F.coalesce(F.col(f"o.{c}"), empty), F.coalesce(F.col(f"n.{c}"), empty))).alias(c)
    return joined.select("document_id", F.array_sort(merge("topics")).alias("topics"), merge("statements"))


def support_id(owner: Column, date: Column, url: Column) -> Column:
    """A deterministic identifier: owner, date and the start of the url's digest."""
    return F.concat_ws("-", owner, date, F.left(F.sha2(url, 256), F.lit(12)))


def state_repair(fingerprints: DataFrame, claims: DataFrame) -> DataFrame:
    """Fingerprints whose claim still exists and isn't about an older election. claims: (claim_id, scope)."""
    return fingerprints.join(claims.where("coalesce(scope, '') <> 'old'"), "claim_id", "left_semi")


def run_report(outcomes: DataFrame) -> DataFrame:
    """One row of counts by outcome."""
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return outcomes.agg(F.count(F.lit(1)).alias("total"), *map(count, ("inserted", "superseded", "merged", "rejected", "deferred")))


def group_by_actor(cards: DataFrame, members: DataFrame) -> DataFrame:
    """Cards of parties join the card of their person: those in the result, else the party's single best one, else the
    party stays apart. cards: (question_id, entity_id, kind, text, score); members: (party_id, entity_id, status_rank)."""
    people, parties = cards.where("kind = 'person'"), cards.where("kind = 'party'")
    present = people.select("question_id", "entity_id").distinct().join(members, "entity_id").select("question_id", F.col("party_id").alias("party"), F.col("entity_id").alias("target"))
    ranked = members.withColumn("r", F.rank().over(Window.partitionBy("party_id").orderBy("status_rank"))).where("r = 1")
    best = ranked.groupBy(F.col("party_id").alias("party")).agg(F.min("entity_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    placed = parties.withColumnRenamed("entity_id", "party").join(present, ["question_id", "party"], "left").join(best, "party", "left")
    moved = placed.select("question_id", F.coalesce("target", "best", "party").alias("entity_id"), F.lit(1).alias("inherited"), "text", "score")
    rows = people.select("question_id", "entity_id", F.lit(0).alias("inherited"), "text", "score").unionByName(moved)
    texts = F.transform(F.array_sort(F.collect_set(F.struct("inherited", (-F.col("score")).alias("s"), "text"))), lambda x: x.text)
    return rows.groupBy("question_id", "entity_id").agg(F.array_distinct(texts).alias("texts"), F.max("score").alias("score"), F.max("inherited").alias("with_party"))


def actor_type_filter(evidence: DataFrame, questions: DataFrame, entities: DataFrame) -> DataFrame:
    """Evidence of the kind of actor that a question names: candidates or parties, both if it names both or neither.
    evidence: (question_id, entity_id, …); questions: (question_id, text); entities: (entity_id, type)."""
    text = T.norm(F.col("text"))
    person, party = text.rlike(r"\bcandidate?s?\b"), text.rlike(r"\bpartis?\b")
    wanted = questions.select("question_id", F.when(person & ~party, "person").when(party & ~person, "party").alias("wanted"))
    kinds = entities.select("entity_id", F.col("type").alias("kind"))
    return evidence.join(wanted, "question_id").join(kinds, "entity_id").where("wanted is null or wanted = kind").drop("wanted", "kind")


def named_qualifier(evidence: DataFrame, questions: DataFrame, known: DataFrame) -> DataFrame:
    """Where a question has exactly one capitalised word of five letters or more, beyond its first word and what is
    known, evidence must hold it. evidence: (question_id, text, …); questions: (question_id, text); known: (term)."""
    found = F.regexp_extract_all("text", F.lit(r"(?<=\s)(\p{Lu}\p{Ll}{4,})"), F.lit(1))
    named = questions.select("question_id", F.explode(F.array_distinct(F.transform(found, T.norm))).alias("term")).join(known, "term", "left_anti")
    single = named.groupBy("question_id").agg(F.min("term").alias("term"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return evidence.join(single, "question_id", "left").where(F.col("term").isNull() | T.contains_phrase(T.norm(F.col("text")), F.coalesce("term", F.lit("")))).drop("term")


def dominant_concepts(matches: DataFrame) -> DataFrame:
    """Of the concepts that a question matches, those with the longest alias of two words or more; all if none has
    one. matches: (question_id, concept, alias)."""
    words = F.size(F.split(F.trim("alias"), r"\s+"))
    rows = matches.withColumn("__n", F.when(words >= 2, F.length("alias")).otherwise(0))
    return rows.withColumn("__m", F.max("__n").over(Window.partitionBy("question_id"))).where("__n = __m or __m = 0").drop("__n", "__m")


def strict_groups(evidence: DataFrame, groups: DataFrame) -> DataFrame:
    """Evidence that holds a term of every strict group of its question's concept. evidence: (question_id, concept,
    text, …); groups: (concept, groups ARRAY<ARRAY<STRING>>)."""
    joined = evidence.join(groups, "concept", "left")
    text = T.norm(F.col("text"))
    held = F.forall("groups", lambda g: F.exists(g, lambda t: T.contains_phrase(text, T.norm(t))))
    return joined.where(F.col("groups").isNull() | held).drop("groups")
