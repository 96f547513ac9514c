"""The rows of a search index: one schema for statuses, profiles, documents and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of every row.
FIELDS = {
    **dict.fromkeys("id record kind entity entity_label title text path source_url source_tier document_status proposal_status".split(), "string"),
    **dict.fromkeys("supersedes superseded_by source_documents".split(), "array<string>"),
    **dict.fromkeys("candidate_status published confidence certainty".split(), "string"),
    "topics": "array<string>",
    "section": "string",
    "chunk": "int",
}
#: Where entities are registered, the tier of a party's own site and the label of what isn't known (fixed values).
REGISTRY_PATH, OWN_SITE_TIER, UNKNOWN = "data/entities.json", "tier_1_primary_official", "Entité inconnue"


def _shaped(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """rows with all FIELDS in order: those given, else null, lists empty."""
    empty = lambda kind: F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
    whole = {c: F.coalesce(values[c].cast(kind), empty(kind)) if c in values else empty(kind) for c, kind in FIELDS.items()}
    return rows.select(*(v.alias(c) for c, v in whole.items()))


def status_rows(candidates: DataFrame, snapshot: Column) -> DataFrame:
    """A row for the status of each candidate (id, name, status, confidence, declared, as_of, party, source_url, source_tier)."""
    day = F.coalesce("declared", "as_of", snapshot)
    text = F.concat_ws(" ", F.concat("name", F.lit(".")), F.concat(F.lit("Statut : "), "status", F.lit(".")), F.concat(F.lit("Confiance : "), "confidence", F.lit(".")), F.concat(F.lit("Parti : "), "party", F.lit(".")))
    topics = F.array_compact(F.array(F.lit("candidat"), F.lit("candidature"), F.lit("statut"), "status", "party"))
    return _shaped(candidates, {
        "id": F.concat(F.lit("candidate:"), "id"), "record": F.col("id"), "kind": F.lit("candidate_status"), "entity": F.col("id"), "entity_label": F.col("name"),
        "title": F.concat(F.lit("Statut de "), "name"), "text": text, "path": F.lit(REGISTRY_PATH), "source_url": F.col("source_url"), "source_tier": F.col("source_tier"),
        "document_status": F.lit("current"), "candidate_status": F.col("status"), "published": day, "confidence": F.col("confidence"), "topics": topics, "section": F.lit("Statut"), "chunk": F.lit(0),
    })


def party_rows(parties: DataFrame, snapshot: Column) -> DataFrame:
    """A row for the profile of each party (id, name, website); one with a site of its own is better documented."""
    site = F.nullif("website", F.lit(""))
    return _shaped(parties, {
        "id": F.concat(F.lit("party:"), "id"), "record": F.col("id"), "kind": F.lit("party_profile"), "entity": F.col("id"), "entity_label": F.col("name"),
        "title": F.concat(F.lit("Parti : "), "name"), "text": F.concat("name", F.lit(" est un parti ou mouvement du corpus.")), "path": F.lit(REGISTRY_PATH), "source_url": site,
        "source_tier": F.when(site.isNotNull(), OWN_SITE_TIER), "document_status": F.lit("current"), "published": snapshot, "confidence": F.when(site.isNotNull(), "high").otherwise("medium"),
        "topics": F.array(F.lit("parti"), F.lit("mouvement"), F.lit("programme")), "section": F.lit("Profil"), "chunk": F.lit(0),
    })


def piece_rows(records: DataFrame, pieces: DataFrame, candidates: DataFrame, parties: DataFrame) -> DataFrame:
    """A row for each piece (record, chunk, section, text) of a record.

    records: record, claim (boolean), entity, title, path, source_url, primary_url, source_tier, document_status,
    proposal_status, supersedes, superseded_by, source_documents, published, first_documented, verification, certainty,
    topics. A claim's own lifecycle goes before its document's status; a claim without any is current, a document unknown.
    What is verified has high confidence, all else that of its candidate. Labels come from candidates, then from parties."""
    known = candidates.select(F.col("id").alias("entity"), F.col("name").alias("named"), F.col("status").alias("held"), F.col("confidence").alias("sure"))
    bodies = parties.select(F.col("id").alias("entity"), F.col("name").alias("body"))
    whole = records.join(known, "entity", "left").join(bodies, "entity", "left")
    status = F.when(F.col("claim"), F.coalesce(F.nullif("proposal_status", F.lit("")), F.nullif("document_status", F.lit("")), F.lit("current"))).otherwise(F.coalesce(F.nullif("document_status", F.lit("")), F.lit("unknown")))
    whole = whole.withColumn("__status", status)
    cut = pieces.select("record", F.col("chunk").alias("__chunk"), F.col("section").alias("__section"), F.col("text").alias("__text"))
    rows = cut.join(whole, "record")
    listed = lambda c: F.filter(c, lambda x: x.isNotNull() & (x != ""))
    return _shaped(rows, {
        "id": F.concat("record", F.lit("#"), (F.col("__chunk") + 1).cast("string")), "record": F.col("record"), "kind": F.when(F.col("claim"), "proposal").otherwise("document"),
        "entity": F.col("entity"), "entity_label": F.coalesce("named", "body", "entity", F.lit(UNKNOWN)), "title": F.coalesce("title", "path"), "text": F.col("__text"), "path": F.col("path"),
        "source_url": F.coalesce(F.nullif("source_url", F.lit("")), F.nullif("primary_url", F.lit(""))), "source_tier": F.col("source_tier"), "document_status": F.col("__status"),
        "proposal_status": F.when(F.col("claim"), F.nullif("proposal_status", F.lit(""))), "supersedes": listed("supersedes"), "superseded_by": listed("superseded_by"), "source_documents": listed("source_documents"),
        "candidate_status": F.col("held"), "published": F.coalesce("published", "first_documented"), "confidence": F.when(F.col("verification") == "verified", "high").otherwise(F.col("sure")), "certainty": F.col("certainty"),
        "topics": listed(F.concat(F.coalesce("topics", F.array().cast("array<string>")), F.array("__status"))), "section": F.col("__section"), "chunk": F.col("__chunk"),
    })


def assemble(candidates: DataFrame, parties: DataFrame, records: DataFrame, pieces: DataFrame, snapshot: Column) -> DataFrame:
    """All rows of the index, with the columns of FIELDS. Ids of candidates, parties and records are unique; pieces of
    records that aren't there are left out, and records without pieces have no rows. Texts of pieces meet their record once,
    by an equi-join; the registries are joined with the records, not with the pieces."""
    return status_rows(candidates, snapshot).unionByName(party_rows(parties, snapshot)).unionByName(piece_rows(records, pieces, candidates, parties))
