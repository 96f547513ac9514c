"""Dates over a provenance graph: a record without a date basis takes that of the records it cites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.session import shared_folder, written

#: Record statuses that don't count for the freshness of a corpus (fixed values).
INACTIVE = "superseded withdrawn archived rejected draft historical".split()


def propagate(records: DataFrame, links: DataFrame) -> DataFrame:
    """(id, basis, captured, state, round) for records (id, basis, captured) and links (id, source).

    In round 0 a record with a basis of its own keeps it (state own). In each further round the records without one look at
    those they cite that were given a basis in the round before, so the nearest ones decide. If these agree, the record
    takes their basis (inherited), and with it the earliest captured date of all it cites: those without a basis count with
    their own date. If they disagree, it keeps its own date and no basis, for good (conflict). What no round reaches is
    unknown, with a null round.

    Each record is decided once, so cycles and links of a record to itself end. Rows of one id are one record: its basis
    counts if all that state one agree, and the earliest date. Null ids, links to ids that aren't there and repeated links
    count for nothing; without records the result is empty.

    A round joins the links of records still open with the records of the round before and aggregates by record, with
    partial sums before the shuffle, so a source that a third of all records cite is one row of the small side. Each round
    is written to one folder, which the result reads at once, however many rounds there are."""
    spark = records.sparkSession
    stated = records.where("id is not null").groupBy("id").agg(F.when(F.min("basis") == F.max("basis"), F.min("basis")).alias("basis"), F.min("captured").alias("captured"))
    stated = written(stated)
    nodes = stated.select(F.col("id").alias("source"), F.col("captured").alias("stated"))
    cited = links.select("id", "source").distinct().join(stated.where("basis is null").select("id"), "id", "left_semi")
    waiting = written(cited.join(nodes, "source"))
    fresh = stated.where("basis is not null")
    folder, rounds = shared_folder(spark), 0
    decided = "id {}, basis {}, captured {}".format(*(stated.schema[c].dataType.simpleString() for c in ("id", "basis", "captured")))
    while True:
        rounds += 1
        known = fresh.select(F.col("id").alias("source"), "basis", "captured")
        date = F.when(F.col("basis").isNotNull(), F.col("captured")).otherwise(F.col("stated"))
        met = waiting.join(known, "source", "left").groupBy("id").agg(F.min("basis").alias("low"), F.max("basis").alias("high"), F.min(date).alias("captured"))
        met = met.where("low is not null").select("id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("basis"), "captured")
        path = f"{folder}/round={rounds}"
        met.write.parquet(path)
        met = spark.read.schema(decided).parquet(path)
        if met.isEmpty():
            break
        fresh = met.where("basis is not null")
        waiting = written(waiting.join(met.select("id"), "id", "left_anti"))
    found = spark.read.schema(f"{decided}, round int").option("basePath", folder).parquet(folder)
    found = found.select("id", F.col("basis").alias("given"), F.col("captured").alias("earliest"), "round")
    own, given = F.col("basis").isNotNull(), F.col("given").isNotNull()
    state = F.when(own, "own").when(given, "inherited").when(F.col("round").isNotNull(), "conflict").otherwise("unknown")
    return stated.join(found, "id", "left").select(
        "id",
        F.coalesce("basis", "given").alias("basis"),
        F.when(given, F.col("earliest")).otherwise(F.col("captured")).alias("captured"),
        state.alias("state"),
        F.when(own, 0).otherwise(F.col("round")).alias("round"),
    )


def effective_day(basis: str = "basis", captured: str = "captured", published: str = "published"):
    """The day that a record counts for: captured first where that is only a fallback for a publication, else published."""
    return F.when(F.col(basis) == "capture_fallback", F.coalesce(captured, published)).otherwise(F.coalesce(published, captured))


def freshness(records: DataFrame, snapshot) -> DataFrame:
    """One row (corpus_freshness, latest_captured, status_snapshot) over records (kind, status, basis, captured, published):
    the latest effective day of active documents and proposals or the snapshot of statuses, whichever is later. Without
    records it is the snapshot, without that too it is null."""
    active = F.col("kind").isin("document", "proposal") & ~F.coalesce(F.lower("status"), F.lit("")).isin(*INACTIVE)
    days = records.where(active).agg(F.max(effective_day()).alias("day"), F.max("captured").alias("latest_captured"))
    return days.select(F.greatest("day", snapshot).alias("corpus_freshness"), "latest_captured", snapshot.alias("status_snapshot"))
