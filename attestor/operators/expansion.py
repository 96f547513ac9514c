"""Evidence in depth: what a question's evidence is enriched with, from the same records and from the documents they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as T

#: Words that don't show that a document supports a claim (fixed values).
SUPPORT_STOP = """
avec avoir cette dans des elle elles entre etre fait leur leurs mais nous notre pour plus peut politique programme propose
proposition source sont sur une vers vous ainsi comme aux par que qui les est du de la le un
""".split()
#: Shares of a score that chunks of the same record and of a cited document get, and the least (fixed values).
SAME_RECORD, CITED, LEAST = 0.55, 0.5, 0.1


def support_terms(*texts: str) -> Column:
    """Distinct folded words of three letters or more that can show support."""
    found = F.split(T.norm(F.concat_ws(" ", *texts)), " ")
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*SUPPORT_STOP)))


def support_numbers(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b\d+(?:[.,]\d+)?\b"), F.lit(0)))


def support(shared: Column, numbers: Column, a: Column, b: Column) -> Column:
    """Shared terms, 1.5 for each shared number up to 3, and the overlap with the smaller side; 0 below two shared terms."""
    return F.when(shared >= 2, F.round(shared + F.least(F.lit(3.0), numbers * 1.5) + shared / F.greatest(F.lit(1), F.least(a, b)), 6)).otherwise(F.lit(0.0))


def expand(evidence: DataFrame, chunks: DataFrame, most: int = 36, per_source: int = 3) -> DataFrame:
    """(item_id, place, origin, claim, record, chunk, entity, owner, score): each question's evidence, then for each piece of
    it, in the order of rank, chunks of its record and chunks of the documents that it cites.

    evidence: item_id, rank, record, score, entity, path, section, title, text, sources (array of records, in order).
    chunks: record, chunk (order in its record), kind, entity, path, section, title, text.

    A record gives its first `per_source` chunks at 0.55 of the score, a cited document the `per_source` chunks that support
    the evidence most (see support) at 0.5, the least being 0.1. A cited chunk speaks for the entity of the evidence, with
    its own one as owner and the citing record as claim. Of rows that agree in claim, record, path, section, entity and
    text the first counts; then `most` rows of each question stay. Both limits are the operator's own.

    Records and cited documents are found by equi-joins, and both limits are windows that cut before the shuffle. Null texts
    are empty; evidence without a record or sources stays alone; a source named twice counts where it first stands."""
    base = evidence.withColumn("text", F.coalesce("text", F.lit("")))
    parts = chunks.where("record is not null").withColumn("text", F.coalesce("text", F.lit("")))
    none = F.lit(None).cast(evidence.schema["record"].dataType)
    key = F.sha2(F.trim("text", F.lit(" \t\r\n")), 256)
    columns = ["item_id", "rank", "step", "at", "nth", "origin", "claim", "record", "chunk", "entity", "owner", "path", "section", "score", "digest"]
    nothing = F.lit(None).cast(chunks.schema["entity"].dataType)
    zero = F.lit(0)

    own = base.select("item_id", "rank", zero.alias("step"), zero.alias("at"), zero.cast("long").alias("nth"), F.lit("base").alias("origin"), none.alias("claim"), "record", F.lit(None).cast("long").alias("chunk"), "entity", nothing.alias("owner"), "path", "section", "score", key.alias("digest"))

    wanted = base.select("record").distinct()
    first = parts.join(wanted, "record", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("record").orderBy("chunk"))).where(F.col("nth") <= per_source)
    scored = base.where("record is not null").select("item_id", "rank", "record", F.greatest(F.lit(LEAST), F.round(F.col("score") * SAME_RECORD, 6)).alias("score"))
    same = scored.join(first, "record").select("item_id", "rank", F.lit(1).alias("step"), zero.alias("at"), F.col("nth").cast("long").alias("nth"), F.lit("record").alias("origin"), none.alias("claim"), "record", F.col("chunk").cast("long").alias("chunk"), "entity", nothing.alias("owner"), "path", "section", "score", key.alias("digest"))

    asked = base.select("item_id", "rank", F.col("record").alias("claim"), F.col("entity").alias("speaker"), F.col("score").alias("full"), support_terms("text", "title").alias("terms"), support_numbers("text").alias("numbers"), F.posexplode(F.array_distinct("sources")).alias("at", "record"))
    held = parts.where("kind = 'document'").join(asked.select("record").distinct(), "record", "left_semi")
    held = held.select("record", "chunk", "entity", "path", "section", key.alias("digest"), support_terms("title", "text").alias("words"), support_numbers("text").alias("figures"))
    met = asked.join(held, "record")
    shared, numbers = F.size(F.array_intersect("terms", "words")), F.size(F.array_intersect("numbers", "figures"))
    met = met.withColumn("support", support(shared, numbers, F.size("terms"), F.size("words"))).where("support > 0").drop("terms", "words", "numbers", "figures")
    order = Window.partitionBy("item_id", "rank", "at").orderBy(F.desc("support"), "chunk")
    met = met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_source)
    cited = met.select("item_id", "rank", F.lit(2).alias("step"), "at", F.col("nth").cast("long").alias("nth"), F.lit("cited").alias("origin"), "claim", "record", F.col("chunk").cast("long").alias("chunk"), F.col("speaker").alias("entity"), F.col("entity").alias("owner"), "path", "section", F.greatest(F.lit(LEAST), F.round(F.col("full") * CITED, 6)).alias("score"), "digest")

    rows = own.select(columns).unionByName(same.select(columns)).unionByName(cited.select(columns))
    # all evidence comes first, then what each piece of it leads to
    sequence = F.struct(F.when(F.col("step") == 0, 0).otherwise(1).alias("later"), "rank", "step", "at", "nth")
    rows = rows.withColumn("sequence", sequence)
    again = Window.partitionBy("item_id", "claim", "record", "path", "section", "entity", "digest").orderBy("sequence")
    rows = rows.withColumn("same", F.row_number().over(again)).where("same = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("sequence"))).where(F.col("place") <= most)
    return rows.select("item_id", "place", "origin", "claim", "record", "chunk", "entity", "owner", "score")
