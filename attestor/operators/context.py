"""What short follow-up turns take over from the turns before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators.ordered import Ordered

#: A turn of at most so many words, or one that begins with one of these, follows up (fixed values).
FEW_WORDS, OPENINGS = 8, "^(et|eux|elles|lui|elle|sinon|quid|meme question)"


def follows_up(text: Column) -> Column:
    said = T.normalize(text)
    return (F.size(F.filter(F.split(said, " "), lambda w: w != "")) <= FEW_WORDS) | said.rlike(OPENINGS)


def carried(turns: DataFrame) -> DataFrame:
    """The turns with what each one stands for: entities and topic are its own, or, where it has none and follows up, those that
    the turn before stands for; so a chain of follow-ups inherits across any number of turns, and a turn that doesn't
    follow up ends it. turns: conv_id, turn, short, entities, topic (arrays), compares, status (booleans).

    mode: comparison where the turn compares, or follows up on a turn of that mode and names no entity of its own or the turn
    before stood for two at least; else measures where it follows up on a turn with a topic and asks for no status; else
    null. origin: how many of entities, topic and mode are inherited.

    The fold is made of running values: chains are numbered by the turns that don't follow up, entities and topics are the
    last that aren't empty in the chain, and comparisons last from the turn that compares to the first that breaks them."""
    log = Ordered(turns, ["conv_id"], ["turn"]).total(F.when(F.col("short"), 0).otherwise(1), "chain")
    for name in ("entities", "topic"):
        log = log.last(F.when(F.size(name) > 0, F.struct(F.col("chain").alias("chain"), F.col(name).alias("value"))), f"last_{name}")
    none = F.array().cast("array<string>")

    def stands_for(name: str) -> Column:
        same = F.col(f"last_{name}")["chain"] == F.col("chain")
        return F.when(F.size(name) > 0, F.col(name)).when(F.col("short") & same, F.col(f"last_{name}")["value"]).otherwise(none)

    log.rows = log.rows.withColumns({"all_entities": stands_for("entities"), "all_topic": stands_for("topic")})
    log = log.last(F.struct("chain", "all_entities", "all_topic"), "before")
    linked = F.col("short") & F.col("before").isNotNull()
    goes_on = linked & ((F.size("entities") == 0) & (F.size(F.col("before")["all_entities"]) > 0) | (F.size(F.col("before")["all_entities"]) >= 2))
    # 1 begins a comparison, 0 breaks one, null lets it go on
    log = log.last(F.when(F.col("compares"), 1).when(~goes_on, 0), "mark")
    comparing = F.col("compares") | (goes_on & (F.coalesce("mark", F.lit(0)) == 1))
    measuring = linked & (F.size(F.col("before")["all_topic"]) > 0) & ~F.col("status")
    mode = F.when(comparing, "comparison").when(measuring, "measures")
    inherited = lambda name: ((F.size(name) == 0) & (F.size(f"all_{name}") > 0)).cast("int")
    origin = inherited("entities") + inherited("topic") + (mode.isNotNull() & ~F.col("compares")).cast("int")
    return log.done().select("conv_id", "turn", F.col("all_entities").alias("entities"), F.col("all_topic").alias("topic"), mode.alias("mode"), origin.alias("inherited"))
