"""Ordered logs whose keys may hold any share of the rows.

A window over a key sorts all its rows in one task. Here rows are dealt by ranges of (key, order), so a hot key is cut into
chunks that many tasks share; windows run inside a chunk, and what must pass a border (the last value, a running sum) is
taken from one summary row for each chunk. Only the first key of a range can go on from the range before, so what is
carried has at most one row for each range, whatever the keys: its size is that of the number of partitions, and it is
broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.session import written


class Ordered:
    """rows in the order of `order` (columns; ties must not matter) within each key."""

    def __init__(self, rows: DataFrame, key: list[str], order: list[str]):
        self.key, self.order = key, order
        ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = written(rows.repartitionByRange(ranges, *key, *order).withColumn("__part", F.spark_partition_id()))

    def _chunk(self, start: int, end: int, backwards: bool = False) -> Column:
        return Window.partitionBy(*self.key, "__part").orderBy(*(F.desc(c) if backwards else F.asc(c) for c in self.order)).rowsBetween(start, end)

    def _carried(self, rows: DataFrame, summary: Column, carry: Column, backwards: bool = False) -> DataFrame:
        """rows with __carry: `carry` over the summaries of the chunks of a key that come before (after, if backwards)."""
        chunks = rows.groupBy(*self.key, "__part").agg(summary.alias("__summary"))
        # keys are told apart by their neighbours: a key that one chunk holds whole needs nothing
        spans = Window.partitionBy(*self.key)
        chunks = chunks.withColumn("__chunks", F.count(F.lit(1)).over(spans)).where("__chunks > 1")
        past = spans.orderBy(F.desc("__part") if backwards else F.asc("__part")).rowsBetween(Window.unboundedPreceding, -1)
        carried = chunks.select(*(F.col(c).alias(f"__{c}") for c in self.key), F.col("__part").alias("__of"), carry.over(past).alias("__carry"))
        same = F.col("__part") == F.col("__of")
        for c in self.key:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return rows.join(F.broadcast(carried), same, "left").drop("__of", *(f"__{c}" for c in self.key))

    def last(self, value: Column, name: str) -> Ordered:
        """Adds the last value that isn't null before each row."""
        rows = self.rows.withColumn("__value", value).withColumn("__local", F.last("__value", ignorenulls=True).over(self._chunk(Window.unboundedPreceding, -1)))
        at = F.when(F.col("__value").isNotNull(), F.struct(*self.order))
        return self._with(self._carried(rows, F.max_by("__value", at), F.last("__summary", ignorenulls=True)), name, F.coalesce("__local", "__carry"))

    def following(self, value: Column, name: str) -> Ordered:
        """Adds the first value that isn't null behind each row."""
        rows = self.rows.withColumn("__value", value).withColumn("__local", F.last("__value", ignorenulls=True).over(self._chunk(Window.unboundedPreceding, -1, True)))
        at = F.when(F.col("__value").isNotNull(), F.struct(*self.order))
        return self._with(self._carried(rows, F.min_by("__value", at), F.last("__summary", ignorenulls=True), True), name, F.coalesce("__local", "__carry"))

    def total(self, value: Column, name: str) -> Ordered:
        """Adds the sum of a whole number over all rows up to and with each row."""
        rows = self.rows.withColumn("__value", value.cast("long")).withColumn("__local", F.sum("__value").over(self._chunk(Window.unboundedPreceding, 0)))
        zero = F.lit(0).cast("long")
        return self._with(self._carried(rows, F.sum("__value"), F.sum("__summary")), name, F.coalesce("__local", zero) + F.coalesce("__carry", zero))

    def _with(self, rows: DataFrame, name: str, value: Column) -> Ordered:
        out = Ordered.__new__(Ordered)
        out.key, out.order, out.rows = self.key, self.order, rows.withColumn(name, value).drop("__value", "__local", "__carry")
        return out

    def done(self) -> DataFrame:
        return self.rows.drop("__part")


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles (the smallest value that at least a share of the group's values doesn't exceed; nulls count for
    nothing), one column for each of `shares`, and `most`. Rows are dealt by ranges of (group, value); counts for each chunk
    tell which chunk holds a rank, and only rows are numbered within chunks."""
    dealt = Ordered(rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n")), [group], [value])
    ranked = dealt.total(F.col("n"), "upto").done()
    sizes = ranked.groupBy(group).agg(F.sum("n").alias("all"), F.max(value).alias("most"))
    marks = sizes.select(F.col(group).alias("__g"), "most", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("all"))).alias("rank")) for name, p in shares.items()))).alias("m"))
    # a rank lies in the one distinct value whose counts reach it
    found = ranked.join(marks, F.col(group).eqNullSafe(F.col("__g")) & (F.col("upto") >= F.col("m.rank")) & (F.col("upto") - F.col("n") < F.col("m.rank")))
    picked = [F.max(F.when(F.col("m.name") == name, F.col(value))).alias(name) for name in shares]
    return found.groupBy(group).agg(*picked, F.max("most").alias("most"))


def releases(log: DataFrame, key: str, at: str, hours: int = 48) -> DataFrame:
    """(key, releases, last_release, held): changes are held until `hours` after the last release and go out together
    with the first change from then on. held: changes after the last release.

    Each distinct hour points to the first one at least `hours` later; a key's releases are the chain from its first
    hour. Its length and end come from pointer doubling: in each round every hour takes over the pointer and the length of
    the hour it points to, so chains of any length take the logarithm of it in joins on (key, hour), written round by round."""
    points = written(log.where(F.col(at).isNotNull()).groupBy(F.col(key).alias("key"), F.date_trunc("hour", at).alias("hour")).agg(F.count(F.lit(1)).alias("n")))
    none = F.lit(None).cast("timestamp")
    asks = points.select("key", (F.col("hour") + F.expr(f"interval {hours} hours")).alias("t"), F.lit(0).alias("is_point"), F.col("hour").alias("of"), none.alias("point"))
    there = points.select("key", F.col("hour").alias("t"), F.lit(1).alias("is_point"), none.alias("of"), F.col("hour").alias("point"))
    both = Ordered(asks.unionByName(there), ["key"], ["t", "is_point"]).following(F.col("point"), "next").done()
    one = F.lit(1).cast("long")
    chain = written(both.where("is_point = 0").select("key", F.col("of").alias("hour"), F.coalesce("next", "of").alias("to"), F.when(F.col("next").isNull(), one - 1).otherwise(one).alias("steps")))
    while True:
        ahead = chain.select(F.col("key").alias("k"), F.col("hour").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
        joined = chain.join(ahead, F.col("key").eqNullSafe(F.col("k")) & (chain["to"] == ahead["to"]))
        chain = written(joined.select("key", "hour", F.col("further").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")))
        if chain.where("moved").isEmpty():
            break
        chain = chain.drop("moved")
    first = points.groupBy("key").agg(F.min("hour").alias("first"))
    ends = first.select(F.col("key").alias("k"), "first").join(chain, F.col("key").eqNullSafe(F.col("k")) & (F.col("hour") == F.col("first")))
    ends = ends.select("k", F.col("to").alias("last_release"), (F.col("steps") + 1).cast("int").alias("releases"))
    held = points.join(ends, F.col("key").eqNullSafe(F.col("k"))).groupBy("key", "releases", "last_release").agg(F.sum(F.when(F.col("hour") > F.col("last_release"), F.col("n")).otherwise(0)).alias("held"))
    return held.select(F.col("key").alias(key), "releases", "last_release", "held")
