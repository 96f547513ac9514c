"""Near-duplicate groups by min-max hashing of word shingles, confirmed on full sets.

1. Every whole text becomes its set of shingles; equal sets are one class, known by the 128-bit digest of the set.
2. Min-max signature: each permutation gives two values, the minimum and the maximum of the set under it, so the
   hashing is half of what as many minima would take. The values are banded, and classes with an equal band meet in
   a bucket. Buckets with more than one class are cut by size, since sets of very unequal size can't be similar: class
   c and class c + 1 of sizes share a bucket.
3. Each bucket has its smallest member as its centre. Every member is compared with the centre on full sets: this
   gives its difference to the centre (the shingles that only one of the two has) and confirms or rejects the link.
4. Components of these links are taken. Members of a bucket that are in their centre's component, through whatever
   bucket, need nothing further. One that is still apart can be linked to another member. The difference of two members
   is the difference of their differences to the centre: |A ^ B| = |dA| + |dB| - 2 |dA & dB|, which is exact, and
   differences are small where sets are large. An inverted index of a block of members that are apart counts |dA & dB|
   for each member that streams past. Only a link that joins something new is written, never the pairs of a bucket.
5. Components of all links are taken by labels that are passed along them.

Two linked classes fail to meet only if no band agrees: (1 - j^rows)^bands for similarity j, with the settings here
below 1e-5 at 0.85 and below 3e-4 at 0.8, and that for each of the links that hold a group together.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a text with fewer words than
a shingle is one shingle; repeated rows belong to one class; rows of one id with different texts are one document, which
is linked through each of its texts; rows with a null id are linked with nothing and kept, with a null component; texts
of any length are read whole; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import shingles
from attestor.llm.common import drop_dir, map_arrow, materialize, record_batch, shared_dir

#: Values in a band and bands; two values come from each permutation.
ROWS, BANDS = 4, 18
SEED = 20240607
#: Unlinked members whose differences one task indexes, members that stream past them in one task, and members compared
#: with one copy of a centre. So no group, however large, meets in one task.
INDEX_BLOCK, PASSING_BLOCK, CENTRE_BLOCK = 512, 512, 256


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, digest of the set and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers, masks = shingles.permutations(ROWS * BANDS // 2, SEED)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles.shingle_set(text, size)
                sizes.append(len(found))
                digests.append(shingles.digest(found))
                keys.append(shingles.bands(shingles.min_max(found, multipliers, masks), ROWS).view(np.int64))
            ends = np.arange(len(keys) + 1, dtype=np.int32) * BANDS
            yield record_batch(doc_id=batch.column(0), text_hash=batch.column(2), n_shingles=pa.array(sizes, pa.int64()), digest=pa.array(digests, pa.binary()), bands=pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))))

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text")), run, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>")


def buckets(classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (centre, member), each once, for all buckets with more than one class of a like size."""
    keyed = classes.select("digest", "n_shingles", F.explode("bands").alias("band"))
    full = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band")
    grade = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(math.log(1 / threshold)))
    cut = keyed.join(full, "band", "left_semi").select("digest", F.explode(F.array(F.xxhash64("band", grade), F.xxhash64("band", grade + 1))).alias("bucket"))
    centres = cut.groupBy("bucket").agg(F.min("digest").alias("centre"), F.max("digest").alias("last")).where("centre <> last").select("bucket", "centre")
    return cut.join(centres, "bucket").where("digest <> centre").select("centre", F.col("digest").alias("member")).distinct()


def _needed(d_a, d_b, n_a, n_b, threshold: int):
    """The least |dA & dB| at which sets of sizes n_a, n_b are linked. threshold: percent; all whole numbers.
    100 common >= t union, with common = (n_a + n_b - difference) / 2 and union = (n_a + n_b + difference) / 2."""
    most = (100 - threshold) * (n_a + n_b) // (100 + threshold)  # the largest difference of linked sets
    return -((most - d_a - d_b) // 2)


def compare(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """texts: member, text. For each (centre, member): sizes, whether they are linked, and the member's difference to the centre where
    another member may need it. A centre's text is repeated for each CENTRE_BLOCK members."""
    counts = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("members"))
    salts = F.ceil(F.col("members") / CENTRE_BLOCK)
    members = pairs.join(counts, "centre").select("centre", "member", F.pmod(F.xxhash64("member"), salts).alias("salt"), F.lit(True).alias("is_member"), (F.col("members") > 1).alias("wanted"))
    centres = counts.select("centre", F.col("centre").alias("member"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(False).alias("is_member"), F.lit(False).alias("wanted"))
    dealt = members.unionByName(centres).join(texts, "member").select("centre", "salt", "is_member", "member", "wanted", "text").repartition("centre", "salt").sortWithinPartitions("centre", "salt", "is_member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.empty(0, np.uint64)
        for batch in batches:
            rows = []
            for centre, is_member, member, wanted, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
                own = shingles.shingle_set(text, size)
                if not is_member:
                    middle = own
                    continue
                common = shingles.common(own, middle)
                union = len(own) + len(middle) - common
                difference = np.setxor1d(own, middle, assume_unique=True).tobytes() if wanted else None
                rows.append((centre, member, len(own), union - common, 100 * common >= threshold * union, difference))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield record_batch(**{name: pa.array(c, kind) for name, c, kind in zip(("centre", "member", "n", "d", "linked", "difference"), columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)})

    return map_arrow(dealt, run, "centre binary, member binary, n long, d long, linked boolean, difference binary")


class _Index:
    """An inverted index over the differences of a block of unlinked members, and what they are joined to so far."""

    def __init__(self, rows: list[tuple[bytes, int, int, bytes]]):
        self.ids = [r[0] for r in rows]
        self.place = {m: k for k, m in enumerate(self.ids)}
        self.n, self.d = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        parts = [np.frombuffer(r[3], np.uint64) for r in rows]
        tokens = np.concatenate(parts)
        places = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
        order = np.argsort(tokens, kind="stable")
        self.places, tokens = places[order], tokens[order]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
        self.tokens, self.starts, self.ends = tokens[starts], starts, np.append(starts[1:], len(tokens))
        self.root = list(range(len(rows) + 1))  # the last stands for the centre

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = k = self.root[self.root[k]]
        return k

    def common(self, difference: bytes) -> np.ndarray:
        wanted = np.frombuffer(difference, np.uint64)
        at = np.searchsorted(self.tokens, wanted)
        inside = at < len(self.tokens)
        at = at[inside][self.tokens[at[inside]] == wanted[inside]]
        lengths = self.ends[at] - self.starts[at]
        if not lengths.sum():
            return np.zeros(len(self.ids), np.int64)
        steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return np.bincount(self.places[np.repeat(self.starts[at], lengths) + steps], minlength=len(self.ids))

    def links(self, member: bytes, n: int, d: int, linked: bool, difference: bytes, threshold: int) -> Iterator[tuple[bytes, bytes]]:
        """The links of a passing member that join something new."""
        need = _needed(self.d, d, self.n, n, threshold)
        open_ = need <= np.minimum(self.d, d)
        if not open_.any():
            return
        found = np.flatnonzero(open_ & (self.common(difference) >= need))
        own = len(self.ids) if linked else self.place.get(member)
        last = None if own is None else self.find(own)
        for k in found.tolist():
            root = self.find(k)
            if self.ids[k] == member or root == last:
                continue
            if last is not None:
                self.root[root] = last
            else:
                last = root  # a member outside the block: it joins what it meets
            yield self.ids[k], member


def cross_links(compared: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between members of one centre of which at least one is apart from it. compared: as of compare, with
    apart."""
    groups = compared.groupBy("centre").agg(F.count_if("apart").alias("apart"), F.count(F.lit(1)).alias("members")).where("apart > 0 and members > 1")
    blocks = groups.select("centre", F.ceil(F.col("apart") / INDEX_BLOCK).alias("blocks"), F.ceil(F.col("members") / PASSING_BLOCK).alias("slices"))
    rows = compared.where(F.col("difference").isNotNull()).join(blocks, "centre")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt_to = lambda n: F.pmod(F.xxhash64("member"), F.col(n))
    held = rows.where("apart").withColumn("block", dealt_to("blocks")).withColumn("slice", each("slices")).withColumn("passing", F.lit(False))
    passing = rows.withColumn("slice", dealt_to("slices")).withColumn("block", each("blocks")).withColumn("passing", F.lit(True))
    columns = ["centre", "block", "slice", "passing", "member", "n", "d", "apart", "difference"]
    dealt = held.select(columns).unionByName(passing.select(columns)).repartition("centre", "block", "slice").sortWithinPartitions("centre", "block", "slice", "passing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, index = None, [], None
        for batch in batches:
            found = []
            for centre, block, part, is_passing, member, n, d, apart, difference in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (centre, block, part) != now:
                    now, rows, index = (centre, block, part), [], None
                if not is_passing:
                    rows.append((member, n, d, difference))
                    continue
                if not rows:
                    continue
                index = index or _Index(rows)
                found.extend(index.links(member, n, d, not apart, difference, threshold))
            if found:
                a, b = zip(*found, strict=True)
                yield record_batch(a=pa.array(a, pa.binary()), b=pa.array(b, pa.binary()))

    return map_arrow(dealt, run, "a binary, b binary")


def components(links: DataFrame, folder: str) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of links(a, b). Each round takes the smallest label
    among a node's neighbours and then the label of that label; it ends when nothing changes."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), folder, "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), folder, "labels0")
    for k in range(1, 200):
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("near"))
        far = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        after = materialize(nearer.join(far, "near").select("node", F.least("near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("changed")), folder, f"labels{k}")
        drop_dir(links.sparkSession, f"{folder}/labels{k - 1}")
        labels = after.select("node", "component")
        if after.where("changed").isEmpty():
            drop_dir(links.sparkSession, f"{folder}/edges")
            return labels
    raise RuntimeError("labels still change after 200 rounds")


def labelled(rows: DataFrame, labels: DataFrame, of: str, name: str) -> DataFrame:
    """rows with the component of the column `of`; what has no links is its own component."""
    found = labels.select(F.col("node").alias(of), F.col("component").alias("__component"))
    return rows.join(found, of, "left").withColumn(name, F.coalesce("__component", of)).drop("__component")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs. threshold: the least similarity in percent."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(signatures(docs, size), folder, "signatures")
    linkable = signed.where("doc_id is not null and n_shingles > 0")
    # the first row of each class stands for it: its smallest id and, should that id have several texts, one of them
    classes = materialize(linkable.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("digest", F.col("first.doc_id").alias("first"), F.col("first.text_hash").alias("text_hash")), folder, "classes")
    firsts = linkable.join(classes.select("digest", F.col("first").alias("doc_id"), "text_hash"), ["digest", "doc_id", "text_hash"], "left_semi").dropDuplicates(["digest"])
    pairs = materialize(buckets(firsts, threshold / 100), folder, "pairs")
    wanted = pairs.select(F.col("member").alias("digest")).unionByName(pairs.select(F.col("centre").alias("digest"))).distinct()
    # the ids grow with the corpus, so the joins are ones that need neither side to be small
    chosen = classes.join(wanted.hint("merge"), "digest", "left_semi").select(F.col("first").alias("doc_id"), "text_hash", F.col("digest").alias("member"))
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(chosen.hint("merge"), ["doc_id", "text_hash"]).select("member", "text").dropDuplicates(["member"])
    compared = materialize(compare(pairs, materialize(texts, folder, "texts"), size, threshold), folder, "compared")
    near = compared.where("linked").select(F.col("centre").alias("a"), F.col("member").alias("b"))
    so_far = components(near, f"{folder}/near")
    placed = labelled(labelled(compared, so_far, "centre", "of_centre"), so_far, "member", "of_member")
    far = cross_links(placed.withColumn("apart", F.col("of_centre") != F.col("of_member")), threshold)
    # from classes to documents; an id with several texts joins their classes
    ids = classes.select("digest", "first")
    named = near.unionByName(far).join(ids.select(F.col("digest").alias("a"), F.col("first").alias("x")), "a").join(ids.select(F.col("digest").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    several = linkable.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    own = linkable.join(several.hint("merge"), "doc_id", "left_semi").join(ids, "digest").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    joined = components(named.unionByName(own).where("a <> b"), folder)
    for name in ("pairs", "texts", "compared", "near"):  # what follows reads signatures, classes and labels only
        drop_dir(spark, f"{folder}/{name}")
    grouped = labelled(ids, joined, "first", "group").select("digest", "group")
    return (
        signed.select("doc_id", "n_shingles", "digest")
        .join(grouped, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("group")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
