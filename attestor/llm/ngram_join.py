"""Jaccard similarity join on word n-grams with prefix trees: all links on full sets, given as groups of documents.

1. Every whole text becomes its set of n-gram hashes; equal sets are one class, known by the 128-bit digest of the set.
2. Window: with a least similarity of t percent, two sets of n-grams in one global order (by hash) that are similar share
   at least l of their first n - ceil(t n / 100) + l n-grams, where l is a fifth of the smaller set. So only these
   are compared at first. They are sent packed to buckets of hashes, where it is counted how many classes hold each one
   in their windows.
3. Prefix: a class whose window has fewer than l n-grams that another window has is alone. In the windows of the rest the same
   holds again with the order (number of classes, hash): similar classes share one of the first w - l + 1 of w. A passage
   that many documents share comes last in this order and brings together only texts that consist of such passages.
4. Cells: the classes of a prefix n-gram meet at the smallest of them, sets of far different sizes apart from each other.
   Equal pairs of (cell, class) from other n-grams fall together, so a family of copies is one cell or a few, not one
   for each n-gram. A cell is dealt in blocks, each with its smallest class.
5. Trie: a block stores its sets, n-grams ordered by how many sets of the block have them, as paths of a compact trie. A chunk of
   sets walks down the trie at once and shares the overlap of all paths below a node. A subtree is left when the
   overlap so far and what can still come, in the set or on the longest path below, is less than the smallest set below
   asks for, and when everything below is joined with the walking set already.
6. Classes of a cell of several blocks that are still apart from the cell's smallest class are stored in tries again,
   and all classes of the cell walk past them.
7. Components of all links are taken by labels that are passed along them.

Nothing is approximate but the 64-bit hashes of n-grams; no pair that both windows could hide is lost.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a text with fewer words than
an n-gram is one n-gram; repeated rows belong to one class; rows of one id with different texts are one document, which
is linked through each of its texts; rows with a null id are linked with nothing and have a null component; texts of any
length are read whole; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm import shingles
from attestor.llm.common import drop_dir, map_arrow, materialize, record_batch, shared_dir
from attestor.llm.near_dup import components, labelled

#: l, in percent of a set.
SHARED = 20
#: Window entries that one bucket should hold, sets and n-grams of a block, and sets that walk past a trie in one task.
BUCKET_ENTRIES, BLOCK_SETS, BLOCK_NGRAMS, WALKERS = 2_000_000, 512, 1_500_000, 2048
#: Cells of the table of walking sets x n-grams that are held at once.
WALK_CELLS = 4_000_000


def fewest(n, threshold: int):
    """The least overlap of a set of n with any similar set; whole numbers or arrays."""
    return (threshold * n + 99) // 100


def asked(n):
    """l for a smaller set of n."""
    return np.maximum(1, n * SHARED // 100)


def window(n, threshold: int):
    return n - fewest(n, threshold) + asked(n)


def signatures(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, digest of the set and its window (sorted hashes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, windows = [], [], []
            for text in batch.column(1):
                found = shingles.shingle_set(text.as_py(), size)
                sizes.append(len(found))
                digests.append(shingles.digest(found))
                windows.append(found[: window(len(found), threshold)].tobytes() if len(found) else b"")
            yield record_batch(doc_id=batch.column(0), text_hash=batch.column(2), n_shingles=pa.array(sizes, pa.int64()), digest=pa.array(digests, pa.binary()), window=pa.array(windows, pa.binary()))

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text")), run, "doc_id long, text_hash long, n_shingles long, digest binary, window binary")


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several spans, one after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def packed_windows(signed: DataFrame, buckets: int) -> DataFrame:
    """bucket, hashes, how many classes hold each, which ones of ids (two bytes each), ids (digests), sizes: one row for each bucket and Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, windows, known = [], [], [], set()
            for digest, n, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest not in known:  # copies in one batch
                    known.add(digest)
                    ids.append(digest)
                    sizes.append(n)
                    windows.append(np.frombuffer(held, np.uint64))
            if not ids:
                continue
            hashes, owners = np.concatenate(windows), np.repeat(np.arange(len(ids), dtype=np.uint16), [len(w) for w in windows])
            order = np.argsort(hashes, kind="stable")
            hashes, owners = hashes[order], owners[order]
            of = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with the hash
            at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            names, numbers = np.array(ids, object), np.array(sizes, np.int32)
            rows = []
            for begin, end in zip(at.tolist(), [*at[1:].tolist(), len(of)], strict=True):
                first = begin + np.flatnonzero(np.concatenate(([True], hashes[begin + 1 : end] != hashes[begin : end - 1])))
                present, local = np.unique(owners[begin:end], return_inverse=True)
                counts = np.diff(np.append(first, end)).astype(np.uint16)
                rows.append((int(of[begin]), hashes[first].tobytes(), counts.tobytes(), local.astype(np.uint16).tobytes(), b"".join(names[present]), numbers[present].tobytes()))
            columns = list(zip(*rows, strict=True))
            yield record_batch(bucket=pa.array(columns[0], pa.int32()), **{name: pa.array(c, pa.binary()) for name, c in zip(("hashes", "counts", "owners", "ids", "sizes"), columns[1:], strict=True)})

    return map_arrow(signed.select("digest", "n_shingles", "window"), run, "bucket int, hashes binary, counts binary, owners binary, ids binary, sizes binary")


def shared_entries(packed: DataFrame, partitions: int) -> DataFrame:
    """digest, n, ngram, classes for the window entries that more than one class has. A bucket is held whole in a task, ten bytes an entry."""
    dealt = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")

    def entries(rows: list[tuple]) -> pa.RecordBatch | None:
        hashes = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
        counts = np.concatenate([np.frombuffer(r[2], np.uint16) for r in rows]).astype(np.int64)
        known, of = np.unique(hashes, return_inverse=True)
        often = np.bincount(of, counts)[of] > 1  # entries of copies in several batches count as several until they are told apart below
        if not often.any():
            return None
        names: dict[bytes, int] = {}
        sizes, owners = [], []
        for r in rows:
            ids, own = r[4], np.frombuffer(r[5], np.int32)
            place = np.empty(len(own), np.int64)
            for k in range(len(own)):
                name = ids[16 * k : 16 * k + 16]
                place[k] = names.setdefault(name, len(names))
                if place[k] == len(sizes):
                    sizes.append(int(own[k]))
            owners.append(place[np.frombuffer(r[3], np.uint16)])
        begins = np.cumsum(counts) - counts
        owner = np.concatenate(owners)[_spans(begins[often], counts[often])]
        held = np.unique(np.repeat(of[often], counts[often]) * len(names) + owner)
        ngram, owner = held // len(names), held % len(names)
        classes = np.bincount(ngram, minlength=len(known))[ngram]
        keep = classes > 1
        if not keep.any():
            return None
        ngram, owner, classes = ngram[keep], owner[keep], classes[keep]
        digests = pa.array(list(names), pa.binary()).take(pa.array(owner))
        return record_batch(digest=digests, n=pa.array(np.array(sizes, np.int64)[owner]), ngram=pa.array(known[ngram].view(np.int64)), classes=pa.array(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now and rows:
                    if (found := entries(rows)) is not None:
                        yield found
                    rows = []
                now = row[0]
                rows.append(row)
        if rows and (found := entries(rows)) is not None:
            yield found

    return map_arrow(dealt, run, "digest binary, n long, ngram long, classes long")


def prefixes(entries: DataFrame, threshold: int) -> DataFrame:
    """digest, n, ngram: the n-grams by which a class meets others."""
    smaller = F.floor((threshold * F.col("n") + 99) / 100)
    least = F.greatest(F.lit(1), F.floor(smaller * SHARED / 100)).cast("int")
    held = entries.groupBy("digest", "n").agg(F.collect_list(F.struct("classes", "ngram")).alias("entries")).where(F.size("entries") >= least)
    first = F.slice(F.array_sort("entries"), F.lit(1), F.size("entries") - least + 1)
    return held.select("digest", "n", F.explode(first.getField("ngram")).alias("ngram"))


def cells(found: DataFrame, threshold: int) -> DataFrame:
    """Pairs (centre, member), each once, and the member's size n; a centre is a member of its cell."""
    grade = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / threshold) * (1 + 1e-9)))
    keyed = found.select("digest", "n", F.explode(F.array(F.xxhash64("ngram", grade), F.xxhash64("ngram", grade + 1))).alias("key"))
    centres = keyed.groupBy("key").agg(F.min("digest").alias("centre"), F.max("digest").alias("last")).where("centre <> last").select("key", "centre")
    return keyed.join(centres, "key").select("centre", F.col("digest").alias("member"), "n").distinct()


class Trie:
    """Sets of n-grams as paths of a compact trie. Nodes are intervals of the sets in order of their paths."""

    def __init__(self, sets: list[np.ndarray], threshold: int, fewest_sets: int = 1):
        """fewest_sets: n-grams of fewer sets are left out of the paths, but counted in sizes. 2 where only the sets themselves walk."""
        self.threshold, self.n = threshold, np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        known, of, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count >= fewest_sets)
        ordered = shared[np.argsort(-count[shared], kind="stable")]
        rank = np.full(len(known), -1, np.int64)
        rank[ordered] = np.arange(len(ordered))
        self.width = len(ordered)
        self.ngrams, self.ranks = known[shared], rank[shared]
        owner = np.repeat(np.arange(len(sets)), self.n)
        inside = rank[of] >= 0
        owner, of = owner[inside], rank[of][inside]
        order = np.lexsort((of, owner))
        self.own = np.split(of[order], np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])
        paths = [p.astype(">u4").tobytes() for p in self.own]
        self.order = sorted(range(len(sets)), key=paths.__getitem__)
        self._build([self.own[k] for k in self.order])

    def _build(self, paths: list[np.ndarray]) -> None:
        common = np.zeros(len(paths) + 1, np.int64)
        for k in range(1, len(paths)):
            a, b = paths[k - 1], paths[k]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            common[k] = int(differ.argmax()) if differ.any() else m
        low, high, top, depth, child, children = [0], [len(paths)], [0], [0], [0], [0]
        node = 0
        while node < len(low):  # children are added behind one another
            lo, hi = low[node], high[node]
            if hi - lo == 1:
                depth[node] = len(paths[lo])
            else:
                inner = common[lo + 1 : hi]
                depth[node] = int(inner.min())
                cuts = [lo, *(lo + 1 + np.flatnonzero(inner == depth[node])).tolist(), hi]
                child[node], children[node] = len(low), len(cuts) - 1
                for begin, end in zip(cuts, cuts[1:], strict=False):
                    low.append(begin)
                    high.append(end)
                    top.append(depth[node])
                    depth.append(0)
                    child.append(0)
                    children.append(0)
            node += 1
        self.low, self.high, self.child, self.children = (np.array(x, np.int64) for x in (low, high, child, children))
        top, depth = np.array(top, np.int64), np.array(depth, np.int64)
        self.edge = depth - top
        self.edge_at = np.cumsum(self.edge) - self.edge
        self.edges = np.concatenate([paths[lo][a:b] for lo, a, b in zip(low, top.tolist(), depth.tolist(), strict=True)])
        last = [int(paths[lo][b - 1]) if b else -1 for lo, b in zip(low, depth.tolist(), strict=True)]
        self.passed = np.array(last, np.int64) + 1  # ranks below this have been passed at the node's end
        lengths, sizes = np.array([len(p) for p in paths], np.int64), self.n[self.order]
        self.longest, self.small, self.large = lengths[self.low], sizes[self.low], sizes[self.low]
        for node in range(len(low) - 1, -1, -1):
            if children[node]:
                below = slice(child[node], child[node] + children[node])
                self.longest[node], self.small[node], self.large[node] = self.longest[below].max(), self.small[below].min(), self.large[below].max()
        self.longest -= depth  # n-grams that can follow the node

    def ranked(self, found: np.ndarray) -> np.ndarray:
        """The ranks of a set's n-grams that the trie knows."""
        if not self.width:
            return np.empty(0, np.int64)
        at = np.searchsorted(self.ngrams, found)
        at[at == len(self.ngrams)] = 0
        return self.ranks[at[self.ngrams[at] == found]]

    def similar(self, walkers: list[np.ndarray], n: np.ndarray, labels: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(walker, set) pairs that are similar, of those whose labels differ. walkers: ranks; labels of the sets and, as joined, of the walkers."""
        t = self.threshold
        held = np.zeros((len(walkers), self.width), bool)
        for k, ranks in enumerate(walkers):
            held[k, ranks] = True
        seen = np.zeros((len(walkers), self.width + 1), np.int32)
        np.cumsum(held, axis=1, out=seen[:, 1:])
        own = labels[self.order]
        changes = np.concatenate(([0], np.cumsum(own[1:] != own[:-1])))
        uniform = np.where(changes[self.high - 1] == changes[self.low], own[self.low], -1)
        who, at, overlap = np.arange(len(walkers)), np.zeros(len(walkers), np.int64), np.zeros(len(walkers), np.int64)
        out_who, out_at = [], []
        while len(who):
            open_ = (uniform[at] != joined[who]) & (100 * self.large[at] >= t * n[who]) & (t * self.small[at] <= 100 * n[who])
            who, at, overlap = who[open_], at[open_], overlap[open_]
            lengths = self.edge[at]
            hits = np.concatenate(([0], np.cumsum(held[np.repeat(who, lengths), self.edges[_spans(self.edge_at[at], lengths)]])))
            ends = np.cumsum(lengths)
            overlap = overlap + hits[ends] - hits[ends - lengths]
            still = np.minimum(seen[who, -1] - seen[who, self.passed[at]], self.longest[at])
            open_ = (100 + t) * (overlap + still) >= t * (n[who] + self.small[at])
            who, at, overlap = who[open_], at[open_], overlap[open_]
            leaf = self.children[at] == 0
            out_who.append(who[leaf])
            out_at.append(self.low[at[leaf]])
            who, at, overlap = who[~leaf], at[~leaf], overlap[~leaf]
            more = self.children[at]
            who, overlap, at = np.repeat(who, more), np.repeat(overlap, more), _spans(self.child[at], more)
        order = np.array(self.order, np.int64)
        return np.concatenate(out_who or [np.empty(0, np.int64)]), order[np.concatenate(out_at or [np.empty(0, np.int64)])]


class Groups:
    """Which of the sets are joined: numbers with a smallest one for each group."""

    def __init__(self, labels: list):
        known: dict = {}
        self.root = [known.setdefault(x, k) for k, x in enumerate(labels)]

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = k = self.root[self.root[k]]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)
        return a != b

    def all(self) -> np.ndarray:
        return np.array([self.find(k) for k in range(len(self.root))], np.int64)


def links(trie: Trie, walkers: list[np.ndarray], n: np.ndarray, groups: Groups, first: int) -> Iterator[tuple[int, int]]:
    """(walker, set) links that join something new. In groups the trie's sets come first, the walkers from `first` on. Chunks of
    walkers grow: the first ones join most of a family, and the others then find it joined."""
    at, chunk, most = 0, 1, max(1, WALK_CELLS // max(1, trie.width))
    labels = groups.all()
    while at < len(walkers):
        end = min(len(walkers), at + min(chunk, most))
        found = trie.similar(walkers[at:end], n[at:end], labels[: len(trie.n)], labels[first + at : first + end])
        new = False
        for who, of in zip(*(x.tolist() for x in found), strict=True):
            if groups.join(first + at + who, of):
                new = True
                yield at + who, of
        if new:
            labels = groups.all()
        at, chunk = end, min(chunk * 4, 256)


def _out(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return record_batch(a=pa.array(a, pa.binary()), b=pa.array(b, pa.binary()))


def _blocks(sets: str, ngrams: str) -> Column:
    return F.greatest(F.ceil(F.col(sets) / BLOCK_SETS), F.ceil(F.col(ngrams) / BLOCK_NGRAMS)).cast("long")


def _dealt(n: str) -> Column:
    return F.pmod(F.xxhash64("member"), F.col(n))


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def block_links(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Links (a, b) within the blocks of each cell."""
    counts = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("ngrams")).select("centre", _blocks("sets", "ngrams").alias("blocks"))
    rows = pairs.join(counts, "centre")
    spread = rows.where("centre <> member").select("centre", _dealt("blocks").alias("block"), "member")
    middle = rows.where("centre = member").select("centre", _each("blocks").alias("block"), "member")
    dealt = spread.unionByName(middle).join(texts, "member").select("centre", "block", "member", "text").repartition("centre", "block").sortWithinPartitions("centre", "block")

    def joined(members: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        if len(members) < 2:
            return []
        trie, groups = Trie(sets, threshold, 2), Groups(list(range(len(sets))))
        return [(members[a], members[b]) for a, b in links(trie, trie.own, trie.n, groups, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, sets = None, [], []
        for batch in batches:
            found = []
            for centre, block, member, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if (centre, block) != now:
                    found.extend(joined(members, sets))
                    now, members, sets = (centre, block), [], []
                members.append(member)
                sets.append(shingles.shingle_set(text.as_py(), size))
            if found:
                yield _out(found)
        if found := joined(members, sets):
            yield _out(found)

    return map_arrow(dealt, run, "a binary, b binary")


def cross_links(pairs: DataFrame, so_far: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Links (a, b) of members of a cell of several blocks that are apart from its centre. so_far: node, component."""
    counts = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("ngrams")).where(_blocks("sets", "ngrams") > 1).select("centre")
    placed = labelled(labelled(pairs.join(counts, "centre", "left_semi"), so_far, "centre", "of_centre"), so_far, "member", "of_member")
    placed = placed.withColumn("apart", F.col("of_centre") != F.col("of_member"))
    alone = F.when(F.col("apart"), F.col("n"))
    groups = placed.groupBy("centre").agg(F.count(alone).alias("sets"), F.sum(alone).alias("ngrams"), F.ceil(F.count(F.lit(1)) / WALKERS).alias("slices")).where("sets > 0")
    rows = placed.join(groups.select("centre", "slices", _blocks("sets", "ngrams").alias("blocks")), "centre")
    columns = ["centre", "block", "slice", "walks", "member", "of_member"]
    held = rows.where("apart").withColumn("block", _dealt("blocks")).withColumn("slice", _each("slices")).withColumn("walks", F.lit(False))
    walking = rows.withColumn("slice", _dealt("slices")).withColumn("block", _each("blocks")).withColumn("walks", F.lit(True))
    both = held.select(columns).unionByName(walking.select(columns)).join(texts, "member")
    dealt = both.select(*columns, "text").repartition("centre", "block", "slice").sortWithinPartitions("centre", "block", "slice", "walks")

    def joined(stored: list[tuple], walking: list[tuple], trie: Trie | None, names: dict[bytes, bytes]) -> list[tuple[bytes, bytes]]:
        """names: labels that links have joined so far, each with another one of its group."""
        if not walking or trie is None:
            return []

        def name(label: bytes) -> bytes:
            while label in names:
                label = names[label]
            return label

        groups = Groups([name(x[1]) for x in stored] + [name(x[1]) for x in walking])
        walkers, n = [trie.ranked(x[2]) for x in walking], np.array([len(x[2]) for x in walking], np.int64)
        found = list(links(trie, walkers, n, groups, len(stored)))
        for a, b in found:
            one, other = name(walking[a][1]), name(stored[b][1])
            if one != other:
                names[max(one, other)] = min(one, other)
        return [(walking[a][0], stored[b][0]) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored, walking, trie, names, held = None, [], [], None, {}, 0
        for batch in batches:
            found = []
            for centre, block, part, walks, member, label, text in zip(*(batch.column(k).to_pylist() for k in range(6)), batch.column(6), strict=True):
                if (centre, block, part) != now:
                    found.extend(joined(stored, walking, trie, names))
                    now, stored, walking, trie, names, held = (centre, block, part), [], [], None, {}, 0
                row = (member, label, shingles.shingle_set(text.as_py(), size))
                if not walks:
                    stored.append(row)
                    continue
                if trie is None and stored:
                    trie = Trie([x[2] for x in stored], threshold)
                walking.append(row)
                held += len(row[2])
                if len(walking) >= 256 or held >= BLOCK_NGRAMS:
                    found.extend(joined(stored, walking, trie, names))
                    walking, held = [], 0
            if found:
                yield _out(found)
        if found := joined(stored, walking, trie, names):
            yield _out(found)

    return map_arrow(dealt, run, "a binary, b binary")


def ngram_join(docs: DataFrame, size: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs. threshold: the least similarity in percent."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(signatures(docs, size, threshold), folder, "signatures")
    linkable = signed.where("doc_id is not null and n_shingles > 0")
    total = linkable.agg(F.sum(F.octet_length("window") / 8)).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_ENTRIES))
    entries = shared_entries(packed_windows(linkable, 4 * partitions), partitions)
    pairs = materialize(cells(materialize(prefixes(entries, threshold), folder, "prefixes"), threshold), folder, "pairs")
    # the first row of each class stands for it: its smallest id and, should that id have several texts, one of them
    classes = materialize(linkable.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("digest", F.col("first.doc_id").alias("first"), F.col("first.text_hash").alias("text_hash")), folder, "classes")
    wanted = pairs.select(F.col("member").alias("digest")).distinct()
    # the ids grow with the corpus, so the joins are ones that need neither side to be small
    chosen = classes.join(wanted.hint("merge"), "digest", "left_semi").select(F.col("first").alias("doc_id"), "text_hash", F.col("digest").alias("member"))
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(chosen.hint("merge"), ["doc_id", "text_hash"]).select("member", "text").dropDuplicates(["member"])
    texts = materialize(texts, folder, "texts")
    near = materialize(block_links(pairs, texts, size, threshold), folder, "links")
    so_far = components(near, f"{folder}/near")
    far = materialize(cross_links(pairs, so_far, texts, size, threshold), folder, "far")
    # from classes to documents; an id with several texts joins their classes
    ids = classes.select("digest", "first")
    named = near.unionByName(far).join(ids.select(F.col("digest").alias("a"), F.col("first").alias("x")), "a").join(ids.select(F.col("digest").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    several = linkable.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    own = linkable.join(several.hint("merge"), "doc_id", "left_semi").join(ids, "digest").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    joined = components(named.unionByName(own).where("a <> b"), folder)
    for name in ("prefixes", "pairs", "texts", "links", "far", "near"):  # what follows reads signatures, classes and labels only
        drop_dir(spark, f"{folder}/{name}")
    grouped = labelled(ids, joined, "first", "group").select("digest", "group")
    return (
        signed.select("doc_id", "n_shingles", "digest")
        .join(grouped, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("group")).otherwise(F.col("doc_id"))).alias("component_id"))
    )
