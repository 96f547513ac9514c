"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. Two lexicons: INSULTS, a fixed list of common insults of four languages, and one that is learned from a bounded
   sample of labelled rows. For the latter Spark counts, for each word and each word beginning, the toxic and the other
   documents that hold it, and the LEXICON terms with the largest log odds are kept. A row's own label must not shape
   its features, so the sample is dealt into FOLDS parts, and the features of a part's rows come from a lexicon that is
   learned from the other parts; what is scored later meets the lexicon of the whole sample.
2. Every whole text becomes a row of dense features: densities of lexicon terms, their nearness to second-person words,
   shares of capitals, punctuation, digits and symbols, and the rate of obfuscated words (letters mixed with digits or
   symbols, and words that match the lexicon only once such signs are read as letters).
3. Trees of a fixed depth are boosted over feature histograms; pair-adjacent-violators isotonic regression over scores
   of rows that the trees haven't seen makes them probabilities.

Fitting reads at most SAMPLE_ROWS labelled documents; scoring is spread by Spark and reads whole texts.

Defined results: null and empty texts are scored like any other (all features are 0); without labelled rows of both
classes every score is the share of label 1 (0 without any); repeated rows get the same score; texts of any length are
read whole; a null id is in no fold; an empty table gives an empty result; other input columns are not read, whatever
their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import crc32_mod, map_arrow, record_batch
from attestor.llm.labelled import labelled_sample

SAMPLE_ROWS, LEXICON, LEAST_DOCS, LEAST_ODDS, FOLDS = 16000, 600, 3, 2.2, 3
#: Lengths of word beginnings; whole words count as terms of their own.
BEGINNINGS = range(3, 11)
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes".split()
#: Common insults of the four languages, as whole words (fixed values).
INSULTS = """
arsehole asshole bastard bitch clown coward creep crap cretin cunt dickhead dimwit disgusting douchebag dumb dumbass fool
freak fucking garbage hateful idiot idiotic idiots imbecile jackass jerk kys loser losers lunatic maggot moron moronic
morons nazi parasite pathetic pig prick psycho rat retard retarded rubbish scum scumbag shit shithead slut stupid subhuman
swine trash twat useless vermin vile wanker weirdo whore worthless
abruti andouille batard bâtard bouffon connard connasse crétin débile déchet enculé enfoiré idiote imbécile lamentable
merde minable nul ordure pathétique pourriture pute raclure salaud salope stupide vaurien
abschaum arschloch blödmann depp dummkopf dreckskerl hurensohn idiotin erbärmlich lächerlich missgeburt mistkerl müll
nutzlos penner schlampe schwachkopf schwein trottel vollidiot widerlich wertlos
basura bobo cabrón cerdo cobarde desgraciado escoria estúpida estúpido gilipollas imbécil inútil mierda payaso patético puta
puto subnormal tonto zorra
""".split()
#: Characters between a second-person word and a lexicon term that count as near.
NEAR = 60
FEATURES = ("insult_hits", "insult_density", "word_hits", "begin_hits", "word_density", "begin_density", "log_odds", "distinct_terms", "second_person", "proximity", "hidden_hits", "obfuscated", "capitals", "punctuation", "exclamations", "digits", "symbols", "log_words")

#: Signs that stand for letters in obfuscated words (fixed values).
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_ASCII_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_TO_SPACE = bytes(32 if (b < 128 and not chr(b).isalnum()) else b for b in range(256))
_READ_SIGNS = bytes(ord(SIGNS[chr(b)]) if chr(b) in SIGNS else 32 if (b < 128 and not chr(b).isalpha()) else b for b in range(256))
_OBFUSCATED = regex.compile(r"\p{L}[0-9@$!*]+\p{L}")


def plain(text: str, table: bytes = _TO_SPACE) -> str:
    """Lower-case text with a space for every ASCII sign and at both ends; one character for each UTF-8 byte."""
    return f" {text.lower().encode('utf-8', 'replace').translate(table).decode('latin-1')} "


def terms(text: str) -> set[str]:
    """The words of a text (" word ") and their beginnings (" begin")."""
    out = set()
    for word in set(plain(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in BEGINNINGS if k <= len(word))
    return out


def learned_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Lexicons (term -> log odds of toxic against other documents, at most LEXICON terms): of the whole sample, then of
    the sample without each part. sample: text, label, part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, label, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for term in terms(text):
                    counts.setdefault(term, [0] * (2 * FOLDS))[2 * part + label] += 1
        if counts:
            yield record_batch(term=pa.array([t.encode("latin-1") for t in counts], pa.binary()), **{f"n{k}": pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(2 * FOLDS)})

    sizes = [[0, 0] for _ in range(FOLDS)]
    for r in sample.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.part][r.label] = r.n
    names = [f"n{k}" for k in range(2 * FOLDS)]
    counted = map_arrow(sample.select("text", "label", "part"), run, "term binary, " + ", ".join(f"{n} long" for n in names)).groupBy("term").agg(*[F.sum(n).alias(n) for n in names])
    variants = []
    for without in (None, *range(FOLDS)):
        parts = [k for k in range(FOLDS) if k != without]
        toxic, other = (sum((F.col(f"n{2 * k + label}") for k in parts), F.lit(0)) for label in (1, 0))
        most = [sum(sizes[k][label] for k in parts) for label in (1, 0)]
        odds = F.log((toxic + 0.5) / (most[0] + 1)) - F.log((other + 0.5) / (most[1] + 1))
        if min(most):
            variants.append(F.struct(F.lit(0 if without is None else without + 1).alias("lexicon"), toxic.cast("double").alias("toxic"), odds.alias("odds")))
    out: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]
    if not variants:
        return out
    best = counted.select("term", F.explode(F.array(*variants)).alias("v")).select("term", "v.*").where((F.col("toxic") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
    order = Window.partitionBy("lexicon").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term")
    for r in best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEXICON).collect():
        out[r.lexicon][bytes(r.term).decode("latin-1")] = float(r.odds)
    return out


class Extractor:
    """Texts to rows of FEATURES."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.automaton = lexicon, None

    def _built(self) -> ahocorasick.Automaton:
        """Finds what a term is: a second-person word, an insult, its odds in the lexicon (a term may be all three)."""
        automaton = ahocorasick.Automaton()
        persons, insults = set(map(plain, SECOND_PERSON)), set(map(plain, INSULTS))
        for term in persons | insults | self.lexicon.keys():
            automaton.add_word(term, (term, term in persons, term in insults, self.lexicon.get(term)))
        automaton.make_automaton()
        return automaton

    def row(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        if self.automaton is None:
            self.automaton = self._built()
        flat, raw = plain(text), text.encode("utf-8", "replace")
        size = len(raw)
        words = max(1, len(flat.split()))
        hits, insults = {True: 0, False: 0}, 0
        persons, places, found, total = [], [], set(), 0.0
        for end, (term, person, insult, odds) in self.automaton.iter(flat):
            if person:
                persons.append(end)
            if insult:
                insults += 1
            if odds is not None:
                hits[term[-1] == " "] += 1
                total += odds
            if insult or odds is not None:
                places.append(end)
                found.add(term)
        near = 0.0
        if persons and places:
            p, q = np.array(persons), np.array(places)
            at = np.searchsorted(p, q)
            gap = np.minimum(np.abs(p[np.minimum(at, len(p) - 1)] - q), np.abs(q - p[np.maximum(at - 1, 0)]))
            near = float((gap <= NEAR).mean())
        obfuscated, hidden = len(_OBFUSCATED.findall(text)), 0
        if obfuscated:
            part = " ".join(w.strip("!") for w in text.split() if _OBFUSCATED.search(w))
            count = lambda flat: sum(insult or odds is not None for _, (_, _, insult, odds) in self.automaton.iter(flat))
            hidden = count(plain(part, _READ_SIGNS)) - count(plain(part))
        without = lambda signs: size - len(raw.translate(None, signs))
        return [
            math.log1p(insults), insults / words, math.log1p(hits[True]), math.log1p(hits[False]), hits[True] / words, hits[False] / words, total / words, math.log1p(len(found)),
            len(persons) / words, near, math.log1p(max(0, hidden)), obfuscated / words,
            without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, without(_ASCII_SIGNS) / size, without(b"!") / size, without(b"0123456789") / size, without(b"#*$%&|<>") / size, math.log1p(words),
        ]

    def rows(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.row(t) for t in texts], float).reshape(-1, len(FEATURES))

    def __getstate__(self):
        return {"lexicon": self.lexicon, "automaton": None}


class Forest:
    """Boosted trees of depth DEPTH for the logistic loss, over BINS quantile bins of each feature."""

    TREES, DEPTH, BINS, RATE, LEAST, SHRINK = 60, 3, 32, 0.2, 8.0, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.BINS + 1)[1:-1])) for c in x.T]
        binned, share = self.binned(x), np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        margin = np.full(len(y), self.start)
        for _ in range(self.TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grown(binned, p - y, np.maximum(p * (1 - p), 1e-9))
            self.trees.append(tree)
            margin += self._values(tree, binned)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grown(self, binned, gradient, curvature):
        """feature[node], bin[node] (rows above it go right) and value[leaf] of a full tree."""
        inner = 2**self.DEPTH - 1
        feature, cut, node = np.zeros(inner, int), np.full(inner, self.BINS), np.zeros(len(gradient), int)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 1e-6
            if len(rows) >= 2:
                g, h = gradient[rows], curvature[rows]
                whole = g.sum() ** 2 / (h.sum() + self.SHRINK)
                for f in range(binned.shape[1]):
                    gs, hs, ns = (np.cumsum(np.bincount(binned[rows, f], v, self.BINS)) for v in (g, h, np.ones(len(rows))))
                    gain = gs**2 / (hs + self.SHRINK) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.SHRINK) - whole
                    gain[(ns < self.LEAST) | (ns[-1] - ns < self.LEAST)] = 0
                    b = int(gain.argmax())
                    if gain[b] > best:
                        best, feature[k], cut[k] = gain[b], f, b
            right = rows[binned[rows, feature[k]] > cut[k]]
            node[rows] = 2 * k + 1
            node[right] = 2 * k + 2
        leaf = node - inner
        g, h = (np.bincount(leaf, v, 2**self.DEPTH) for v in (gradient, curvature))
        return feature, cut, -self.RATE * g / (h + self.SHRINK)

    def _values(self, tree, binned):
        feature, cut, value = tree
        node, rows = np.zeros(len(binned), int), np.arange(len(binned))
        for _ in range(self.DEPTH):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def margins(self, x: np.ndarray) -> np.ndarray:
        binned = self.binned(x)
        return self.start + sum(self._values(t, binned) for t in self.trees)


def isotonic(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function that fits y best by least squares (pair-adjacent violators)."""
    order = np.argsort(margins, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first and last margin
    for m, v in zip(margins[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, m, m])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks.pop()
            n = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2], b[3]])
    # each block is drawn towards the overall share by one row, so that small blocks at the ends aren't 0 or 1
    share = float(y.mean())
    x = [v for b in blocks for v in (b[2], b[3])]
    return np.array(x), np.array([p for b in blocks for p in [(b[0] * b[1] + share) / (b[1] + 1)] * 2])


class Model:
    def __init__(self, lexicon: dict[str, float]):
        self.extractor, self.constant = Extractor(lexicon), None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.0
            return self
        fold = np.arange(len(y)) % 3
        unseen = np.empty(len(y))
        for k in range(3):
            part = y[fold != k]
            unseen[fold == k] = Forest().fit(x[fold != k], part).margins(x[fold == k])
        self.knots = isotonic(unseen, y)
        self.forest = Forest().fit(x, y)
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.empty(0)
        return np.clip(np.interp(self.forest.margins(self.extractor.rows(texts)), *self.knots), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    """A model fitted on a sample of the labelled documents outside the held-out fold; only features of fixed size and
    the lexicon reach the driver."""
    sample = labelled_sample(docs, labels, "toxic", crc32_mod("doc_id", folds) != held_out, SAMPLE_ROWS).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(FOLDS)).cast("int"))
    lexicons = learned_lexicons(sample)
    model, extractors = Model(lexicons[0]), [Extractor(x) for x in lexicons[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [extractors[part].row(text) for text, part in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield record_batch(doc_id=batch.column(0), x=pa.array(x, pa.list_(pa.float64())), label=batch.column(2))

    rows = map_arrow(sample, run, "doc_id long, x array<double>, label int").orderBy("doc_id").collect()
    return model.fit(np.array([r.x for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.label for r in rows], float))


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a column of scores; a column of that name is replaced."""
    kept = docs.drop(column)
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(place).to_pylist()), pa.float64())], names=[*batch.schema.names, column])

    return map_arrow(kept, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{column}` double"]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, labels, folds, held_out))
    return rows.select("doc_id", F.coalesce(crc32_mod("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
