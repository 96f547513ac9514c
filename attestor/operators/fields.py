"""Scoring of records by their fields: two profiles over one posting list.

A record has doc_id, text, title, section, topics, entity_label, entity, kind, status, confidence, tier, source_url and path.
Each record's terms are counted once, with the set of fields that hold them as bits. Both profiles deal the records into blocks;
a block meets the whole batch of questions in one task, so pairs of questions and records are never shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import detect
from attestor.operators.retrieval import BLOCK_TEXTS, K1, SLACK, B, _best_rows, least_hits
from attestor.session import ship_package, spread, written

#: Fields of a record and their bits.
FIELDS = {"text": 1, "title": 2, "section": 4, "topics": 8, "entity_label": 16}

#: Words of questions that name no subject (fixed values).
GENERIC = """
actuel actuelle actuels actuelles alors autre autres avoir candidat candidats candidature candidatures compare comparaison concerne
concernent connaitre corpus developpe developper developpement difference dire dis documente documentee documentes documentees donne
donner engagement engagements est etre exemple exemples explique faire fais fortement info infos information informations mesure
mesures nouveau nouveaux nouvelle nouvelles officiel officiels parle parler peux peut position positions programme programmes projet
projets propos propose proposent proposition propositions prevoit public publique publics publiques savoir source sources sujet sujets
systeme systemes type types veut veulent vision voudrais
""".split()

#: Words of questions that the rarity profile takes for no signal, and those that only show an intent (fixed values).
FILLER = """
alors aimerais aimerait avoir concernant connaitre connais corpus dire dis disponible disponibles donne donner est etaient etait ete
etre exemple exemples explique faire fais info infos information informations interesse interessent parle parler peux peut position
positions propos savoir sera seraient serait seront sont sujet sujets type types vision voudrais voudrait
""".split()
INTENT_ONLY = """
candidat candidats candidature candidatures compare comparaison difference engagement engagements mesure mesures programme programmes
projet projets propose proposent proposition propositions prevoit source sources veut veulent
""".split()

#: Patterns of intents in normalised questions (fixed values): for the term profile and for the rarity profile.
_STATUS = "declare|officiel|potentiel|probable|possible|primaire|investi|designe|retire|renonce|condition|statut|en course"
INTENTS = {
    "candidate_status": f"(?:candidat|candidature).{{0,45}}(?:{_STATUS})|(?:{_STATUS}).{{0,45}}(?:candidat|candidature)",
    "compare": "compare|comparaison|difference|versus| vs ",
    "programme": "programme|proposition|mesure|propose|veut|prevoit|engagement|position",
    "source": "source|preuve|document|citation",
}
RARITY_INTENTS = {
    "candidate_status": "candidat|candidature|declare|investi|designe|primaire|renonce|retire",
    "compare": "compare|comparaison|difference|qui propose|lesquels|quels candidats",
    "programme": "programme|proposition|mesure|propose|veut|prevoit|engagement",
    "source": "source|preuve|document|citation",
}


def intents(questions: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(item_id, a boolean for each intent). The wording is normalised and stands between spaces."""
    said = F.concat(F.lit(" "), T.normalize(F.col("text")), F.lit(" "))
    return questions.select("item_id", *(F.coalesce(said.rlike(p), F.lit(False)).alias(name) for name, p in patterns.items()))


def raw_words(c: Column) -> Column:
    """All words of the folded text."""
    return F.filter(F.split(T.norm(c), " "), lambda w: w != "")


def plain_terms(c: Column) -> Column:
    """Distinct raw words that carry meaning: longer than one character or numbers, and not stop words."""
    return F.array_distinct(F.filter(raw_words(c), lambda w: ((F.length(w) > 1) | w.rlike("^[0-9]+$")) & ~w.isin(*T.STOP)))


#: Attributes of a record that scoring reads.
_ATTRIBUTES = ["entity", "kind", "status", "confidence", "tier", "source_url", "path"]


@dataclass(frozen=True)
class FieldIndex:
    records: DataFrame
    cut: DataFrame  # one row for each record: doc_id, attributes, length, and terms, tf and fields of each distinct term
    terms: DataFrame  # doc_id, term, tf, fields, impact
    df: DataFrame  # term, df
    total: int  # records
    mean: float  # length of a record


def _counted(records: DataFrame, words: Callable[[Column], Column]) -> DataFrame:
    """doc_id, attributes, length, terms, tf and fields of each row: its words are counted where they are cut, and nothing is shuffled."""
    kept = ["doc_id", *_ATTRIBUTES]
    cuts = [words(F.coalesce(name, F.lit(""))).alias(name) for name in FIELDS]
    ship_package(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, bits = [], [], []
            for name, bit in FIELDS.items():
                column = batch.column(f"__{name}")
                sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
                rows.append(np.repeat(np.arange(len(sizes)), sizes))
                held.append(column.flatten())
                bits.append(np.full(len(rows[-1]), bit, np.int8))
            row, bit = np.concatenate(rows), np.concatenate(bits)
            coded = pa.concat_arrays(held).dictionary_encode()
            pair = row * max(1, len(coded.dictionary)) + np.asarray(coded.indices)
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, int)
            tf = np.diff(np.r_[first, len(pair)]).astype(np.int32)
            fields = np.bitwise_or.reduceat(bit[order], first) if len(first) else np.zeros(0, np.int8)
            row, term = np.divmod(pair[first], max(1, len(coded.dictionary)))
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32))
            listed = lambda values: pa.ListArray.from_arrays(offsets, values)
            length = np.bincount(row, weights=tf, minlength=batch.num_rows).astype(np.int64)
            columns = [batch.column(c) for c in kept] + [pa.array(length), listed(coded.dictionary.take(pa.array(term))), listed(pa.array(tf)), listed(pa.array(fields))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "length", "terms", "tf", "fields"])

    typed = ", ".join(f"{c} {records.schema[c].dataType.simpleString()}" for c in kept)
    rows = spread(records).select(*kept, *(c.alias(f"__{name}") for name, c in zip(FIELDS, cuts, strict=True)))
    return rows.mapInArrow(run, f"{typed}, length long, terms array<string>, tf array<int>, fields array<tinyint>")


def _merged(cut: DataFrame) -> DataFrame:
    """Rows of one doc_id are one text, under the attributes of each row."""
    flat = cut.select("doc_id", F.explode(F.arrays_zip("terms", "tf", "fields")).alias("x"))
    flat = flat.groupBy("doc_id", "x.terms").agg(F.sum("x.tf").cast("int").alias("tf"), F.bit_or("x.fields").alias("fields"))
    whole = flat.groupBy("doc_id").agg(F.sum("tf").alias("length"), F.collect_list(F.struct("terms", "tf", "fields")).alias("x"))
    whole = whole.select("doc_id", "length", F.col("x.terms").alias("terms"), F.col("x.tf").alias("tf"), F.col("x.fields").alias("fields"))
    joined = cut.select("doc_id", *_ATTRIBUTES).join(whole, "doc_id", "left")
    nothing = {"length": F.lit(0).cast("long"), **{c: F.array().cast(cut.schema[c].dataType) for c in ("terms", "tf", "fields")}}
    return joined.select("doc_id", *_ATTRIBUTES, *(F.coalesce(c, v).alias(c) for c, v in nothing.items()))


def _index(records: DataFrame, words: Callable[[Column], Column], uncounted: int) -> FieldIndex:
    cut = _counted(records, words)
    shared = not records.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    cut = written(_merged(cut) if shared else cut)
    once = cut.dropDuplicates(["doc_id"]) if shared else cut
    size = once.agg(F.sum(F.greatest("length", F.lit(1))).alias("words"), F.count(F.lit(1)).alias("texts")).first()
    total = cut.count() if shared else size.texts
    # a record without terms counts as one of length 1
    mean = ((size.words or 0) + total - size.texts) / total if total else 0.0
    flat = once.select("doc_id", "length", F.explode(F.arrays_zip("terms", "tf", "fields")).alias("x"))
    flat = flat.select("doc_id", "length", F.col("x.terms").alias("term"), F.col("x.tf").alias("tf"), F.col("x.fields").cast("int").alias("fields"))
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / max(1.0, mean)))
    df = written(flat.where(F.col("fields").bitwiseAND(~uncounted & 31) != 0).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    return FieldIndex(records, cut, flat.select("doc_id", "term", "tf", "fields", impact.alias("impact")), df, total, mean)


def field_index(records: DataFrame) -> FieldIndex:
    """Each field is cut once into stems, by which BM25 counts."""
    return _index(records, T.words, 0)


def word_index(records: DataFrame) -> FieldIndex:
    """Each field is cut once into raw words, by which the rarity profile looks for forms; its df counts no sections."""
    return _index(records, raw_words, FIELDS["section"])


def has(field: str) -> Column:
    return F.col("fields").bitwiseAND(FIELDS[field]) != 0


@dataclass(frozen=True)
class Asked:
    """What questions ask for."""

    subjects: DataFrame  # item_id, term
    concepts: DataFrame  # item_id, concept, alias, fuzzy
    entities: DataFrame  # item_id, entity
    numbers: DataFrame  # item_id, term
    intents: DataFrame  # item_id, one boolean each


def requested_entities(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(item_id, entity): entities with an alias in the question, or one of five letters and one word at one edit of a word of it.
    aliases: (entity, alias), normalised."""
    named = aliases.select(F.col("entity").alias("concept"), "alias")
    asked = detect.grams(questions, "item_id")
    words = asked.where(~F.contains("gram", F.lit(" "))).withColumnRenamed("gram", "word")
    hits = detect.alias_hits(asked, named, "item_id").unionByName(detect.fuzzy_hits(words, named, "item_id").drop("word"))
    return hits.select("item_id", F.col("concept").alias("entity")).distinct()


def analysed(questions: DataFrame, ontology: DataFrame, aliases: DataFrame) -> Asked:
    """Subjects are all tokens but generic words and the words of requested entities."""
    tokens = questions.select("item_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    entities = written(requested_entities(questions, aliases))
    named = entities.join(aliases, "entity").select("item_id", F.explode(T.tokens(F.col("alias"))).alias("term")).distinct()
    subjects = tokens.where(~F.col("term").isin(*GENERIC)).join(named, ["item_id", "term"], "left_anti")
    numbers = tokens.where(F.col("term").rlike("^[0-9]+$") & (F.col("term") != "2027"))
    return Asked(written(subjects), written(detect.detect_concepts(questions, ontology, "item_id")), entities, numbers, intents(questions, INTENTS))


def _bonus(said: dict[str, Column], weights: dict[str, float]) -> Column:
    """What kind, status, confidence, tier and intents (said) add. weights: by name."""
    when = lambda c, name: F.when(c, weights[name]).otherwise(0.0)
    kind = F.col("kind")
    return (
        when(said["candidate_status"] & (kind == "candidate_status"), "status_intent")
        + when(said["programme"] & kind.isin("proposal", "document"), "programme_intent")
        + when(said["compare"] & (kind == "proposal"), "compare_intent")
        + when(said["source"] & F.col("source_url").isNotNull(), "source_intent")
        + when(kind == "proposal", "proposal")
        + when(F.col("status") == "current", "current")
        + when(F.col("confidence") == "high", "high")
        + when(F.col("tier") == "tier_1_primary_official", "primary")
    )


#: Weights of the two profiles (fixed values).
TERM_FIELDS = {"title": 2.8, "section": 2.2, "topics": 2.3, "entity_label": 4.5}
TERM_BONUS = {"status_intent": 6.0, "programme_intent": 2.5, "compare_intent": 3.0, "source_intent": 1.5, "proposal": 1.1, "current": 0.7, "high": 0.4, "primary": 0.4}
RARITY_FIELDS = {"text": 2.2, "topics": 3.2, "section": 3.8, "title": 5.0, "entity_label": 6.0}
RARITY_BONUS = {"status_intent": 8.0, "programme_intent": 3.0, "compare_intent": 4.0, "source_intent": 2.0, "proposal": 0.0, "current": 0.0, "high": 0.8, "primary": 0.8}


#: The parts of a bonus: what a record gets anyway, and with each intent.
_INTENTS = ("candidate_status", "programme", "compare", "source")


def _bonuses(weights: dict[str, float]) -> Column:
    """The bonus of a record as an array: without intents, and what each of _INTENTS adds."""
    said = lambda *names: {n: F.lit(n in names) for n in _INTENTS}
    bare = _bonus(said(), weights)
    return F.array(bare, *(_bonus(said(n), weights) - bare for n in _INTENTS))


def _weights(index: FieldIndex, rows: DataFrame) -> DataFrame:
    """rows (with a term) with the idf of each term that some record holds."""
    return rows.join(index.df, "term").withColumn("idf", F.log(1 + (F.lit(index.total) - F.col("df") + 0.5) / (F.col("df") + 0.5))).drop("df")


def concept_values(index: FieldIndex, concepts: DataFrame, retrieval_terms: DataFrame, anchors: DataFrame) -> DataFrame:
    """(concept, doc_id, value): 5.5 and 0.8 times the four best BM25 values (7 at most) for each record that matches a concept: that
    has one of its terms and, if it has anchors, one of these. retrieval_terms, anchors: (concept, term); concepts: those asked
    for. term_profile finds the same where it scores; this form is for a few records, by an index of these alone."""
    wanted = concepts.select("concept").distinct()
    found = _weights(index, wanted.join(retrieval_terms, "concept")).join(index.terms, "term").withColumn("bm25", F.col("idf") * F.col("impact"))
    found = found.groupBy("concept", "doc_id").agg(F.collect_list("bm25").alias("all"))
    four = F.slice(F.reverse(F.array_sort("all")), 1, 4)
    values = found.select("concept", "doc_id", (5.5 + F.least(F.lit(7.0), 0.8 * F.aggregate(four, F.lit(0.0), lambda a, x: a + x))).alias("value"))
    held = wanted.join(anchors, "concept").join(index.terms, "term").select("concept", "doc_id").distinct()
    anchored = anchors.select("concept").distinct()
    return values.join(anchored, "concept", "left_anti").unionByName(values.join(anchored, "concept", "left_semi").join(held, ["concept", "doc_id"], "left_semi"))


def _in_blocks(index: FieldIndex, bonus: Column, questions: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(records of a block, all questions) for each block of records: pairs are never rows of a shuffle."""
    blocks = max(index.cut.sparkSession.sparkContext.defaultParallelism, -(-index.total // BLOCK_TEXTS))
    records = index.cut.withColumn("bonus", bonus).drop("status", "confidence", "tier", "source_url")
    records = records.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    every = questions.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ship_package(index.cut.sparkSession)
    return records.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(run, schema)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


class _Holders:
    """Who holds each of a list of terms: for codes of terms, the places of all who do."""

    def __init__(self, codes: np.ndarray, width: int):
        self.order = np.argsort(codes, kind="stable")
        self.ends = np.cumsum(np.bincount(codes, minlength=width))
        self.starts = self.ends - np.bincount(codes, minlength=width)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the list, and for each the position of its code among `codes`."""
        many = (self.ends - self.starts)[codes]
        by = np.repeat(np.arange(len(codes)), many)
        return self.order[np.arange(len(by)) + (self.starts[codes] - (np.cumsum(many) - many))[by]], by


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a list column: its borders, the row of each value, and the values."""
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    return np.r_[0, np.cumsum(sizes)], np.repeat(np.arange(len(sizes)), sizes), column.flatten()


def term_profile(index: FieldIndex, asked: Asked, retrieval_terms: DataFrame, anchors: DataFrame, least: float = 2.2, of_path: int | None = None) -> DataFrame:
    """(item_id, doc_id, score, direct, concepts, entity_match, numbers, and entity, path, kind and compare) of the records that
    answer a question. retrieval_terms, anchors: (concept, term), see concept_values.

    2.7 times BM25 and the weights of the fields for each subject; the value of each concept; 18 for a requested entity; 7
    for each number; and the bonuses. A record answers with `least` at least, of a requested entity, with enough numbers, with
    a concept if one is asked for (and with a subject, unless an entity, a concept of several words or a misspelt one
    bridges it), else with enough of the subjects.

    Records are dealt into blocks, and a block meets all questions in one task. With of_path a task gives only what can
    be among the first of_path coherent records of a question, path and entity."""
    role = lambda rows, name: rows.select("item_id", "term", F.lit(name).alias("role"))
    has_role = lambda name: F.bool_or(F.col("role") == name)
    pack = F.collect_list(F.struct("term", "idf", "one", "two")).alias("terms")
    roles = role(asked.subjects, "subject").unionByName(role(asked.numbers, "number")).groupBy("item_id", "term").agg(has_role("subject").alias("one"), has_role("number").alias("two"))
    rows = asked.intents.join(_weights(index, roles).groupBy("item_id").agg(pack), "item_id", "left")
    count = lambda rows, name: rows.groupBy("item_id").agg(F.count(F.lit(1)).alias(name))
    bridge = F.coalesce(F.max(F.contains("alias", F.lit(" ")) | F.col("fuzzy")), F.lit(False)).alias("bridge")
    named = asked.concepts.groupBy("item_id").agg(F.count(F.lit(1)).alias("wants_concept"), bridge, F.collect_list("concept").alias("named"))
    requested = asked.entities.groupBy("item_id").agg(F.count(F.lit(1)).alias("requested"), F.collect_list("entity").alias("entities"))
    for more in (count(asked.subjects, "subjects"), count(asked.numbers, "wanted"), named, requested):
        rows = rows.join(more, "item_id", "left")
    rows = rows.fillna(0, ["subjects", "requested", "wanted", "wants_concept"]).withColumn("bridge", F.coalesce("bridge", F.lit(False)) | (F.col("requested") > 0))
    rows = rows.withColumn("need", least_hits(F.col("subjects")).cast("long")).withColumn("concept", F.lit(None).cast("string"))
    # concepts go along as rows without a question: the terms that show one, and those that are anchors
    part = lambda rows, name: asked.concepts.select("concept").distinct().join(rows, "concept").select("concept", "term", F.lit(name).alias("role"))
    shown = part(retrieval_terms, "term").unionByName(part(anchors, "anchor")).groupBy("concept", "term").agg(has_role("term").alias("one"), has_role("anchor").alias("two"))
    shown = shown.join(index.df, "term", "left").withColumn("idf", F.coalesce(F.log(1 + (F.lit(index.total) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0)))
    questions = written(rows.unionByName(shown.groupBy("concept").agg(pack), allowMissingColumns=True))
    mean, weights = max(1.0, index.mean), np.array([sum(w for f, w in TERM_FIELDS.items() if bits & FIELDS[f]) for bits in range(32)])

    def run(block: pa.Table, questions: pa.Table) -> pa.Table:
        column = lambda t, name: _column(t, name) if t.num_rows else t[name].combine_chunks()
        is_question = pc.is_null(questions["concept"])
        items, shown = questions.filter(is_question), questions.filter(pc.invert(is_question))
        n, concepts = items.num_rows, {c: k for k, c in enumerate(shown["concept"].to_pylist())}
        _, who, packed = _lists(column(items, "terms"))
        _, what, shows = _lists(column(shown, "terms"))
        coded = pa.concat_arrays([packed.field("term"), shows.field("term")]).dictionary_encode()
        code, width = np.asarray(coded.indices), len(coded.dictionary)
        field = lambda rows, name: np.asarray(rows.field(name))
        asks, shows_it = _Holders(code[: len(who)], width), _Holders(code[len(who) :], width)
        ask_idf, subject, number = field(packed, "idf"), field(packed, "one").astype(bool), field(packed, "two").astype(bool)
        show_idf, retrieves, anchors = field(shows, "idf"), field(shows, "one").astype(bool), field(shows, "two").astype(bool)
        anchored = np.bincount(what[anchors], minlength=len(concepts)) > 0
        wants, wanted_concept = [], []
        for k, listed in enumerate(items["named"].to_pylist()):
            found = [concepts[c] for c in listed or [] if c in concepts]
            wants += [k] * len(found)
            wanted_concept += found
        wants, wanted_concept = np.array(wants, int), np.array(wanted_concept, int)
        of_entity: dict[str, list[int]] = {}
        for k, listed in enumerate(items["entities"].to_pylist()):
            for e in listed or []:
                of_entity.setdefault(e, []).append(k)
        flags = np.stack([np.ones(n), *(np.asarray(items[c]).astype(float) for c in _INTENTS)], axis=1)
        subjects, requested, wanted, named, need = (np.asarray(items[c]).astype(int) for c in ("subjects", "requested", "wanted", "wants_concept", "need"))
        bridge, status_asked, compare = (np.asarray(items[c]).astype(bool) for c in ("bridge", "candidate_status", "compare"))
        cuts, row, held = _lists(column(block, "terms"))
        found = pc.index_in(held, value_set=coded.dictionary)
        there = np.flatnonzero(np.asarray(found.is_valid()))
        term = np.asarray(found.fill_null(0))[there]
        tf, bits = np.asarray(_column(block, "tf").flatten())[there], np.asarray(_column(block, "fields").flatten())[there]
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.asarray(block["length"])[row[there]] / mean))
        cuts = np.searchsorted(there, cuts)
        bonus = np.asarray(_column(block, "bonus").flatten()).reshape(-1, len(_INTENTS) + 1)
        entities, kinds = block["entity"].to_pylist(), block["kind"].to_pylist()
        out = []
        for d in range(block.num_rows):
            a, b = cuts[d], cuts[d + 1]
            if a == b:
                continue
            at, by = asks.of(term[a:b])
            item, one = who[at], subject[at]
            part = np.where(one, 2.7 * ask_idf[at] * impact[a:b][by] + weights[bits[a:b]][by], 0.0)
            parts, direct = np.bincount(item, weights=part, minlength=n), np.bincount(item[one], minlength=n)
            numbers = np.bincount(item[number[at]], minlength=n)
            at, by = shows_it.of(term[a:b])
            value, count = np.zeros(len(concepts)), np.zeros(n, int)
            if len(at):
                met = np.bincount(what[at][anchors[at]], minlength=len(concepts)) > 0
                at, by = at[retrieves[at]], by[retrieves[at]]
                bm25 = show_idf[at] * impact[a:b][by]
                order = np.lexsort((-bm25, what[at]))
                concept = what[at][order]
                place = np.arange(len(concept)) - np.searchsorted(concept, concept)
                best = np.bincount(concept[place < 4], weights=bm25[order][place < 4], minlength=len(concepts))
                shown_here = (np.bincount(concept, minlength=len(concepts)) > 0) & (met | ~anchored)
                value = np.where(shown_here, 5.5 + np.minimum(7.0, 0.8 * best), 0.0)
                here = shown_here[wanted_concept]
                count = np.bincount(wants[here], minlength=n)
                parts = parts + np.bincount(wants[here], weights=value[wanted_concept[here]], minlength=n)
            match = np.zeros(n, bool)
            match[of_entity.get(entities[d], [])] = True
            by_subject = np.where(subjects > 0, direct >= need, status_asked & (kinds[d] == "candidate_status"))
            by_concept = (count > 0) & ((subjects == 0) | (direct > 0) | bridge)
            fits = ((requested == 0) | match) & ((wanted == 0) | (numbers > 0)) & np.where(named > 0, by_concept, by_subject) & (direct + numbers + count > 0)
            score = parts + 18.0 * match + 7.0 * numbers + flags @ bonus[d]
            k = np.flatnonzero(fits & (score >= least - SLACK))
            if len(k):
                out.append((k, np.full(len(k), d), score[k], direct[k], count[k], numbers[k], match[k]))
        item, doc, score, direct, count, numbers, match = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 7
        if of_path is not None and len(item):
            best = np.full(n, -np.inf)
            np.maximum.at(best, item, score)
            near = np.flatnonzero(score >= best[item] * np.where(compare[item], 0.25, 0.4) - SLACK)
            of = lambda name: np.asarray(_column(block, name).dictionary_encode().indices.fill_null(-1)) + 1
            path, entity = of("path"), of("entity")
            group = (item[near] * (path.max() + 1) + path[doc[near]]) * (entity.max() + 1) + entity[doc[near]]
            kept = near[_best_rows(group, np.asarray(block["doc_id"])[doc[near]], score[near], of_path)]
            item, doc, score, direct, count, numbers, match = (x[kept] for x in (item, doc, score, direct, count, numbers, match))
        rows, records = items.take(pa.array(item.astype(int))), block.select(["doc_id", "entity", "path", "kind"]).take(pa.array(doc.astype(int)))
        whole = lambda x: pa.array(x.astype(np.int64))
        return pa.table({"item_id": rows["item_id"], "doc_id": records["doc_id"], "score": pa.array(score.astype(float)), "direct": whole(direct), "concepts": whole(count), "entity_match": pa.array(match.astype(bool)), "numbers": whole(numbers), "entity": records["entity"], "path": records["path"], "kind": records["kind"], "compare": rows["compare"]})

    kind = lambda rows, c: f"{c} {rows.schema[c].dataType.simpleString()}"
    schema = f"{kind(questions, 'item_id')}, {kind(index.cut, 'doc_id')}, score double, direct long, concepts long, entity_match boolean, numbers long, {kind(index.cut, 'entity')}, {kind(index.cut, 'path')}, {kind(index.cut, 'kind')}, compare boolean"
    return _in_blocks(index, _bonuses(TERM_BONUS), questions, run, schema).withColumn("score", F.round("score", 6)).where(F.col("score") >= least)


def rarity_profile(index: FieldIndex, questions: DataFrame, entity_aliases: DataFrame, least: float = 1.8) -> DataFrame:
    """(item_id, doc_id, score, matched, hit, phrase, and entity, path, kind and compare) of the records that answer a question: the
    rarity of each term times the weight of each field that holds one of its forms, or whose entity has it for an alias;
    12 for the whole wording, 4 for the signals in a row, and the bonuses. entity_aliases: (entity, term). index: of words.

    A record answers with enough signals: 1 of 1, 2 of 2, else half of them and two at least; two signals of which one is a
    number of one or two digits must stand in a row. Without signals the question must show an intent. Records are dealt
    into blocks, and a block meets all questions in one task; wordings are looked for only in what is left."""
    asked = questions.select("item_id", F.explode(plain_terms(F.col("text"))).alias("term"))
    signal = ~F.col("term").isin(*FILLER, *INTENT_ONLY)
    rarity = F.log((F.lit(index.total) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weighed = asked.join(index.df, "term", "left").select("item_id", "term", signal.alias("signal"), rarity.alias("rarity"))
    forms = F.when(F.col("term").rlike("^[a-z]{5,}$"), T.variants(F.col("term"))).otherwise(F.array("term"))
    words = weighed.groupBy("item_id").agg(F.collect_list(F.struct(F.col("term"), forms.alias("forms"), F.col("signal"), F.col("rarity"))).alias("terms"), F.count(F.lit(1)).alias("asked"), F.count_if("signal").alias("signals"))
    n = F.col("signals")
    need = F.when(n <= 2, n).otherwise(F.greatest(F.lit(2), F.ceil(n * 0.5))).cast("long")
    aliases = entity_aliases.groupBy(F.col("entity").alias("of")).agg(F.collect_set("term").alias("aliases"))
    rows = words.join(intents(questions, RARITY_INTENTS), "item_id").withColumn("need", need).withColumn("of", F.lit(None).cast("string"))
    asked_rows = written(rows.unionByName(aliases, allowMissingColumns=True))
    weights = np.array([sum(w for f, w in RARITY_FIELDS.items() if bits & FIELDS[f]) for bits in range(32)])

    def run(block: pa.Table, questions: pa.Table) -> pa.Table:
        is_question = pc.is_null(questions["of"])
        items, named = questions.filter(is_question), questions.filter(pc.invert(is_question))
        n = items.num_rows
        _, who, packed = _lists(_column(items, "terms") if n else items["terms"].combine_chunks())
        _, slot, form = _lists(packed.field("forms"))
        rarity, signal = np.asarray(packed.field("rarity")), np.asarray(packed.field("signal")).astype(bool)
        coded = pa.concat_arrays([form, packed.field("term")]).dictionary_encode()
        code = np.asarray(coded.indices)
        by_form, by_term = _Holders(code[: len(slot)], len(coded.dictionary)), _Holders(code[len(slot) :], len(coded.dictionary))
        of_entity = {}
        for entity, listed in zip(named["of"].to_pylist(), named["aliases"].to_pylist(), strict=True):
            known = pc.index_in(pa.array(listed, pa.string()), value_set=coded.dictionary).drop_null()
            of_entity[entity] = by_term.of(np.asarray(known))[0]
        flags = np.stack([np.ones(n), *(np.asarray(items[c]).astype(float) for c in _INTENTS)], axis=1)
        signals, need = np.asarray(items["signals"]), np.asarray(items["need"])
        meant = flags[:, 1:].any(axis=1)
        cuts, _, held = _lists(_column(block, "terms"))
        found = pc.index_in(held, value_set=coded.dictionary)
        there = np.flatnonzero(np.asarray(found.is_valid()))
        term, bits = np.asarray(found.fill_null(0))[there], np.asarray(_column(block, "fields").flatten())[there]
        cuts = np.searchsorted(there, cuts)
        bonus = np.asarray(_column(block, "bonus").flatten()).reshape(-1, len(_INTENTS) + 1)
        fields, out = np.zeros(len(who), np.int8), []
        for d, entity in enumerate(block["entity"].to_pylist()):
            a, b = cuts[d], cuts[d + 1]
            at, by = by_form.of(term[a:b])
            at = slot[at]
            np.bitwise_or.at(fields, at, bits[a:b][by])
            own = of_entity.get(entity, at[:0])
            fields[own] |= FIELDS["entity_label"]
            hit = np.unique(np.r_[at, own])
            if not len(hit):
                continue
            item = who[hit]
            matched, signs = np.bincount(item, minlength=n), np.bincount(item[signal[hit]], minlength=n)
            k = np.flatnonzero((matched > 0) & np.where(signals == 0, meant, signs >= need))
            if len(k):
                score = np.bincount(item, weights=weights[fields[hit]] * rarity[hit], minlength=n) + flags @ bonus[d]
                out.append((k, np.full(len(k), d), score[k], matched[k], signs[k]))
            fields[hit] = 0
        item, doc, score, matched, signs = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 5
        rows, records = items.take(pa.array(item)), block.select(["doc_id", "entity", "path", "kind"]).take(pa.array(doc))
        whole = lambda x: pa.array(x.astype(np.int64))
        return pa.table({"item_id": rows["item_id"], "doc_id": records["doc_id"], "part": pa.array(score.astype(float)), "matched": whole(matched), "hit": whole(signs), "signals": rows["signals"], "asked": rows["asked"], "entity": records["entity"], "path": records["path"], "kind": records["kind"], "compare": rows["compare"]})

    kind = lambda rows, c: f"{c} {rows.schema[c].dataType.simpleString()}"
    schema = f"{kind(asked_rows, 'item_id')}, {kind(index.cut, 'doc_id')}, part double, matched long, hit long, signals long, asked long, {kind(index.cut, 'entity')}, {kind(index.cut, 'path')}, {kind(index.cut, 'kind')}, compare boolean"
    rows = written(_in_blocks(index, _bonuses(RARITY_BONUS), asked_rows, run, schema))
    # wordings that stand whole in a record are looked for only where all their inner words are held
    wording = questions.select("item_id", T.norm(F.col("text")).alias("wording"), F.array_join(F.filter(plain_terms(F.col("text")), lambda t: ~t.isin(*FILLER, *INTENT_ONLY)), " ").alias("in_a_row"))
    # the first and the last word may be parts of words of the record, and so be no hits
    maybe = (F.col("matched") >= F.col("asked") - 2) | ((F.col("signals") > 0) & (F.col("hit") >= F.col("signals") - 2))
    hay = F.array_join(F.array(*(T.norm(F.coalesce(f, F.lit(""))) for f in ("title", "entity_label", "section", "topics", "text"))), " ")
    found = rows.where(maybe).select("item_id", "doc_id").distinct().join(index.records.select("doc_id", T.norm(hay).alias("hay")), "doc_id").join(wording, "item_id")
    whole = F.bool_or((F.length("wording") > 6) & F.contains("hay", F.col("wording"))).alias("whole")
    phrase = F.bool_or((F.col("in_a_row") != "") & F.contains("hay", F.col("in_a_row"))).alias("phrase")
    found = found.groupBy("item_id", "doc_id").agg(whole, phrase)
    rows = rows.join(found, ["item_id", "doc_id"], "left").join(wording.select("item_id", "in_a_row"), "item_id").fillna(False, ["whole", "phrase"])
    short = (F.col("signals") == 2) & F.col("in_a_row").rlike(r"(^|\s)[0-9]{1,2}($|\s)")
    score = F.round(F.col("part") + F.when(F.col("whole"), 12.0).otherwise(0.0) + F.when(F.col("phrase"), 4.0).otherwise(0.0), 6)
    rows = rows.withColumn("score", score).where((F.col("score") >= least) & (~short | F.col("phrase")))
    return rows.select("item_id", "doc_id", "score", "matched", "hit", "phrase", "entity", "path", "kind", "compare")


def coherent(scored: DataFrame) -> DataFrame:
    """Records of at least 0.4 times their question's best score, 0.25 where it compares."""
    best = F.max("score").over(Window.partitionBy("item_id"))
    return scored.withColumn("best", best).where(F.col("score") >= F.col("best") * F.when(F.col("compare"), 0.25).otherwise(0.4)).drop("best")


def diversify(ranked: DataFrame, path_cap: Column, entity_cap: Column, limit: int) -> DataFrame:
    """A greedy pass over each question's records in order (score, then doc_id): a record is taken if fewer than path_cap
    records of its path and fewer than entity_cap of its entity were taken, until there are `limit`; one that is left out counts for
    neither. (item_id, rank, doc_id, score).

    Of one path, entity and pair of caps, once a record is left out all later ones are, so no more than the first path_cap are
    sent on; records of other caps are counted apart, since one that is left out for its own lower cap says nothing of them.
    The rest streams in order past two counters, with nothing held but them."""
    keys = ["item_id", "score", "doc_id", "path", "entity", "path_cap", "entity_cap"]
    rows = ranked.withColumns({"path_cap": path_cap.cast("int"), "entity_cap": entity_cap.cast("int")}).select(keys)
    same = Window.partitionBy("item_id", "path", "entity", "path_cap", "entity_cap").orderBy(F.desc("score"), "doc_id")
    most = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= F.col("path_cap")).drop("place")
    dealt = most.repartition("item_id").sortWithinPartitions("item_id", F.desc("score"), "doc_id")
    kind = ranked.schema["item_id"].dataType.simpleString()
    ship_package(ranked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken, paths, entities = object(), 0, {}, {}
        for batch in batches:
            kept = []
            for k, (item, path, entity, of_path, of_entity) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("item_id", "path", "entity", "path_cap", "entity_cap")), strict=True)):
                if item != now:
                    now, taken, paths, entities = item, 0, {}, {}
                if taken >= limit or paths.get(path, 0) >= of_path or entities.get(entity, 0) >= of_entity:
                    continue
                taken += 1
                paths[path], entities[entity] = paths.get(path, 0) + 1, entities.get(entity, 0) + 1
                kept.append((k, taken))
            if kept:
                rows = batch.take(pa.array([k for k, _ in kept]))
                yield pa.RecordBatch.from_arrays([rows.column("item_id"), pa.array([n for _, n in kept], pa.int32()), rows.column("doc_id"), rows.column("score")], names=["item_id", "rank", "doc_id", "score"])

    return dealt.mapInArrow(run, f"item_id {kind}, rank int, doc_id long, score double")
