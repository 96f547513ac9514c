"""One gated retrieval: analysis, gates, scoring, a second pass, evidence of a party for its candidate, and the filters on
what was found. Every step works on the whole batch of questions; those that a step refuses leave it with a reason.

A pass gives each question evidence or the first reason against it. It is run at most three times: over all questions, over
those refused for words that turn out to be harmless (without these words), and over questions about the parties of
requested candidates, which are derived from the candidates' questions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import detect, terms
from attestor.operators import fields as P
from attestor.session import written

#: Wordings that ask for what isn't said, and for a ranking by taste (fixed values).
ABSENCE = r"\bne\s+(propose|proposent|parle|parlent|prevoit|prevoient|defend|defendent|soutient|soutiennent|veut|veulent)\s+pas\b"
RANKING = r"\b(meilleur|meilleure|meilleurs|meilleures|pire|pires)\b|\bplus\s+(favorable|radical|radicale|radicaux|radicales|strict|stricte|stricts|strictes|dur|dure|durs|dures)\b|\bplus\s+a\s+(droite|gauche)\b"
#: Words of questions that change a subject but name none (fixed values).
MODIFIERS = """
abroger acces actuellement ajouter annee annees ans attribuer augmenter baisser brut chacun chacune chaque completer construire couper
creer davantage deux diminuer euro euros financer financee financier financiere financiers financieres finir fondee fonder introduire
lancer limiter long longue mettre million millions milliard milliards mille minimum maximum monter moins neuf partir pendant permettre
personne plus plusieurs porter premier premiere procedure programmer programmation quatre reformer remplacer restreindre selection sept
six supprimer temps tot tard trois travailleur travailleurs viser zero
""".split()
#: Words that name the two kinds of actors (fixed values).
ACTORS = {"candidate": r"\b(candidat|candidats|candidate|candidates|personnalite|personnalites)\b", "party": r"\b(parti|partis|mouvement|mouvements)\b"}
#: Share of a party's score that its candidate inherits, and the score of a record whose title the question holds (fixed values).
INHERITED, EXACT = 0.94, 1_000_000.0


@dataclass(frozen=True)
class World:
    """What questions are held against."""

    index: P.FieldIndex
    ontology: DataFrame  # concept, alias
    anchors: DataFrame  # concept, term
    strict: DataFrame  # concept, groups: array of arrays of terms, of each of which evidence must hold one
    entities: DataFrame  # entity, alias, type (candidate or party), party (of candidates that inherit its programme, else null)
    scope: DataFrame  # term: words that show a subject of the corpus without naming a concept
    benign: DataFrame  # term: unknown words that may be dropped


@dataclass(frozen=True)
class Pass:
    asked: P.Asked
    reasons: DataFrame  # item_id, reason: of the questions without evidence
    found: DataFrame  # item_id, rank, doc_id, score, named, entity, path, kind
    unknown: DataFrame  # item_id, term: unknown words of the questions refused for them


def _without(rows: DataFrame, refused: DataFrame) -> DataFrame:
    return rows.join(refused.select("item_id"), "item_id", "left_anti")


def _concept_terms(world: World) -> DataFrame:
    return world.ontology.select("concept", F.explode(T.tokens(F.col("alias"))).alias("term")).distinct()


def _covered(world: World, asked: P.Asked) -> DataFrame:
    """(item_id, term): the words of the concepts that a question names."""
    return asked.concepts.select("item_id", "concept").join(_concept_terms(world), "concept").select("item_id", "term").distinct()


def harmless(world: World, words: DataFrame) -> DataFrame:
    """(item_id, term) of `words` that are listed as benign, words of the ontology, or at one edit of one."""
    known = world.ontology.select(F.explode(T.tokens(F.col("alias"))).alias("alias")).distinct().withColumn("concept", F.lit(""))
    near = detect.fuzzy_hits(words.withColumnRenamed("term", "word"), known, "item_id").select("item_id", F.col("word").alias("term"))
    listed = world.benign.select("term").unionByName(known.where(F.length("alias") >= 5).select(F.col("alias").alias("term"))).distinct()
    return near.unionByName(words.join(listed, "term").select("item_id", "term")).distinct()


def qualifiers(world: World, asked: P.Asked) -> DataFrame:
    """(item_id, term): subjects of four letters or more beyond numbers and the words of named concepts."""
    rows = asked.subjects.where((F.length("term") >= 4) & ~F.col("term").rlike("^[0-9]+$"))
    return rows.join(_covered(world, asked), ["item_id", "term"], "left_anti")


def gates(world: World, questions: DataFrame, asked: P.Asked) -> tuple[DataFrame, DataFrame]:
    """(item_id, reason) of the questions that are refused before scoring, and (item_id, term) of the unknown words."""
    said = T.normalize(F.col("text"))
    named = asked.concepts.select("item_id").unionByName(asked.entities.select("item_id")).distinct().withColumn("named", F.lit(True))
    strange = asked.subjects.join(world.scope, "term", "left_anti").groupBy("item_id").agg(F.count(F.lit(1)).alias("strange"))
    sizes = asked.subjects.groupBy("item_id").agg(F.count(F.lit(1)).alias("subjects"))
    unknown = qualifiers(world, asked).join(asked.concepts.select("item_id").distinct(), "item_id", "left_semi").where(~F.col("term").isin(*MODIFIERS))
    unknown = written(unknown.join(world.index.df.select("term"), "term", "left_anti").select("item_id", "term"))
    rows = questions.select("item_id", F.size(T.tokens(F.coalesce("text", F.lit("")))).alias("words"), said.rlike(ABSENCE).alias("absence"), said.rlike(RANKING).alias("ranking"))
    for more in (asked.intents, named, strange, sizes, unknown.select("item_id").distinct().withColumn("unknown", F.lit(True))):
        rows = rows.join(more, "item_id", "left")
    nothing_strange, some = F.col("strange").isNull(), F.col("subjects").isNotNull()
    inside = F.col("named").isNotNull() | (F.col("candidate_status") & nothing_strange) | ((F.col("programme") | F.col("source")) & some & nothing_strange)
    reason = (
        F.when(F.col("words") == 0, "empty")
        .when(F.col("absence"), "unsupported_absence")
        .when(F.col("ranking"), "unsupported_ranking")
        .when(~inside, "out_of_scope")
        .when(F.col("unknown"), "unknown_qualifier")
    )
    return written(rows.select("item_id", reason.alias("reason")).where("reason is not null")), unknown


def targeted(world: World, asked: P.Asked, found: DataFrame) -> DataFrame:
    """(item_id): questions for an entity and a concept with a qualifier that is in none of their evidence; if that holds
    proposals, in none of them."""
    both = asked.entities.select("item_id").distinct().join(asked.concepts.select("item_id").distinct(), "item_id", "left_semi")
    rest = qualifiers(world, asked).join(both, "item_id", "left_semi").join(found.select("item_id").distinct(), "item_id", "left_semi")
    rest = rest.join(harmless(world, rest), ["item_id", "term"], "left_anti")
    best = F.max(F.when(F.col("kind") == "proposal", 1).otherwise(0)).over(Window.partitionBy("item_id"))
    pool = found.withColumn("proposals", best).where((F.col("proposals") == 0) | (F.col("kind") == "proposal")).select("item_id", "doc_id")
    return rest.join(_held(world, pool), ["item_id", "term"], "left_anti").select("item_id").distinct()


def _held(world: World, rows: DataFrame) -> DataFrame:
    """rows (item_id, doc_id) with each term of title, section and text of their records."""
    inside = P.FIELDS["text"] | P.FIELDS["title"] | P.FIELDS["section"]
    return rows.select("item_id", "doc_id").join(world.index.terms.where(F.col("fields").bitwiseAND(inside) != 0).select("doc_id", "term"), "doc_id")


def one_pass(world: World, questions: DataFrame, limit: int) -> Pass:
    asked = P.analysed(questions, world.ontology, world.entities.select("entity", "alias"))
    refused, unknown = gates(world, questions, asked)
    active = replace(asked, subjects=_without(asked.subjects, refused), concepts=_without(asked.concepts, refused), entities=_without(asked.entities, refused), numbers=_without(asked.numbers, refused))
    near = written(P.coherent(P.term_profile(world.index, active, _concept_terms(world), world.anchors, of_path=2)))
    chosen = written(P.diversify(near, F.lit(2), F.when(F.col("compare"), 4).otherwise(5), limit))
    # which concepts the chosen records match is found again, for these alone
    few = replace(world.index, terms=written(world.index.terms.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")))
    values = P.concept_values(few, active.concepts, _concept_terms(world), world.anchors)
    matched = chosen.join(active.concepts.select("item_id", "concept"), "item_id").join(values.select("concept", "doc_id"), ["concept", "doc_id"])
    named = matched.groupBy("item_id", "doc_id").agg(F.collect_set("concept").alias("named"))
    found = chosen.join(near.select("item_id", "doc_id", "entity", "path", "kind"), ["item_id", "doc_id"]).join(named, ["item_id", "doc_id"], "left")
    found = written(found.withColumn("named", F.coalesce("named", F.array().cast("array<string>"))))
    reason = lambda rows, name: rows.select("item_id").distinct().withColumn("reason", F.lit(name))
    poor = reason(questions.join(refused, "item_id", "left_anti").join(found, "item_id", "left_anti"), "insufficient_relevance")
    unmatched = written(reason(targeted(world, asked, found), "unmatched_qualifier"))
    return Pass(asked, refused.unionByName(poor).unionByName(unmatched), _without(found, unmatched), unknown.join(refused.where("reason = 'unknown_qualifier'"), "item_id", "left_semi"))


def _nothing(like: Pass) -> Pass:
    """A pass over no questions."""
    asked = P.Asked(*(getattr(like.asked, f).where("false") for f in ("subjects", "concepts", "entities", "numbers", "intents")))
    return Pass(asked, *(rows.where("false") for rows in (like.reasons, like.found, like.unknown)))


def cleaned(world: World, questions: DataFrame, unknown: DataFrame) -> DataFrame:
    """The questions all of whose unknown words are harmless, without these words."""
    fine = harmless(world, unknown).withColumn("fine", F.lit(True))
    words = unknown.join(fine, ["item_id", "term"], "left").groupBy("item_id").agg(F.collect_set("term").alias("drop"), F.bool_and(F.col("fine").isNotNull()).alias("all"))
    kept = F.array_join(F.filter(F.split(T.normalize(F.col("text")), " "), lambda w: ~F.array_contains(F.col("drop"), T.stem(w))), " ")
    return questions.join(words.where("all"), "item_id").select("item_id", kept.alias("text")).where("text <> ''")


def party_questions(world: World, asked: P.Asked, refused: DataFrame) -> DataFrame:
    """(item_id, of, candidate, party, text): what the party of a requested candidate says on the question's subject."""
    heirs = world.entities.where("type = 'candidate' and party is not null").select("entity", "party").distinct()
    names = world.entities.groupBy(F.col("entity").alias("party")).agg(F.min("alias").alias("name"))
    eligible = _without(asked.entities, refused).join(heirs, "entity").join(names, "party")
    listed = lambda rows, c, name: rows.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set(c)), " ").alias(name))
    concepts = listed(asked.concepts, "alias", "concepts")
    subjects = listed(asked.subjects.where(F.length("term") >= 3).unionByName(asked.numbers), "term", "subjects")
    text = F.concat_ws(" ", F.lit("Que propose"), "name", F.lit("sur"), "concepts", "subjects")
    rows = eligible.join(concepts, "item_id", "left").join(subjects, "item_id", "left")
    return rows.select(F.concat_ws(">", F.col("item_id").cast("string"), "entity").alias("item_id"), F.col("item_id").alias("of"), F.col("entity").alias("candidate"), "party", text.alias("text"))


def _ranked(rows: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "origin", "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _merged(rows: DataFrame) -> DataFrame:
    """The best row of each entity and path."""
    best = Window.partitionBy("item_id", "entity", "path").orderBy(F.desc("score"), "origin", "doc_id")
    return rows.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def _qualifier_of_name(questions: DataFrame, world: World, asked: P.Asked) -> DataFrame:
    """(item_id, term): the one capitalised word of five letters or more of a question that is a subject, but no word of its concepts."""
    found = F.filter(F.regexp_extract_all("text", F.lit(r"(\p{Lu}[\p{L}\p{N}]{3,})"), F.lit(1)), lambda w: w != F.upper(w))
    rows = questions.select("item_id", F.explode(F.array_distinct(F.transform(found, lambda w: T.stem(T.norm(w))))).alias("term")).where(F.length("term") >= 5)
    rows = rows.join(asked.subjects, ["item_id", "term"], "left_semi").join(_covered(world, asked), ["item_id", "term"], "left_anti")
    return rows.groupBy("item_id").agg(F.min("term").alias("term"), F.count(F.lit(1)).alias("n")).where("n = 1").select("item_id", "term")


def exact_titles(world: World, questions: DataFrame, asked: P.Asked) -> DataFrame:
    """(item_id, doc_id, entity, path): current proposals of a requested entity whose title stands in the question; the one
    with the longest text of each path."""
    active = world.index.records.where("kind = 'proposal' and title <> '' and status = 'current'")
    pairs = terms.phrase_pairs(questions, active.select("doc_id", F.col("title").alias("text")), "item_id", "doc_id", 1)
    rows = pairs.join(active.select("doc_id", "entity", "path", F.length("text").alias("long")), "doc_id").join(asked.entities, ["item_id", "entity"], "left_semi")
    first = Window.partitionBy("item_id", "path").orderBy(F.desc("long"), "doc_id")
    return rows.withColumn("place", F.row_number().over(first)).where("place = 1").select("item_id", "doc_id", "entity", "path")


def retrieve(world: World, questions: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """Evidence (item_id, rank, doc_id, entity, score, origin) and one row (item_id, reason, tries) for each question.
    item_id must be a string. origin: direct, party (inherited from the party of `entity`) or title."""
    first = one_pass(world, questions, limit)
    again = written(cleaned(world, questions, first.unknown))
    second = one_pass(world, again, limit) if not again.isEmpty() else _nothing(first)
    retried = again.select("item_id")
    join_up = lambda name: _without(getattr(first, name), retried).unionByName(getattr(second, name))
    reasons, found = written(join_up("reasons")), written(join_up("found").withColumn("origin", F.lit("direct")))
    asked = P.Asked(*(_without(getattr(first.asked, f), retried).unionByName(getattr(second.asked, f)) for f in ("subjects", "concepts", "entities", "numbers", "intents")))
    wordings = _without(questions, retried).unionByName(again)

    derived = written(party_questions(world, asked, reasons.where("reason like 'unsupported%' or reason in ('empty', 'out_of_scope')")))
    third = one_pass(world, derived.select("item_id", "text"), max(limit, 14)) if not derived.isEmpty() else _nothing(first)
    heirs = third.found.join(derived.select("item_id", "of", "candidate", "party"), "item_id").where("entity = party")
    inherited = heirs.select(F.col("of").alias("item_id"), "doc_id", F.round(F.col("score") * INHERITED, 6).alias("score"), "named", F.col("candidate").alias("entity"), "path", "kind", F.lit("party").alias("origin"))
    columns = ["item_id", "doc_id", "score", "named", "entity", "path", "kind", "origin"]
    evidence = written(_ranked(_merged(found.select(columns).unionByName(inherited.select(columns))), limit).drop("rank"))

    # filters on what was found; each one that leaves a question nothing is its reason
    lost = []

    def keep(rows: DataFrame, name: Column) -> None:
        nonlocal evidence
        rows = written(rows)
        gone = _without(evidence.select("item_id").distinct(), rows.select("item_id").distinct())
        lost.append(gone.join(wordings.select("item_id", name.alias("reason")), "item_id"))
        evidence = rows

    size = F.size(F.split("alias", " "))
    top = asked.concepts.withColumn("n", size).withColumn("most", F.max(size).over(Window.partitionBy("item_id"))).where("most >= 2 and n = most")
    wanted = top.groupBy("item_id").agg(F.collect_set("concept").alias("wanted"))
    groups = top.join(world.strict, "concept").select("item_id", "concept", F.posexplode("groups").alias("k", "group")).select("item_id", "concept", "k", F.explode("group").alias("word"))
    groups = groups.select("item_id", "concept", "k", F.explode(T.tokens(F.col("word"))).alias("term"))
    met = groups.join(_held(world, evidence), ["item_id", "term"]).select("item_id", "doc_id", "concept", "k").distinct().groupBy("item_id", "doc_id", "concept").agg(F.count(F.lit(1)).alias("met"))
    asked_for = world.strict.select("concept", F.size("groups").alias("need"))
    matched = evidence.join(wanted, "item_id").select("item_id", "doc_id", "origin", F.explode(F.array_intersect("named", "wanted")).alias("concept"))
    fits = matched.join(asked_for, "concept", "left").join(met, ["item_id", "doc_id", "concept"], "left").where(F.coalesce("need", F.lit(0)) <= F.coalesce("met", F.lit(0)))
    fits = fits.select("item_id", "doc_id", "origin").distinct()
    keep(_without(evidence, wanted).unionByName(evidence.join(fits, ["item_id", "doc_id", "origin"], "left_semi")), F.lit("unmatched_specific_concept"))

    names = written(_qualifier_of_name(wordings, world, asked))
    holding = _held(world, evidence).join(names, ["item_id", "term"], "left_semi").select("item_id", "doc_id").distinct()
    keep(_without(evidence, names).unionByName(evidence.join(holding, ["item_id", "doc_id"], "left_semi")), F.lit("unmatched_specific_qualifier"))

    said = T.normalize(F.col("text"))
    person, party = said.rlike(ACTORS["candidate"]), said.rlike(ACTORS["party"])
    kind = F.when(person & ~party, "candidate").when(party & ~person, "party")
    types = world.entities.select("entity", "type").distinct()
    typed = evidence.join(wordings.select("item_id", kind.alias("actor")), "item_id").join(types, "entity", "left").where("actor is null or actor = type").select(columns)
    keep(typed, F.concat(F.lit("no_"), kind, F.lit("_evidence")))

    open_ = wordings.join(reasons.where("reason like 'unsupported%'"), "item_id", "left_anti")
    titles = exact_titles(world, open_, asked).join(wordings.select("item_id", kind.alias("actor")), "item_id").join(types, "entity", "left").where("actor is null or actor = type")
    titles = titles.select("item_id", "doc_id", F.lit(EXACT).alias("score"), F.array().cast("array<string>").alias("named"), "entity", "path", F.lit("proposal").alias("kind"), F.lit("title").alias("origin"))
    final = written(_ranked(_merged(evidence.unionByName(titles.select(columns))), limit).select("item_id", "rank", "doc_id", "entity", "score", "origin"))

    gone = lost[0].unionByName(lost[1]).unionByName(lost[2]).select("item_id", F.col("reason").alias("later")).groupBy("item_id").agg(F.min("later").alias("later"))
    origins = final.groupBy("item_id").agg(F.bool_or(F.col("origin") == "title").alias("title"), F.bool_or(F.col("origin") == "party").alias("party"))
    early = reasons.groupBy("item_id").agg(F.min("reason").alias("reason"))
    rows = questions.select("item_id").distinct().join(early, "item_id", "left").join(gone, "item_id", "left").join(origins, "item_id", "left").join(retried.distinct().withColumn("retried", F.lit(True)), "item_id", "left")
    reason = F.when(F.col("title"), "exact_title").when(F.col("party"), "with_party_evidence").when(F.col("title").isNotNull(), "evidence").otherwise(F.coalesce("later", "reason"))
    return final, rows.select("item_id", reason.alias("reason"), F.when(F.col("retried"), 2).otherwise(1).alias("tries"))
