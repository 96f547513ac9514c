"""Both profiles score records in blocks: the results are those of scoring every pair, and pairs are never shuffled."""

import math
import re

import pytest

from attestor.functions import text as T
from attestor.operators import fields as P

TEXTS = ["Le nucleaire et la reforme. Energie verte pour tous.", "Reforme des retraites 2030. Energie.", "Energie verte energie. Impots 12 reformes.", "", "Verte reforme nucleaire energie retraites impots"]


@pytest.fixture(scope="module")
def records(spark):
    rows = []
    for k in range(40):
        text = TEXTS[k % 5] + (f" Detail {k % 7} verte." if k % 3 else "")
        kind, status = ("proposal", "candidate_status", "document", None)[k % 4], ("current", "unknown")[k % 2]
        rows.append((k, text, text.split(".")[0], f"section verte {k % 2}", ("energie", "")[k % 2], f"src{k % 3}", f"src{k % 3}" if k % 6 else None, kind, status, ("high", "medium")[k % 2], "tier_1_primary_official" if k % 5 == 0 else "other", "u" if k % 2 else None, f"p{k % 4}"))
    rows.append((7, "Deux fois la reforme verte", "", "", "", "src1", "src1", "proposal", "current", "high", "other", None, "p9"))  # one id, two rows
    names = ["doc_id long", "text", "title", "section", "topics", "entity_label", "entity", "kind", "status", "confidence", "tier", "source_url", "path"]
    return spark.createDataFrame(rows, ", ".join(n if " " in n else f"{n} string" for n in names)).cache()


@pytest.fixture(scope="module")
def questions(spark):
    asked = [(1, "programme reforme energie verte"), (2, "comparaison src1 energie nucleaire retraites"), (3, "energie"), (4, "candidat"), (5, "impots 12"), (6, None), (7, "Energie verte pour tous"), (8, "source src2 verte 2030")]
    return spark.createDataFrame(asked, "item_id long, text string").cache()


def _words(text):
    return [w for w in re.sub("[^a-z0-9]+", " ", (text or "").lower()).split()]


def _rarity(records, questions):
    """Every pair, one after the other."""
    rows, fields = [r.asDict() for r in records.collect()], list(P.FIELDS)
    held = {}
    for r in rows:
        for f in fields:
            for w in _words(r[f]):
                held.setdefault(r["doc_id"], {}).setdefault(w, set()).add(f)
    df = {}
    for words in held.values():
        for w, f in words.items():
            df[w] = df.get(w, 0) + bool(f - {"section"})
    out = []
    for q in questions.collect():
        terms = [w for w in dict.fromkeys(_words(q.text)) if (len(w) > 1 or w.isdigit()) and w not in T.STOP]
        signals = [t for t in terms if t not in P.FILLER and t not in P.INTENT_ONLY]
        said = {n: bool(re.search(p, f" {' '.join(_words(q.text))} ")) for n, p in P.RARITY_INTENTS.items()}
        for r in rows:
            score, hit = 0.0, []
            for t in terms:
                forms = {t} if not re.fullmatch("[a-z]{5,}", t) else {t, t[:-1] if t.endswith("s") else t + "s", t[:-1] if t.endswith("x") else t}
                found = set().union(*(held.get(r["doc_id"], {}).get(x, set()) for x in forms)) | ({"entity_label"} if r["entity"] and t == r["entity"] else set())
                if found:
                    hit.append(t)
                    score += (math.log((len(rows) + 1) / (df.get(t, 0) + 1)) + 1) * sum(P.RARITY_FIELDS[f] for f in found)
            signs = len([t for t in hit if t in signals])
            hay = " ".join(_words(" ".join(r[f] or "" for f in ("title", "entity_label", "section", "topics", "text"))))
            everything = [x for x in rows if x["doc_id"] == r["doc_id"]]
            hays = [" ".join(_words(" ".join(x[f] or "" for f in ("title", "entity_label", "section", "topics", "text")))) for x in everything]
            in_a_row, wording = " ".join(signals), " ".join(_words(q.text))
            phrase = in_a_row != "" and any(in_a_row in h for h in hays)
            score += 12.0 * (len(wording) > 6 and any(wording in h for h in hays)) + 4.0 * phrase
            score += 8.0 * (said["candidate_status"] and r["kind"] == "candidate_status") + 3.0 * (said["programme"] and r["kind"] in ("proposal", "document")) + 4.0 * (said["compare"] and r["kind"] == "proposal")
            score += 2.0 * (said["source"] and r["source_url"] is not None) + 0.8 * (r["confidence"] == "high") + 0.8 * (r["tier"] == "tier_1_primary_official")
            n = len(signals)
            short = n == 2 and re.search(r"(^|\s)[0-9]{1,2}($|\s)", in_a_row)
            fits = any(said.values()) if n == 0 else signs >= (n if n <= 2 else max(2, math.ceil(n / 2))) and (not short or phrase)
            if hit and fits and round(score, 6) >= 1.8:
                out.append((q.item_id, r["doc_id"], r["path"], len(hit), signs, phrase, round(score, 4)))
            assert hay in hays
    return sorted(out)


@pytest.mark.parametrize("block", [3, 20_000])
def test_rarity_of_blocks_equals_every_pair(records, questions, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK_TEXTS", block)
    aliases = records.where("entity is not null").selectExpr("entity", "entity as term").distinct()
    got = P.rarity_profile(P.word_index(records), questions, aliases)
    rows = sorted((r.item_id, r.doc_id, r.path, r.matched, r.hit, r.phrase, round(r.score, 4)) for r in got.collect())
    want = _rarity(records, questions)
    assert len(want) > 30 and rows == want
