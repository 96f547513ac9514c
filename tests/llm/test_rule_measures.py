"""The quality rules against brute force, from words to verdicts."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from attestor.llm import quality_rules as R

PIECES, BYTES, SAME = map(public_tokenizers.path, ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))  # the last two are one vocabulary
WORDS = "river stone garden window letter élève straße música 漢字 $$$ a|b <b>".split()


def corpus():
    rnd = random.Random(3)
    rows = []
    for k in range(140):
        words = [rnd.choice(WORDS[:8]) + rnd.choice(WORDS[:8]) for _ in range(rnd.randint(1, 90))]
        if k % 17 == 0:
            words = [rnd.choice(["\U00012000\U00012001", "\U00012003"]) for _ in words]
        if k % 19 == 0:
            words = words[:1] * (len(words) // 2) + words
        if k % 23 == 0:
            words += words[:12]
        rows.append((k, "".join(w + rnd.choice(" \n\t") for w in words) + rnd.choice(["", "\n\n", "#"]), ["en", "fr", None, "EN"][k % 4]))
    tail = [f"w{k}x{j}" for k in range(300) for j in range(2)]
    return rows + [(500, None, "en"), (501, " \n ", "en"), (502, "one line\none line\n\none line", "en"), (503, " ".join(tail + ["end"] * 200), "en")] + [rows[5], rows[5]]


def brute(rows):
    pieces, library = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(SAME)
    half = {k for k in range(library.get_vocab_size()) if "�" in library.decode([k], skip_special_tokens=False)}

    def entropy(ids):
        width = min(256, len(ids))
        if width < 2:
            return 1.0
        windows = [ids[k : k + width] for k in range(0, len(ids) - width + 1, width)]
        if len(ids) % width:
            windows.append(ids[-width:])
        return sum(-sum(c / width * math.log(c / width) for c in Counter(w).values()) for w in windows) / len(windows) / math.log(width)

    out = []
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        places: dict = {}
        for k in range(len(words) - 7):
            places.setdefault(tuple(words[k : k + 8]), []).append(k)
        marked = {p for at in places.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
        row = {"doc_id": doc, "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(marked)}
        row["base_failed"] = len(words) < 20 or 100 * len(marked) > 30 * len(words)
        row["language"] = lang.lower() if lang else "und"
        for name, ids, bad in (("", [i for w in words for i in pieces.encode(w)], lambda i: pieces.is_byte(i) or pieces.is_unknown(i)), ("_2", [i for w in words for i in library.encode(" " + w, add_special_tokens=False).ids], half.__contains__)):
            n = max(1, len(ids))
            row[f"chars_per_token{name}"], row[f"byte_share{name}"], row[f"entropy{name}"] = round(row["word_chars"] / n, 4), round(sum(map(bad, ids)) / n, 4), round(entropy(ids), 4)
        out.append(row)
    for row in out:
        same = [r for r in out if r["language"] == row["language"] and not r["base_failed"]]
        row["kept"] = not row["base_failed"]
        for name in ("chars_per_token", "byte_share", "entropy", "chars_per_token_2", "byte_share_2", "entropy_2"):
            if not same:
                continue
            values = sorted(r[name] for r in same)
            low, high = (values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.75))
            margin = {"chars_per_token": 0.35, "byte_share": 0.02, "entropy": 0.05, "byte_share_2": 0.15}.get(name) or {"chars_per_token_2": 0.35, "entropy_2": 0.05}[name]
            width = max(4 * (high - low), margin)
            if not name.startswith("byte") and row[name] < low - width or not name.startswith("entropy") and row[name] > high + width:
                row["kept"] = False
    return out


def test_rules_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, x, "low", 1) for d, t, x in rows], "doc_id long, text string, lang string, language string, measure int")
    got = [r.asDict() for r in R.judge(df, [PIECES, BYTES]).collect()]
    want = brute(rows)
    key = lambda r: (r["doc_id"], r["n_words"])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        for name, value in b.items():
            assert a[name] == (pytest.approx(value, abs=1.1e-4) if isinstance(value, float) else value), (a["doc_id"], name)
    assert {r["kept"] for r in want if not r["base_failed"]} == {True, False}


def test_empty_tables_and_very_long_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert R.judge(df, [PIECES, BYTES]).count() == 0
    long = spark.createDataFrame([(1, "river stone garden " * 60_000 + "end", "en"), (None, "x", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in R.judge(long, [PIECES]).collect()}
    assert got[1].n_words == 180_001 and got[1].base_failed and got[None].n_words == 1


def test_quartiles_do_not_depend_on_the_order_of_rows(spark):
    rnd = random.Random(8)
    rows = [("en", round(rnd.random(), 4)) for _ in range(999)] + [("fr", 0.5)]
    found = []
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "language string, m double").repartition(7)
        found.append({r.language: (r.low, r.high) for r in R.quartiles(df, ["m"]).collect()})
    values = sorted(v for x, v in rows if x == "en")
    assert found[0] == found[1] == {"en": (values[math.ceil(0.25 * 999) - 1], values[math.ceil(0.75 * 999) - 1]), "fr": (0.5, 0.5)}
