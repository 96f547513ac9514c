"""Text expressions: folding, normalising, tokens, stems, sentences, excerpts, numbers. All are built-in Column
expressions, so they stay inside generated code and are pushed along with the plan."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin_marks() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and their base letters, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in r]
    pairs = [(a, b) for a, b in pairs if a != b and a == a.lower() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BASE = _latin_marks()

#: Words that carry no meaning in names (fixed values).
NAME_STOP = ("a", "an", "and", "de", "des", "du", "et", "la", "le", "les", "of", "the")


def fold(c: Column) -> Column:
    """Lower case without marks."""
    return F.regexp_replace(F.translate(F.lower(c), _MARKED, _BASE), r"\p{M}", "")


def norm(c: Column) -> Column:
    """Folded; everything but a-z and 0-9 is one space; trimmed."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def normalize(c: Column) -> Column:
    """norm, with digit groups of thousands joined (2 000 -> 2000)."""
    return F.regexp_replace(norm(c), r"(\d{1,3})\s+(?=\d{3}\b)", "$1")


#: Words that carry no meaning in questions and texts (fixed values).
STOP = """
a au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me meme mes moi mon ne nos notre nous on
ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous quel quelle quels quelles
""".split()


def whole_words(c: Column) -> Column:
    """Words of the normalised text in order: longer than one character or numbers, and not stop words."""
    return F.filter(F.split(normalize(c), " "), lambda t: ((F.length(t) > 1) | t.rlike("^[0-9]+$")) & ~t.isin(*STOP))


def words(c: Column) -> Column:
    """Tokens in order: the stems of whole_words."""
    return F.transform(whole_words(c), stem)


def tokens(c: Column) -> Column:
    """Distinct tokens."""
    return F.array_distinct(words(c))


def variants(t: Column) -> Column:
    """A term and, from five letters on, its forms with an s, without its last s and without its last x."""
    long = F.length(t) >= 5
    forms = F.array(t, F.when(long & ~t.endswith("s"), F.concat(t, F.lit("s"))), F.when(long & t.endswith("s"), F.left(t, F.length(t) - 1)), F.when(long & t.endswith("x"), F.left(t, F.length(t) - 1)))
    return F.array_distinct(F.array_compact(forms))


def fnv1a(c: Column) -> Column:
    """The 32-bit FNV-1a hash over a string's UTF-16 units (2166136261 and 16777619 are its fixed values)."""
    h = F.hex(F.encode(c, "UTF-16BE"))
    units = F.transform(F.when(F.length(h) > 0, F.sequence(F.lit(1), F.length(h) - 3, F.lit(4))).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substring(h, i, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda x, u: (x.bitwiseXOR(u) * F.lit(16777619).cast("long")) % F.lit(1 << 32))


def stem(t: Column) -> Column:
    """Light plural stem: -aux (over 6 letters) to -al, -es (over 6) and -s (over 5) cut; short words and numbers stay."""
    n = F.length(t)
    return (
        F.when((n <= 4) | t.rlike("^[0-9]+$"), t)
        .when((n > 6) & t.endswith("aux"), F.concat(F.left(t, n - 3), F.lit("al")))
        .when((n > 6) & t.endswith("es"), F.left(t, n - 2))
        .when((n > 5) & t.endswith("s"), F.left(t, n - 1))
        .otherwise(t)
    )


def compact(c: Column) -> Column:
    """White space collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def sentences(c: Column, least: int = 12) -> Column:
    """Sentences in order, white space collapsed, of at least `least` characters."""
    found = F.regexp_extract_all(c, F.lit(r"[^.!?…]+(?:[.!?…]+|$)"), F.lit(0))
    return F.filter(F.transform(found, compact), lambda s: F.length(s) >= least)


def excerpt(c: Column, target: int = 320) -> Column:
    """Text up to the first sentence end after `target` characters; the whole text if there is none."""
    end = F.regexp_extract(F.substring(c, target + 1, 1 << 30), r"^[^.!?…]*[.!?…]", 0)
    return F.when((F.length(c) <= target) | (end == ""), c).otherwise(F.concat(F.left(c, F.lit(target)), end))


def policy_numbers(c: Column) -> Column:
    """Numbers that aren't glued to letters, with a decimal point, without whole numbers from 1900 to 2100 (years)."""
    parts = F.transform(F.split(c, r"[^0-9\p{L}_.,]+"), lambda p: F.regexp_replace(p, r"^[.,]+|[.,]+$", ""))
    numbers = F.transform(F.filter(parts, lambda p: p.rlike(r"^[0-9]+([.,][0-9]+)?$")), lambda p: F.replace(p, F.lit(","), F.lit(".")))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda p: ~p.rlike(r"^(19[0-9][0-9]|20[0-9][0-9]|2100)$"))))


def acronym(c: Column) -> Column:
    """Initials of a name's words other than stop words; null for fewer than two."""
    kept = F.filter(F.split(F.trim(F.lower(c)), r"\s+"), lambda w: ~w.isin(*NAME_STOP) & (w != ""))
    return F.when(F.size(kept) >= 2, F.array_join(F.transform(kept, lambda w: F.left(w, F.lit(1))), ""))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether a normalised text contains a normalised phrase at word borders."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))) & (phrase != "")


def mask(text: Column, name: Column, mark: str = "[...]") -> Column:
    """A name, and its parts of more than three characters, replaced regardless of case."""
    parts = F.filter(F.split(name, r"\s+"), lambda p: F.length(p) > 3)
    quoted = F.transform(F.array_union(F.array(name), parts), lambda p: F.regexp_replace(p, r"([^A-Za-z0-9_ ])", r"\\$1"))
    return F.regexp_replace(text, F.concat(F.lit("(?i)"), F.array_join(quoted, "|")), F.lit(mark))


def clean_markdown(c: Column) -> Column:
    """Markdown without fences, images, link targets, headings, list bullets, quotes and emphasis."""
    for pattern, to in (
        (r"(?s)```.*?```", " "),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"(?m)^#{1,6}\s*", ""),
        (r"(?m)^\s*(?:[-*+]|\d+\.)\s+", ""),
        (r"(?m)^>\s?", ""),
        (r"[*_`~]+", ""),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def edit_or_swap(a: Column, b: Column) -> Column:
    """Whether two words of at least five letters are at one substitution, insertion or swap of neighbours."""
    n = F.length(a)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    differ = F.filter(F.transform(pairs, lambda p, i: F.struct(p.x.alias("x"), p.y.alias("y"), i.alias("i"))), lambda p: p.x != p.y)
    first, second = F.get(differ, F.lit(0)), F.get(differ, F.lit(1))
    swap = (F.size(differ) == 2) & (second.i == first.i + 1) & (first.x == second.y) & (first.y == second.x)
    return (n >= 5) & (F.length(b) >= 5) & ((F.levenshtein(a, b) == 1) | ((n == F.length(b)) & (F.levenshtein(a, b) == 2) & swap))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
