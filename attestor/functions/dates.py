"""Date expressions: flexible dates, dates supported by a text, election scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: French month names (fixed values).
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


def flexible(c: Column) -> Column:
    """A day, a year and month, or a year, as a date (first day); null where it isn't one."""
    s = F.trim(c)
    full = F.when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01"))).when(s.rlike(r"^\d{4}-\d{2}$"), F.concat(s, F.lit("-01"))).when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(s, F.lit(10)))
    return F.try_to_date(full, "yyyy-MM-dd")


def supported_by(date: Column, text: Column) -> Column:
    """Whether a date is written in a text: ISO, dd/mm/yyyy, d/m/yyyy, with points, or day, month name and year."""
    day, month, year = F.dayofmonth(date), F.month(date), F.year(date).cast("string")
    name = F.element_at(F.array(*map(F.lit, MONTHS)), month)
    forms = [F.date_format(date, p) for p in ("yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "dd.MM.yyyy", "d.M.yyyy")]
    forms += [F.concat_ws(" ", day.cast("string"), name, year), F.when(day == 1, F.concat_ws(" ", F.lit("1er"), name, year))]
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}0-9./-]+", " "), F.lit(" "))
    return F.exists(F.filter(F.array(*forms), lambda f: f.isNotNull()), lambda f: F.regexp_instr(spaced, F.concat(F.lit("(?<![0-9])"), F.replace(f, F.lit("."), F.lit("[.]")), F.lit("(?![0-9])"))) > 0)


def scope(url: Column, title: Column, cycle: str = "2027", last_old: int = 2024) -> Column:
    """current, old or undated: a page that names years up to last_old, and not the cycle, is about an older election."""
    text = F.lower(F.concat_ws(" ", url, title))
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(19\d\d|20\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.when(F.contains(text, F.lit(cycle)), "current").when(F.size(years) == 0, "undated").when(F.array_max(years) <= last_old, "old").otherwise("current")


def date_label(basis: Column, day: Column) -> Column:
    """Wording of a date that tells a capture from a publication."""
    return F.when(basis == "capture_fallback", F.concat(F.lit("captured on "), day, F.lit(" (publication date not exposed)"))).otherwise(day)
