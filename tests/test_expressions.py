from datetime import date

from pyspark.sql import functions as F

from attestor.functions import dates as D
from attestor.functions import text as T
from attestor.functions import urls as U


def values(spark, items, make, schema="x string"):
    rows = [(i, x) if not isinstance(x, tuple) else (i, *x) for i, x in enumerate(items)]
    return [r[0] for r in spark.createDataFrame(rows, f"i int, {schema}").select("i", make().alias("v")).orderBy("i").select("v").collect()]


def test_normalize_joins_thousands(spark):
    assert values(spark, ["Élan: 2 000 €!", "1 234 567 d'œufs", None, ""], lambda: T.normalize(F.col("x"))) == ["elan 2000", "1234567 d ufs", None, ""]


def test_stem(spark):
    assert values(spark, ["nationaux", "mesures", "retraites", "pays", "2027", "plans"], lambda: T.stem(F.col("x"))) == ["national", "mesur", "retrait", "pays", "2027", "plans"]


def test_edit_or_swap(spark):
    pairs = [("retraite", "retraites"), ("retraite", "retriate"), ("retraite", "rteriate"), ("abcd", "abce"), ("maison", "saison")]
    assert values(spark, pairs, lambda: T.edit_or_swap(F.col("a"), F.col("b")), "a string, b string") == [True, True, False, False, True]


def test_clean_markdown(spark):
    text = "# Title\n\n- a **bold** [link](http://x)\n> quote\n![i](u)\n```\ncode\n```\nend"
    assert values(spark, [text], lambda: T.compact(T.clean_markdown(F.col("x")))) == ["Title a bold link quote end"]


def test_policy_numbers_leave_years_out(spark):
    assert values(spark, ["En 2027, 64 ans et 1,5 % ; A4 et 2100"], lambda: T.policy_numbers(F.col("x"))) == [["1.5", "64"]]


def test_mask(spark):
    assert values(spark, [("Jean Dupont et dupont, Jean", "Jean Dupont")], lambda: T.mask(F.col("a"), F.col("b"), "X"), "a string, b string") == ["X et X, X"]


def test_canonical_url(spark):
    urls = ["https://Example.com/article?utm_source=x&b=2&a=1#section", "HTTP://A.org", " mailto:x@y ", None]
    assert values(spark, urls, lambda: U.canonical(F.col("x"))) == ["https://example.com/article?a=1&b=2", "http://a.org/", "mailto:x@y", None]


def test_domains_have_no_look_alikes(spark):
    assert values(spark, ["politique.lemonde.fr", "lemonde.fr.example.org", "lemonde.fr"], lambda: U.in_domain(F.col("x"), "lemonde.fr")) == [True, False, True]


def test_social_profiles(spark):
    urls = ["https://x.com/alice", "https://x.com/alice/status/1", "https://www.instagram.com/p/", "https://youtube.com/channel/UC1", "https://www.tiktok.com/@bob"]
    got = values(spark, urls, lambda: U.social_profile(F.col("x")))
    assert [tuple(g) if g else None for g in got] == [("x", "alice"), None, None, ("youtube", "UC1"), ("tiktok", "bob")]


def test_flexible_dates(spark):
    assert values(spark, ["2025", "2025-03", "2025-03-04T10:00:00Z", "2025-13-01", "x"], lambda: D.flexible(F.col("x"))) == [date(2025, 1, 1), date(2025, 3, 1), date(2025, 3, 4), None, None]


def test_dates_supported_by_text(spark):
    rows = [("2026-08-11", "publié le 11 août 2026"), ("2026-08-12", "publié le 11 août 2026"), ("2026-08-11", "le 11/08/2026"), ("2026-08-01", "1er août 2026"), ("2026-08-01", "11 août 2026")]
    assert values(spark, rows, lambda: D.supported_by(F.to_date("a"), F.col("b")), "a string, b string") == [True, False, True, True, False]


def test_scope(spark):
    rows = [("/2022/x", "Programme 2022"), ("/a", "2027 et 2022"), ("/a", "b"), ("/a", "2026")]
    assert values(spark, rows, lambda: D.scope(F.col("a"), F.col("b")), "a string, b string") == ["old", "current", "undated", "current"]
