"""French number words as digits, as a fold over the tokens of a normalised text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of number words (fixed values).
VALUES = dict(zip("un une deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize vingt vingts trente quarante cinquante soixante".split(), (1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 20, 20, 30, 40, 50, 60), strict=True))
SCALES = {"cent": 100, "cents": 100, "mille": 1000, "million": 10**6, "millions": 10**6, "milliard": 10**9, "milliards": 10**9}
#: Words that a number counts; without one behind it, a number word stays as it is (fixed values).
UNITS = ("ans", "an", "annees", "euros", "euro", "heures", "heure", "jours", "jour", "mois", "postes", "places", "logements", "pourcent", "pour", "degres", "tonnes", "emplois", "personnes", "kilometres")


def _lookup(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)]).cast("map<string,bigint>")


def number_words(c: Column) -> Column:
    """Number words before a unit become digits: quatre vingt dix ans -> 90 ans, deux mille euros -> 2000 euros. Texts
    with two or more tokens in digits are left alone. c: a normalised text."""
    tokens = F.split(c, " ")
    value, scale = (lambda t: F.try_element_at(_lookup(VALUES), t)), (lambda t: F.try_element_at(_lookup(SCALES), t))
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    pack = lambda out, words, total, now: F.struct(out.alias("out"), words.alias("words"), total.alias("total"), now.alias("now"))

    def step(acc: Column, t: Column) -> Column:
        v, s, active = value(t), scale(t), F.size(acc["words"]) > 0
        small = acc["now"] % 100
        plus = F.when((v == 20) & (small == 4), acc["now"] + 76).otherwise(acc["now"] + v)
        grown = F.greatest(acc["now"], F.lit(1))
        words = F.array_append(acc["words"], t)
        flushed = F.when(active & t.isin(*UNITS), F.array_append(acc["out"], (acc["total"] + acc["now"]).cast("string"))).otherwise(F.concat(acc["out"], acc["words"]))
        return (
            F.when(v.isNotNull(), pack(acc["out"], words, acc["total"], plus))
            .when(s == 100, pack(acc["out"], words, acc["total"], grown * 100))
            .when(s.isNotNull(), pack(acc["out"], words, acc["total"] + grown * s, zero))
            .when(active & (t == "et"), pack(acc["out"], words, acc["total"], acc["now"]))
            .otherwise(pack(F.array_append(flushed, t), none, zero, zero))
        )

    folded = F.aggregate(tokens, pack(none, none, zero, zero), step, lambda acc: F.array_join(F.concat(acc["out"], acc["words"]), " "))
    digits = F.size(F.filter(tokens, lambda t: t.rlike("^[0-9]+$")))
    return F.when(digits >= 2, c).otherwise(folded)
