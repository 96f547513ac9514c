"""Registration of queries: a Spark callable and, where SQL can express it, its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestor.functions.text import STOP

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """A decorator that registers a function under its name."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return add


# DuckDB fragments that equal attestor.functions.text: norm, normalize, stem and the words of a text.
def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


def sql_normalize(x: str) -> str:
    out = sql_norm(x)
    for _ in range(2):  # without lookahead, neighbouring groups of thousands take two passes with a mark between them
        out = f"regexp_replace({out}, '(\\d) (\\d{{3}})\\b', '\\1~\\2', 'g')"
    return f"replace({out}, '~', '')"


def sql_stem(x: str) -> str:
    return f"""(CASE WHEN length({x}) <= 4 OR regexp_full_match({x}, '[0-9]+') THEN {x}
    WHEN length({x}) > 6 AND {x} LIKE '%aux' THEN left({x}, length({x}) - 3) || 'al'
    WHEN length({x}) > 6 AND {x} LIKE '%es' THEN left({x}, length({x}) - 2)
    WHEN length({x}) > 5 AND {x} LIKE '%s' THEN left({x}, length({x}) - 1) ELSE {x} END)"""


_STOP = ", ".join(f"'{w}'" for w in STOP)


def sql_whole_words(x: str) -> str:
    return f"list_filter(string_split({sql_normalize(x)}, ' '), lambda w: (length(w) > 1 OR regexp_full_match(w, '[0-9]+')) AND w NOT IN ({_STOP}))"


def sql_words(x: str) -> str:
    return f"list_transform({sql_whole_words(x)}, lambda w: {sql_stem('w')})"


def sql_compact(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
