"""Token streams and n-grams as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifiers, runs of digits, single symbols; spelled out because \w is ASCII in Java and Unicode in Python.
CODE = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+|[^\p{L}\p{N}_\s\p{Z}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: what a lambda only refers to is evaluated for each element."""
    return F.transform(F.array(value), use)[0]


def _col(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def code_tokens(text: Column | str, lower: bool = False) -> Column:
    tokens = F.regexp_extract_all(_col(text), F.lit(CODE), F.lit(0))
    return F.transform(tokens, F.lower) if lower else tokens


def tranx_tokens(text: Column | str) -> Column:
    """Symbols and camel-case parts apart; quotes as backticks."""
    apart = F.regexp_replace(_col(text), r"([^A-Za-z0-9_])", " $1 ")
    camel = F.regexp_replace(apart, r"([a-z])([A-Z])", "$1 $2")
    flat = F.translate(F.regexp_replace(camel, r"[\s\p{Z}]+", " "), "\"'", "``")
    return F.filter(F.split(flat, " "), lambda x: x != "")


def whitespace_tokens(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), r"[\s\p{Z}]+"), lambda x: x != "")


def ngrams(tokens: Column, n: int, joined: str = " ") -> Column:
    """Contiguous n-grams, joined; empty where there are fewer than n tokens."""

    def cut(t: Column) -> Column:
        spots = F.when((F.size(t) >= n) & F.lit(n > 0), F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.array_join(F.slice(t, i, n), joined))

    return let(tokens, cut)
