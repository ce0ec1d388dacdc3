"""The public word-punctuation rule, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \\s is ASCII; the rule's white space is Unicode's.
_SPACE = r"\t-\r\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = rf"[\p{{L}}\p{{N}}_]++|[^\p{{L}}\p{{N}}_{_SPACE}]++"

TOKEN_SQL = TOKEN.replace("++", "+")


def token_count(text: Column) -> Column:
    """Number of tokens of the whole text; 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("int")


def token_count_sql(expr: str) -> str:
    return f"coalesce(len(regexp_extract_all({expr}, '{TOKEN_SQL}')), 0)"
