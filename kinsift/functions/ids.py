"""Ids and white space, as every table here treats them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode and Python count as white space.
_WHITE_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE = "".join(map(chr, _WHITE_CODES))

#: The same set, as the inside of a Java or RE2 character class.
WHITE_CLASS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(col: Column | str) -> Column:
    """The text without surrounding white space of any kind (null stays null)."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE))


def ref_id(col: Column | str) -> Column:
    """An id as it compares: stripped, and null where nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def strip_sql(expr: str) -> str:
    """strip() in the SQL dialect of the checks."""
    chars = "||".join(f"chr({ord(c)})" for c in WHITE)
    return f"trim({expr}, {chars})"


def ref_id_sql(expr: str) -> str:
    return f"nullif({strip_sql(expr)}, '')"
