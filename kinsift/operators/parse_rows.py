"""Exported records into typed rows, and the unusable ones apart with their reason.

Method: every record is parsed into cells, the cells are exploded into (row, column, value), a rule table is
joined to them, the rules are evaluated, errors are aggregated by row, and clean rows are what an anti-join
leaves. Everything is built from JVM expressions; quoting is read with possessive patterns, which need no
stack, so that a field may be of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.functions.ids import strip
from kinsift.functions.labels import NUMBER, STRICT_NEGATIVE, STRICT_POSITIVE

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
WELL_QUOTED = rf"(?s)\A{_FIELD}(?:,{_FIELD})*+\z"
_NEXT = r'(?s),("[^"]*+(?:""[^"]*+)*+"|[^",]*+)'

#: target, column (-1: the record's quoting, -2: its number of fields), rule, what the rule compares with,
#: rank of the reason, reason.
RULES = [
    (target, *rule)
    for target, third in (("pairs", "label"), ("qrels", "relevance"))
    for rule in (
        (-1, "equals", "good", 1, "bad_quoting"),
        (-2, "equals", "4", 2, "column_count"),
        (0, "id", "", 3, "bad_value"),
        (1, "id", "", 3, "bad_value"),
        (2, third, "", 3, "bad_value"),
    )
]
_RULE_SCHEMA = "target string, col int, rule string, arg string, rank int, reason string"


def split_record(line: Column) -> Column:
    """The fields of a record, unquoted; null where its quoting is broken."""
    body = F.regexp_replace(F.coalesce(line, F.lit("")), r"\r\z", "")
    raw = F.regexp_extract_all(F.concat(F.lit(","), body), F.lit(_NEXT), F.lit(1))
    plain = F.transform(
        raw,
        lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x),
    )
    return F.when(body.rlike(WELL_QUOTED), plain)


def usable_label(text: Column) -> Column:
    """0, 1 or null for a stripped label."""
    key = F.lower(text)
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(key.isin(STRICT_POSITIVE) | (number == 1), 1).when(key.isin(STRICT_NEGATIVE) | (number == 0), 0)


def usable_relevance(text: Column) -> Column:
    """A finite number of at least 0, or null."""
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when((number >= 0) & (number < float("inf")), number)


_NAMES = {"pairs": ("left_id", "right_id", "label", "problem"), "qrels": ("query_id", "document_id", "relevance", "comment")}


def _split(lines: DataFrame, targets: list[str]) -> DataFrame:
    return lines.where(F.col("target").isin(targets)).select(
        "raw_id", "target", F.coalesce("raw_id", F.lit(-1)).alias("_row"), F.xxhash64("line").alias("_text"), split_record(F.col("line")).alias("_fields")
    )


def _errors(rows: DataFrame) -> DataFrame:
    """(_row, _text, target, raw_id, reason) of the records that break a rule."""
    pair = lambda col, value: F.struct(F.lit(col).cast("int").alias("col"), value.alias("value"))
    head = F.array(
        pair(-1, F.when(F.col("_fields").isNull(), "bad").otherwise("good")),
        pair(-2, F.when(F.col("_fields").isNotNull(), F.size("_fields").cast("string"))),
    )
    body = F.transform(F.slice(F.coalesce("_fields", F.array().cast("array<string>")), 1, 3), lambda x, i: F.struct(i.alias("col"), x.alias("value")))
    cells = rows.select("raw_id", "_row", "_text", "target", F.inline(F.concat(head, body)))
    rules = rows.sparkSession.createDataFrame(RULES, _RULE_SCHEMA)  # fixed: ten rules
    value, text = F.col("value"), strip("value")
    holds = (
        F.when(F.col("rule") == "equals", value.isNull() | (value == F.col("arg")))
        .when(F.col("rule") == "id", (text != "") & ~text.contains("/") & ~text.contains("\\"))
        .when(F.col("rule") == "label", usable_label(text).isNotNull())
        .when(F.col("rule") == "relevance", usable_relevance(text).isNotNull())
    )
    broken = cells.join(F.broadcast(rules), ["target", "col"]).where(~holds).groupBy("_row", "_text", "target", "raw_id")
    return broken.agg(F.min(F.struct("rank", "reason")).alias("first")).select("_row", "_text", "target", "raw_id", "first.reason")


def unusable_rows(lines: DataFrame, targets: list[str] = ("pairs", "qrels")) -> DataFrame:
    """(raw_id, reason) of the unusable records of several targets, in one pass; see parse_rows()."""
    return _errors(_split(lines, list(targets))).select("raw_id", "reason")


def parse_rows(lines: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(usable, unusable) of the rows of `lines` (raw_id, target, line; other columns are left alone).

    usable: raw_id, the first two fields stripped, the typed third and the fourth, named as in the target.
    unusable: raw_id, reason (the first that applies: bad_quoting, column_count, bad_value).
    A null line is an empty record (column_count); rows of another or a null target are in neither result.
    Repeated rows are judged each by itself and stay repeated in usable; unusable has each raw_id and reason
    once per distinct record. No cut-offs, no sampling: a record may hold any number of fields of any length."""
    names, rows = _NAMES[target], _split(lines, [target])
    errors = _errors(rows)
    good = rows.join(errors, ["_row", "_text"], "left_anti")
    third = usable_label(strip(F.col("_fields")[2])) if target == "pairs" else usable_relevance(strip(F.col("_fields")[2]))
    usable = good.select(
        "raw_id", strip(F.col("_fields")[0]).alias(names[0]), strip(F.col("_fields")[1]).alias(names[1]), third.alias(names[2]), F.col("_fields")[3].alias(names[3])
    )
    return usable, errors.select("raw_id", "reason")
