"""Checks of a data set's tables: one row an issue with its severity and how many rows it concerns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.functions.ids import ref_id
from kinsift.functions.labels import binary_label


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = reduce(DataFrame.unionByName, parts).where("count > 0")
    return whole.groupBy("severity", "code", "table_name").agg(F.sum("count").alias("count"))


def conditions(df: DataFrame, table: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """A row an issue with how many rows of the table fulfil its condition, all counted in one pass. rules: code:
    (severity, condition); a condition may be an aggregate, which then is the count."""
    counted = df.agg(*[(c if severity == "warning!" else F.count_if(c)).cast("long").alias(code) for code, (severity, c) in rules.items()])
    rows = F.array(*[F.struct(F.lit(severity.rstrip("!")).alias("severity"), F.lit(code).alias("code"), F.col(code).alias("count")) for code, (severity, _) in rules.items()])
    return counted.select(F.inline(rows)).withColumn("table_name", F.lit(table))


def repeated(df: DataFrame, keys: list[Column], table: str, code: str, severity: str = "error") -> DataFrame:
    """Rows of keys (all present) that are there more than once."""
    present = df.where(reduce(lambda a, b: a & b, [k.isNotNull() for k in keys]))
    twice = present.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n")).where("n > 1")
    return twice.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count")).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "count", F.lit(table).alias("table_name"))


def _key_rules(key: str) -> dict[str, tuple[str, Column]]:
    return {"missing_ids": ("error", F.col(key).isNull()), "blank_ids": ("error", F.col(key).isNotNull() & ref_id(key).isNull())}


def reference_issue(df: DataFrame, field: str, parents: DataFrame, key: str, table: str, code: str) -> DataFrame:
    """Rows whose reference is in no parent row; null and blank references are another issue."""
    known = parents.select(ref_id(key).alias("k")).where("k is not null").distinct()
    unknown = df.select(ref_id(field).alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("n")).join(known, "k", "left_anti")
    count = unknown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
    return count.select(F.lit("error").alias("severity"), F.lit(code).alias("code"), "count", F.lit(table).alias("table_name"))


def pair_issues(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(severity, code, count, table_name) of a pair data set; only issues that occur come out. Each table is read
    once for all conditions on its rows, once for repeated keys, and once a reference."""
    left, right = ref_id("left_id"), ref_id("right_id")
    label = binary_label(F.col("label").cast("string"), "strict")
    parts = [
        conditions(files, "files", _key_rules("file_id") | {"empty_files": ("warning", F.coalesce(F.length("text"), F.lit(0)) == 0)}),
        repeated(files, [ref_id("file_id")], "files", "duplicate_ids"),
        conditions(pairs, "pairs", {
            "missing_pair_labels": ("error", F.col("label").isNull()), "invalid_pair_labels": ("error", F.col("label").isNotNull() & label.isNull()),
            "single_class_labels": ("warning!", F.coalesce((F.min(label) == F.max(label)).cast("int"), F.lit(0))),
        }),
        repeated(pairs, [F.when(left.isNotNull() & right.isNotNull(), F.least(left, right)), F.greatest(left, right)], "pairs", "duplicate_pairs", "warning"),
        *[reference_issue(pairs, side, files, "file_id", "pairs", "unknown_pair_file_ids") for side in ("left_id", "right_id")],
    ]
    return _union(parts)


def retrieval_issues(files: DataFrame, queries: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """The same of a retrieval data set."""
    r = F.col("relevance")
    good = F.coalesce(~F.isnan(r) & (r >= 0) & (r < float("inf")), F.lit(False))
    parts = []
    for df, key, table in ((files, "file_id", "files"), (queries, "query_id", "queries"), (corpus, "document_id", "corpus")):
        parts += [conditions(df, table, _key_rules(key)), repeated(df, [ref_id(key)], table, "duplicate_ids")]
    rules = {"invalid_qrel_relevance": ("error", ~good), "no_positive_qrels": ("warning!", 1 - F.coalesce(F.max((good & (r > 0)).cast("int")), F.lit(0)))}
    parts += [
        conditions(qrels, "qrels", rules), repeated(qrels, [ref_id("query_id"), ref_id("document_id")], "qrels", "duplicate_qrels"),
        reference_issue(queries, "file_id", files, "file_id", "queries", "unknown_query_file_ids"),
        reference_issue(corpus, "file_id", files, "file_id", "corpus", "unknown_corpus_file_ids"),
        reference_issue(qrels, "query_id", queries, "query_id", "qrels", "unknown_qrel_query_ids"),
        reference_issue(qrels, "document_id", corpus, "document_id", "qrels", "unknown_qrel_document_ids"),
    ]
    return _union(parts)


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("issue_count"), F.sum("count").alias("row_count"))
