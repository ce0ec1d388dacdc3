"""A normalised data set on disk, inspected without changing it: a report of what is wrong with its files and tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.functions.ids import strip
from kinsift.operators import validate
from kinsift.sources import readers
from kinsift.sources.readers import contained

PAIR, RETRIEVAL = "pair_classification", "retrieval"
TABLES = {
    PAIR: {"files": ("file_id", "file_path"), "pairs": ("left_id", "right_id", "label")},
    RETRIEVAL: {"files": ("file_id", "file_path"), "queries": ("query_id", "file_id"), "corpus": ("document_id", "file_id"), "qrels": ("query_id", "document_id", "relevance")},
}
_KINDS = {"pair": PAIR, "pairs": PAIR, PAIR: PAIR, "pair-classification": PAIR, RETRIEVAL: RETRIEVAL, "ranking": RETRIEVAL}
MESSAGES = {
    "missing_metadata": "there is no metadata.json", "invalid_metadata_json": "metadata.json is no JSON", "invalid_metadata": "metadata.json holds no object", "invalid_requested_kind": "no such kind of data set",
    "ambiguous_dataset_kind": "the tables are those of both kinds", "unknown_dataset_kind": "the tables are those of neither kind", "metadata_kind_mismatch": "metadata.json names another kind",
    "missing_dataset_name": "metadata.json names no data set", "missing_task_type": "metadata.json names no task", "missing_manifest": "a table is missing", "empty_csv": "a table has not even a header",
    "invalid_csv": "a table can't be read", "missing_columns": "a table lacks columns", "empty_manifest": "a table has no rows", "missing_file_paths": "files without a path", "unsafe_file_paths": "paths that leave the data set",
    "missing_files": "paths of files that aren't there", "non_file_paths": "paths of what is no file", "empty_files": "files without text", "missing_ids": "rows without an id", "blank_ids": "blank ids",
    "duplicate_ids": "rows of repeated ids", "duplicate_pairs": "rows of repeated pairs", "missing_pair_labels": "pairs without a label", "invalid_pair_labels": "labels that are neither 0 nor 1",
    "single_class_labels": "all labels are the same", "unknown_pair_file_ids": "pairs of unknown files", "duplicate_qrels": "rows of repeated judgements", "unknown_query_file_ids": "queries of unknown files",
    "unknown_corpus_file_ids": "documents of unknown files", "unknown_qrel_query_ids": "judgements of unknown queries", "unknown_qrel_document_ids": "judgements of unknown documents",
    "invalid_qrel_relevance": "relevances that are no numbers from 0", "no_positive_qrels": "no judgement is positive",
}


def _metadata(root: Path, found: list) -> dict:
    path = root / "metadata.json"
    if not path.exists():
        found.append(("error", "missing_metadata", "metadata", 1))
        return {}
    try:
        value = json.loads(path.read_text(encoding="utf-8"))
    except ValueError:
        found.append(("error", "invalid_metadata_json", "metadata", 1))
        return {}
    if not isinstance(value, dict):
        found.append(("error", "invalid_metadata", "metadata", 1))
        return {}
    return value


def _kind(root: Path, asked: str, metadata: dict, found: list) -> str | None:
    key = (asked or "auto").strip().lower()
    if key in _KINDS:
        return _KINDS[key]
    if key not in ("auto", ""):
        found.append(("error", "invalid_requested_kind", "", 1))
        return None
    named = str(metadata.get("dataset_kind") or "").strip().lower()
    if named in TABLES:
        return named
    there = [kind for kind, tables in TABLES.items() if all((root / f"{t}.csv").exists() for t in tables)]
    if len(there) == 1:
        return there[0]
    found.append(("error", "ambiguous_dataset_kind" if there else "unknown_dataset_kind", "", 1))
    return None


def _table(spark: SparkSession, root: Path, name: str, columns: tuple[str, ...], found: list, counts: dict) -> DataFrame | None:
    """The table with all its columns as text, or None where it can't be used."""
    path = root / f"{name}.csv"
    counts[name] = 0
    if not path.exists():
        found.append(("error", "missing_manifest", name, 1))
        return None
    try:
        if not path.read_bytes()[:4096].strip():
            found.append(("error", "empty_csv", name, 1))
            return None
        df = readers.read_table(spark, str(path))
    except (OSError, AnalysisException, ValueError):
        found.append(("error", "invalid_csv", name, 1))
        return None
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        found.append(("error", "missing_columns", name, len(lacking)))
        return None
    counts[name] = df.count()
    if not counts[name]:
        found.append(("warning", "empty_manifest", name, 1))
    return df


def _paths(spark: SparkSession, root: Path, files: DataFrame, found: list) -> DataFrame:
    """files with `text`, and what is wrong with their paths. Whether a path stays inside is decided by its text;
    what lies there is looked up in one listing of the data set, the texts in one scan."""
    path = F.replace(F.trim("file_path"), F.lit("\\"), F.lit("/"))
    parts = F.split(path, "/")
    unsafe = path.startswith("/") | path.rlike("^[A-Za-z]:") | F.exists(parts, lambda p: p == "..")
    listed = [(p.relative_to(root).as_posix(), p.is_file()) for p in root.rglob("*") if contained(str(root), p.relative_to(root).as_posix())]
    there = spark.createDataFrame(listed, "p string, is_file boolean")
    texts = readers.read_directory(spark, str(root)).toDF("p", "text")
    both = files.withColumn("p", F.regexp_replace(path, r"^(?:\./)+", "")).join(there, "p", "left").join(texts, "p", "left")
    given = strip("file_path") != ""
    rules = {
        "missing_file_paths": ("error", F.col("file_path").isNull()), "unsafe_file_paths": ("error", F.col("file_path").isNotNull() & unsafe),
        "missing_files": ("error", given & ~unsafe & F.col("is_file").isNull()), "non_file_paths": ("error", given & ~unsafe & (F.col("is_file") == F.lit(False))),
        "empty_files": ("warning", F.col("is_file") & ~unsafe & (strip(F.coalesce("text", F.lit(""))) == "")),
    }
    found += [tuple(r) for r in validate.conditions(both, "files", rules).where("count > 0").select("severity", "code", "table_name", "count").collect()]
    return both.drop("p", "is_file")


def validate_directory(spark: SparkSession, root: str, kind: str = "auto") -> dict:
    """dataset_kind, dataset_name, status (pass, warning, error), counts by table, metadata and issues (severity, code,
    table_name, count, message) of a data set on disk."""
    base = Path(root).expanduser().resolve()
    found: list[tuple] = []
    metadata, counts = _metadata(base, found), {}
    own = _kind(base, kind, metadata, found)
    if own is not None:
        if metadata:
            if str(metadata.get("dataset_kind") or own).strip() != own:
                found.append(("error", "metadata_kind_mismatch", "metadata", 1))
            for key, code in (("name", "missing_dataset_name"), ("task_type", "missing_task_type")):
                if not str(metadata.get(key) or "").strip():
                    found.append(("warning", code, "metadata", 1))
        tables = {name: _table(spark, base, name, columns, found, counts) for name, columns in TABLES[own].items()}
        if tables["files"] is not None:
            tables["files"] = _paths(spark, base, tables["files"], found)
        if all(t is not None for t in tables.values()):
            if own == PAIR:
                issues = validate.pair_issues(tables["files"], tables["pairs"])
            else:
                issues = validate.retrieval_issues(*(tables[t] for t in ("files", "queries", "corpus")), tables["qrels"].withColumn("relevance", F.col("relevance").try_cast("double")))
            found += [(r.severity, r.code, r.table_name, r["count"]) for r in issues.where("code <> 'empty_files'").collect()]
    issues = [{"severity": s, "code": c, "table_name": t, "count": int(n), "message": MESSAGES[c]} for s, c, t, n in sorted(found, key=lambda x: (x[0], x[1], x[2]))]
    status = "error" if any(i["severity"] == "error" for i in issues) else "warning" if issues else "pass"
    return {"schema_version": 1, "dataset_kind": own or "unknown", "dataset_name": str(metadata.get("name") or base.name), "root_name": base.name, "status": status, "counts": counts, "metadata": metadata, "issues": issues}
