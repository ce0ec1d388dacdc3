"""Writers: normalised data sets, score tables, metrics, run cache, registry and HTML reports."""

from __future__ import annotations

import hashlib
import html
import importlib.metadata
import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _one_csv(df: DataFrame, path: str) -> None:
    """A small table as one csv file; rows pass the driver one by one, not all at once."""
    import csv

    with Path(path).open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])


def write_pair_dataset(files: DataFrame, pairs: DataFrame, metadata: dict, root: str) -> None:
    """metadata.json, files.csv, pairs.csv and files/<id><suffix>. For data beyond one machine write_parquet()."""
    _write_files(files, root)
    _one_csv(pairs, f"{root}/pairs.csv")
    _write_json(f"{root}/metadata.json", metadata)


def write_retrieval_dataset(files: DataFrame, queries: DataFrame, corpus: DataFrame, qrels: DataFrame, metadata: dict, root: str) -> None:
    _write_files(files, root)
    for name, df in (("queries", queries), ("corpus", corpus), ("qrels", qrels)):
        _one_csv(df, f"{root}/{name}.csv")
    _write_json(f"{root}/metadata.json", metadata)


def _write_files(files: DataFrame, root: str) -> None:
    base = Path(root) / "files"
    base.mkdir(parents=True, exist_ok=True)
    rows = []
    for r in files.select("file_id", "text", *(["suffix"] if "suffix" in files.columns else [])).orderBy("file_id").toLocalIterator():
        suffix = (r["suffix"] if "suffix" in files.columns else None) or ".txt"
        name = f"{r.file_id}{suffix if suffix.startswith('.') else '.' + suffix}"
        if Path(name).name != name or name.startswith("."):
            raise ValueError(f"unsafe file id: {r.file_id}")
        (base / name).write_bytes((r.text or "").encode("utf-8", "surrogatepass"))
        rows.append((r.file_id, f"files/{name}"))
    lines = ["file_id,file_path", *(f'"{a}","{b}"' for a, b in rows)]
    (Path(root) / "files.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")


def write_parquet(tables: dict[str, DataFrame], metadata: dict, root: str) -> None:
    """The native layout: a parquet folder a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")
    _write_json(f"{root}/metadata.json", metadata)


def _write_json(path: str, value: object) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def write_scores(scored: DataFrame, path: str) -> None:
    _one_csv(scored, path)


def write_metrics(metrics: DataFrame, path: str) -> dict:
    value = metrics.first().asDict(recursive=True)
    _write_json(path, value)
    return value


def html_page(title: str, *parts: str) -> str:
    return f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>\n"


def html_rows(columns: list[str], rows) -> str:
    """A table of results; every value escaped."""
    cell = lambda v: html.escape("" if v is None else str(v))
    head = "".join(f"<th>{cell(c)}</th>" for c in columns)
    return f"<table><thead><tr>{head}</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in row) + "</tr>" for row in rows) + "</tbody></table>"


def html_table(df: DataFrame, title: str, limit: int | None = None) -> str:
    """A static page of a table of results: all of it, or its first `limit` rows, and the page says so then."""
    rows = list(df.toLocalIterator()) if limit is None else df.limit(limit + 1).collect()
    more = limit is not None and len(rows) > limit
    note = f"<p>The first {limit} rows.</p>" if more else ""
    return html_page(title, note, html_rows(df.columns, rows[:limit]))


def cache_key(config: dict, fingerprint: str, versions: dict, seed: int | None = None) -> str:
    text = json.dumps({"config": config, "fingerprint": fingerprint, "versions": versions, "seed": seed}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def versions(names: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy")) -> dict[str, str | None]:
    out = {}
    for name in names:
        try:
            out[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            out[name] = None
    return out


def _cache_path(root: str, key: str) -> Path:
    return Path(root) / key[:2] / key


def is_cached(root: str, key: str) -> bool:
    return (_cache_path(root, key) / "results.parquet" / "_SUCCESS").exists()


def cached(spark: SparkSession, root: str, key: str, make, metadata: dict | None = None) -> DataFrame:
    """make()'s result, kept as parquet under <key[:2]>/<key> beside metadata.json; made only where it isn't there."""
    path = _cache_path(root, key)
    if not is_cached(root, key):
        make().write.mode("overwrite").parquet(str(path / "results.parquet"))
        _write_json(str(path / "metadata.json"), {"key": key, "created_utc": now(), **(metadata or {})})
    return spark.read.parquet(str(path / "results.parquet"))


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def register_run(path: str, run: dict) -> list[dict]:
    """Adds or replaces a run (by run_id) in a JSON registry, in the order of (created_at, run_id)."""
    runs = json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else []
    runs = [r for r in runs if r["run_id"] != run["run_id"]] + [run]
    runs.sort(key=lambda r: (r["created_at"], r["run_id"]))
    _write_json(path, runs)
    return runs
