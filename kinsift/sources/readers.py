"""Collections of source files and normalised data sets, read as DataFrames."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "left_id string, right_id string, label string"
QUERIES = "query_id string, file_id string"
CORPUS = "document_id string, file_id string"
QRELS = "query_id string, document_id string, relevance double"
_OUT = "file_name string, code string"
_ARROW = pa.schema([("file_name", pa.string()), ("code", pa.string())])


def _visible(name: str) -> bool:
    return not any(part.startswith(".") for part in PurePosixPath(name).parts)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, code) of a directory, walked whole, or of a zip archive; hidden paths are left out, undecodable
    bytes ignored. Any other path is an error. A file is read by one task as a whole."""
    where = Path(path)
    if where.is_dir():
        return read_directory(spark, path)
    if where.is_file() and zipfile.is_zipfile(where):
        return read_zip(spark, path)
    raise ValueError(f"neither a directory nor a zip archive: {path}")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    root = Path(path).resolve().as_posix()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        for batch in batches:
            names, codes = [], []
            for url, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                name = unquote(url).split(":", 1)[-1]
                name = "/" + name.lstrip("/")
                relative = name[len(root) :].lstrip("/") if name.startswith(root) else name
                if _visible(relative):
                    names.append(relative)
                    codes.append((content or b"").decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(codes, pa.string())], schema=_ARROW)

    read = files.mapInArrow(decode, _OUT)
    # Spark's scan leaves out files without content.
    empty = [(p.relative_to(root).as_posix(), "") for p in Path(root).rglob("*") if p.is_file() and not p.stat().st_size]
    empty = [x for x in empty if _visible(x[0])]
    return read.unionByName(spark.createDataFrame(empty, _OUT)) if empty else read


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    archives = spark.read.format("binaryFile").load(path).select("content")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for info in archive.infolist():
                        if not info.is_dir() and _visible(info.filename):
                            code = archive.read(info).decode("utf-8", "ignore")
                            yield pa.RecordBatch.from_arrays([pa.array([info.filename]), pa.array([code])], schema=_ARROW)

    return archives.mapInArrow(members, _OUT)


def safe_members(archive: zipfile.ZipFile, destination: str) -> list[zipfile.ZipInfo]:
    """The archive's members; one that would leave the destination, or is a link, is an error."""
    root = Path(destination).resolve()
    for info in archive.infolist():
        target = (root / info.filename).resolve()
        if not target.is_relative_to(root) or (info.external_attr >> 16) & 0o170000 == 0o120000:
            raise ValueError(f"unsafe archive member: {info.filename}")
    return archive.infolist()


def extract_archive(path: str, destination: str) -> None:
    """A zip or tar archive unpacked; members and links that would leave the destination are an error."""
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as archive:
            archive.extractall(destination, safe_members(archive, destination))
        return
    root = Path(destination).resolve()
    with tarfile.open(path) as archive:
        for member in archive.getmembers():
            targets = [root / member.name] + ([(root / member.name).parent / member.linkname] if member.issym() or member.islnk() else [])
            if not all(t.resolve().is_relative_to(root) for t in targets) or member.isdev():
                raise ValueError(f"unsafe archive member: {member.name}")
        archive.extractall(destination, filter="data")


def extract_zip(path: str, destination: str) -> None:
    if not zipfile.is_zipfile(path):
        raise ValueError(f"no zip archive: {path}")
    extract_archive(path, destination)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """csv, tsv, tab, jsonl, json or parquet by suffix. Without a schema all csv columns are strings: ids keep
    their zeros, nothing is inferred."""
    suffix = Path(path).suffix.lower()
    if suffix in (".csv", ".tsv", ".tab"):
        reader = spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').option("sep", "," if suffix == ".csv" else "\t")
        whole = reader.csv(path)
        if schema is None:
            return whole
        typed = spark.createDataFrame([], schema).schema
        missing = [f.name for f in typed if f.name not in whole.columns]
        if missing:
            raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
        return whole.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in typed})
    if suffix == ".jsonl":
        return spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    if suffix == ".json":
        reader = spark.read.option("multiLine", "true")
        return reader.schema(schema).json(path) if schema else reader.json(path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported table format: {path}")


def discover_tables(root: str, table: str | None = None, split: str | None = None) -> list[str]:
    """Table files below root: the requested one first, then those whose name speaks of the split, then the rest."""
    suffixes = {".csv", ".tsv", ".tab", ".jsonl", ".json", ".parquet"}
    found = sorted(p for p in Path(root).rglob("*") if p.suffix.lower() in suffixes and _visible(str(p.relative_to(root))))
    wanted = (split or "").strip().lower()
    names = {wanted, wanted.replace("-", "_"), wanted.replace("_", "-")} - {""}

    def place(p: Path) -> tuple[int, str]:
        if table and (str(p.relative_to(root)) == table or p.name == table):
            return 0, str(p)
        return (1 if p.stem.lower() in names or p.name.lower() in names else 2), str(p)

    return [str(p) for p in sorted(found, key=place)]


def contained(root: str, relative: str) -> Path:
    """The path below root; one that leaves it is an error."""
    base = Path(root).resolve()
    target = (base / relative).resolve()
    if Path(relative).is_absolute() or not target.is_relative_to(base):
        raise ValueError(f"path leaves the data set: {relative}")
    return target


def read_metadata(root: str) -> dict:
    path = Path(root) / "metadata.json"
    if not path.is_file():
        raise FileNotFoundError(f"no metadata.json in {root}")
    value = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError("metadata.json must hold an object")
    return value


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_id, file_path, ..., text): the manifest with the texts it names."""
    manifest = read_table(spark, f"{root}/files.csv", "file_id string, file_path string")
    texts = read_directory(spark, root).withColumnRenamed("file_name", "file_path").withColumnRenamed("code", "text")
    return manifest.join(texts, "file_path", "left")


def read_pair_dataset(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, dict]:
    """(files, pairs, metadata) of a normalised data set."""
    return read_files(spark, root), read_table(spark, f"{root}/pairs.csv", PAIRS), read_metadata(root)


def read_retrieval_dataset(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, dict]:
    """(files, queries, corpus, qrels, metadata) of a normalised data set."""
    tables = [read_table(spark, f"{root}/{name}.csv", schema) for name, schema in (("queries", QUERIES), ("corpus", CORPUS), ("qrels", QRELS))]
    return read_files(spark, root), *tables, read_metadata(root)


def read_trec_qrels(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(query_id, document_id, relevance): lines of four or more fields are query, run, document, relevance; of two
    or three, query and document with relevance 1. Other lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    reader = spark.read if pattern is None else spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    rows = reader.text(path).select(parts.alias("p")).where(F.size("p") >= 2)
    four = F.size("p") >= 4
    return rows.select(F.col("p")[0].alias("query_id"), F.when(four, F.get("p", F.lit(2))).otherwise(F.col("p")[1]).alias("document_id"), F.when(four, F.get("p", F.lit(3)).try_cast("double")).otherwise(1.0).alias("relevance"))
