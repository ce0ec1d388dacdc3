"""Foreign data set layouts as normalised tables: names of files and folders parsed, pairs built by joins."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.operators import datasets
from kinsift.operators.datasets import generated_id
from kinsift.session import cut
from kinsift.sources import readers, sinks
from kinsift.sources.registry import ADAPTERS


def case_pairs(files: DataFrame) -> DataFrame:
    """(left_id, right_id, label, case_id) of files in case-*/original, plagiarized or non-plagiarized folders:
    every original of a case with every other file of it. files: file_id, file_path."""
    parts = files.select("file_id", F.regexp_extract("file_path", r"(?:^|/)(case-[^/]+)/", 1).alias("case_id"), F.regexp_extract("file_path", r"/(original|plagiarized|non-plagiarized)/", 1).alias("kind")).where("case_id <> '' and kind <> ''")
    left = parts.where("kind = 'original'").select(F.col("file_id").alias("left_id"), "case_id")
    right = parts.where("kind <> 'original'").select(F.col("file_id").alias("right_id"), "case_id", (F.col("kind") == "plagiarized").cast("int").alias("label"))
    return left.join(right, "case_id").select("left_id", "right_id", "label", "case_id")


def version_pairs(files: DataFrame, labels: DataFrame) -> DataFrame:
    """(left_id, right_id, label, problem) of a label table (sub1, sub2, problem, verdict) over files named after
    submissions; where a stem is there more than once, the one in version_<problem> is taken. Pairs without both
    files are dropped."""
    stems = files.select("file_id", F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), F.regexp_extract("file_path", r"version_([^/]+)/", 1).alias("version"))
    rows = labels.select("sub1", "sub2", F.col("problem").cast("string").alias("problem"), "verdict")

    def side(rows: DataFrame, sub: str, out: str) -> DataFrame:
        met = rows.join(stems, F.col(sub) == F.col("stem"))
        best = F.min(F.struct((F.col("version") != F.col("problem")).alias("other"), F.col("file_id"))).alias("best")
        return met.groupBy(*rows.columns).agg(best).withColumn(out, F.col("best.file_id")).drop("best")

    both = side(side(rows, "sub1", "left_id"), "sub2", "right_id")
    return both.select("left_id", "right_id", F.col("verdict").cast("int").alias("label"), "problem")


def course_pairs(files: DataFrame) -> DataFrame:
    """(left_id, right_id, label, course, assignment) of files named course/A1-(P|NP)-Sol-n[-variant]: all pairs
    within a course's assignment, positive where both are marked P and of the same solution. The output is all
    pairs by definition of the data set; assignments are joined on their key."""
    name = r"([^/]+)/(A\d+)-(P|NP)-Sol-(\d+)[^/]*$"
    parts = files.where(~F.col("file_path").endswith(".ast")).select("file_id", "file_path", *[F.regexp_extract("file_path", name, i).alias(c) for i, c in enumerate(("course", "assignment", "mark", "solution"), 1)]).where("course <> ''")
    a, b = parts.alias("a"), parts.alias("b")
    same = (F.col("a.course") == F.col("b.course")) & (F.col("a.assignment") == F.col("b.assignment")) & (F.col("a.file_path") < F.col("b.file_path"))
    label = ((F.col("a.mark") == "P") & (F.col("b.mark") == "P") & (F.col("a.solution") == F.col("b.solution"))).cast("int")
    return a.join(b, same).select(F.col("a.file_id").alias("left_id"), F.col("b.file_id").alias("right_id"), label.alias("label"), F.col("a.course").alias("course"), F.col("a.assignment").alias("assignment"))


def original_pairs(originals: DataFrame, copies: DataFrame) -> DataFrame:
    """(left_id, right_id, label, original_id): every copy with every original. 1 for the original of the copy's whole
    key (original, group, university), or where there is none, for those of its original's number; 0 for the others.
    originals, copies: file_id, original_id, grp, university. The output is all of them by definition of the data set."""
    key = ["original_id", "grp", "university"]
    left = originals.select(F.col("file_id").alias("left_id"), *[F.col(c).alias(f"l_{c}") for c in key])
    exact = copies.join(originals.select(*key).distinct(), key, "left_semi").select("file_id", F.lit(True).alias("exact"))
    right = copies.join(exact, "file_id", "left").select(F.col("file_id").alias("right_id"), *[F.col(c).alias(f"r_{c}") for c in key], F.coalesce("exact", F.lit(False)).alias("exact"))
    number = F.col("l_original_id") == F.col("r_original_id")
    whole = number & (F.col("l_grp") == F.col("r_grp")) & (F.col("l_university") == F.col("r_university"))
    label = F.when(F.col("exact"), whole).otherwise(number).cast("int")
    return left.crossJoin(right).select("left_id", "right_id", label.alias("label"), F.col("r_original_id").alias("original_id"))


def case_retrieval(files: DataFrame) -> dict[str, DataFrame]:
    """queries, corpus and qrels of the files case_pairs() reads: the first original of a case is a document, its other
    files are queries judged 1 if plagiarized."""
    pairs = case_pairs(files)
    first = pairs.groupBy("case_id").agg(F.min("left_id").alias("left_id"))
    own = pairs.join(first, ["case_id", "left_id"])
    named = own.select("case_id", "label", "left_id", "right_id", generated_id("document", F.col("left_id")).alias("document_id"), generated_id("query", F.col("right_id")).alias("query_id"))
    return {
        "queries": named.select("query_id", F.col("right_id").alias("file_id")).distinct(),
        "corpus": named.select("document_id", F.col("left_id").alias("file_id")).distinct(),
        "qrels": named.select("query_id", "document_id", F.col("label").cast("double").alias("relevance")).distinct(),
    }


def judged_files(files: DataFrame, qrels: DataFrame) -> dict[str, DataFrame]:
    """queries, corpus and qrels of judgements whose ids are file names or stems (see read_trec_qrels), and `skipped`,
    the number of judgements of which a file is missing. Of several files of one name the first path counts."""
    name = F.regexp_extract("file_path", r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    plain = files.where(~F.lower(name).contains("qrel") & ~name.startswith("."))
    known = plain.select(F.explode(F.array_distinct(F.array(name, stem))).alias("token"), "file_path", "file_id").groupBy("token").agg(F.min_by("file_id", "file_path").alias("file_id"))
    base = lambda c: F.regexp_extract(c, r"([^/\\]+)$", 1)
    rows = qrels
    for side in ("query", "document"):
        one, two = known.toDF("_t1", f"_{side}_1"), known.toDF("_t2", f"_{side}_2")
        rows = rows.join(one, F.col(f"{side}_id") == F.col("_t1"), "left").drop("_t1").join(two, base(f"{side}_id") == F.col("_t2"), "left").drop("_t2")
        rows = rows.withColumn(f"{side}_file", F.coalesce(f"_{side}_1", f"_{side}_2")).drop(f"_{side}_1", f"_{side}_2")
    rows = cut(rows)
    met = rows.where("query_file is not null and document_file is not null")
    return {
        "queries": met.groupBy("query_id").agg(F.min("query_file").alias("file_id")), "corpus": met.groupBy("document_id").agg(F.min("document_file").alias("file_id")),
        "qrels": met.select("query_id", "document_id", "relevance"), "skipped": rows.agg(F.count_if(F.col("query_file").isNull() | F.col("document_file").isNull()).alias("skipped")),
    }


#: Suffixes of source files that make up a submission.
SOURCE_SUFFIXES = ("java", "py", "c", "cpp", "h", "hpp", "cs", "js", "ts", "go", "rb", "php", "kt", "scala", "swift", "rs", "txt")


def submission_units(files: DataFrame) -> DataFrame:
    """(file_id, source_label, original_id, grp, university, text) of files (file_path, text) below code/orig and
    code/plag: a unit is the shallowest file or folder whose path names an original (o1, o2, ...); it holds all its
    source files, each under a comment with its path. A unit of a folder is bounded by what a person handed in."""
    path = F.regexp_extract("file_path", r"(?:^|/)(?:orig|plag)/(.+)$", 1)
    label = F.when(F.col("file_path").rlike(r"(?:^|/)orig/"), "original").when(F.col("file_path").rlike(r"(?:^|/)plag/"), "plagiarized")
    rows = files.where(F.lower("file_path").rlike(r"\.(?:" + "|".join(SOURCE_SUFFIXES) + r")$") & ~F.col("file_path").rlike(r"(?:^|/)\."))
    rows = rows.select(label.alias("source_label"), path.alias("path"), F.coalesce("text", F.lit("")).alias("text")).where("path <> '' and source_label is not null")
    parts = F.split("path", "/")
    token = r"(?i)(?:^|[^a-z0-9])o\d+(?=$|[^a-z0-9])"
    depth = F.array_position(F.transform(parts, lambda p: p.rlike(token)), F.lit(True)).cast("int")
    rows = rows.withColumn("depth", depth).where("depth > 0").withColumn("unit", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    inner = F.when(F.length("unit") < F.length("path"), F.expr("substring(path, length(unit) + 2)")).otherwise(F.element_at(parts, -1))
    named = rows.select("source_label", "unit", F.struct(inner.alias("name"), "text").alias("file"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("file")), lambda f: F.concat(F.lit("// "), f["name"], F.lit("\n"), f["text"])), "\n\n")
    units = named.groupBy("source_label", "unit").agg(body.alias("text"))
    low = F.lower("unit")
    pick = lambda pattern: F.regexp_extract(low, rf"(?:^|[^a-z0-9])({pattern})(?=$|[^a-z0-9])", 1)
    return units.select(generated_id("criminal_minds", F.concat_ws("/", "source_label", "unit")).alias("file_id"), "source_label", "unit", pick(r"o\d+").alias("original_id"), pick("[ab]").alias("grp"), pick(r"uni\d+").alias("university"), "text")


# ---------------------------------------------------------------- adapters by name
def _named(spark: SparkSession, root: str) -> DataFrame:
    files = readers.read_directory(spark, root).toDF("file_path", "text")
    return cut(files.withColumn("file_id", generated_id("file", F.col("file_path"))))


def _one_table(spark: SparkSession, root: str, options: dict) -> DataFrame:
    found = readers.discover_tables(root, options.get("table"), options.get("split"))
    if not found:
        raise ValueError(f"no table below {root}")
    return readers.read_table(spark, found[0])


def _columns(options: dict) -> dict[str, str]:
    return {k[: -len("_column")]: v for k, v in options.items() if k.endswith("_column")}


def _with_texts(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """files with the texts of their paths, where they have paths."""
    texts = readers.read_directory(spark, root).toDF("file_path", "_own")
    return files.join(texts, "file_path", "left").withColumn("text", F.coalesce("text", "_own")).drop("_own")


def _auto_pair(spark: SparkSession, root: str, **options) -> dict[str, DataFrame]:
    files, pairs = datasets.adapt_pairs(_one_table(spark, root, options), _columns(options))
    return {"files": _with_texts(spark, root, files), "pairs": pairs}


def _auto_retrieval(spark: SparkSession, root: str, **options) -> dict[str, DataFrame]:
    out = datasets.adapt_retrieval(_one_table(spark, root, options), _columns(options))
    return out | {"files": _with_texts(spark, root, out["files"])}


def _irplag_pair(spark: SparkSession, root: str, **options) -> dict[str, DataFrame]:
    files = _named(spark, root)
    pairs = cut(case_pairs(files))
    return {"files": files, "pairs": pairs} if pairs.limit(1).count() else _auto_pair(spark, root, **options)


def _irplag_retrieval(spark: SparkSession, root: str, **options) -> dict[str, DataFrame]:
    files = _named(spark, root)
    if cut(case_pairs(files)).limit(1).count():
        return {"files": files, **case_retrieval(files)}
    own = {"query_id": "left_id", "document_id": "right_id", "query_path": "left_path", "document_path": "right_path"}
    table = _one_table(spark, root, options)
    lower = datasets.resolve_columns(table.columns, _columns(options), datasets.PAIR_COLUMNS)
    return datasets.adapt_retrieval(table, {k: lower[v] for k, v in own.items() if v in lower} | {"relevance": lower["label"]} | {k: lower[v] for k, v in (("query_text", "left_text"), ("document_text", "right_text")) if v in lower})


def _conplag(spark: SparkSession, root: str, **options) -> dict[str, DataFrame]:
    files = _named(spark, root)
    found = [p for p in readers.discover_tables(root, options.get("table")) if p.endswith("labels.csv")]
    if not found:
        raise ValueError("the data set has no labels.csv")
    return {"files": files, "pairs": version_pairs(files.where(F.col("file_path").endswith(".java")), readers.read_table(spark, found[0]))}


def _ipca(spark: SparkSession, root: str, **_) -> dict[str, DataFrame]:
    files = _named(spark, root)
    return {"files": files, "pairs": course_pairs(files)}


def _criminal_minds(spark: SparkSession, root: str, **_) -> dict[str, DataFrame]:
    units = cut(submission_units(readers.read_directory(spark, root).toDF("file_path", "text")))
    pairs = original_pairs(units.where("source_label = 'original'"), units.where("source_label = 'plagiarized'"))
    return {"files": units, "pairs": pairs}


def _soco14(spark: SparkSession, root: str, split: str = "test", **_) -> dict[str, DataFrame]:
    if split not in ("train", "test"):
        raise ValueError("the split is train or test")
    files = _named(spark, root)
    qrels = readers.read_trec_qrels(spark, root, pattern="*.qrel")
    return {"files": files, **judged_files(files, qrels)}


for _name, _run in {
    "auto_pair_tabular": _auto_pair, "auto_retrieval_tabular": _auto_retrieval, "irplag_pair": _irplag_pair, "irplag_retrieval": _irplag_retrieval, "conplag_pair": _conplag,
    "ipca_pair": _ipca, "student_code_similarity_pair": _auto_pair, "criminal_minds_pair": _criminal_minds, "soco14_retrieval": _soco14,
}.items():
    ADAPTERS.add(_name, _run, replace=True)


def adapt(spark: SparkSession, name: str, root: str, destination: str, dataset_name: str | None = None, **options) -> str:
    """A foreign layout below root as a normalised data set below destination. What is normalised already is copied
    as it is."""
    if (Path(root) / "metadata.json").is_file() and (Path(root) / "files.csv").is_file():
        shutil.copytree(root, destination, dirs_exist_ok=True)
        return destination
    out = ADAPTERS.get(name)(spark, root, **options)
    retrieval = "qrels" in out
    metadata = {"name": dataset_name or Path(root).name, "task_type": "plagiarism", "dataset_kind": "retrieval" if retrieval else "pair_classification", "adapter": name}
    if options.get("split"):
        metadata["split"] = str(options["split"])
    if "skipped" in out:
        metadata["qrel_rows_skipped_missing_files"] = out["skipped"].first()[0]
    if retrieval:
        sinks.write_retrieval_dataset(out["files"], out["queries"], out["corpus"], out["qrels"], metadata, destination)
    else:
        sinks.write_pair_dataset(out["files"], out["pairs"], metadata, destination)
    return destination
