"""Data set tables: adapters of foreign tables, merging, roles and counts of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsift.functions.ids import ref_id
from kinsift.functions.labels import binary_label, relevance_value
from kinsift.plans.skew import numbered
from kinsift.session import cut

# Names that columns of foreign tables go by.
PAIR_COLUMNS = {
    "left_id": ("left_id", "left_file_id", "id1", "file_id_1", "submission_1_id"),
    "right_id": ("right_id", "right_file_id", "id2", "file_id_2", "submission_2_id"),
    "left_text": ("left_text", "left_code", "code_a", "code1", "code_1", "func1", "student1_code", "student_1_code", "submission1_code", "submission_1_text", "submission_1_code", "source_1_text", "source_1_code"),
    "right_text": ("right_text", "right_code", "code_b", "code2", "code_2", "func2", "student2_code", "student_2_code", "submission2_code", "submission_2_text", "submission_2_code", "source_2_text", "source_2_code"),
    "left_path": ("left_path", "file1", "file_1", "path1", "submission_1", "source_1_path"),
    "right_path": ("right_path", "file2", "file_2", "path2", "submission_2", "source_2_path"),
    "label": ("label", "cheating", "is_cheating", "is_clone", "is_plagiarism", "plagiarism", "plagiarism_label", "verdict", "target"),
}
RETRIEVAL_COLUMNS = {
    "query_id": ("query_id", "qid", "left_id", "submission_1_id"),
    "document_id": ("document_id", "doc_id", "did", "right_id", "submission_2_id"),
    "query_text": ("query_text", "query_code", "left_text", "code1", "code_1", "func1"),
    "document_text": ("document_text", "doc_text", "document_code", "right_text", "code2", "code_2", "func2"),
    "query_path": ("query_path", "query_file", "left_path", "file1", "file_1", "path1"),
    "document_path": ("document_path", "doc_path", "document_file", "right_path", "file2", "file_2", "path2"),
    "relevance": ("relevance", "label", "is_relevant", "is_clone", "is_plagiarism", "verdict", "target"),
}


def resolve_columns(columns: list[str], overrides: dict[str, str] | None = None, names: dict = PAIR_COLUMNS) -> dict[str, str]:
    """Which column of a table serves as what: an override, else the first known name, any case."""
    by_name = {c.strip().lower(): c for c in columns}
    out = {}
    for role, known in names.items():
        given = (overrides or {}).get(role)
        if given is not None:
            if given not in columns:
                raise ValueError(f"no column {given} for {role}")
            out[role] = given
        elif hit := next((by_name[k] for k in known if k in by_name), None):
            out[role] = hit
    return out


def generated_id(role: str, key) -> F.Column:
    """role, underscore and the first 16 hex digits of the key's SHA-1."""
    return F.concat(F.lit(f"{role}_"), F.substring(F.sha1(F.encode(key, "UTF-8")), 1, 16))


def _files(rows: DataFrame, sides: dict[str, str], use: dict[str, str], root: str) -> tuple[DataFrame, DataFrame]:
    """(files, rows with `<side>_file` for every side). sides: side and the role its ids share with others.

    A file's identity is its id, else its path below root, else its text. Equal identities are one file, named after
    the role of the first place it stands in (rows in the order of `_at`, sides in theirs), with the text of that
    place. Generated names are the role and the first 16 hex digits of the SHA-1 of id, path or text."""
    pick = lambda name: F.col(use[name]).cast("string") if name in use else F.lit(None).cast("string")
    places = []
    for number, (side, shared) in enumerate(sides.items()):
        name, text = ref_id(pick(f"{side}_id")), pick(f"{side}_text")
        path = F.concat(F.lit(f"{root.rstrip('/')}/" if root else ""), F.regexp_replace(F.replace(ref_id(pick(f"{side}_path")), F.lit("\\"), F.lit("/")), r"^(?:\./)+", ""))
        one = lambda by, role, value: F.struct(F.lit(by).alias("by"), F.lit(role).alias("role"), value.alias("value"))
        by = F.when(name.isNotNull(), one("id", shared, name)).when(path.isNotNull(), one("path", side, path)).when(text.isNotNull(), one("text", side, text))
        places.append(rows.select("_at", F.lit(number).alias("_side"), by.alias("own"), text.alias("text"), path.alias("file_path")))
    out = places[0]
    for more in places[1:]:
        out = out.unionByName(more)
    key = F.concat_ws(":", "own.by", F.when(F.col("own.by") == "id", F.col("own.role")), F.sha1(F.encode("own.value", "UTF-8")))
    placed = cut(out.where("own is not null").withColumn("key", key))
    first = F.min_by(F.struct("own.role", F.sha1(F.encode("own.value", "UTF-8")).alias("digest"), "text", "file_path"), F.struct("_at", "_side")).alias("first")
    named = cut(placed.groupBy("key").agg(first).select("key", F.concat("first.role", F.lit("_"), F.substring("first.digest", 1, 16)).alias("file_id"), "first.text", "first.file_path"))
    ids = placed.select("_at", "_side", "key").join(named.select("key", "file_id"), "key")
    for number, side in enumerate(sides):
        rows = rows.join(ids.where(F.col("_side") == number).select("_at", F.col("file_id").alias(f"{side}_file")), "_at", "left")
    return named.select("file_id", "text", "file_path"), rows


def adapt_pairs(rows: DataFrame, overrides: dict[str, str] | None = None, order: list[str] | None = None, root: str = "") -> tuple[DataFrame, DataFrame]:
    """(files: file_id, text, file_path; pairs: left_id, right_id, label, row_index) of a table of pairs, see _files().
    Left and right ids are one kind ("source"). Rows without a usable label, or with a side that has neither id, path
    nor text, are left out. order: columns that tell all rows apart (default: as they are read)."""
    use = resolve_columns(rows.columns, overrides)
    if "label" not in use or not all({f"{s}_text", f"{s}_path", f"{s}_id"} & set(use) for s in ("left", "right")):
        raise ValueError("a pair table needs a label and an id, path or text for both sides")
    label = binary_label(F.col(use["label"]).cast("string"), "adapter")
    placed = _placed(rows, use, order).withColumn("_label", label).where("_label is not null")
    both = [F.coalesce(*[F.nullif(F.col(use[f"{s}_{x}"]).cast("string"), F.lit("")) for x in ("id", "path", "text") if f"{s}_{x}" in use]).isNotNull() for s in ("left", "right")]
    files, typed = _files(placed.where(both[0] & both[1]), {"left": "source", "right": "source"}, use, root)
    return files, typed.where("left_file is not null and right_file is not null").select(F.col("left_file").alias("left_id"), F.col("right_file").alias("right_id"), F.col("_label").alias("label"), F.col("_at").alias("row_index"))


def _placed(rows: DataFrame, use: dict[str, str], order: list[str] | None) -> DataFrame:
    own = rows.select(*dict.fromkeys([*use.values(), *(order or ())]))
    if order:
        return numbered(own, order, "_at")[0]
    return cut(own.withColumn("_at", F.monotonically_increasing_id()))


def adapt_retrieval(rows: DataFrame, overrides: dict[str, str] | None = None, order: list[str] | None = None, root: str = "") -> dict[str, DataFrame]:
    """files, queries, corpus and qrels of a table of judged pairs. A query or document goes by its id, else by a
    name generated from its file's; of several rows with one id the first decides on the file, the highest
    relevance counts. Rows without a usable relevance or with a side that has neither id, path nor text are left out."""
    use = resolve_columns(rows.columns, overrides, RETRIEVAL_COLUMNS)
    if "relevance" not in use or not all({f"{s}_text", f"{s}_path"} & set(use) for s in ("query", "document")):
        raise ValueError("a retrieval table needs a relevance and a path or text for both sides")
    value = relevance_value(F.col(use["relevance"]).cast("string"))
    files, typed = _files(_placed(rows, use, order).withColumn("_rel", value).where("_rel is not null"), {"query": "query", "document": "document"}, use, root)
    for side in ("query", "document"):
        own = ref_id(F.col(use[f"{side}_id"]).cast("string")) if f"{side}_id" in use else F.lit(None).cast("string")
        typed = typed.withColumn(f"_{side}", F.coalesce(own, generated_id(side, F.col(f"{side}_file"))))
    typed = cut(typed.where("query_file is not null and document_file is not null"))
    first = lambda side: typed.groupBy(F.col(f"_{side}").alias(f"{side}_id")).agg(F.min_by(f"{side}_file", "_at").alias("file_id"))
    qrels = typed.groupBy(F.col("_query").alias("query_id"), F.col("_document").alias("document_id")).agg(F.max("_rel").alias("relevance"))
    return {"files": files, "queries": first("query"), "corpus": first("document"), "qrels": qrels}


def adapt_qrels(rows: DataFrame, query: str = "query_id", document: str = "document_id", relevance: str = "relevance") -> DataFrame:
    """(query_id, document_id, relevance): usable rows, the highest relevance of each pair."""
    value = relevance_value(F.col(relevance).cast("string"))
    typed = rows.select(ref_id(query).alias("query_id"), ref_id(document).alias("document_id"), value.alias("relevance")).dropna()
    return typed.groupBy("query_id", "document_id").agg(F.max("relevance").alias("relevance"))


def merge_tables(parts: dict[str, DataFrame], ids: list[str]) -> DataFrame:
    """The tables of several data sets as one: ids prefixed with the data set's name and two underscores,
    dataset_name added, columns that one lacks null."""
    out = None
    for name, df in parts.items():
        own = df.withColumns({i: F.concat(F.lit(f"{name}__"), F.col(i)) for i in ids}).withColumn("dataset_name", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to merge")
    return out


def pair_file_counts(pairs: DataFrame) -> DataFrame:
    """(file_id, pair_count): in how many pairs a file stands, on either side."""
    sides = pairs.select(F.explode(F.array_distinct(F.array(ref_id("left_id"), ref_id("right_id")))).alias("file_id")).where("file_id is not null")
    return sides.groupBy("file_id").agg(F.count("*").alias("pair_count"))


def file_roles(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(file_id, role): query, document or both."""
    q = queries.select(ref_id("file_id").alias("file_id"), F.lit(1).alias("r"))
    d = corpus.select(ref_id("file_id").alias("file_id"), F.lit(2).alias("r"))
    both = q.unionByName(d).where("file_id is not null").groupBy("file_id").agg(F.bit_or("r").alias("r"))
    return both.select("file_id", F.when(F.col("r") == 1, "query").when(F.col("r") == 2, "document").otherwise("both").alias("role"))


def class_counts(pairs: DataFrame) -> DataFrame:
    """Positives and negatives by data set."""
    return pairs.groupBy("dataset_name").agg(F.count_if(F.col("label") == 1).alias("positive_count"), F.count_if(F.col("label") == 0).alias("negative_count"))


def sample_pairs(pairs: DataFrame, limit: int, keys: list[str], seed: int = 7) -> DataFrame:
    """A sample of `limit` labelled pairs (all, if there are fewer): the same number of every label first, as far as
    there are, then filled up from the rest. Which rows is decided by a hash of their keys (unique) and the seed."""
    if limit < 1:
        raise ValueError("a sample has one pair at least")
    known = pairs.where("label is not null").withColumn("_h", F.xxhash64(F.lit(seed), *keys))
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two labels
    each = max(1, min(limit, sum(sizes.values())) // max(1, len(sizes)))
    order = Window.partitionBy("label").orderBy("_h", *keys)
    own = known.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= limit)
    return own.withColumn("_late", F.col("_at") > each).orderBy("_late", "_h", *keys).limit(limit).drop("_h", "_at", "_late")


def sample_retrieval(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, n_queries: int, n_documents: int, seed: int = 7) -> dict[str, DataFrame]:
    """queries, corpus and qrels of a sample: so many queries, all documents judged for them, and others up to
    n_documents; judgements of what isn't in the sample are left out."""
    pick = lambda df, key, n: df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
    some = cut(pick(queries, "query_id", n_queries))
    judged = qrels.join(some.select("query_id"), "query_id", "left_semi")
    needed = cut(corpus.join(judged.select("document_id").distinct(), "document_id", "left_semi"))
    fill = max(0, n_documents - needed.count())
    documents = needed.unionByName(pick(corpus.join(needed.select("document_id"), "document_id", "left_anti"), "document_id", fill))
    return {"queries": some, "corpus": documents, "qrels": judged.join(documents.select("document_id"), "document_id", "left_semi")}


def referenced_files(files: DataFrame, *columns: DataFrame) -> DataFrame:
    """The rows of files (file_id) that any of the one-column tables names."""
    ids = columns[0].toDF("file_id")
    for more in columns[1:]:
        ids = ids.unionByName(more.toDF("file_id"))
    return files.join(ids.where("file_id is not null").distinct(), "file_id", "left_semi")


def pick_pair(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The row of a pair of ids: as given, else the other way round; none where there is neither. Of repeated rows
    the least counts."""
    l, r = ref_id("left_id"), ref_id("right_id")
    hits = pairs.where(((l == left) & (r == right)) | ((l == right) & (r == left)))
    return hits.orderBy(F.when(l == left, 0).otherwise(1), *pairs.columns).limit(1)


def with_metadata(points: DataFrame, metadata: DataFrame, key: str = "document_id") -> DataFrame:
    """points with the columns of metadata (one row a key), which replace those of the same name."""
    return points.drop(*[c for c in metadata.columns if c != key]).join(metadata, key, "left")
