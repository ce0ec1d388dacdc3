"""Collections and data sets scored: features by document, then pairs, then one weighted score."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.functions import chunks, strings, text, tokens, vectors, weights
from kinsift.operators import code_metrics, winnowing
from kinsift.session import cut, spread


@dataclass(frozen=True)
class Options:
    """How pairs are scored. Unknown names and scales that don't mix are errors before any job starts."""

    feature_weights: dict | str | list | None = None
    preprocess_mode: str = "none"
    language: str | None = None
    similarity_function: str = "cosine"
    normalize_semantic: bool = False
    static_dim: int = 256
    winnow_k: int = 5
    winnow_w: int = 4
    gst_least: int = 5
    jaro_weight: float = 0.1
    edit_weights: tuple[int, int, int] = (1, 1, 1)
    code_metric: str = "none"
    metric_order: int = 4
    trivial_ngrams: int = 50
    bidirectional: bool = False
    keywords: tuple[str, ...] | None = None
    ruby_mode: str = "auto"
    ruby_tokenizer: str = "tranx"
    ruby_denominator: str = "max"
    lexical_tokenizer: str = "raw"
    vector_backend: str = "static_hash"
    chunking: str = "none"
    chunk_size: int = 200
    chunk_overlap: int = 0
    max_chunks: int | None = None
    chunk_aggregation: str = "mean"
    multivector: bool = False
    multivector_both_ways: bool = False
    extra: tuple[str, ...] = ()
    weights: dict[str, float] = field(init=False)

    def __post_init__(self) -> None:
        own = weights.parse_weights(self.feature_weights, self.extra)
        weights.check_scales(own, self.similarity_function, self.normalize_semantic)
        vectors.score_range(self.similarity_function)
        if own.get("code_metric", 0) > 0:
            code_metrics.require(self.code_metric)
            code_metrics.ruby(F.col, F.col, self.ruby_mode, self.ruby_tokenizer, self.ruby_denominator)
        if self.lexical_tokenizer.strip().lower() not in ("raw", "regex", "none", ""):
            raise ImportError("tokens of a parser need tree_sitter and its grammars; lexical_tokenizer is raw here")
        vectors.backend(self.vector_backend)
        chunks.chunk_text("", self.chunking, self.chunk_size, self.chunk_overlap, self.max_chunks)
        object.__setattr__(self, "weights", own)

    def active(self, *names: str) -> bool:
        return any(self.weights.get(n, 0) > 0 for n in names)


def document_features(docs: DataFrame, o: Options) -> DataFrame:
    """docs (id, text) with what the active features need, worked out once a document: code, and tok, fps, vec."""
    out = spread(docs.select("id", "text")).select("id", text.preprocess("text", o.preprocess_mode, o.language).alias("code"))
    if o.active("winnowing", "gst", "code_metric"):
        out = out.withColumn("tok", tokens.code_tokens("code"))
    if o.active("winnowing"):
        out = out.withColumn("fps", winnowing.fingerprints(F.col("tok"), o.winnow_k, o.winnow_w))
    if o.active("code_metric"):
        out = out.withColumn("tranx", tokens.tranx_tokens("code")).withColumn("words", tokens.whitespace_tokens("code"))
    if o.active("semantic"):
        plain = vectors.hash_vector("code", o.static_dim)
        if o.chunking == "none" and not o.multivector:
            return out.withColumn("vec", plain)
        parts = out.withColumn("_chunks", chunks.chunks("code", o.chunking, o.chunk_size, o.chunk_overlap, o.max_chunks))
        stack = parts.withColumn("vec", F.transform("_chunks", lambda c: vectors.hash_vector(c, o.static_dim))).drop("_chunks")
        return stack if o.multivector else stack.withColumn("vec", vectors.aggregate_chunks("vec", o.chunk_aggregation))
    return out


def score(o: Options, trivial: DataFrame | None = None) -> Column:
    """The weighted score of joined document features l_* and r_*; inactive features are not in the plan."""
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    columns: dict[str, Column] = {}
    if o.active("semantic"):
        one = vectors.similarity(l("vec"), r("vec"), o.similarity_function, o.normalize_semantic)
        columns["semantic"] = vectors.max_sim(l("vec"), r("vec"), o.multivector_both_ways) if o.multivector else one
    if o.active("levenshtein"):
        plain = tuple(o.edit_weights) == (1, 1, 1)
        columns["levenshtein"] = strings.levenshtein_similarity(l("code"), r("code")) if plain else strings.weighted_levenshtein(l("code"), r("code"), *o.edit_weights)
    if o.active("jaro_winkler"):
        columns["jaro_winkler"] = strings.jaro_winkler(l("code"), r("code"), o.jaro_weight)
    if o.active("winnowing"):
        columns["winnowing"] = winnowing.jaccard(l("fps"), r("fps"))
    if o.active("gst"):
        columns["gst"] = strings.gst(l("tok"), r("tok"), o.gst_least)
    if o.active("code_metric"):
        m, both = o.code_metric, o.bidirectional
        if m == "crystalbleu" and trivial is not None:
            pick = code_metrics.crystalbleu(l("tok"), r("tok"), trivial, o.metric_order, both)
        elif m == "crystalbleu":
            pick = code_metrics.crystalbleu_pair_context(l("tok"), r("tok"), o.metric_order, o.trivial_ngrams, both)
        elif m == "ruby":
            pick = code_metrics.ruby(l, r, o.ruby_mode, o.ruby_tokenizer, o.ruby_denominator, o.metric_order, both)
        elif m == "codebleu_ngram":
            pick = code_metrics.bleu(l("words"), r("words"), both)
        elif m == "codebleu_weighted_ngram":
            pick = code_metrics.weighted_bleu(l("words"), r("words"), code_metrics.keywords_of(o.language or "java", o.keywords), both)
        elif m == "none":
            pick = F.lit(0.0)
        else:
            raise NotImplementedError(f"{m} needs a parser or a model, which this library doesn't call")
        columns["code_metric"] = pick
    for name in o.extra:
        columns[name] = F.col(name)
    return weights.blend(o.weights, columns)


def highest_score(o: Options) -> Column:
    """What the score of two documents can't exceed, by their sizes alone: columns l_ and r_ with chars, n_tok, n_fps.
    Features of which sizes say nothing count as 1 (raw distances are at most 0)."""
    share = lambda c: F.when(F.greatest(f"l_{c}", f"r_{c}") == 0, 1.0).otherwise(F.least(f"l_{c}", f"r_{c}") / F.greatest(f"l_{c}", f"r_{c}"))
    out: Column = F.lit(0.0)
    for name, weight in o.weights.items():
        if name == "levenshtein" and tuple(o.edit_weights) == (1, 1, 1):
            most = share("chars")
        elif name == "winnowing":
            most = share("n_fps")
        elif name == "gst":
            both = F.col("l_n_tok") + F.col("r_n_tok")
            most = F.when(both == 0, 1.0).otherwise(2 * F.least("l_n_tok", "r_n_tok") / both)
        elif name in o.extra or (name == "semantic" and o.similarity_function == "dot" and not o.normalize_semantic):
            most = F.lit(float("inf"))
        else:
            most = F.lit(1.0)
        out = out + weight * most if weight > 0 else out
    return out


def _side(features: DataFrame, prefix: str) -> DataFrame:
    return features.select(*[F.col(c).alias(f"{prefix}_{c}") for c in features.columns])


def compare_collection(files: DataFrame, options: Options | None = None, threshold: float = 0.0, number_results: int = 10) -> DataFrame:
    """(file_name_1, file_name_2, similarity_score to 4 decimals) of the best pairs of a collection (file_name,
    code) at or above the threshold, by score, then by the later names first.

    Where winnowing is the only feature and the threshold is above 0, pairs come from the prefix-filtered join of
    classes, and members are paired as far as the best need them; the result is that of all pairs. Otherwise every
    pair is asked for by definition. With a threshold above 0, pairs are formed from ids and sizes, those whose sizes
    already rule the threshold out are left, and features are joined to the rest; only the best are kept."""
    o = options or Options()
    if number_results < 1:
        raise ValueError("number_results must be at least 1")
    features = cut(document_features(files.select(F.col("file_name").alias("id"), F.col("code").alias("text")), o))
    if o.weights.get("winnowing", 0) == 1.0 and threshold > 0:
        members, reps = winnowing.classes(features, "id", "fps")
        scored = winnowing.best_members(members, winnowing.similar_classes(reps, threshold), number_results).withColumnRenamed("similarity", "s")
    else:
        # A corpus's frequent n-grams are counted before pairs are formed.
        trivial = code_metrics.trivial_ngrams(features, "id", "tok", o.metric_order, o.trivial_ngrams) if o.active("code_metric") and o.code_metric == "crystalbleu" else None
        if threshold > 0:
            sizes = features.select("id", F.length("code").alias("chars"), *[F.size(c).alias(f"n_{c}") for c in ("tok", "fps") if c in features.columns])
            near = _side(sizes, "l").join(_side(sizes, "r"), (F.col("l_id") < F.col("r_id")) & (highest_score(o) >= threshold - 1e-9)).select("l_id", "r_id")
            both = near.join(_side(features, "l"), "l_id").join(_side(features, "r"), "r_id")
        else:
            both = _side(features, "l").join(_side(features, "r"), F.col("l_id") < F.col("r_id"))
        scored = both.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), score(o, trivial).alias("s"))
    best = scored.where(F.col("s") >= threshold).orderBy(F.desc("s"), F.desc("left_id"), F.desc("right_id")).limit(number_results)
    return best.select(F.col("left_id").alias("file_name_1"), F.col("right_id").alias("file_name_2"), F.round("s", 4).alias("similarity_score"))


def score_pairs(files: DataFrame, pairs: DataFrame, options: Options | None = None) -> DataFrame:
    """pairs (left_id, right_id, ...) with similarity_score; files: file_id, text. Each file's features are worked
    out once. CrystalBLEU's context is the pair itself, as labelled pairs have no collection."""
    o = options or Options(feature_weights={"levenshtein": 1.0}, language="python")
    features = cut(document_features(files.select(F.col("file_id").alias("id"), "text"), o))
    both = pairs.join(_side(features, "l"), F.col("left_id") == F.col("l_id")).join(_side(features, "r"), F.col("right_id") == F.col("r_id"))
    return both.select(*pairs.columns, score(o).alias("similarity_score"))


def score_retrieval(files: DataFrame, queries: DataFrame, corpus: DataFrame, options: Options | None = None) -> DataFrame:
    """(query_id, document_id, similarity_score): every query against every document, the stated query set against
    all rows. queries: query_id, file_id; corpus: document_id, file_id."""
    o = options or Options(feature_weights={"levenshtein": 1.0}, language="python")
    features = cut(document_features(files.select(F.col("file_id").alias("id"), "text"), o))
    q = queries.join(_side(features, "l"), F.col("file_id") == F.col("l_id")).drop("file_id")
    d = corpus.join(_side(features, "r"), F.col("file_id") == F.col("r_id")).drop("file_id")
    return q.crossJoin(d).select("query_id", "document_id", score(o).alias("similarity_score"))


def calculate_similarity(spark: SparkSession, left: str | None, right: str | None, options: Options | None = None) -> float:
    """The score of two texts: one row through the same columns as any pair. Null texts count as empty."""
    o = options or Options()
    both = spark.createDataFrame([("l", left or ""), ("r", right or "")], "id string, text string")
    features = document_features(both, o)
    pair = _side(features.where("id = 'l'"), "l").crossJoin(_side(features.where("id = 'r'"), "r"))  # one row each
    return float(pair.select(score(o).alias("s")).first()[0])


def custom_scores(files: DataFrame, pairs: DataFrame, scorer, context: object = None) -> DataFrame:
    """pairs with similarity_score of the caller's scorer(left_text, right_text) or, with a context worked out
    beforehand, scorer(left_text, right_text, context). A score that isn't finite fails the query."""
    import math

    def one(a: str, b: str) -> float:
        value = float(scorer(a, b) if context is None else scorer(a, b, context))
        if not math.isfinite(value):
            raise ValueError("scores must be finite")
        return value

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x or "", y or "") for x, y in zip(a, b)], dtype="float64")

    left = files.select(F.col("file_id").alias("left_id"), F.col("text").alias("_l"))
    right = files.select(F.col("file_id").alias("right_id"), F.col("text").alias("_r"))
    return pairs.join(left, "left_id").join(right, "right_id").withColumn("similarity_score", run("_l", "_r")).drop("_l", "_r")
