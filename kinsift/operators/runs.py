"""Comparison suites and leaderboards: runs described by plain mappings, scored, ranked and summed up."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import fields
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.functions.labels import binary_label
from kinsift.functions.weights import DEFAULTS, parse_weights
from kinsift.operators import algorithms, classify, compare, leaderboard, retrieval
from kinsift.session import cut
from kinsift.sources import readers, sinks
from kinsift.sources.registry import Registry

# Names that scoring options go by in configurations, and the fields of Options they set.
OPTION_NAMES = {
    "code_language": "language", "normalize_semantic_scores": "normalize_semantic", "static_vector_dim": "static_dim", "winnowing_kgram": "winnow_k", "winnowing_window": "winnow_w",
    "gst_min_match_length": "gst_least", "jaro_winkler_prefix_weight": "jaro_weight", "levenshtein_weights": "edit_weights", "crystalbleu_max_order": "metric_order", "ruby_max_order": "metric_order",
    "crystalbleu_trivial_ngram_count": "trivial_ngrams", "code_metric_bidirectional": "bidirectional", "chunking_method": "chunking", "multivector_bidirectional": "multivector_both_ways",
}
#: Options for libraries that aren't here; they change nothing without them.
_WITHOUT_EFFECT = {"model_name", "model", "device", "max_token_length", "pooling_method", "progress", "progress_callback", "code_metric_weight", "chunk_language", "chunker_options", "static_vector_lowercase"}
_OWN = {f.name for f in fields(compare.Options) if f.init}
# The blends that leaderboards know by name.
PRESETS = Registry("leaderboard preset", {
    "balanced": ("Balanced", {"feature_weights": {"semantic": 0.7, "levenshtein": 0.3}}),
    "lexical only": ("Lexical Only", {"feature_weights": {"levenshtein": 0.5, "winnowing": 0.25, "gst": 0.25}}),
    "embedding only": ("Embedding Only", {"feature_weights": {"semantic": 1.0}}),
    "code-aware": ("Code-Aware", {"feature_weights": {"semantic": 0.5, "levenshtein": 0.25, "code_metric": 0.25}, "code_metric": "codebleu"}),
    "jaro-winkler": ("Jaro-Winkler", {"feature_weights": {"jaro_winkler": 1.0}}),
    "winnowing": ("Winnowing", {"feature_weights": {"winnowing": 1.0}}),
    "gst": ("GST", {"feature_weights": {"gst": 1.0}}),
    "codebleu": ("CodeBLEU", {"feature_weights": {"code_metric": 1.0}, "code_metric": "codebleu"}),
})
PAIR_METRICS = ("accuracy", "precision", "recall", "f1", "auroc", "average_precision")
RETRIEVAL_METRICS = {"mean_average_precision": "map", "mean_reciprocal_rank": "mrr", "precision_at_k": "precision_at_k", "recall_at_k": "recall_at_k", "ndcg_at_k": "ndcg_at_k"}
_TASKS = {"pair": "pair", "pairs": "pair", "pair_classification": "pair", "retrieval": "retrieval", "ranking": "retrieval"}


def options_of(given: dict) -> compare.Options:
    """Scoring options from a mapping in the names of configurations or of Options."""
    own = {}
    for name, value in given.items():
        field = OPTION_NAMES.get(name, name)
        if field in _OWN:
            own[field] = tuple(value) if isinstance(value, list) and field != "feature_weights" else value
        elif name not in _WITHOUT_EFFECT:
            raise ValueError(f"there is no scoring option {name}")
    if "max_chunks" in own:
        own["max_chunks"] = own["max_chunks"] or None
    return compare.Options(**own)


def slug(name: object) -> str:
    """A run's name as a file name."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", str(name).strip()).strip("._") or "run"


# ---------------------------------------------------------------- comparison suites
def parse_runs(given: str | list | dict, base: Path | None = None) -> list[dict]:
    """Runs (name, options, algorithm, algorithm_options, threshold, number_results) of a list, an object with `runs`,
    or either as JSON text. Paths of algorithms start at `base`."""
    value = json.loads(given) if isinstance(given, str) else given
    runs = value.get("runs", []) if isinstance(value, dict) else value
    if not isinstance(runs, list) or not all(isinstance(r, dict) for r in runs):
        raise ValueError("runs are a list of objects")
    out = []
    for number, run in enumerate(runs, 1):
        flat = {**run.get("options", {}), **{k: v for k, v in run.items() if k not in ("options", "run_name")}}
        name = str(run.get("run_name") or flat.pop("run_name", None) or f"run_{number}")
        flat.pop("run_name", None)
        number_results = int(flat.pop("number_results", flat.pop("num", 10)))
        own = {"name": name, "threshold": float(flat.pop("threshold", 0.0)), "number_results": number_results}
        algorithm = flat.pop("algorithm", None) or flat.pop("algorithm_path", None)
        flat.pop("algorithm_path", None)
        if algorithm is not None:
            if isinstance(algorithm, str) and base is not None and ("/" in algorithm or algorithm.endswith(".py")) and not Path(algorithm).is_absolute():
                algorithm = str((base / algorithm).resolve())
            settings = algorithms.checked_options(flat.pop("algorithm_options", None))
            unknown = set(flat) - {"preprocess_mode", "code_language"} - _WITHOUT_EFFECT
            if unknown:
                raise ValueError(f"a custom algorithm takes no {', '.join(sorted(unknown))}")
            own |= {"algorithm": algorithm, "algorithm_options": settings, "options": flat}
        else:
            if set(flat) & {"ws", "wl", "wj", "Ws", "Wl", "Wj"}:
                raise ValueError("weights are given as feature_weights")
            flat["feature_weights"] = parse_weights(flat.get("feature_weights")) or dict(DEFAULTS)
            options_of(flat)
            own |= {"algorithm": None, "algorithm_options": {}, "options": flat}
        out.append(own)
    return out


def load_runs(path: str) -> list[dict]:
    return parse_runs(Path(path).read_text(encoding="utf-8"), Path(path).resolve().parent)


def score_run(files: DataFrame, run: dict) -> DataFrame:
    """The best pairs of a collection (file_name, code) as one run asks for them."""
    if run["algorithm"] is None:
        return compare.compare_collection(files, options_of(run["options"]), run["threshold"], run["number_results"])
    o = run["options"]
    return algorithms.compare_collection(files, run["algorithm"], run["algorithm_options"], run["threshold"], run["number_results"], o.get("preprocess_mode", "none"), o.get("code_language"))


def run_suite(files: DataFrame, runs: list[dict], cache_dir: str | None = None, fingerprint: str = "", seed: int | None = None, progress: Callable[[dict], None] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(summary, results by run). The collection is read once; a run found in the cache isn't scored. summary: a row a
    run (count, mean, median, max, min, std, the first pair, seconds, cache status), best runs first; a run without
    pairs has zeros. progress gets a mapping with stage, current and total after every run."""
    spark = files.sparkSession
    files, results, heads = cut(files), {}, []
    for number, run in enumerate(runs, 1):
        began, status, key = time.perf_counter(), "disabled", ""
        make = lambda run=run: score_run(files, run)
        if cache_dir is None:
            found = cut(make())
        else:
            key = sinks.cache_key({k: str(v) for k, v in run.items()}, fingerprint, sinks.versions(), seed)
            status = "hit" if sinks.is_cached(cache_dir, key) else "miss"
            found = sinks.cached(spark, cache_dir, key, make, {"run_name": run["name"]})
        results[run["name"]] = found
        heads.append((run["name"], round(time.perf_counter() - began, 4), status, key))
        if progress:
            progress({"stage": "suite_runs", "current": number, "total": len(runs), "run_name": run["name"]})
    named = [df.select(F.lit(name).alias("run_name"), F.col("file_name_1").alias("left_id"), F.col("file_name_2").alias("right_id"), "similarity_score") for name, df in results.items()]
    rows = spark.createDataFrame(heads, "run_name string, elapsed_seconds double, cache_status string, cache_key string")
    if not named:
        return rows, results
    summary = rows.join(leaderboard.suite_summary(reduce(DataFrame.unionByName, named)), "run_name", "left")
    zeros = {c: 0.0 for c in ("mean_score", "median_score", "max_score", "min_score", "std_score")} | {"pair_count": 0, "top_left": "", "top_right": ""}
    return summary.fillna(zeros).orderBy(F.desc("max_score"), F.desc("mean_score"), "run_name"), results


# ---------------------------------------------------------------- leaderboards
def _metrics(given, known, default: str) -> tuple[str, ...]:
    names = [str(m).strip().lower() for m in ([given] if isinstance(given, str) else given or [default])]
    if unknown := [m for m in names if m not in known]:
        raise ValueError(f"no leaderboard metric {', '.join(unknown)}; known: {', '.join(known)}")
    return tuple(dict.fromkeys(names))


def parse_leaderboard(manifest: dict, base: Path | None = None) -> dict:
    """A leaderboard's manifest with every default in place: data sets (task, path, threshold or k), algorithms
    (preset, options or algorithm_path) and metrics. An algorithm may be a preset's name."""
    if not isinstance(manifest, dict) or not manifest.get("datasets") or not manifest.get("algorithms"):
        raise ValueError("a leaderboard needs a data set and an algorithm")
    where = lambda p: str((base / p).resolve()) if base is not None and not Path(p).is_absolute() else str(p)
    sets = []
    for number, item in enumerate(manifest["datasets"], 1):
        task = _TASKS.get(str(item.get("task") or item.get("task_family") or item.get("kind") or "").strip().lower())
        if task is None:
            raise ValueError("a data set's task is pair or retrieval")
        path = item.get("path") or item.get("identifier")
        sets.append({"name": str(item.get("name") or f"{task}_dataset_{number}"), "task_family": task, "path": where(path), "source": item.get("source", "local"), "threshold": item.get("threshold"), "k": item.get("k"), "options": dict(item.get("similarity_options", {}))})
    algos = []
    for number, item in enumerate(manifest["algorithms"], 1):
        own = {"preset": item} if isinstance(item, str) else dict(item)
        preset = own.pop("preset", None) or own.pop("algorithm_preset", None)
        path = own.pop("algorithm_path", None)
        if preset and path:
            raise ValueError("a preset has no algorithm_path")
        title, options = PRESETS.get(preset) if preset else (f"algorithm_{number}", {})
        head = {k: own.pop(k, None) for k in ("name", "threshold", "k", "algorithm_options")}
        options = {**options, **own.pop("options", {}), **own.pop("similarity_options", {}), **own}
        algos.append({"name": str(head["name"] or title), "algorithm_path": where(path) if path else None, "algorithm_options": algorithms.checked_options(head["algorithm_options"]), "options": options, "threshold": head["threshold"], "k": head["k"]})
    return {
        "name": str(manifest.get("name") or "leaderboard"), "seed": manifest.get("seed"), "datasets": sets, "algorithms": algos,
        "pair_metrics": _metrics(manifest.get("pair_metrics") or manifest.get("pair_metric"), PAIR_METRICS, "f1"),
        "retrieval_metrics": _metrics(manifest.get("retrieval_metrics") or manifest.get("retrieval_metric"), RETRIEVAL_METRICS, "mean_average_precision"),
    }


def load_leaderboard(path: str) -> dict:
    return parse_leaderboard(json.loads(Path(path).read_text(encoding="utf-8")), Path(path).resolve().parent)


def _first(*values):
    return next((v for v in values if v is not None), None)


def _pair_scores(files: DataFrame, pairs: DataFrame, algo: dict, options: dict) -> DataFrame:
    if algo["algorithm_path"]:
        return algorithms.score_pairs(files, pairs, algo["algorithm_path"], algo["algorithm_options"], options.get("preprocess_mode", "none"), options.get("code_language"))
    return compare.score_pairs(files, pairs, options_of(options))


def _retrieval_scores(files: DataFrame, queries: DataFrame, corpus: DataFrame, algo: dict, options: dict) -> DataFrame:
    if not algo["algorithm_path"]:
        return compare.score_retrieval(files, queries, corpus, options_of(options))
    q, d = queries.select("query_id", F.col("file_id").alias("left_id")), corpus.select("document_id", F.col("file_id").alias("right_id"))
    return algorithms.score_pairs(files, q.crossJoin(d), algo["algorithm_path"], algo["algorithm_options"], options.get("preprocess_mode", "none"), options.get("code_language")).drop("left_id", "right_id")  # every query against every document, by definition


def run_leaderboard(spark: SparkSession, config: dict, progress: Callable[[dict], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(per_dataset, aggregate): every algorithm on every data set, ranked; see leaderboard.ranked and aggregated. The
    data set's options go before the algorithm's, the algorithm's threshold and k before the data set's."""
    parts, done = [], 0
    for ds in config["datasets"]:
        pair = ds["task_family"] == "pair"
        loaded = readers.read_pair_dataset(spark, ds["path"]) if pair else readers.read_retrieval_dataset(spark, ds["path"])
        files = cut(loaded[0].select("file_id", "text"))
        for algo in config["algorithms"]:
            options = {**algo["options"], **ds["options"]}
            if pair:
                pairs = loaded[1].withColumn("label", binary_label(F.col("label").cast("string")))
                checked = cut(classify.checked(_pair_scores(files, pairs, algo, options), "similarity_score"))
                row = classify.confusion(checked, float(_first(algo["threshold"], ds["threshold"], 0.5)))
                if set(config["pair_metrics"]) & {"auroc", "average_precision"}:
                    row = row.crossJoin(classify.auroc(checked).select("auroc")).crossJoin(classify.average_precision(checked))  # one row each
                names, count = {m: m for m in config["pair_metrics"]}, "pair_count"
            else:
                _, queries, corpus, qrels, _ = loaded
                scored = _retrieval_scores(files, queries, corpus, algo, options)
                row = retrieval.retrieval_metrics(scored, qrels, int(_first(algo["k"], ds["k"], 10)))
                names, count = {m: RETRIEVAL_METRICS[m] for m in config["retrieval_metrics"]}, "result_count"
            values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("score")) for m, c in names.items()])
            head = {"task_family": ds["task_family"], "dataset_name": ds["name"], "algorithm_name": algo["name"], "dataset_source": ds["source"], "algorithm_kind": "custom" if algo["algorithm_path"] else "builtin"}
            parts.append(cut(row.select(F.inline(values), F.col(count).cast("long").alias("sample_count")).select(*[F.lit(v).alias(k) for k, v in head.items()], "metric", "score", "sample_count")))
            done += 1
            if progress:
                progress({"stage": "leaderboard_runs", "current": done, "total": len(config["datasets"]) * len(config["algorithms"])})
    board = cut(leaderboard.ranked(reduce(DataFrame.unionByName, parts)))
    return leaderboard.ordered(board), leaderboard.ordered(leaderboard.aggregated(board))
