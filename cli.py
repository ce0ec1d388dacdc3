"""Command line: compare collections, evaluate and tune labelled pairs, evaluate retrieval, run suites and leaderboards,
inspect, adapt, draw and explain data sets, keep a registry of runs."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinsift.functions.ids import ref_id
from kinsift.functions.labels import binary_label
from kinsift.operators import algorithms, classify, compare, datasets, explain, leaderboard, retrieval, runs
from kinsift.session import build_session, cut
from kinsift.sources import adapters, checks, readers, registry, reports, sinks


def _print(df) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), sort_keys=True, default=str))


def _options(a: argparse.Namespace) -> compare.Options:
    own = dict(x.partition("=")[::2] for x in a.option or [])
    typed = {k: json.loads(v) if v[:1] in "[{0123456789-tfn\"" else v for k, v in own.items()}
    return runs.options_of({"feature_weights": a.weights, "preprocess_mode": a.preprocess, "language": a.language, "code_metric": a.code_metric, "similarity_function": a.similarity, **typed})


def _algorithm_options(a: argparse.Namespace) -> dict:
    return json.loads(a.algorithm_options) if a.algorithm_options else {}


def _scored_pairs(spark: SparkSession, a: argparse.Namespace):
    files, pairs, _ = readers.read_pair_dataset(spark, a.path)
    typed = pairs.withColumn("label", binary_label(F.col("label").cast("string"))).withColumns({c: ref_id(c) for c in ("left_id", "right_id")})
    if a.algorithm:
        return cut(algorithms.score_pairs(files, typed, a.algorithm, _algorithm_options(a), a.preprocess, a.language))
    return cut(compare.score_pairs(files, typed, _options(a)))


def _compare(spark: SparkSession, a: argparse.Namespace) -> int:
    files = readers.read_collection(spark, a.path)
    if a.algorithm:
        _print(algorithms.compare_collection(files, a.algorithm, _algorithm_options(a), a.threshold, a.num, a.preprocess, a.language))
    else:
        _print(compare.compare_collection(files, _options(a), a.threshold, a.num))
    if a.reproducibility_out:
        sinks._write_json(a.reproducibility_out, reports.snapshot(spark, a.path, {k: v for k, v in vars(a).items() if k != "run"}))
    return 0


def _pair(spark: SparkSession, a: argparse.Namespace) -> int:
    left, right = (Path(p).read_text(encoding="utf-8", errors="ignore") for p in (a.left, a.right))
    print(json.dumps({"similarity_score": compare.calculate_similarity(spark, left, right, _options(a))}))
    return 0


def _evaluate_pairs(spark: SparkSession, a: argparse.Namespace) -> int:
    scored = _scored_pairs(spark, a)
    metrics = classify.confusion(classify.checked(scored, "similarity_score"), a.threshold)
    if a.scores_out:
        sinks.write_scores(scored, a.scores_out)
    if a.metrics_out:
        sinks.write_metrics(metrics, a.metrics_out)
    _print(metrics)
    return 0


def _tune(spark: SparkSession, a: argparse.Namespace) -> int:
    report = classify.calibration_report(classify.checked(_scored_pairs(spark, a), "similarity_score"), a.metric, one_class=a.command == "tune-threshold")
    if a.output:
        reports.write_calibration(report, a.output, a.command.replace("-", "_"))
    _print(report["summary"])
    return 0


def _evaluate_retrieval(spark: SparkSession, a: argparse.Namespace) -> int:
    files, queries, corpus, qrels, _ = readers.read_retrieval_dataset(spark, a.path)
    own = {"algorithm_path": a.algorithm, "algorithm_options": _algorithm_options(a)}
    scored = runs._retrieval_scores(files, queries, corpus, own, {"preprocess_mode": a.preprocess, "code_language": a.language}) if a.algorithm else compare.score_retrieval(files, queries, corpus, _options(a))
    scored = cut(scored)
    retrieval.reject_duplicates(scored)
    metrics = retrieval.retrieval_metrics(scored, qrels, a.num)
    if a.scores_out:
        sinks.write_scores(scored, a.scores_out)
    if a.metrics_out:
        sinks.write_metrics(metrics, a.metrics_out)
    _print(metrics)
    return 0


def _datasets(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.action == "list":
        for e in registry.catalogue(dataset_kind=a.kind if a.kind != "auto" else None):
            print(json.dumps({"name": e.name, "task_type": e.task_type, "dataset_kind": e.dataset_kind, "source": e.source, "adapter": e.adapter or e.retrieval_adapter, "source_url": e.source_url}, sort_keys=True))
        return 0
    if not a.path:
        raise SystemExit(f"datasets {a.action} needs a path")
    if a.action == "adapt":
        if not a.adapter or not a.output:
            raise SystemExit("datasets adapt needs --adapter and --output")
        print(adapters.adapt(spark, a.adapter, a.path, a.output, a.name, **({"split": a.split} if a.split else {})))
        return 0
    report = checks.validate_directory(spark, a.path, a.kind)
    if a.output:
        reports.write_validation(report, a.output)
    for issue in report["issues"]:
        print(json.dumps(issue, sort_keys=True))
    return int(report["status"] == "error")


def _dataset(spark: SparkSession, path: str):
    return (readers.read_retrieval_dataset if (Path(path) / "qrels.csv").exists() else readers.read_pair_dataset)(spark, path)


def _visualize(spark: SparkSession, a: argparse.Namespace) -> int:
    files, *rest = _dataset(spark, a.path)
    own = {"pairs": rest[0]} if len(rest) == 2 else {"queries": rest[0], "corpus": rest[1]}
    extra = readers.read_table(spark, a.metadata) if a.metadata else None
    points = cut(explain.embedding_map(files, dim=a.dim, metadata=extra, method=a.method, **own))
    if a.output:
        reports.write_map(points, a.output, colour_by=a.colour)
    else:
        _print(points)
    return 0


def _explain(spark: SparkSession, a: argparse.Namespace) -> int:
    files, pairs, _ = readers.read_pair_dataset(spark, a.path)
    row = (datasets.pick_pair(pairs, a.left_id, a.right_id) if a.left_id else pairs.limit(a.index + 1)).collect()
    if not row or (not a.left_id and len(row) <= a.index):
        raise SystemExit("there is no such pair")
    texts = {r.file_id: r.text for r in files.where(F.col("file_id").isin(row[-1].left_id, row[-1].right_id)).collect()}
    one = spark.createDataFrame([("pair", texts.get(row[-1].left_id), texts.get(row[-1].right_id))], "pair_id string, left_text string, right_text string")
    bands = (a.high, a.medium, a.low)
    matches = cut(explain.explain_pairs(one, a.mode, bands, a.chunk_size)).orderBy("left_index")
    if a.output:
        reports.write_explanation(explain.explained_segments(one, a.mode, bands, a.chunk_size), matches, a.output)
    _print(matches)
    return 0


def _leaderboard(spark: SparkSession, a: argparse.Namespace) -> int:
    config = runs.load_leaderboard(a.path)
    per_dataset, aggregate = runs.run_leaderboard(spark, config)
    if a.output:
        reports.write_leaderboard(spark, per_dataset, aggregate, config, a.output)
    _print(aggregate)
    if a.registry:
        rows = [r.asDict() for r in aggregate.collect()]
        sinks.register_run(a.registry, {"run_id": a.run_id or runs.slug(config["name"]), "name": config["name"], "created_at": sinks.now(), "aggregate": rows, "per_dataset": [r.asDict() for r in per_dataset.collect()], "manifest": reports.redacted(config)})
    return 0


def _registry(spark: SparkSession, a: argparse.Namespace) -> int:
    path = Path(a.path)
    if a.action == "add":
        payload = json.loads(Path(a.report).read_text(encoding="utf-8"))
        name = payload.get("manifest", {}).get("name", Path(a.report).stem)
        sinks.register_run(a.path, {"run_id": a.run_id or runs.slug(name), "name": name, "created_at": sinks.now(), "aggregate": payload.get("aggregate", []), "per_dataset": payload.get("per_dataset", []), "manifest": payload.get("manifest", {})})
        return 0
    known = json.loads(path.read_text(encoding="utf-8")) if path.exists() else []
    if a.action == "list":
        for r in known:
            rows = r.get("aggregate", [])
            print(json.dumps({"run_id": r["run_id"], "created_at": r["created_at"], "name": r.get("name", ""), "rows": len(rows), "algorithm_count": len({x.get("algorithm_name") for x in rows}), "dataset_count": len({x.get("dataset_name") for x in r.get("per_dataset", [])})}, sort_keys=True))
        return 0
    rows = [(r["run_id"], r["created_at"], x["task_family"], x["algorithm_name"], x["metric"], x["mean_score"]) for r in known for x in r.get("aggregate", [])]
    df = spark.createDataFrame(rows, "run_id string, created_at string, task_family string, algorithm_name string, metric string, mean_score double")
    _print(leaderboard.compare_runs(df, a.baseline).orderBy("created_at", "run_id", "task_family", "algorithm_name", "metric"))
    return 0


def _suite(spark: SparkSession, a: argparse.Namespace) -> int:
    own = runs.load_runs(a.config)
    print_ = reports.fingerprint(spark, a.path)["sha256"] or ""
    summary, results = runs.run_suite(readers.read_collection(spark, a.path), own, a.cache_dir, print_, a.seed)
    reports.write_suite(summary, results, a.summary_out, a.details_dir)
    if a.reproducibility_out:
        sinks._write_json(a.reproducibility_out, reports.snapshot(spark, a.path, own))
    _print(summary)
    return 0


def _init(_: SparkSession | None, a: argparse.Namespace) -> int:
    print(algorithms.write_template(a.path, a.name, a.overwrite, not a.no_prepare))
    return 0


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="kinsift", description=__doc__)
    parser.add_argument("--master", default=None)
    commands = parser.add_subparsers(dest="command", required=True)

    def add(command: str, run, /, *paths: str, scoring: bool = False, plain: bool = False, **extra) -> argparse.ArgumentParser:
        sub = commands.add_parser(command)
        sub.set_defaults(run=run)
        for p in paths:
            sub.add_argument(p.rstrip("?"), nargs="?" if p.endswith("?") else None)
        if scoring:
            sub.add_argument("--weights", default=None if plain else "levenshtein=1")
            sub.add_argument("--preprocess", default="none")
            sub.add_argument("--language", default=None if plain else "python")
            sub.add_argument("--code-metric", default="none")
            sub.add_argument("--similarity", default="cosine")
            sub.add_argument("--option", action="append", help="any other scoring option, name=value")
            sub.add_argument("--algorithm", "--algorithm-path", default=None)
            sub.add_argument("--algorithm-options", default=None)
            sub.add_argument("--threshold", type=float, default=0.0 if plain else 0.5)
            sub.add_argument("--num", type=int, default=10)
            sub.add_argument("--metric", default="f1")
        for flag, default in extra.items():
            kind = {"type": type(default)} if default is not None and not isinstance(default, bool) else {"action": "store_true"} if default is False else {}
            sub.add_argument("--" + flag.replace("_", "-"), default=default, **kind)
        return sub

    add("compare", _compare, "path", scoring=True, plain=True, reproducibility_out=None)
    add("similarity", _pair, "left", "right", scoring=True, plain=True)
    add("evaluate-pairs", _evaluate_pairs, "path", scoring=True, scores_out=None, metrics_out=None)
    add("evaluate-retrieval", _evaluate_retrieval, "path", scoring=True, scores_out=None, metrics_out=None)
    add("tune-threshold", _tune, "path", scoring=True, output=None)
    add("calibration-report", _tune, "path", scoring=True, output=None)
    add("datasets", _datasets, "action", "path?", kind="auto", output=None, adapter=None, name=None, split=None)
    add("visualize-dataset", _visualize, "path", output=None, dim=256, method="auto", metadata=None, colour=None)
    add("explain-pair", _explain, "path", left_id=None, right_id=None, index=0, mode="line", high=0.85, medium=0.6, low=0.3, chunk_size=5, output=None)
    add("leaderboard", _leaderboard, "path", output=None, registry=None, run_id=None)
    add("benchmark-registry", _registry, "action", "path", report=None, run_id=None, baseline=None)
    add("compare-suite", _suite, "path", "config", summary_out=None, details_dir=None, reproducibility_out=None, cache_dir=None, seed=0)
    add("init-custom-algorithm", _init, "path", name=None, overwrite=False, no_prepare=False)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command in ("datasets", "benchmark-registry"):
        known = ("list", "validate", "adapt") if args.command == "datasets" else ("add", "list", "compare")
        if args.action not in known:
            raise SystemExit(f"{args.command} has the actions {', '.join(known)}")
    if args.command == "init-custom-algorithm":
        return args.run(None, args)
    return args.run(spark or build_session(master=args.master), args)


if __name__ == "__main__":
    sys.exit(main())
