"""Leaderboards, suite summaries and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame) -> DataFrame:
    """rows (task_family, dataset_name, algorithm_name, metric, score) with `rank`: the smallest of equal scores'
    places, missing and NaN scores last."""
    score = F.when(~F.isnan("score"), F.col("score"))
    order = Window.partitionBy("task_family", "dataset_name", "metric").orderBy(score.desc_nulls_last())
    return rows.withColumn("score", score).withColumn("rank", F.rank().over(order))


def aggregated(rows: DataFrame) -> DataFrame:
    """Per task family, algorithm and metric: mean, median, data sets, samples, and the rank by mean."""
    out = rows.groupBy("task_family", "algorithm_name", "metric").agg(
        F.avg("score").alias("mean_score"), F.median("score").alias("median_score"), F.countDistinct("dataset_name").alias("dataset_count"), F.sum("sample_count").alias("sample_count")
    )
    order = Window.partitionBy("task_family", "metric").orderBy(F.col("mean_score").desc_nulls_last())
    return out.withColumn("rank", F.rank().over(order))


def ordered(board: DataFrame) -> DataFrame:
    keys = ["task_family", *(c for c in ("dataset_name",) if c in board.columns), "metric", "rank", "algorithm_name"]
    return board.orderBy(*keys)


def filtered(board: DataFrame, task_family: str | None = None, dataset_name: str | None = None, metric: str | None = None, algorithm_name: str | None = None) -> DataFrame:
    for column, value in (("task_family", task_family), ("dataset_name", dataset_name), ("metric", metric), ("algorithm_name", algorithm_name)):
        if value is not None:
            board = board.where(F.col(column) == value)
    return board


def suite_summary(runs: DataFrame, by: str = "run_name") -> DataFrame:
    """runs (run, left_id, right_id, similarity_score): count, mean, median, max, min, std (n) to 4 decimals and
    the first of the best pairs; best runs first."""
    best = F.max(F.struct("similarity_score", F.struct(F.col("left_id"), F.col("right_id")).alias("pair"))).alias("best")
    r4 = lambda c: F.round(c, 4)
    out = runs.groupBy(by).agg(
        F.count("*").alias("pair_count"), r4(F.avg("similarity_score")).alias("mean_score"), r4(F.median("similarity_score")).alias("median_score"), r4(F.max("similarity_score")).alias("max_score"),
        r4(F.min("similarity_score")).alias("min_score"), r4(F.stddev_pop("similarity_score")).alias("std_score"), best,
    )
    flat = out.select("*", F.col("best.pair.left_id").alias("top_left"), F.col("best.pair.right_id").alias("top_right")).drop("best")
    return flat.orderBy(F.desc("max_score"), F.desc("mean_score"), by)


def run_listing(runs: DataFrame) -> DataFrame:
    """runs (run_id, created_at, dataset_name, algorithm_name, ...): rows, data sets and algorithms of each run."""
    return runs.groupBy("run_id", "created_at").agg(
        F.count("*").alias("rows"), F.countDistinct("dataset_name").alias("dataset_count"), F.countDistinct("algorithm_name").alias("algorithm_count")
    )


def compare_runs(aggregates: DataFrame, baseline: str | None = None) -> DataFrame:
    """aggregates (run_id, created_at, task_family, algorithm_name, metric, mean_score): each row beside the
    baseline's, the earliest run by (created_at, run_id) unless one is named, and the difference."""
    if baseline is None:
        first = aggregates.agg(F.min(F.struct("created_at", "run_id")).alias("f")).select(F.col("f.run_id").alias("baseline_run"))
    else:
        first = aggregates.where(F.col("run_id") == baseline).select(F.col("run_id").alias("baseline_run")).distinct()
    base = aggregates.join(F.broadcast(first), F.col("run_id") == F.col("baseline_run"))  # one row
    base = base.select("task_family", "algorithm_name", "metric", "baseline_run", F.col("mean_score").alias("baseline_score"))
    both = aggregates.join(base, ["task_family", "algorithm_name", "metric"], "left")
    return both.withColumn("delta", F.col("mean_score") - F.col("baseline_score"))
