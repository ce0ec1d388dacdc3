"""Scored pairs as a classifier: confusion counts, threshold sweeps, ROC and precision-recall curves, tuning.

All of it works on counts by distinct score: one aggregation of the pairs, then running totals over as many rows
as there are distinct scores. Totals run over ranges of the scores (ordered_totals), so that no task has them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsift.plans.skew import in_ranges, ordered_totals
from kinsift.session import cut

METRICS = ("f1", "accuracy", "precision", "recall")


def checked(pairs: DataFrame, score: str = "score", label: str = "label", keep: list[str] = ()) -> DataFrame:
    """(score, label, and columns to keep) as double and 0/1; a score that isn't finite or a label outside 0 and 1 fails the query."""
    s, y = F.col(score).cast("double"), F.col(label).cast("int")
    bad_score = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    return pairs.select(
        *keep,
        F.when(bad_score, F.raise_error(F.lit("scores must be finite")).cast("double")).otherwise(s).alias("score"),
        F.when(y.isNull() | ~y.isin(0, 1), F.raise_error(F.lit("labels must be 0 or 1")).cast("int")).otherwise(y).alias("label"),
    )


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_ratios(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy from tp, fp, tn, fn; 0 where a denominator is."""
    c = F.col
    out = counts.withColumn("precision", ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", ratio(c("tp"), c("tp") + c("fn")))
    out = out.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))
    return out.withColumn("accuracy", ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("tn") + c("fn")))


def confusion(pairs: DataFrame, threshold: float = 0.5, greater: bool = True, by: list[str] = ()) -> DataFrame:
    """One row (or one a group): threshold, pair_count, tp, fp, tn, fn and the ratios. A score equal to the
    threshold is a match."""
    hit = (F.col("score") >= threshold) if greater else (F.col("score") <= threshold)
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    counts = pairs.groupBy(*by).agg(
        F.count("*").alias("pair_count"),
        count(hit & (F.col("label") == 1)).alias("tp"), count(hit & (F.col("label") == 0)).alias("fp"),
        count(~hit & (F.col("label") == 0)).alias("tn"), count(~hit & (F.col("label") == 1)).alias("fn"),
    )
    return with_ratios(counts).withColumn("threshold", F.lit(float(threshold)))


def _by_score(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))


def _counts_at(thresholds: DataFrame, counts: DataFrame, greater: bool) -> DataFrame:
    """thresholds: threshold (distinct). Running totals over scores and thresholds in one order."""
    marks = thresholds.select(F.col("threshold").alias("v"), F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit(1).alias("mark"))
    both = counts.select(F.col("score").alias("v"), "p", "n", F.lit(0).alias("mark")).unionByName(marks)
    order = [F.desc("v") if greater else F.asc("v"), F.asc("mark")]
    run = ordered_totals(both, order, {"tp": "p", "fp": "n"}).where("mark = 1")
    whole = counts.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positive_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("negative_count"))
    rows = run.select(F.col("v").alias("threshold"), "tp", "fp").crossJoin(F.broadcast(whole))  # one row
    rows = rows.select("threshold", "positive_count", "negative_count", "tp", "fp", (F.col("negative_count") - F.col("fp")).alias("tn"), (F.col("positive_count") - F.col("tp")).alias("fn"))
    return with_ratios(rows)


def with_previous(df: DataFrame, order: list[Column], columns: list[str], over: str = "_before") -> DataFrame:
    """df with {column}{over}: the columns' values of the row before in the given order, 0 at the first. A range's
    first row has those of the last row of the range before it, of which there is one a range."""
    ranged = in_ranges(df, order)
    inside = Window.partitionBy("_range").orderBy(*order)
    marked = ranged.withColumns({f"{c}{over}": F.lag(c).over(inside) for c in columns} | {"_first": F.row_number().over(inside) == 1, "_last": F.lead(F.lit(1)).over(inside).isNull()})
    marked = cut(marked)
    ends = marked.where("_last").select("_range", *columns)
    earlier = Window.orderBy("_range")
    ends = ends.select(F.lead("_range").over(earlier).alias("_range"), *[F.col(c).alias(f"_end_{c}") for c in columns]).where("_range is not null")
    both = marked.join(F.broadcast(ends), "_range", "left")
    filled = {f"{c}{over}": F.coalesce(F.when(F.col("_first"), F.col(f"_end_{c}")).otherwise(F.col(f"{c}{over}")), F.lit(0)) for c in columns}
    return both.withColumns(filled).drop("_range", "_first", "_last", *[f"_end_{c}" for c in columns])


def _margins(counts: DataFrame) -> DataFrame:
    ends = counts.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    size = F.when(F.col("lo") == F.col("hi"), F.abs("lo")).otherwise(F.col("hi") - F.col("lo"))
    return ends.where("lo is not null").withColumn("m", F.greatest(size * 1e-12, F.lit(1e-12)))


def candidates(counts: DataFrame) -> DataFrame:
    """Every distinct score, the middles between neighbours, and a little beyond both ends."""
    lowest = counts.agg(F.min("score").alias("lowest"))
    after = with_previous(counts.select("score"), [F.col("score")], ["score"]).crossJoin(F.broadcast(lowest))  # one row
    middles = after.where("score <> lowest").select(((F.col("score") + F.col("score_before")) / 2).alias("threshold"))
    ends = _margins(counts).select(F.explode(F.array(F.col("lo") - F.col("m"), F.col("hi") + F.col("m"))).alias("threshold"))
    return counts.select(F.col("score").alias("threshold")).unionByName(middles).unionByName(ends).distinct()


def threshold_sweep(pairs: DataFrame, thresholds: list[float] | None = None, greater: bool = True) -> DataFrame:
    """Counts and ratios at every candidate threshold, or at those given."""
    counts = cut(_by_score(pairs))  # read for marks, middles, ends and totals, but scored once
    if thresholds is None:
        marks = candidates(counts)
    else:
        marks = pairs.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double").distinct()
    return _counts_at(marks, counts, greater)


def best_threshold(pairs: DataFrame, metric: str = "f1", greater: bool = True) -> DataFrame:
    """The candidate with the highest metric, then precision, recall, accuracy, then the larger threshold (the
    smaller where lower is a match), with optimized_metric and candidate_count."""
    if metric not in METRICS:
        raise ValueError(f"a threshold is tuned for one of {', '.join(METRICS)}")
    sweep = threshold_sweep(pairs, greater=greater)
    last = F.col("threshold") if greater else -F.col("threshold")
    best = F.max_by(F.struct(*sweep.columns), F.struct(metric, "precision", "recall", "accuracy", last.alias("_t"))).alias("b")
    return sweep.agg(best, F.count("*").alias("candidate_count")).where("b is not null").select("b.*", "candidate_count", F.lit(metric).alias("optimized_metric"))


def _curve(pairs: DataFrame, greater: bool) -> DataFrame:
    counts = cut(_by_score(pairs))
    ends = _margins(counts).select(F.explode(F.array(F.col("lo") - F.col("m"), F.col("hi") + F.col("m"))).alias("threshold"))
    return _counts_at(counts.select(F.col("score").alias("threshold")).unionByName(ends).distinct(), counts, greater)


def roc_curve(pairs: DataFrame, greater: bool = True) -> DataFrame:
    """True and false positive rates from beyond the best score to beyond the worst."""
    rows = _curve(pairs, greater)
    return rows.withColumn("tpr", F.col("recall")).withColumn("fpr", ratio(F.col("fp"), F.col("negative_count")))


def auroc(pairs: DataFrame, greater: bool = True) -> DataFrame:
    """(auroc, positive_count, negative_count); null with only one class."""
    points = with_previous(roc_curve(pairs, greater), [F.asc("fpr"), F.asc("tpr"), F.asc("threshold")], ["fpr", "tpr"])
    area = (F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2
    out = points.select(area.alias("a"), "positive_count", "negative_count").agg(F.sum("a").alias("a"), F.max("positive_count").alias("positive_count"), F.max("negative_count").alias("negative_count"))
    return out.select(F.when((F.col("positive_count") > 0) & (F.col("negative_count") > 0), F.col("a")).alias("auroc"), "positive_count", "negative_count")


def precision_recall_curve(pairs: DataFrame, greater: bool = True) -> DataFrame:
    return _curve(pairs, greater).withColumn("predicted_positive", F.col("tp") + F.col("fp"))


def average_precision(pairs: DataFrame, greater: bool = True) -> DataFrame:
    """The sum over thresholds, best first, of the growth of recall times precision; null with one class."""
    points = with_previous(precision_recall_curve(pairs, greater), [F.desc("threshold") if greater else F.asc("threshold")], ["recall"])
    step = F.greatest(F.lit(0.0), F.col("recall") - F.col("recall_before")) * F.col("precision")
    out = points.select(step.alias("s"), "positive_count", "negative_count").agg(F.sum("s").alias("s"), F.max("positive_count").alias("p"), F.max("negative_count").alias("n"))
    return out.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("s")).alias("average_precision"))


def tuning_report(pairs: DataFrame, metric: str = "f1", greater: bool = True) -> DataFrame:
    """The best threshold with AUROC and average precision (null where there is one class)."""
    pairs = cut(pairs)  # scored once for three curves
    return best_threshold(pairs, metric, greater).drop("positive_count", "negative_count").crossJoin(auroc(pairs, greater)).crossJoin(average_precision(pairs, greater))  # one row each


def calibration_report(pairs: DataFrame, metric: str = "f1", greater: bool = True, thresholds: list[float] | None = None, one_class: bool = False) -> dict[str, DataFrame]:
    """summary (one row: pair_count, the best threshold, auroc, average_precision), threshold_sweep, roc and
    precision_recall as tables. Labels of one class are an error, or with `one_class` leave auroc, average_precision
    and the curves out."""
    pairs = cut(pairs)
    n = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    both = 0 < n.p < n.n
    if not both and not one_class:
        raise ValueError("a calibration needs pairs of both labels")
    best = best_threshold(pairs, metric, greater).drop("positive_count", "negative_count")
    head = best.select(F.lit(n.n).alias("pair_count"), F.lit(n.p).alias("positive_count"), F.lit(n.n - n.p).alias("negative_count"), F.lit(greater).alias("greater_is_match"), "*")
    out = {"threshold_sweep": threshold_sweep(pairs, thresholds, greater)}
    if both:
        head = head.crossJoin(auroc(pairs, greater).select("auroc")).crossJoin(average_precision(pairs, greater))  # one row each
        out |= {"roc": roc_curve(pairs, greater), "precision_recall": precision_recall_curve(pairs, greater)}
    else:
        head = head.withColumns({"auroc": F.lit(None).cast("double"), "average_precision": F.lit(None).cast("double")})
    return {"summary": head, **out}
