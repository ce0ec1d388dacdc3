"""The N best items of every group, with ties broken by the smaller item.

Method: histograms of the scores per group give a threshold that at least N items survive; rows below it are
filtered away, the rest is ranked exactly with the tie key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsift.session import cut

#: Bins of a binary order of magnitude. A double's sign, exponent and leading bits of its fraction are its bin,
#: so that bins ascend with the score, need no minimum or maximum and number a few dozen in a group of scores.
BINS_PER_OCTAVE = 8


def _bin(score: Column) -> Column:
    octave = F.floor(F.log2(F.greatest(F.abs(score), F.lit(1e-300))))
    within = F.floor((F.abs(score) / F.pow(F.lit(2.0), octave) - 1) * BINS_PER_OCTAVE)
    place = (octave + 1001) * (BINS_PER_OCTAVE + 1) + F.least(F.greatest(within, F.lit(0)), F.lit(BINS_PER_OCTAVE))
    return F.when(score == 0, F.lit(0)).otherwise(F.signum(score) * place).cast("int")


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, item, score, rank 1..n) of the n items with the highest score in each group, ties by the smaller
    item in code point order. Rows with a null group or item, or a score that is null, NaN or infinite, do not
    count; an item given repeatedly counts once, with its highest score. A group of fewer items comes out
    whole; no rows give no rows. Other columns are left out, whatever their names.

    Scale: the first aggregation is by (group, item), so that no group is hot in it; histograms combine on the
    map side to some dozen bins a group. The threshold table has one row a group and is joined by the group
    with hot groups split by AQE (both sides are plain exchanges of written tables). Ranking keeps n rows of a
    group in each task before the shuffle (Spark's window group limit), so equal scores by the million never
    meet in one task."""
    g, i, s = F.col(group), F.col(item), F.col(score)
    usable = rows.where(g.isNotNull() & i.isNotNull() & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))
    best = cut(usable.groupBy(g.alias("g"), i.alias("i")).agg(F.max(s).cast("double").alias("s")))
    bins = best.groupBy("g", _bin(F.col("s")).alias("bin")).agg(F.count("*").alias("c"))
    down = Window.partitionBy("g").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    kept = bins.withColumn("above", F.coalesce(F.sum("c").over(down), F.lit(0))).where(F.col("above") < n)
    floor = cut(kept.groupBy("g").agg(F.min("bin").alias("least")))
    survivors = best.join(floor, "g").where(_bin(F.col("s")) >= F.col("least"))
    order = [F.desc("s"), F.asc("i")]
    ranked = survivors.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
