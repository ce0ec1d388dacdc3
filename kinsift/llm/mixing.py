"""A mix of sources whose shares of the total size meet their targets.

Method: Efraimidis-Spirakis sampling. Each record draws an exponential key scaled by its quality weight; whole
epochs of a source come first, then the records with the smallest keys, their sizes summed in the order of the
keys, until the token budget is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsift.functions.ids import strip
from kinsift.session import cut

#: Ordered buckets of a source's keys; only the bucket with the cut is sorted.
BUCKETS = 4096


def source_key(col: str) -> Column:
    """A source as it compares: stripped and lower-cased."""
    return F.lower(strip(col))


def quality_weight(score: Column) -> Column:
    """1 + the alignment score where that lies within 0 and 1, otherwise 1."""
    ok = score.isNotNull() & ~F.isnan(score) & (score >= 0) & (score <= 1)
    return F.when(ok, 1.0 + score).otherwise(F.lit(1.0))


def plan_sources(records: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source of `targets` (source, target_pct, max_repeats): its tokens, its budget (target_pct of T,
    the tokens of all sources in targets), whole epochs, the tokens of the fraction that follows, and whether
    max_repeats keeps it from its share. records: source, tokens.

    A source without records or with a null cap has 0 tokens and 0 repeats. Targets that compare equal are added
    up: their percentages summed, the larger cap taken, the smallest spelling kept."""
    wanted = targets.where(F.col("source").isNotNull()).groupBy(source_key("source").alias("key")).agg(
        F.min("source").alias("source"), F.sum("target_pct").cast("long").alias("target_pct"), F.coalesce(F.max("max_repeats"), F.lit(0)).cast("long").alias("max_repeats")
    )
    own = records.groupBy(source_key("source").alias("key")).agg(F.sum("tokens").cast("long").alias("tokens"), F.max("tokens").cast("long").alias("largest"))
    both = wanted.join(own, "key", "left").fillna(0, ["tokens", "largest"])
    total = F.sum("tokens").over(Window.partitionBy())  # one row a target
    budget = both.withColumn("total", total)
    short = 100 * F.col("max_repeats") * F.col("tokens") < F.col("target_pct") * F.col("total")
    goal = F.floor(F.col("target_pct") * F.col("total") / 100)
    reach = F.least(goal, F.col("max_repeats") * F.col("tokens"))
    return (
        budget.withColumn("short", F.coalesce(short, F.lit(False)))
        .withColumn("goal", reach)
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens"))).otherwise(0))
        .withColumn("fraction", F.col("goal") - F.col("epochs") * F.col("tokens"))
        .select("key", "source", "target_pct", "max_repeats", "tokens", "total", "short", "goal", "epochs", "fraction", "largest")
    )


def draw_mix(records: DataFrame, targets: DataFrame, key: str, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(draws, plan). draws: (key, source, tokens, repeats) of the records used at least once, source being the
    target's spelling; plan: see plan_sources(). records: key (unique), source, tokens, weight.

    Repeats are the source's whole epochs, and one more for records whose running total in key order stays
    within the fraction; so a source never exceeds its budget and misses it by less than one record. Records
    without a target source are not used. Records of 0 tokens follow the rule as others do. The draw depends on
    the seed and the keys only. Weights that are null or not above 0 count as 1.

    Scale: the plan has a row a target source (bounded by the targets table, which is fixed) and is broadcast.
    Sources may hold any share of the rows: keys are summed in BUCKETS ordered buckets a source, and only the
    bucket in which the budget ends, about 1/BUCKETS of the source, is sorted."""
    plan = cut(plan_sources(records, targets))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0))
    keyed = (
        records.select(F.col(key).alias("_key"), source_key("source").alias("key"), F.col("tokens").cast("long").alias("size"), (-F.log(uniform) / weight).alias("draw"))
        .join(F.broadcast(plan.select("key", F.col("source").alias("name"), "epochs", "fraction")), "key")
        .withColumn("bucket", F.floor((1 - F.exp(-F.col("draw"))) * BUCKETS).cast("int"))
    )
    keyed = cut(keyed)
    sums = keyed.groupBy("key", "bucket").agg(F.sum("size").alias("own"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("own").over(before), F.lit(0)))  # at most sources x BUCKETS rows
    placed = keyed.join(F.broadcast(starts), ["key", "bucket"])
    whole = F.col("start") + F.col("own") <= F.col("fraction")
    edge = placed.where(~whole & (F.col("start") < F.col("fraction")))
    inside = Window.partitionBy("key", "bucket").orderBy("draw", "_key").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("extra", ((F.col("start") + F.sum("size").over(inside)) <= F.col("fraction")).cast("int"))
    rest = placed.where(whole | (F.col("start") >= F.col("fraction"))).withColumn("extra", whole.cast("int"))
    drawn = edge.unionByName(rest).withColumn("repeats", F.col("epochs") + F.col("extra")).where("repeats > 0")
    return drawn.select(F.col("_key").alias(key), F.col("name").alias("source"), F.col("size").alias("tokens"), "repeats"), plan


def reached_shares(draws: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source: goal and tokens drawn, the share of the mix reached in percent (4 decimals), whether the
    draw fell short of the source's share with every record used max_repeats times, and the largest mix (in tokens)
    in which all sources that have records could hold their shares.

    All but the plan's own columns is counted from the draw."""
    capped = F.sum(F.when(F.col("repeats") >= F.col("max_repeats"), F.col("tokens")).otherwise(0))
    own = draws.join(F.broadcast(plan.select("source", "max_repeats")), "source")
    got = own.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn"), F.count("*").alias("records"), capped.alias("spent"))
    both = plan.drop("short").join(got, "source", "left").fillna(0, ["drawn", "records", "spent"])
    short = ((F.col("spent") == F.col("tokens")) | (F.col("max_repeats") <= 0)) & (100 * F.col("drawn") < F.col("target_pct") * F.col("total"))
    whole = Window.partitionBy()  # a row a target
    share = F.coalesce(F.try_divide(100.0 * F.col("drawn"), F.sum("drawn").over(whole)), F.lit(0.0))
    reach = F.when((F.col("tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_pct") > 0), F.floor(100 * F.col("max_repeats") * F.col("tokens") / F.col("target_pct")))
    return both.select(
        "source", "target_pct", "max_repeats", "tokens", short.alias("short"), "goal", "drawn", "records", F.round(share, 4).alias("share_pct"), F.min(reach).over(whole).alias("largest_mix")
    )


def check_mix(draws: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, goal, over, far, beyond): whether more was drawn than the goal, whether the goal was missed by the
    largest record of the source or more with records left, and how many records were used more than max_repeats
    times; 0 is right for all."""
    own = draws.join(F.broadcast(plan.select("source", "max_repeats")), "source")
    got = own.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("drawn"), F.sum((F.col("repeats") > F.col("max_repeats")).cast("int")).alias("beyond")
    )
    both = plan.select("source", "goal", "largest").join(got, "source", "left").fillna(0, ["drawn", "beyond"])
    far = (F.col("goal") - F.col("drawn") >= F.greatest("largest", F.lit(1))).cast("int")
    return both.select("source", "goal", (F.col("drawn") > F.col("goal")).cast("int").alias("over"), far.alias("far"), "beyond")
