"""Items of varying length into containers of fixed capacity.

Method: minimum bin slack. All a packing needs to know of the items is how many there are of each length, at
most `capacity` numbers. With the longest remaining item set, a subset-sum over bitsets finds the multiset of
remaining lengths that fills the container closest to its capacity, counts are backtracked, and the filling is
repeated as often as the counts allow. Items then find their container by their rank among those of their
length, so that neither containers nor items pass through one task."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsift.plans.skew import running_totals
from kinsift.session import cut


def _fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the lengths in `counts` with the greatest sum of at most `room`, long lengths first."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:  # binary splitting: blocks of 1, 2, 4, ... items
            block = min(take, left)
            steps.append((length, block, reach))
            reach |= (reach << (length * block)) & mask
            left, take = left - block, take * 2
    at, chosen = reach.bit_length() - 1, Counter()
    for length, block, before in reversed(steps):
        if not (before >> at) & 1:
            chosen[length] += block
            at -= length * block
    return dict(chosen)


def fillings(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(items of each length in a container, number of such containers), for all items in `counts`."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        own = Counter({longest: 1}) + Counter(_fill({k: v for k, v in rest.items() if v}, capacity - longest))
        times = min(left[k] // c for k, c in own.items())
        out.append((dict(own), times))
        for k, c in own.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, part_no, tokens, container_id) for the rows of `items`, whose `key` is unique and not null.

    An item within the capacity is one part (0). A larger one is divided: full containers first, the remainder
    as the last part. Items of size 0, null or less need no container: part 0, 0 tokens, container_id null.
    Keys may be of any type; ties among equal lengths go by the key's hash. Other columns are left out.

    Scale: one pass for sizes, a histogram of at most `capacity` rows to the driver (a proven bound), ranks from
    ordered buckets of the hash (no length is sorted in one task, though a third of all rows may have it), and a
    broadcast of the fillings. Each filling uses up a length, so there are at most `capacity` of them, with at most
    22 different lengths each (1 + 2 + ... + 22 < 256; sqrt(2 * capacity) in general)."""
    spark = items.sparkSession
    whole = F.coalesce(F.col(size).cast("long"), F.lit(0))
    sizes = items.select(F.col(key).alias("_key"), F.greatest(whole, F.lit(0)).alias("_size"))
    parts = cut(
        sizes.withColumn("full", F.floor(F.col("_size") / capacity))
        .withColumn("rest", F.col("_size") - F.col("full") * capacity)
        .withColumn("n", F.col("full") + F.when((F.col("rest") > 0) | (F.col("_size") == 0), 1).otherwise(0))
        .select("_key", "full", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("part_no"))
        .select("_key", "part_no", F.when(F.col("part_no") < F.col("full"), F.lit(capacity)).otherwise(F.col("rest")).cast("int").alias("tokens"))
    )
    counts = {r.tokens: r.n for r in parts.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    rows, ranks, container = [], Counter(), 0
    for own, times in fillings(counts, capacity):
        for length, each in own.items():
            rows.append((length, ranks[length], ranks[length] + each * times, container, each))
            ranks[length] += each * times
        container += times
    plan = spark.createDataFrame(rows, "tokens int, low long, high long, first long, each int")
    keyed = parts.where("tokens > 0").withColumn("_h", F.xxhash64("_key", "part_no")).withColumn("_one", F.lit(1))
    ranked = _ranked(keyed)
    fit = (F.col("p.tokens") == F.col("r.tokens")) & (F.col("r._rank") >= F.col("p.low")) & (F.col("r._rank") < F.col("p.high"))
    placed = ranked.alias("r").join(F.broadcast(plan).alias("p"), fit)
    out = placed.select("_key", "part_no", "r.tokens", (F.col("first") + F.floor((F.col("_rank") - F.col("low")) / F.col("each"))).alias("container_id"))
    none = parts.where("tokens = 0").select("_key", "part_no", "tokens", F.lit(None).cast("long").alias("container_id"))
    return out.unionByName(none).withColumnRenamed("_key", key)


def _ranked(keyed: DataFrame) -> DataFrame:
    """Ranks 0.. among the parts of a length, by hash; equal hashes are told apart by the key."""
    same = Window.partitionBy("tokens", "_h").orderBy("_key", "part_no")
    once = keyed.withColumn("_tie", F.row_number().over(same) - 1)
    firsts = once.groupBy("tokens", "_h").agg(F.sum("_one").alias("_one"))
    return once.drop("_one").join(running_totals(firsts, ["tokens"], "_h", "_one", "_before").drop("_one"), ["tokens", "_h"]).withColumn("_rank", F.col("_before") + F.col("_tie"))


def check_packing(packed: DataFrame, items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """One row: the tokens packed, how many were lost or made up, containers above the capacity, items within the
    capacity that were divided, and containers used beyond the least possible by the tokens."""
    loads = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("load"))
    held = loads.agg(F.coalesce(F.sum("load"), F.lit(0)).alias("tokens"), F.count_if(F.col("load") > capacity).alias("overfull"), F.count("*").alias("used"))
    parts = packed.groupBy(key).agg(F.count("*").alias("parts"), F.sum("tokens").alias("own"))
    small = parts.agg(F.count_if((F.col("own") <= capacity) & (F.col("parts") > 1)).alias("divided"))
    given = items.agg(F.coalesce(F.sum(F.greatest(F.col(size), F.lit(0))), F.lit(0)).alias("given"))
    row = held.crossJoin(small).crossJoin(given)  # one row each
    return row.select("tokens", (F.col("tokens") - F.col("given")).alias("lost"), "overfull", "divided", (F.col("used") - F.ceil(F.col("tokens") / capacity)).alias("beyond_least"))
