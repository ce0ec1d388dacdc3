"""Plan shapes for keys of very unequal size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsift.session import cut

#: A key with fewer rows than this is never worth a path of its own.
HOT_ROWS = 100_000
#: No more hot keys than this are broadcast: with at least total / MOST_HOT rows each, there can't be more.
MOST_HOT = 500_000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str) -> DataFrame:
    """left inner join right, where right has one row a key and counts the key's rows of left in `count`.

    Keys with very many rows of left are broadcast, all others shuffled. The broadcast is bounded: a hot key
    stands for at least max(HOT_ROWS, rows / MOST_HOT) rows, so that there are MOST_HOT of them at most."""
    total, most = right.agg(F.sum(count), F.max(count)).first()
    floor = max(HOT_ROWS, (total or 0) // MOST_HOT)
    if (most or 0) < floor:
        return left.join(right.drop(count), on)
    hot = right.where(F.col(count) >= floor).drop(count)
    cold = right.where(F.col(count) < floor).drop(count)
    mark = hot.select(*on).withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(mark), on, "left")
    fast = marked.where("_hot").drop("_hot").join(F.broadcast(hot), on)
    rest = marked.where("_hot is null").drop("_hot").join(cold, on)
    return fast.unionByName(rest)


def running_totals(df: DataFrame, group: list[str], order: str, size: str, out: str, buckets: int = 1024) -> DataFrame:
    """Adds `out`: the total of `size` over the rows of the group that come before, in the order of the
    64-bit hash column `order` (ties by every other column given in `group`'s rows must not exist).

    Ordered buckets of the hash are summed first and the sums added up (groups x buckets rows); rows are
    sorted only within their bucket, so that no group is ever sorted in one task."""
    width = (1 << 64) // buckets
    with_bucket = df.withColumn("_b", F.floor(F.col(order).cast("decimal(20,0)") / F.lit(width)).cast("long"))
    sums = with_bucket.groupBy(*group, "_b").agg(F.sum(size).alias("_s"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = with_bucket.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return ranked.join(starts, [*group, "_b"]).withColumn(out, F.col("_start") + F.col("_in")).drop("_b", "_start", "_in")


def in_ranges(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df as a written table with `_range`: rows of a smaller range come first in the given order. Ranges are
    Spark's own, from a sample of the order; equal rows are in one range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))


def ordered_totals(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with running totals: for every out: column of `sums`, the total of the column over all rows up to and with
    this one in the given order (which tells all rows apart).

    Ranges of the order are totalled first, a row a range; rows are sorted within their range only."""
    ranged = in_ranges(df, order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_own_{out}") for out, c in sums.items()])
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_own_{out}").over(before), F.lit(0)).alias(f"_start_{out}") for out in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({out: F.sum(c).over(inside) for out, c in sums.items()})
    joined = own.join(F.broadcast(starts), "_range")  # a row a range
    return joined.withColumns({out: F.col(out) + F.col(f"_start_{out}") for out in sums}).drop("_range", *[f"_start_{out}" for out in sums])


def numbered(df: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    """(df with `out`: 0, 1, 2, ... in the given order, which tells all rows apart; number of rows)."""
    placed = cut(ordered_totals(df.withColumn("_one", F.lit(1)), [F.col(c) for c in order], {out: "_one"}).drop("_one").withColumn(out, F.col(out) - 1))
    return placed, placed.count()
