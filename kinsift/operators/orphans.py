"""References that do not resolve, by table, field and period.

Method: parent keys are range-partitioned and kept as one sorted array per range; references are aggregated,
sent to the range their key falls into, and probed there in vectorised batches by binary search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.functions.ids import ref_id
from kinsift.session import cut

#: Keys of one range at most: its sorted array, with two times a key, stays near 10 MB.
KEYS_PER_RANGE = 200_000
#: Few keys still make several ranges, so that the references are probed on all cores, but none of fewer than these.
LEAST_KEYS = 2_000
REFERENCE = "table_name string, field_name string, target string, ref_id string, period string, first_us long, last_us long"
MISS = "table_name string, field_name string, period string, ref_id string, reason string"
_NEVER = np.iinfo(np.int64).max


def references(df: DataFrame, table: str, field: str, time: str, target: str) -> DataFrame:
    """The references of one field, aggregated: per key and month the earliest and the latest, which decide on
    `early` and `deleted` as all of them would. A hot key leaves each map task as one row a month."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return (
        df.select(ref_id(field).alias("ref_id"), F.coalesce(F.date_format(time, "yyyy-MM"), F.lit("unknown")).alias("period"), us.alias("_t"))
        .where("ref_id is not null")
        .groupBy("ref_id", "period")
        .agg(F.min("_t").alias("first_us"), F.max("_t").alias("last_us"))
        .select(F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), F.lit(target).alias("target"), "ref_id", "period", "first_us", "last_us")
    )


def parents(df: DataFrame, key: str, born: str, gone: str | None, target: str) -> DataFrame:
    """One row a trimmed key: since when it has been there and from when it is gone (microseconds).

    Rows whose keys differ in white space only are one parent, there from the earliest time, gone at the last."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    end: Column = F.coalesce(us(gone), F.lit(int(_NEVER))) if gone else F.lit(int(_NEVER))
    return (
        df.select(ref_id(key).alias("key"), F.coalesce(us(born), F.lit(-int(_NEVER))).alias("_b"), end.alias("_g"))
        .where("key is not null")
        .groupBy("key")
        .agg(F.min("_b").alias("born"), F.max("_g").alias("gone"))
        .select(F.lit(target).alias("target"), "key", "born", "gone")
    )


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition and target: its keys in order."""
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return
    whole = pa.Table.from_batches(kept).to_pandas()
    for target, own in whole.groupby("target", sort=True):
        own = own.sort_values("key", key=lambda s: s.str.encode("utf-8"), kind="stable")
        row = {"target": target, "low": own["key"].iloc[0], "keys": own["key"].tolist(), "born": own["born"].tolist(), "gone": own["gone"].tolist()}
        yield pa.RecordBatch.from_pylist([row], schema=_ARRAY_ARROW)


_ARRAY = "target string, low string, keys array<string>, born array<long>, gone array<long>"
_ARRAY_ARROW = pa.schema([("target", pa.string()), ("low", pa.string()), ("keys", pa.list_(pa.string())), ("born", pa.list_(pa.int64())), ("gone", pa.list_(pa.int64()))])


def _probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """left: references of one range; right: the one row with the range's sorted arrays, or none."""
    if not len(left):
        return pd.DataFrame(columns=["table_name", "field_name", "period", "ref_id", "reason"])
    wanted = np.array([x.encode() for x in left["ref_id"]], dtype=object)
    known = np.zeros(len(left), bool)
    born = np.full(len(left), -_NEVER)
    gone = np.full(len(left), _NEVER)
    if len(right):
        keys = np.array([x.encode() for x in right["keys"].iloc[0]], dtype=object)
        at = np.searchsorted(keys, wanted)
        known = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted)
        safe = np.where(known, at, 0)
        born = np.where(known, np.asarray(right["born"].iloc[0], dtype=np.int64)[safe], born)
        gone = np.where(known, np.asarray(right["gone"].iloc[0], dtype=np.int64)[safe], gone)
    timed = left["first_us"].notna().to_numpy()
    first = left["first_us"].fillna(0).to_numpy(np.int64)
    last = left["last_us"].fillna(0).to_numpy(np.int64)
    parts = []
    for reason, hit in (("missing", ~known), ("early", known & timed & (first < born)), ("deleted", known & timed & (last >= born) & (last >= gone))):
        parts.append(left.loc[hit, ["table_name", "field_name", "period", "ref_id"]].assign(reason=reason))
    return pd.concat(parts)


def find_orphans(refs: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """Distinct (table_name, field_name, period, ref_id, reason) of the references in `refs` (see references())
    that do not resolve in `parent_rows` (see parents()).

    reason: `missing` (no such key), else `early` (the key came later than the reference), else `deleted` (it was
    gone by then); a key may be early for one reference of a month and deleted for another. Untimed references
    can only be missing. Null and empty keys are no references. An empty parent table makes every reference
    missing; an empty reference table gives no rows. Extra columns of the inputs are never read."""
    parent_rows = cut(parent_rows)
    total = parent_rows.count()
    width = int(parent_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-total // KEYS_PER_RANGE), min(width, total // LEAST_KEYS))
    arrays = cut(parent_rows.repartitionByRange(ranges, "target", "key").mapInArrow(_arrays, _ARRAY))
    # An entry a range and target: their number grows by one for KEYS_PER_RANGE keys. Strings sort as their UTF-8 does.
    lows = sorted(r.target + "\x1f" + r.low for r in arrays.select("target", "low").collect())
    heads = [x.partition("\x1f")[0] for x in lows]

    @F.pandas_udf("int")
    def range_of(target: pd.Series, key: pd.Series) -> pd.Series:
        at = np.searchsorted(np.array(lows, dtype=object), (target + "\x1f" + key).to_numpy(dtype=object), side="right") - 1
        own = np.array([*heads, ""], dtype=object)[at]
        return pd.Series(np.where((at >= 0) & (own == target.to_numpy(dtype=object)), at, -1), dtype="int32")

    placed = cut(refs.withColumn("rng", range_of("target", "ref_id")))
    # Only a range with very many references is split, and only its array copied.
    parts = cut(placed.groupBy("rng").agg(F.ceil(F.count("*") / KEYS_PER_RANGE).cast("int").alias("parts")))
    sides = placed.join(F.broadcast(parts), "rng").withColumn("part", F.pmod(F.xxhash64("ref_id"), F.col("parts")).cast("int")).drop("parts")
    tables = arrays.withColumn("rng", range_of("target", "low")).join(F.broadcast(parts), "rng").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return sides.groupBy("rng", "part").cogroup(tables.groupBy("rng", "part")).applyInPandas(_probe, MISS)
