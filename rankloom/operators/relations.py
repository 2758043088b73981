"""Joins over time, order and identity: as-of lookups, aliases, coalescing, upserts, latest states, stratified orders, splits."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.plans.tables import settle


def nearest_in_time(grid: DataFrame, points: DataFrame, by: str, at: str) -> DataFrame:
    """Each grid row (by, at) with the nearest point (by, at, point_id) of its group, ties to the earlier one. One sort of both
    tables together: the last point before and the first after every grid row."""
    both = grid.select(by, at, F.lit(None).cast("long").alias("_id"), F.lit(1).alias("_kind")).unionByName(points.select(by, at, F.col("point_id").alias("_id"), F.lit(0).alias("_kind")))
    point = F.when(F.col("_kind") == 0, F.struct(F.col(at).alias("t"), F.col("_id").alias("i")))
    back = Window.partitionBy(by).orderBy(F.col(at), "_kind", F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(F.col(at).desc(), "_kind", F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"_b": F.last(point, ignorenulls=True).over(back), "_a": F.last(point, ignorenulls=True).over(ahead)}).where("_kind = 1")
    gap = lambda c: F.abs(F.timestamp_diff("MICROSECOND", F.col(f"{c}.t"), F.col(at)))
    early = F.col("_a").isNull() | (gap("_b") <= gap("_a"))
    return found.select(by, at, F.when(early, F.col("_b.i")).otherwise(F.col("_a.i")).alias("point_id"), F.when(early, gap("_b")).otherwise(gap("_a")).alias("micros"))


def coalesced(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """One row a key, the first in order; how many there were, and whether their values differ."""
    first = F.min(F.struct(*order, value))
    return rows.groupBy(*keys).agg(first[value].alias(value), F.count("*").alias("observations"), (F.countDistinct(value) > 1).alias("conflict"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with new rows put in place of those with the same keys."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The value of each key's last row."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, value))[value].alias(value), F.count("*").alias("n_rows"))


def pending(planned: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Planned work that isn't stored yet."""
    return planned.join(stored.select(*keys), keys, "left_anti")


def hash_order(seed: int, key: Column) -> Column:
    """A fixed shuffle: sha256 of the JSON list [seed, key]."""
    return F.sha2(F.concat(F.lit(f"[{seed},"), F.to_json(F.array(key.cast("string"))), F.lit("]")), 256)


def numbered(rows: DataFrame, order: list[str], name: str = "place", weight: str | None = None) -> DataFrame:
    """rows with their place, from 1, in an order of all of them, or the running sum of a weight (a whole number): a range-partitioned sort, and the
    totals of the partitions before."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*parts.schema.fields, T.StructField("_at", T.LongType())])

    def run(batches):
        at = 0
        for b in batches:
            each = np.ones(b.num_rows, np.int64) if weight is None else b.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = at + np.cumsum(each)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto)], schema.names)
            at = int(upto[-1]) if len(upto) else at

    held = settle(parts.mapInArrow(run, schema))
    total = held.groupBy("_part").agg(F.max("_at").alias("_n"))
    before = total.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")


def in_groups(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place, from 1, within their group, and the group's size as <name>_of: by a sort over all tasks, so that no group is one task's."""
    held = numbered(rows, [*by, *order], "_p")
    groups = held.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.min("_p").alias("_first"), F.count("*").alias(f"{name}_of"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return held.join(groups, same).select(*rows.columns, (F.col("_p") - F.col("_first") + 1).alias(name), f"{name}_of")


def round_robin(rows: DataFrame, strata: list[str], order: Column, n: int | None = None) -> DataFrame:
    """Rows taken in turn from each stratum in a given order; the place of each, the first n of them. A turn has as many rows as strata at most."""
    turn = in_groups(rows.withColumn("_order", order), strata, ["_order"], "turn").drop("turn_of")
    # places come from how many rows all strata have in earlier turns
    per = numbered(turn.groupBy("turn").agg(F.count("*").alias("_n")), ["turn"], "_upto", "_n")
    at = F.row_number().over(Window.partitionBy("turn").orderBy(*strata))
    out = turn.join(per, "turn").withColumn("place", F.col("_upto") - F.col("_n") + at).drop("_upto", "_n", "_order")
    return out if n is None else out.where(F.col("place") <= n)


def greedy_split(groups: DataFrame, target: int, seed: int) -> DataFrame:
    """Groups (group_id, n) in a fixed shuffled order, each added to the part if that brings its size strictly closer to the target.

    The running size makes this one fold over the groups, which are summaries (two numbers each), in blocks of Arrow batches."""
    order = groups.select("group_id", "n").withColumn("_key", hash_order(seed, F.col("group_id"))).orderBy("_key", "group_id").coalesce(1)

    def run(batches):
        size = 0
        for b in batches:
            chosen = []
            for n in b.column("n").to_pylist():
                take = abs(target - size - n) < abs(target - size)
                size += n if take else 0
                chosen.append(take)
            yield pa.RecordBatch.from_arrays([b.column("group_id"), b.column("n").cast(pa.int64()), pa.array(chosen, pa.bool_())], ["group_id", "n", "chosen"])

    kind = groups.schema["group_id"].dataType.simpleString()
    return order.drop("_key").mapInArrow(run, f"group_id {kind}, n long, chosen boolean")


def split_seed(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big")
