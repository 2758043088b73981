"""Summaries: exact percentiles, breakdowns, paired differences, clustered bootstrap intervals, agreement of judges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.relations import numbered


def percentiles(rows: DataFrame, value: str, by: list[str], ps: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(by, p<percent>) of a value by groups, linear between neighbours; groups without a value are left out. Rows are put in order of group and value by a
    range-partitioned sort, and the places asked for are picked: no group's values meet in one task."""
    held = numbered(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), [*by, "_v"], "_place")
    groups = held.groupBy(*by).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    asked = []
    for i, p in enumerate(ps):
        at = (F.col("_n") - 1) * F.lit(p)
        low = F.floor(at)
        asked += [F.struct(F.lit(i).alias("i"), (F.col("_first") + low).alias("place"), (1 - (at - low)).alias("w")), F.struct(F.lit(i).alias("i"), (F.col("_first") + F.least(low + 1, F.col("_n") - 1)).alias("place"), (at - low).alias("w"))]
    wanted = groups.select("_first", F.explode(F.array(*asked)).alias("a")).select("_first", "a.i", "a.w", F.col("a.place").alias("_place"))
    picked = held.join(wanted, "_place")
    return picked.groupBy("_first").agg(*[F.first(c).alias(c) for c in by], *[F.round(F.sum(F.when(F.col("i") == i, F.col("_v") * F.col("w"))), 6).alias(f"p{round(100 * p)}") for i, p in enumerate(ps)]).drop("_first")


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left joined with right on groups, null ones too."""
    other = right.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in right.columns if c not in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(other, same, "left").drop(*[f"_{c}" for c in by])


def distribution(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, p50, p95 (linear between neighbours) and sum of a value by groups."""
    v = F.col(value)
    told = rows.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.sum(v), 4).alias("total"))
    return _beside(told, percentiles(rows, value, by), by)


def long_form(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return rows.unpivot(keys, metrics, "metric", "value")


def means(long: DataFrame, by: list[str]) -> DataFrame:
    return long.groupBy(*by, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def breakdown(rows: DataFrame, variant: str, columns: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates by variant, and by variant and each column, in one pass (grouping sets)."""
    sets = [[F.col(variant)], *[[F.col(variant), F.col(c)] for c in columns]]
    return rows.groupingSets(sets, F.col(variant), *map(F.col, columns)).agg(*aggregates)


def paired(left: DataFrame, right: DataFrame, key: str = "query_id", value: str = "value", frozen: DataFrame | None = None) -> DataFrame:
    """(key, difference right - left) over keys that both have. With a frozen set of keys, both must have exactly those: a key that one side or
    the set lacks raises when it is read."""
    a, b = left.select(key, F.col(value).alias("_l")), right.select(key, F.col(value).alias("_r"))
    if frozen is None:
        return a.join(b, key).select(key, (F.col("_r") - F.col("_l")).alias("difference"))
    every = a.join(b, key, "full_outer").join(frozen.select(key).distinct().withColumn("_in", F.lit(True)), key, "full_outer")
    whole = F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("_in")
    difference = F.when(F.coalesce(whole, F.lit(False)), F.col("_r") - F.col("_l")).otherwise(F.raise_error(F.concat(F.lit("not the frozen query set: "), F.col(key).cast("string"))).cast("double"))
    return every.select(key, difference.alias("difference"))


def paired_summary(differences: DataFrame, by: list[str] | None = None) -> DataFrame:
    d = F.col("difference")
    return differences.groupBy(*(by or [])).agg(F.count(d).alias("n"), F.round(F.avg(d), 6).alias("mean_difference"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))


def cluster_totals(differences: DataFrame, cluster: str) -> DataFrame:
    return differences.groupBy(cluster).agg(F.sum("difference").alias("total"), F.count("difference").alias("n"))


def bootstrap(totals: DataFrame, samples: int = 1000, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """95 % interval of the mean difference over clusters drawn with replacement. totals: one row per cluster (total, n), in order of
    its key `cluster`. Clusters are few and narrow (one row each); a comparison's clusters go to one task, comparisons run side by side."""
    by = by or []
    schema = ", ".join([f"{c} string" for c in by] + ["clusters long, mean double, low double, high double"])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("cluster")
        total, n = f["total"].to_numpy(float), f["n"].to_numpy(float)
        rng, parts = np.random.default_rng(seed), []
        for at in range(0, samples, 100):
            pick = rng.integers(0, len(f), size=(min(100, samples - at), len(f)))
            parts.append(total[pick].sum(1) / n[pick].sum(1))
        low, high = np.percentile(np.concatenate(parts), [2.5, 97.5])
        return pd.DataFrame([{**{c: str(f[c].iloc[0]) for c in by}, "clusters": len(f), "mean": total.sum() / n.sum(), "low": low, "high": high}])

    return totals.groupBy(*(by or [F.lit(1).alias("_one")])).applyInPandas(run, schema)


def dominance(sizes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whether an interval may be given: two clusters at least, none with more than half of the rows."""
    out = sizes.groupBy(*(by or [])).agg(F.count("*").alias("clusters"), F.max("n").alias("largest"), F.sum("n").alias("n"))
    return out.withColumn("eligible", (F.col("clusters") >= 2) & (2 * F.col("largest") <= F.col("n")))


def agreement(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of (left, right) verdicts: how many, how many agree, and the rate."""
    same = F.col("left") == F.col("right")
    return pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), F.round(F.avg(same.cast("double")), 6).alias("rate"))


def confusion(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pairs.groupBy(*(by or []), "left", "right").agg(F.count("*").alias("n"))


def rate_if_all(hit: Column, known: Column) -> Column:
    """A rate only where every row is known, else null: unmeasured isn't zero."""
    return F.when(F.count_if(known) == F.count("*"), F.count_if(hit) / F.count("*"))
