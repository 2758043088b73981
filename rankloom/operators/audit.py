"""Validation: every check returns its violations or its verdicts as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rejections(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows with the reason of the first rule that holds, null for good rows."""
    return rows.withColumn("reason", F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")


def qrel_violations(qrels: DataFrame, queries: DataFrame, corpus: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Counts of broken rules of a label table: unknown ids, repeated pairs, grades out of range, queries without a positive, excluded positives."""
    good = qrels.where("relevance > 0")
    checks = [
        ("unknown_query", orphans(qrels, queries, "query_id").agg(F.count("*").alias("n"))),
        ("unknown_document", orphans(qrels, corpus, "doc_id").agg(F.count("*").alias("n"))),
        ("repeated_pair", repeated_keys(qrels, ["query_id", "doc_id"]).agg(F.count("*").alias("n"))),
        ("grade_out_of_range", qrels.agg(F.count_if(~F.coalesce(F.col("relevance").between(0, 30), F.lit(False))).alias("n"))),
        ("query_without_positive", queries.select("query_id").distinct().join(good, "query_id", "left_anti").agg(F.count("*").alias("n"))),
        ("excluded_positive", good.join(exclusions, ["query_id", "doc_id"], "left_semi").agg(F.count("*").alias("n"))),
    ]
    out = None
    for name, found in checks:
        one = found.select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def counts(actual: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(name, expected, actual, ok) of tables' row counts."""
    out = None
    for name, df in actual.items():
        one = df.agg(F.count("*").alias("actual")).select(F.lit(name).alias("name"), F.lit(expected[name]).cast("long").alias("expected"), "actual").withColumn("ok", F.col("expected") == F.col("actual"))
        out = one if out is None else out.unionByName(one)
    return out


def tiling(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per document: whether segments (doc_id, start, stop) cover [0, length) without gap or overlap. Every document of lengths is judged."""
    w = Window.partitionBy("doc_id").orderBy("start", "stop")
    step = segments.withColumn("_bad", (F.col("start") != F.coalesce(F.lag("stop").over(w), F.lit(0))) | (F.col("stop") <= F.col("start")))
    per = step.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.bool_or("_bad").alias("_bad"), F.max("stop").alias("_end"))
    good = F.when(F.col("length") == 0, F.col("_end").isNull()).otherwise(~F.col("_bad") & (F.col("_end") == F.col("length")))
    return lengths.join(per, "doc_id", "left").select("doc_id", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce(good, F.lit(False)).alias("tiles"))


def verdict_problems(rows: DataFrame, labels: list[str], tolerance: float = 0.001) -> DataFrame:
    """(task_id, choice, probabilities map) with the first thing wrong: unknown label, bad probability, wrong sum, choice not the likeliest."""
    p = F.map_values("probabilities")
    bad = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    known = F.array(*map(F.lit, labels))
    two = F.forall(p, lambda x: F.round(x, 2) == x)
    return rejections(rows, [
        ("label", ~F.array_contains(known, F.col("choice")) | (F.size(F.array_except(F.map_keys("probabilities"), known)) > 0)),
        ("probability", bad),
        ("sum", F.abs(total - 1) > F.when(two, 0.005 * len(labels)).otherwise(tolerance)),
        ("choice", F.element_at("probabilities", F.col("choice")) < F.array_max(p)),
    ])


def longest_run(words: Column) -> Column:
    """The longest run of one word in an array of words: one pass over it, in the row."""
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, w: Column) -> Column:
        run = F.when(w.eqNullSafe(s["w"]), s["run"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("w"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(words, start, step, lambda s: s["best"])
