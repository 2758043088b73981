"""Source components of queries and paired comparisons of a run's variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import stats
from rankloom.operators.graph import components

#: How the queries of a track hang together.
STRATEGIES = {
    "photo": "media", "environment_audio": "media", "video": "media", "speech": "transcript", "code": "function", "document": "document", "composed_image": "reference_and_target",
}
#: The contrasts of a run, by the channels of either side.
CONTRASTS = [("n", "s"), ("n", "n_s"), ("s", "n_s"), ("n", "j"), ("b", "g"), ("b", "e"), ("g", "e"), ("b", "b_g_e")]


def source_links(strategy: str, queries: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, source): what each query's positives, or the query itself, come from. Queries may have group_id and reference_id, documents
    group_id and source_id. A query without a positive, or a positive or query without what the strategy needs, raises when it is read."""
    if strategy not in set(STRATEGIES.values()):
        raise ValueError(strategy)
    positive = queries.join(qrels.where("relevance > 0").select("query_id", "doc_id"), "query_id", "left").join(corpus.select("doc_id", *[F.col(c).alias(f"_{c}") for c in corpus.columns if c != "doc_id"]), "doc_id", "left")
    lacks = lambda what: F.raise_error(F.concat(F.lit(f"no {what} of query "), F.col("query_id").cast("string"))).cast("string")
    named = lambda kind, c: F.when(F.col("doc_id").isNull(), lacks("positive")).when(F.col(c).isNull(), lacks(kind)).otherwise(F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")))
    if strategy == "document":
        sources = [named("document", "_source_id")]
    elif strategy == "function":
        sources = [named("function", "doc_id")]
    elif strategy == "transcript":
        same = F.when(F.col("group_id").isNull() | ~F.col("group_id").eqNullSafe(F.col("_group_id")), lacks("transcript group")).otherwise(F.concat(F.lit("transcript:"), F.col("group_id").cast("string")))
        sources = [same, named("media", "doc_id")]
    else:
        sources = [named("media", "doc_id")]
        if strategy == "reference_and_target":
            sources.append(F.when(F.col("reference_id").isNull(), lacks("reference")).otherwise(F.concat(F.lit("media:"), F.col("reference_id").cast("string"))))
    return positive.select("query_id", F.explode(F.array(*sources)).alias("source")).distinct()


def source_groups(links: DataFrame) -> DataFrame:
    """(query_id, group): queries (long ids, 0 or more) that share a source, directly or by others, have one group: the least id among them."""
    node = F.xxhash64("source").bitwiseOR(F.lit(-(1 << 63)))  # sources are negative nodes, queries nonnegative ones
    found = components(links.select(F.col("query_id").cast("long").alias("a"), node.alias("b")))
    mine = found.where("node >= 0")
    least = mine.groupBy("root").agg(F.min("node").alias("group"))
    return mine.join(least, "root").select(F.col("node").alias("query_id"), "group")


def group_links(links: DataFrame) -> DataFrame:
    """How many queries, groups, sources and associations there are."""
    return links.agg(F.countDistinct("query_id").alias("queries"), F.countDistinct("source").alias("sources"), F.count("*").alias("associations"))


def contrasts(values: DataFrame, track: str, frozen: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(contrast, query_id, metric, left, right, difference) of a track's contrasts whose variants both are there. Values: variant, query_id, metric,
    value. Each variant must have exactly the frozen queries (query_id) of every metric: a query that one lacks raises when it is read."""
    have = {r.variant for r in values.select("variant").distinct().collect()}
    name = lambda x: f"{track}__{x}__none"
    asked = [(a, b) for a, b in pairs or CONTRASTS if name(a) in have and name(b) in have]
    metrics = values.select("metric").distinct()
    if not asked:
        return values.select(F.lit("").alias("contrast"), "query_id", "metric", F.col("value").alias("left"), F.col("value").alias("right"), F.col("value").alias("difference")).limit(0)
    spark = values.sparkSession
    sides = F.broadcast(spark.createDataFrame([(f"{a}-{b}", name(v), s) for a, b in asked for v, s in ((a, "left"), (b, "right"))], "contrast string, variant string, side string"))
    wide = values.join(sides, "variant").groupBy("contrast", "query_id", "metric").agg(*[F.max(F.when(F.col("side") == s, F.col("value"))).alias(s) for s in ("left", "right")])
    plan = frozen.select("query_id").distinct().join(F.broadcast(metrics)).join(F.broadcast(sides.select("contrast").distinct())).withColumn("_in", F.lit(True))
    every = plan.join(wide, ["contrast", "query_id", "metric"], "full_outer")
    whole = F.coalesce(F.col("_in") & F.col("left").isNotNull() & F.col("right").isNotNull(), F.lit(False))
    difference = F.when(whole, F.col("right") - F.col("left")).otherwise(F.raise_error(F.concat(F.lit("not the frozen query set: "), F.col("query_id").cast("string"))).cast("double"))
    return every.select("contrast", "query_id", "metric", "left", "right", difference.alias("difference"))


def contrast_summary(differences: DataFrame, groups: DataFrame, samples: int = 5000, seed: int = 42) -> DataFrame:
    """Means, wins, losses and ties of each contrast and metric, and the 95 % interval over groups drawn with replacement where there are two groups
    or more and none has over half of the queries."""
    by = ["contrast", "metric"]
    d = F.col("difference")
    told = differences.groupBy(*by).agg(F.count(d).alias("n"), F.round(F.avg("left"), 6).alias("left_mean"), F.round(F.avg("right"), 6).alias("right_mean"), (F.round(F.avg(d), 6) + F.lit(0.0)).alias("mean_difference"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))
    totals = differences.join(groups, "query_id").groupBy(*by, F.col("group").alias("cluster")).agg(F.sum("difference").alias("total"), F.count("*").alias("n"))
    may = stats.dominance(totals, by).select(*by, "clusters", "eligible")
    drawn = stats.bootstrap(totals.join(may.where("eligible"), by), samples, seed, by).select(*by, "low", "high")
    return told.join(may, by, "left").join(drawn, by, "left")
