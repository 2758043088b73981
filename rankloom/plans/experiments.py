"""The registry of channel subsets and rerankers, the grid of cells, and their progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Channels of each track, in fusion order, and the rerankers.
TRACKS = {"photo": "BGENSJ", "document": "BGENSJ", "environment_audio": "BGENSJ", "speech": "BGENJ", "video": "BGENSJ", "code": "BGE", "composed_image": "BGENJ"}
RERANKERS = ("none", "judge_text", "cross_encoder_text", "relevance_model")


def subsets(spark: SparkSession, tracks: dict[str, str] | None = None) -> DataFrame:
    """(track, channels) of every non-empty subset of each track's channels, by bit masks."""
    tracks = tracks or TRACKS
    base = spark.createDataFrame(list(tracks.items()), "track string, letters string")
    mask = base.select("track", "letters", F.explode(F.expr("sequence(1, cast(pow(2, length(letters)) as int) - 1)")).alias("mask"))
    chosen = F.expr("array_join(filter(transform(sequence(1, length(letters)), i -> if(shiftright(mask, i - 1) & 1 = 1, substring(letters, i, 1), '')), c -> c <> ''), '')")
    return mask.select("track", chosen.alias("channels"))


def families(spark: SparkSession, tracks: dict[str, str] | None = None) -> DataFrame:
    rerankers = spark.createDataFrame([(r,) for r in RERANKERS], "reranker string")
    return subsets(spark, tracks).crossJoin(F.broadcast(rerankers))


def cells(spark: SparkSession, tracks: dict[str, str] | None = None, budgets: tuple[str, ...] = ("per_channel", "total"), ks: tuple[int, ...] = (20, 50, 100), main: int = 50) -> DataFrame:
    """Every family with every budget mode and, if it reranks, every candidate count; those of the first mode and the main count are primary."""
    grid = spark.createDataFrame([(b, k) for b in budgets for k in ks], "budget string, candidates int")
    out = families(spark, tracks).crossJoin(F.broadcast(grid))
    out = out.where((F.col("reranker") != "none") | (F.col("candidates") == main)).withColumn("candidates", F.when(F.col("reranker") != "none", F.col("candidates")))
    return out.withColumn("primary", (F.col("budget") == budgets[0]) & (F.col("candidates").isNull() | (F.col("candidates") == main)))
