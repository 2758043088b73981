"""Hooks for models: encoders, rerankers and rankers are plain objects whose methods work on batches; here they become columns and tables.

A model is sent to the workers once for each task (as what builds it: `make` is called there), works on Arrow batches and is told to
unload at the end. No model comes with this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.ranking import ranked


class Encoder(Protocol):
    identity: str
    dimension: int

    def encode(self, texts: list[str], role: str) -> np.ndarray: ...

    def unload(self) -> None: ...


class Scorer(Protocol):
    identity: str

    def score(self, query: str, candidates: list[str]) -> list[float]: ...


class Generator(Protocol):
    identity: str

    def preflight(self) -> None: ...

    def generate(self, request: dict) -> dict: ...


class Describer(Protocol):
    identity: str

    def describe(self, item: bytes) -> str: ...


def encoded(rows: DataFrame, key: str, text: str, make: Callable[[], Encoder], role: str) -> DataFrame:
    """(key, v) of every row. Vectors of another size than the encoder's, or with components that aren't finite, raise."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            v = np.asarray(model.encode(f[text].fillna("").tolist(), role), float)
            if v.shape != (len(f), model.dimension) or not np.isfinite(v).all():
                raise ValueError(f"{model.identity} gave {v.shape} for {len(f)} texts")
            yield pd.DataFrame({key: f[key], "v": list(v)})
        model.unload()

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, v array<double>")


def pointwise(pairs: DataFrame, make: Callable[[], Scorer], cached: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, new_score) of pairs (query_id, doc_id, query, text): each distinct (query, text) is scored once, unless a table (key, new_score) has
    it. Scores that aren't finite, or as many as candidates, raise."""
    keyed = pairs.withColumn("key", F.sha2(F.to_json(F.struct("query", "text")), 256))
    asked = keyed.select("key", "query", "text").dropDuplicates(["key"])
    if cached is not None:
        asked = asked.join(cached.select("key"), "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            for query, part in f.groupby("query", sort=False):
                scores = np.asarray(model.score(query, part["text"].tolist()), float)
                if scores.shape != (len(part),) or not np.isfinite(scores).all():
                    raise ValueError(f"{model.identity} gave {scores.shape} for {len(part)} candidates")
                yield pd.DataFrame({"key": part["key"], "new_score": scores})

    fresh = asked.mapInPandas(run, "key string, new_score double")
    scores = fresh if cached is None else fresh.unionByName(cached.select("key", "new_score"))
    return keyed.join(scores, "key").select("query_id", "doc_id", "new_score")


def listwise(lists: DataFrame, make: Callable[[], Scorer], most: int = 1000) -> DataFrame:
    """(query_id, doc_id, new_score) of candidate lists (query_id, doc_id, rank, query, text), each scored as a whole, in order. Lists are candidates cut before;
    one of more than `most` raises."""
    kinds = [lists.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > most:
            raise ValueError(f"{len(f)} candidates")
        f, model = f.sort_values("rank"), make()
        scores = np.asarray(model.score(f["query"].iloc[0], f["text"].tolist()), float)
        if scores.shape != (len(f),) or not np.isfinite(scores).all():
            raise ValueError(f"{model.identity} gave {scores.shape} for {len(f)} candidates")
        return pd.DataFrame({"query_id": f["query_id"], "doc_id": f["doc_id"], "new_score": scores})

    return lists.groupBy("query_id").applyInPandas(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, new_score double")


def in_parts(pairs: DataFrame, cut: Callable, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A scorer around another: texts are cut (a column to an array of strings), all parts scored, and a document has its best part's score."""
    parts = pairs.withColumn("text", F.explode(cut(F.col("text")))).withColumn("_part", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("text")))
    # a part is a document of its own while it is scored
    named = parts.withColumn("_doc", F.col("doc_id")).withColumn("doc_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("_part").cast("string")))
    best = score(named.drop("_doc", "_part")).join(named.select("query_id", "doc_id", "_doc"), ["query_id", "doc_id"])
    return best.groupBy("query_id", F.col("_doc").alias("doc_id")).agg(F.max("new_score").alias("new_score"))


def direct(score: Callable[[DataFrame, DataFrame], DataFrame], documents: DataFrame, queries: DataFrame, k: int, exclusions: DataFrame | None = None) -> DataFrame:
    """A ranker: its scores (query_id, doc_id, score) of documents and queries, without excluded pairs, ranked and cut."""
    scores = score(documents, queries)
    if exclusions is not None:
        scores = scores.join(exclusions.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return ranked(scores, k)


def bound(vectors: DataFrame, items: DataFrame, identity: str) -> DataFrame:
    """Stored vectors (id, v, dataset) of exactly the items (id) of a dataset: a vector of another dataset, or an item without one, raises when it is read."""
    both = items.select("id").join(vectors, "id", "full_outer").join(items.select("id", F.lit(True).alias("_in")), "id", "left")
    good = F.coalesce((F.col("dataset") == identity) & F.col("_in") & F.col("v").isNotNull(), F.lit(False))
    return both.select("id", F.when(good, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("vectors aren't of this dataset: "), F.col("id").cast("string"))).cast("array<double>")).alias("v"))


def projected(states: DataFrame, weight: list[float], bias: float, special: list[int]) -> DataFrame:
    """Sparse weights (id, token, weight) of token states (id, token, h): the positive part of h * weight + bias, the largest of a token, special tokens left out."""
    w = F.array(*[F.lit(float(x)) for x in weight])
    total = F.aggregate(F.zip_with("h", w, lambda x, y: x * y), F.lit(float(bias)), lambda s, x: s + x)
    return states.where(~F.col("token").isin(special)).withColumn("weight", F.greatest(F.lit(0.0), total)).groupBy("id", "token").agg(F.max("weight").alias("weight")).where("weight > 0")
