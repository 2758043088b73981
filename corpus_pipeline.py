"""A corpus pipeline: documents of good quality, one of each group of near copies, without repeated passages, mixed to target
weights, packed into sequences. Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import mixing, near, packing, quality, substrings
from rankloom.llm.shared import settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Shares of tokens that the corpus should have by domain.
MIX = {"good": 0.92, "poor": 0.04, "toxic": 0.04}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model, carry=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near copies: five-word shingles, similarity of 0.8 or more."""
    return near.first_of_each(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier document has; documents that had words and have none left go."""
    out = substrings.remove_repeats(docs.select(*COLUMNS), carry=["lang", "source", "n_chars"], with_text=True).where("n_removed = 0 OR n_removed < n_words")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring poor and toxic text down to their weights; likely good ones all stay, and none is copied."""
    return mixing.drawn(mixing.mix(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), weights=MIX, keep="good", most=1)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality_stage), ("n-gram Jaccard join", near_stage), ("substring dedup", substring_stage), ("mixing to target weights", mixing_stage), ("packing", packing_stage)]
#: The classifiers and the tokenizer have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole documents table; each result is a written table before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
