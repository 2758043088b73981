"""Retrieval and answer metrics, in long form (query_id, metric, value) or one row per query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators.ranking import first_seen


def graded(ranking: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20), ap: int = 16) -> DataFrame:
    """One row per query of qrels (query_id, doc_id, relevance >= 0): hit, recall, mrr and ndcg at each k (gain 2 ** grade - 1) and map at `ap`.
    Repeated documents count at their first rank; an unranked query has zeros."""
    good = qrels.where("relevance > 0")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    ideal = good.withColumn("_at", place).groupBy("query_id").agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("_at") <= k, gain(F.col("relevance"), F.col("_at")))).alias(f"_ideal{k}") for k in ks])
    hits = first_seen(ranking).join(good, ["query_id", "doc_id"])
    hits = hits.withColumn("_before", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    r = F.col("rank")
    sums = [F.min("rank").alias("_first"), F.sum(F.when(r <= ap, F.col("_before") / r)).alias("_ap")]
    for k in ks:
        sums += [F.count_if(r <= k).alias(f"_hits{k}"), F.sum(F.when(r <= k, gain(F.col("relevance"), r))).alias(f"_dcg{k}")]
    joined = ideal.join(hits.groupBy("query_id").agg(*sums), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = []
    for k in ks:
        out += [
            (F.coalesce(F.col(f"_hits{k}"), F.lit(0)) > 0).cast("double").alias(f"hit_{k}"),
            zero(F.col(f"_hits{k}") / F.col("n")).alias(f"recall_{k}"),
            zero(F.when(F.col("_first") <= k, 1 / F.col("_first"))).alias(f"mrr_{k}"),
            F.round(zero(F.col(f"_dcg{k}") / F.col(f"_ideal{k}")), 9).alias(f"ndcg_{k}"),
        ]
    return joined.select("query_id", *out, F.round(zero(F.col("_ap") / F.least(F.col("n"), F.lit(ap))), 9).alias(f"map_{ap}"))


def binary(ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 50)) -> DataFrame:
    """One row per query of gold (query_id, doc_id): recall, hit, all_evidence, mrr and ndcg at each k with binary gain."""
    size = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    hits = first_seen(ranking).join(gold.distinct(), ["query_id", "doc_id"])
    r, sums = F.col("rank"), [F.min("rank").alias("_first")]
    for k in ks:
        sums += [F.count_if(r <= k).alias(f"_hits{k}"), F.sum(F.when(r <= k, 1 / F.log2(r + 1))).alias(f"_dcg{k}")]
    joined = size.join(hits.groupBy("query_id").agg(*sums), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = []
    for k in ks:
        best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        hit = F.coalesce(F.col(f"_hits{k}"), F.lit(0))
        out += [
            (hit / F.col("n")).alias(f"recall_{k}"), (hit > 0).cast("double").alias(f"hit_{k}"), (hit == F.col("n")).cast("double").alias(f"all_evidence_{k}"),
            zero(F.when(F.col("_first") <= k, 1 / F.col("_first"))).alias(f"mrr_{k}"), F.round(zero(F.col(f"_dcg{k}")) / best, 9).alias(f"ndcg_{k}"),
        ]
    return joined.select("query_id", *out)


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays: a merge of both in order, each element met once."""
    both = F.array_sort(F.concat(F.transform(a, lambda w: F.struct(w.alias("w"), F.lit(0).alias("side"))), F.transform(b, lambda w: F.struct(w.alias("w"), F.lit(1).alias("side")))))
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("left"), F.lit(0).alias("shared"))

    def step(s: Column, x: Column) -> Column:
        left = F.when(x["w"].eqNullSafe(s["w"]), s["left"]).otherwise(F.lit(0))  # of this word, those of a not met by one of b
        pair = (x["side"] == 1) & (left > 0)
        return F.struct(x["w"].alias("w"), F.when(x["side"] == 0, left + 1).when(pair, left - 1).otherwise(left).alias("left"), (s["shared"] + pair.cast("int")).alias("shared"))

    return F.aggregate(both, start, step, lambda s: s["shared"])


def token_f1(prediction: Column, reference: Column) -> Column:
    """Of two token arrays; both empty: 1."""
    shared = bag_overlap(prediction, reference)
    return F.when((F.size(prediction) == 0) & (F.size(reference) == 0), 1.0).when(shared == 0, 0.0).otherwise(2.0 * shared / (F.size(prediction) + F.size(reference)))


def answer_metrics(rows: DataFrame, normalise) -> DataFrame:
    """(query_id, prediction, references) to exact match and token F1, each the best over the references, and whether nothing was answered."""
    tokens = lambda c: F.filter(F.split(normalise(c), " "), lambda w: w != "")
    one = rows.select("query_id", F.coalesce(normalise(F.col("prediction")), F.lit("")).alias("_p"), F.explode("references").alias("_r"))
    one = one.withColumns({"_n": normalise(F.col("_r")), "_pt": tokens(F.col("_p")), "_rt": tokens(F.col("_r"))})
    return one.groupBy("query_id").agg(F.max((F.col("_p") == F.col("_n")).cast("double")).alias("em"), F.round(F.max(token_f1(F.col("_pt"), F.col("_rt"))), 9).alias("f1"), F.bool_or(F.col("_p") == "").alias("nonanswer"))


def lexical_metrics(rows: DataFrame) -> DataFrame:
    """(query_id, prediction, references, language) to exact match and token F1, each the best over the references. An empty prediction has 0 of
    both and is no answer; no reference, or an empty one, raises when it is read."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    one = rows.select("query_id", X.lexical_answer(F.coalesce("prediction", F.lit("")), F.col("language")).alias("_p"), "language", F.explode_outer("references").alias("_r"))
    one = one.withColumn("_n", X.lexical_answer(F.col("_r"), F.col("language")))
    one = one.withColumn("_n", F.when(F.coalesce(F.col("_n"), F.lit("")) == "", F.raise_error(F.lit("references must not be empty")).cast("string")).otherwise(F.col("_n")))
    answered = F.col("_p") != ""
    em, f1 = F.when(answered & (F.col("_p") == F.col("_n")), 1.0).otherwise(0.0), F.when(answered, token_f1(words(F.col("_p")), words(F.col("_n")))).otherwise(0.0)
    return one.groupBy("query_id").agg(F.max(em).alias("em"), F.round(F.max(f1), 9).alias("f1"), F.bool_or(~answered).alias("nonanswer"))


def citation_metrics(rows: DataFrame) -> DataFrame:
    """(query_id, cited, gold: arrays) to set precision, recall and hit; nothing cited: precision 0."""
    both = F.size(F.array_intersect("cited", "gold"))
    cited, gold = F.size(F.array_distinct("cited")), F.size(F.array_distinct("gold"))
    return rows.select("query_id", F.when(cited > 0, both / cited).otherwise(0.0).alias("precision"), F.when(gold > 0, both / gold).otherwise(0.0).alias("recall"), (both > 0).cast("double").alias("hit"))


def word_errors(reference: list[str], prediction: list[str]) -> tuple[int, int, int, int]:
    """(errors, substitutions, deletions, insertions) of a least-cost alignment; of equal ones, that with most substitutions, then most deletions.

    One number ranks alignments: errors first, then fewer substitutions and deletions count as worse. The table of it is filled along
    diagonals, a whole diagonal at a time."""
    n, m = len(reference), len(prediction)
    if not n or not m:
        return n + m, 0, n, m
    base = n + m + 1
    # an error costs base squared; a substitution gives back base, a deletion 1, so the least sum follows the order stated
    wide = object if base > 1_000_000 else np.int64
    swap, drop, add = base * base - base, base * base - 1, base * base
    kinds: dict[str, int] = {}
    a, b = (np.array([kinds.setdefault(w, len(kinds)) for w in x]) for x in (reference, prediction))
    before, last = np.zeros(0, wide), np.zeros(1, wide)  # cells (i, d - i) of the two diagonals before, by i
    low_before, low_last = 0, 0
    for d in range(1, n + m + 1):
        low, high = max(0, d - m), min(n, d)
        i = np.arange(low, high + 1)
        cell = np.full(len(i), np.iinfo(np.int64).max // 2, np.int64).astype(wide)
        up = i >= 1  # from (i - 1, d - i): a deletion
        cell[up] = last[i[up] - 1 - low_last] + drop
        left = i <= d - 1  # from (i, d - i - 1): an insertion
        cell[left] = np.minimum(cell[left], last[i[left] - low_last] + add)
        both = up & left
        if both.any():
            x = i[both]
            cell[both] = np.minimum(cell[both], before[x - 1 - low_before] + np.where(a[x - 1] == b[d - x - 1], 0, swap))
        before, low_before, last, low_last = last, low_last, cell, low
    total = int(last[-1])
    errors = -(-total // (base * base))
    given = errors * base * base - total
    return errors, given // base, given % base, errors - given // base - given % base


def alignment(rows: DataFrame) -> DataFrame:
    """(id, reference, prediction: token arrays) to word errors of each row. The table of the alignment is kept row by row."""

    def run(frames):
        for f in frames:
            got = [word_errors(list(a), list(b)) for a, b in zip(f["reference"], f["prediction"])]
            yield pd.DataFrame({"id": f["id"], "words": [len(a) for a in f["reference"]], **{c: np.array([g[i] for g in got], dtype="int64") for i, c in enumerate(("errors", "substitutions", "deletions", "insertions"))}})

    return rows.select("id", "reference", "prediction").mapInPandas(run, "id long, words long, errors long, substitutions long, deletions long, insertions long")


def corpus_rate(aligned: DataFrame) -> DataFrame:
    """Errors over reference words of all rows together."""
    return aligned.agg(*[F.sum(c).alias(c) for c in ("words", "errors", "substitutions", "deletions", "insertions")]).withColumn("wer", F.round(F.col("errors") / F.nullif(F.col("words"), F.lit(0)), 9))
