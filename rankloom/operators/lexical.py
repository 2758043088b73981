"""BM25 over token tables, and texts held whole. Postings are cut to the queries' terms before anything is shuffled by document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators import dense
from rankloom.plans.tables import settle

#: As many terms of queries go to every task; more of them are joined.
BROADCAST_TERMS = 1 << 20


def tokens(docs: DataFrame, text: Column, tokenise, key: str = "doc_id") -> DataFrame:
    """(key, token) with repeats."""
    return docs.select(key, F.explode(tokenise(text)).alias("token"))


def statistics(docs: DataFrame, text: Column, tokenise) -> DataFrame:
    """(doc_id, length) of every document, one without tokens too."""
    return docs.select("doc_id", F.size(tokenise(text)).alias("length"))


def postings(docs: DataFrame, text: Column, terms: DataFrame, tokenise) -> tuple[DataFrame, int, float]:
    """(doc_id, length, token, tf) of the given terms (token), as a written table, with the number of documents and their mean length. Every
    text is tokenised once: the row of token "", which no text holds, stands for the document."""
    held = docs.select("doc_id", F.explode(F.array(F.struct(tokenise(text).alias("w")))).alias("x"))  # a generator is computed once
    every = held.select("doc_id", F.size("x.w").alias("length"), F.explode(F.concat("x.w", F.array(F.lit("")))).alias("token"))
    wanted = terms.select("token").distinct().unionByName(terms.sparkSession.createDataFrame([("",)], "token string"))
    wanted = F.broadcast(wanted) if terms.count() <= BROADCAST_TERMS else wanted
    found = settle(every.join(wanted, "token", "left_semi").groupBy("doc_id", "length", "token").agg(F.count("*").alias("tf")))
    totals = found.where("token = ''").agg(F.sum("tf").alias("n"), F.sum(F.col("tf") * F.col("length")).alias("sum")).first()
    return found.where("token <> ''"), totals.n or 0, (totals["sum"] or 0) / (totals.n or 1)


def bm25_scores(found: DataFrame, n: int, mean: float, asked: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of pairs with a positive score, from postings and the queries' terms (query_id, token, times)."""
    df = found.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / (mean or 1.0)))
    weighed = found.join(df, "token").select("token", "doc_id", (idf * part).alias("w"))
    return asked.join(weighed, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("times") * F.col("w")), 6).alias("score")).where("score > 0")


def counted(docs: DataFrame, text: Column, terms: DataFrame, tokenise) -> DataFrame:
    """(doc_id, length, tokens, counts) of every text as a written table: its number of tokens, and how often it has those among the terms (token). Counted within
    the rows, so nothing is shuffled. More terms than are broadcast cut nothing: then all tokens are kept."""
    spark = docs.sparkSession
    few = terms.select("token").distinct()
    known = few.toArrow().column("token").combine_chunks() if few.count() <= BROADCAST_TERMS else None
    held = spark.sparkContext.broadcast(known)

    def run(batches):
        known = held.value
        for batch in batches:
            sizes = pc.list_value_length(batch.column("w"))
            for lo, hi in dense.cuts(pc.fill_null(sizes, 0).to_numpy().astype(np.int64), dense.SEGMENT_NUMBERS, 1 << 20):
                some = batch.slice(lo, hi - lo)
                size, flat = sizes.slice(lo, hi - lo), some.column("w").flatten()
                values, codes = known, None
                if known is None:
                    flat = flat.dictionary_encode()
                    values, codes = flat.dictionary, flat.indices
                else:
                    codes = pc.fill_null(pc.index_in(flat, value_set=known), -1)
                codes = codes.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(hi - lo), pc.fill_null(size, 0).to_numpy())[codes >= 0]
                key, count = np.unique(row * max(1, len(values)) + codes[codes >= 0], return_counts=True)
                row, code = np.divmod(key, max(1, len(values)))
                edges = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), size.cast(pa.int64()), pa.ListArray.from_arrays(edges, values.take(pa.array(code))), pa.ListArray.from_arrays(edges, pa.array(count.astype(np.int64)))], ["doc_id", "length", "tokens", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return settle(docs.select("doc_id", tokenise(text).alias("w")).mapInArrow(run, f"doc_id {kind}, length long, tokens array<string>, counts array<long>"))


def _merged(found: DataFrame) -> DataFrame:
    """Rows of one id and length are one document's, as in postings; only those of repeated ids are shuffled."""
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return found
    each = found.join(repeated, "doc_id", "left_semi").select("doc_id", "length", F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
    summed = each.groupBy("doc_id", "length", F.col("x.tokens").alias("token")).agg(F.sum("x.counts").alias("tf"))
    whole = summed.groupBy("doc_id", "length").agg(F.collect_list(F.struct("token", "tf")).alias("x")).select("doc_id", "length", F.col("x.token").alias("tokens"), F.col("x.tf").alias("counts"))
    return settle(found.join(repeated, "doc_id", "left_anti").unionByName(whole))


def term_counts(docs: DataFrame, text: Column, asked: DataFrame, tokenise) -> tuple[DataFrame, int, float | None]:
    """`counted` with one row for each id and length, the number of texts, and the mean length of those that are not null."""
    found = counted(docs, text, asked, tokenise)
    n, mean = found.agg(F.count("*"), F.avg("length")).first()
    return _merged(found), n, mean


def bm25_best(found: DataFrame, n: int, mean: float | None, asked: DataFrame, k: int, *, itself: bool = True, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """`bm25_search` from the texts' term counts."""
    df = found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    queries = asked.join(df, "token").select("query_id", "token", (F.col("times") * idf).alias("weight"))
    part = F.transform("counts", lambda c: c / (c + k1 * (1 - b + b * F.col("length") / (mean or 1.0))))
    return dense.sparse_search(queries, found.select("doc_id", "tokens", part.alias("weights")), k, positive=True, itself=itself)


def shared_best(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k texts (doc_id) that have most of each query's distinct terms (query_id, token), from the texts' term counts; the score is their number. A term that several
    rows of an id have counts once."""
    if not found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        found = found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    queries = asked.select("query_id", "token").distinct().withColumn("weight", F.lit(1.0))
    return dense.sparse_search(queries, found.select("doc_id", "tokens", F.transform("tokens", lambda t: F.lit(1.0)).alias("weights")), k)


def bm25_search(docs: DataFrame, text: Column, asked: DataFrame, tokenise, k: int, *, itself: bool = True, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The k texts (doc_id) of the best positive score for each query's terms (query_id, token, times), ranked as by `ranking.ranked`; without the query's own id, if
    asked for. The scores are those of `bm25`, but a null text counts as a document without a length, and no pair is shuffled: idf is the queries' weight, the rest the texts'."""
    return bm25_best(*term_counts(docs, text, asked, tokenise), asked, k, itself=itself, k1=k1, b=b)


def bm25(docs: DataFrame, text: Column, queries: DataFrame, question: Column, tokenise, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of pairs with a positive score. idf is ln(1 + (N - df + 0.5) / (df + 0.5)); a query's repeated
    token counts each time. Queries' terms are few: postings are cut to them before anything is shuffled."""
    asked = settle(tokens(queries, question, tokenise, "query_id").groupBy("query_id", "token").agg(F.count("*").alias("times")))
    return bm25_scores(*postings(docs, text, asked, tokenise), asked, k1, b)


def holders(docs: DataFrame, text: Column, queries: DataFrame, question: Column) -> DataFrame:
    """(query_id, doc_id): documents that hold a question's text as it is. The longest word inside the question, which stands as a word in any text
    that holds it, finds candidates by a join; the few questions without an inner word are looked for one by one."""
    words = F.split(F.col("_q"), r"\s+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = queries.select("query_id", question.alias("_q")).where("_q IS NOT NULL").withColumn("token", F.nullif(longest, F.lit("")))
    held = docs.select("doc_id", text.alias("_t"))
    found = held.withColumn("token", F.explode(F.array_distinct(F.split("_t", r"\s+")))).join(asked.where("token IS NOT NULL"), "token").where(F.contains("_t", F.col("_q"))).select("query_id", "doc_id")
    short = asked.where("token IS NULL").select("query_id", "_q").limit(1001).collect()
    if len(short) > 1000:
        raise ValueError("more than 1,000 questions of one or two words")
    for q in short:
        found = found.unionByName(held.where(F.contains("_t", F.lit(q["_q"]))).select(F.lit(q.query_id).alias("query_id"), "doc_id"))
    return found


def term_statistics(docs: DataFrame, text: Column, tokenise) -> DataFrame:
    """(token, df, cf): documents that hold a token, and its places."""
    return tokens(docs, text, tokenise).groupBy("token", "doc_id").agg(F.count("*").alias("tf")).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
