"""Registered queries over vectors and ranked lists, with the SQL that checks them.

Channels are the 64-dimensional vectors (E) and their normalised prefixes of 32 (G) and 16 (S); queries are rows whose id is divisible
by 50, against all rows but themselves; rows of a query's label are relevant, grade 2 if their ids are at most 100 apart, else 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import vectors as V
from rankloom.operators import dense, metrics, ranking, relations, stats
from rankloom.plans.tables import settle, table

EVERY, DIMS = 50, {"E": 64, "G": 32, "S": 16}


def corpus(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    v = V.prefix(V.doubles(F.col("embedding")), size, 64)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), v.alias("v"), "label")


def asked(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id") % EVERY == 0).withColumnRenamed("doc_id", "query_id")


def itself(docs: DataFrame) -> DataFrame:
    return asked(docs).select("query_id", F.col("query_id").alias("doc_id"))


def channel(spark: SparkSession, sf_dir: str, name: str, k: int = 100) -> DataFrame:
    docs = corpus(spark, sf_dir, DIMS[name])
    return dense.search(asked(docs), docs, k, itself(docs)).withColumn("channel", F.lit(name))


def channels(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    """All channels' rankings, written once: several plans read them."""
    out = None
    for name in DIMS:
        one = channel(spark, sf_dir, name, k)
        out = one if out is None else out.unionByName(one)
    return settle(out)


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).select("doc_id", "label")
    near = F.when(F.abs(F.col("query_id") - F.col("doc_id")) <= 100, 2.0).otherwise(1.0)
    return asked(docs).join(docs, "label").where("query_id <> doc_id").select("query_id", "doc_id", near.alias("relevance"))


UNIT = "list_transform(embedding[1:{d}], lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding[1:{d}], lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))"
CTE = f"""
v AS (SELECT vec_id AS doc_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS "E", {UNIT.format(d=32)} AS "G", {UNIT.format(d=16)} AS "S" FROM embeddings),
s AS (SELECT q.doc_id AS query_id, d.doc_id, c.channel, round(CASE c.channel WHEN 'E' THEN list_dot_product(q."E", d."E") WHEN 'G' THEN list_dot_product(q."G", d."G") ELSE list_dot_product(q."S", d."S") END, 6) AS score
      FROM v q JOIN v d ON q.doc_id <> d.doc_id, (VALUES ('E'), ('G'), ('S')) c(channel) WHERE q.doc_id % {EVERY} = 0),
r AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY channel, query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 100),
rel AS (SELECT q.doc_id AS query_id, d.doc_id, CASE WHEN abs(q.doc_id - d.doc_id) <= 100 THEN 2.0 ELSE 1.0 END AS relevance FROM v q JOIN v d ON q.label = d.label AND q.doc_id <> d.doc_id WHERE q.doc_id % {EVERY} = 0)"""


def graded_sql(source: str, by: str = "query_id") -> str:
    """Metrics of a ranking relation (query_id, doc_id, rank) against rel."""
    ks, out = (1, 5, 10, 20), []
    for k in ks:
        out += [
            f"CAST(coalesce(max(CASE WHEN h.rank <= {k} THEN 1 ELSE 0 END), 0) AS DOUBLE) AS hit_{k}",
            f"coalesce(count(CASE WHEN h.rank <= {k} THEN 1 END) / max(i.n), 0.0) AS recall_{k}",
            f"coalesce(max(CASE WHEN h.rank <= {k} THEN 1.0 / h.rank END), 0.0) AS mrr_{k}",
            f"round(coalesce(sum(CASE WHEN h.rank <= {k} THEN (pow(2, h.relevance) - 1) / log2(h.rank + 1) END), 0.0) / max(i.i{k}), 9) AS ndcg_{k}",
        ]
    ideal = ", ".join(f"sum(CASE WHEN pos <= {k} THEN (pow(2, relevance) - 1) / log2(pos + 1) END) AS i{k}" for k in ks)
    return f"""ideal AS (SELECT query_id, count(*) AS n, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id)  AS pos FROM rel) GROUP BY query_id),
hits AS (SELECT x.query_id, x.doc_id, x.rank, l.relevance, row_number() OVER (PARTITION BY x.query_id ORDER BY x.rank) AS before FROM {source} x JOIN rel l USING (query_id, doc_id)),
graded AS (SELECT i.query_id, {', '.join(out)}, round(coalesce(sum(CASE WHEN h.rank <= 16 THEN h.before * 1.0 / h.rank END), 0.0) / least(max(i.n), 16), 9) AS map_16
           FROM ideal i LEFT JOIN hits h ON h.query_id = i.query_id GROUP BY i.query_id)"""


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {CTE} SELECT query_id, doc_id, score, rank FROM r WHERE channel = 'E' AND rank <= 10")
def vector_topk_excl(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return dense.search(asked(docs), docs, 10, itself(docs))


@query(f"WITH {CTE}, {graded_sql('(SELECT * FROM r WHERE channel = ' + chr(39) + 'E' + chr(39) + ')')} SELECT * FROM graded")
def vector_metrics_by_label(spark, sf_dir):
    return metrics.graded(channel(spark, sf_dir, "E"), qrels(spark, sf_dir))


@query(f"WITH {CTE}, {graded_sql('(SELECT * FROM r WHERE channel = ' + chr(39) + 'E' + chr(39) + ')')}, u AS (UNPIVOT graded ON COLUMNS(* EXCLUDE query_id) INTO NAME metric VALUE value) SELECT metric, round(avg(value), 6) AS mean, count(value) AS n FROM u GROUP BY metric")
def metric_means(spark, sf_dir):
    per = metrics.graded(channel(spark, sf_dir, "E"), qrels(spark, sf_dir))
    return stats.means(stats.long_form(per, ["query_id"], [c for c in per.columns if c != "query_id"]), [])


def _fused_sql(limit: str, where: str = "TRUE", tail: str = "") -> str:
    return f"""f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, CAST(count(*) AS INTEGER) AS n_channels FROM r WHERE rank <= {limit} AND {where} GROUP BY query_id, doc_id),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f){tail}"""


@query(f"WITH {CTE}, {_fused_sql('50')} SELECT * FROM fused")
def rrf_per_channel(spark, sf_dir):
    return ranking.fuse_channels(channels(spark, sf_dir), ["E", "G", "S"], "per_channel", 50)


TOTAL = "CASE channel WHEN 'G' THEN 34 WHEN 'E' THEN 33 ELSE 33 END"


@query(f"WITH {CTE}, {_fused_sql(TOTAL)} SELECT * FROM fused")
def rrf_total_budget(spark, sf_dir):
    return ranking.fuse_channels(channels(spark, sf_dir), ["E", "G", "S"], "total", 100)


@query(f"WITH {CTE} SELECT query_id, doc_id, round(score, 9) AS score, 1 AS n_channels, rank FROM r WHERE channel = 'G' AND rank <= 20")
def rrf_one_channel(spark, sf_dir):
    return ranking.fuse_channels(channels(spark, sf_dir), ["G"], "per_channel", 20)


@query(f"""WITH {CTE}, t AS (SELECT query_id, doc_id, rank, CASE channel WHEN 'E' THEN 0 WHEN 'G' THEN 1 ELSE 2 END AS source FROM r WHERE rank <= 40),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(CAST(source * 1000 + rank AS BIGINT) * 10000000 + doc_id) AS tie FROM t GROUP BY 1, 2)
SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie) AS INTEGER) AS rank FROM f) WHERE rank <= 30""")
def rrf_text_ties(spark, sf_dir):
    source = F.when(F.col("channel") == "E", 0).when(F.col("channel") == "G", 1).otherwise(2)
    lists = channels(spark, sf_dir).where("rank <= 40").select("query_id", source.alias("source"), "rank", "doc_id")
    return ranking.fuse_text(lists, top=30)


@query("SELECT b.budget, c.channel, CAST(b.budget // 3 + CASE WHEN c.i < b.budget % 3 THEN 1 ELSE 0 END AS INTEGER) AS quota FROM (VALUES (20), (50), (100)) b(budget), (VALUES ('B', 0), ('G', 1), ('E', 2)) c(channel, i)")
def channel_allocation(spark, sf_dir):
    return spark.createDataFrame([(b, c, n) for b in (20, 50, 100) for c, n in ranking.allocation(["B", "E", "G"], b).items()], "budget int, channel string, quota int")


@query(f"WITH {CTE}, p AS (SELECT query_id, count(*) AS raw, count(DISTINCT doc_id) AS u FROM r WHERE rank <= {TOTAL} GROUP BY 1) SELECT round(avg(raw), 6) AS mean_raw, round(avg(u), 6) AS mean_unique, min(u) AS least, max(u) AS most, CAST(sum(u) AS BIGINT) AS total FROM p")
def pool_statistics(spark, sf_dir):
    p = ranking.pool_sizes(channels(spark, sf_dir), ["E", "G", "S"], "total", 100)
    return p.agg(F.round(F.avg("raw"), 6).alias("mean_raw"), F.round(F.avg("unique"), 6).alias("mean_unique"), F.min("unique").alias("least"), F.max("unique").alias("most"), F.sum("unique").alias("total"))


@query(f"""WITH {CTE}, p AS (SELECT channel, query_id, CAST(sum(CASE WHEN rank <= 10 AND l.relevance IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) AS hits FROM r LEFT JOIN rel l USING (query_id, doc_id) GROUP BY 1, 2)
SELECT CASE channel WHEN 'E' THEN 64 WHEN 'G' THEN 32 ELSE 16 END AS dim, round(avg(hits), 6) AS mean_hits_10, CAST((SELECT count(*) FROM embeddings) * CASE channel WHEN 'E' THEN 64 WHEN 'G' THEN 32 ELSE 16 END * 4 AS BIGINT) AS bytes, round(CASE channel WHEN 'E' THEN 64 WHEN 'G' THEN 32 ELSE 16 END / 64.0, 6) AS ratio FROM p GROUP BY channel""")
def dimension_sweep(spark, sf_dir):
    dim = F.when(F.col("channel") == "E", 64).when(F.col("channel") == "G", 32).otherwise(16)
    hits = channels(spark, sf_dir).join(qrels(spark, sf_dir), ["query_id", "doc_id"], "left").groupBy("channel", "query_id").agg(F.count_if((F.col("rank") <= 10) & F.col("relevance").isNotNull()).alias("hits"))
    n = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    per = hits.groupBy("channel").agg(F.round(F.avg("hits"), 6).alias("mean_hits_10")).withColumn("dim", dim).crossJoin(F.broadcast(n))
    return per.select("dim", "mean_hits_10", (F.col("n") * F.col("dim") * 4).alias("bytes"), F.round(F.col("dim") / 64.0, 6).alias("ratio"))


PAIRS = f"""x AS (SELECT q.doc_id AS query_id, d.doc_id, q."E" AS a, d."E" AS b FROM v q JOIN v d ON q.doc_id <> d.doc_id WHERE q.doc_id % {EVERY} = 0)"""


def _late_sql(how: str) -> str:
    part = lambda a, i: f"{a}[{16 * i + 1}:{16 * i + 16}]"
    best = [f"greatest({', '.join(f'list_dot_product({part('a', i)}, {part('b', j)})' for j in range(4))})" for i in range(4)]
    total = f"({' + '.join(best)})" + (" / 4" if how == "mean" else "")
    return f"WITH {CTE}, {PAIRS}, m AS (SELECT query_id, doc_id, round({total}, 6) AS score FROM x) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM m) WHERE rank <= 100"


def _late(spark, sf_dir, how):
    """Every query against the full gallery: vectors as four 16-dimensional token vectors."""
    docs = corpus(spark, sf_dir)
    return dense.search(asked(docs), docs, 100, itself(docs), kind=how, parts=4)


@query(_late_sql("sum"))
def maxsim_sum(spark, sf_dir):
    return _late(spark, sf_dir, "sum")


@query(_late_sql("mean"))
def maxsim_mean(spark, sf_dir):
    return _late(spark, sf_dir, "mean")


@query(f"""WITH {CTE}, {PAIRS}, m AS (SELECT query_id, doc_id // 10 AS source_id, max(round(list_dot_product(a, b), 6)) AS score FROM x GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS INTEGER) AS rank FROM m) WHERE rank <= 100""")
def chunk_maxpool(spark, sf_dir):
    """Ten rows are the chunks of one source, which has its best chunk's score, of all chunks there are."""
    docs = corpus(spark, sf_dir)
    return dense.search(asked(docs), docs.withColumn("source_id", F.floor(F.col("doc_id") / 10)), 100, itself(docs), pool="source_id")


@query(f"""WITH e AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS w, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings),
p AS (SELECT * FROM e WHERE w > 0), s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(sum(q.w * d.w), 6) AS score FROM p q JOIN p d USING (token) WHERE q.vec_id % {EVERY} = 0 AND q.vec_id <> d.vec_id GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def sparse_dot(spark, sf_dir):
    held = corpus(spark, sf_dir).select("doc_id", V.positive_weights(F.col("v")).alias("e"))
    q = held.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.explode("e").alias("e")).select("query_id", "e.*")
    return dense.sparse_search(q, held.select("doc_id", F.col("e.token").alias("tokens"), F.col("e.weight").alias("weights")), 10, itself=False)


@query(f"""WITH {CTE}, cells AS (SELECT channel AS cell, query_id, doc_id FROM r WHERE rank <= 20), p AS (SELECT DISTINCT query_id, doc_id FROM cells),
z AS (SELECT p.query_id, p.doc_id, round(list_dot_product(q."E", d."E"), 6) AS score FROM p JOIN v q ON q.doc_id = p.query_id JOIN v d ON d.doc_id = p.doc_id)
SELECT cell, query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY cell, query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM cells JOIN z USING (query_id, doc_id)""")
def score_union_scatter(spark, sf_dir):
    lists = channels(spark, sf_dir).where("rank <= 20").select(F.col("channel").alias("cell"), "query_id", "doc_id")
    docs = corpus(spark, sf_dir)
    pairs = lists.select("query_id", "doc_id").distinct().join(docs.select("doc_id", "v"), "doc_id").join(docs.select(F.col("doc_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return ranking.scatter(lists, pairs.select("query_id", "doc_id", F.round(V.dot(F.col("q"), F.col("v")), 6).alias("score")))


def _rerank_sql(tie: str) -> str:
    return f"WITH {CTE}, n AS (SELECT query_id, doc_id, rank, round(score, 1) AS new_score FROM r WHERE channel = 'E' AND rank <= 50) SELECT query_id, doc_id, new_score AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, {tie}) AS INTEGER) AS rank FROM n"


def _reranked(spark, sf_dir, tie):
    lists = settle(channel(spark, sf_dir, "E", 50))
    return ranking.rerank(lists.drop("score", "channel"), lists.select("query_id", "doc_id", F.round("score", 1).alias("new_score")), tie)


@query(_rerank_sql("doc_id"))
def rerank_ties_id(spark, sf_dir):
    return _reranked(spark, sf_dir, "doc_id")


@query(_rerank_sql("rank"))
def rerank_ties_position(spark, sf_dir):
    return _reranked(spark, sf_dir, "rank")


@query(f"WITH {CTE} SELECT channel, k AS candidates, query_id, count(*) AS n, round(min(score), 6) AS last_score FROM r, (VALUES (20), (50), (100)) c(k) WHERE rank <= k GROUP BY 1, 2, 3")
def candidate_cuts(spark, sf_dir):
    cuts = spark.createDataFrame([(20,), (50,), (100,)], "candidates int")
    return channels(spark, sf_dir).join(F.broadcast(cuts), F.col("rank") <= F.col("candidates")).groupBy("channel", "candidates", "query_id").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("last_score"))


@query("""SELECT label, count(*) AS n, count(CASE WHEN len(embedding) = 64 AND abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) <= 0.002 THEN 1 END) AS valid,
round(avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS mean_norm FROM embeddings GROUP BY label""")
def vector_validation(spark, sf_dir):
    v = V.doubles(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(V.valid(v, 64)).alias("valid"), F.round(F.avg(V.norm(v)), 6).alias("mean_norm"))


@query(f"""WITH {CTE}, a AS (SELECT query_id, rank, doc_id, score FROM r WHERE channel = 'E' AND rank <= 20),
b AS (SELECT query_id, rank, CASE WHEN query_id % 250 = 0 AND rank = 3 THEN -doc_id ELSE doc_id END AS doc_id, score + CASE WHEN query_id % 150 = 0 THEN 5e-5 ELSE 5e-7 END AS score FROM a WHERE NOT (query_id % 350 = 0 AND rank = 20))
SELECT coalesce(a.query_id, b.query_id) AS query_id, bool_and(coalesce(a.doc_id = b.doc_id AND abs(a.score - b.score) <= greatest(1e-6, 1e-5 * greatest(abs(a.score), abs(b.score))), FALSE)) AS same FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.rank = b.rank GROUP BY 1""")
def near_identical_rankings(spark, sf_dir):
    """Against a ranking whose scores are a little off, for some queries too much, and some of which has another document or is a row short."""
    a = settle(channel(spark, sf_dir, "E", 20))
    q = F.col("query_id")
    b = a.where(~((q % 350 == 0) & (F.col("rank") == 20))).withColumns({
        "score": F.col("score") + F.when(q % 150 == 0, 5e-5).otherwise(5e-7),
        "doc_id": F.when((q % 250 == 0) & (F.col("rank") == 3), -F.col("doc_id")).otherwise(F.col("doc_id")),
    })
    return ranking.close_rankings(a, b)


BROKEN = """SELECT query_id, CASE WHEN query_id % 150 = 0 AND rank = 20 THEN query_id WHEN query_id % 250 = 0 AND rank = 2 THEN -1 WHEN query_id % 350 = 0 AND rank = 4 THEN first_value(doc_id) OVER (PARTITION BY query_id ORDER BY rank) ELSE doc_id END AS doc_id,
score + CASE WHEN query_id % 200 = 0 AND rank = 7 THEN 1 ELSE 0 END AS score, rank FROM r WHERE channel = 'S' AND rank <= 20"""


@query(f"""WITH {CTE}, y AS ({BROKEN}), x AS (SELECT * FROM y WHERE NOT (query_id % 100 = 0 AND rank = 5)),
w AS (SELECT *, rank <> row_number() OVER (PARTITION BY query_id ORDER BY rank) AS gap, coalesce(lag(score) OVER (PARTITION BY query_id ORDER BY rank) < score OR (lag(score) OVER (PARTITION BY query_id ORDER BY rank) = score AND lag(doc_id) OVER (PARTITION BY query_id ORDER BY rank) > doc_id), FALSE) AS turned FROM x)
SELECT query_id, CAST(sum(CAST(gap AS INTEGER)) AS BIGINT) AS rank_gaps, CAST(sum(CAST(turned AS INTEGER)) AS BIGINT) AS order_breaks, count(*) - count(DISTINCT doc_id) AS repeats, count(CASE WHEN doc_id NOT IN (SELECT doc_id FROM v) THEN 1 END) AS unknown, count(CASE WHEN doc_id = query_id THEN 1 END) AS excluded_hits,
count(*) AS n, count(*) = least(20, (SELECT count(*) FROM v) - 1) AS full_length FROM w GROUP BY query_id""")
def ranking_contract(spark, sf_dir):
    """Rankings that break every rule somewhere: rows missing, out of order, repeated, unknown, excluded."""
    docs, q, r = corpus(spark, sf_dir), F.col("query_id"), F.col("rank")
    lists = channel(spark, sf_dir, "S", 20).withColumn("_top", F.first("doc_id").over(Window.partitionBy("query_id").orderBy("rank")))
    other = F.when((q % 150 == 0) & (r == 20), q).when((q % 250 == 0) & (r == 2), -1).when((q % 350 == 0) & (r == 4), F.col("_top")).otherwise(F.col("doc_id"))
    broken = lists.where(~((q % 100 == 0) & (r == 5))).select("query_id", other.alias("doc_id"), (F.col("score") + F.when((q % 200 == 0) & (r == 7), 1).otherwise(0)).alias("score"), "rank")
    return ranking.contract(broken, docs.select("doc_id"), itself(docs), 20)


@query(f"WITH {CTE}, a AS (SELECT query_id, doc_id FROM r WHERE channel = 'E' AND rank <= 20), b AS (SELECT query_id, doc_id FROM r WHERE channel = 'G' AND rank <= 20) SELECT *, 'dropped' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def candidate_set_difference(spark, sf_dir):
    r = channels(spark, sf_dir).where("rank <= 20")
    return ranking.same_documents(r.where("channel = 'E'"), r.where("channel = 'G'"))


def _delta_sql(tail: str) -> str:
    one = lambda c: f"(SELECT query_id, count(CASE WHEN l.relevance IS NOT NULL THEN 1 END) / 10.0 AS value FROM r LEFT JOIN rel l USING (query_id, doc_id) WHERE channel = '{c}' AND rank <= 10 GROUP BY 1)"
    return f"WITH {CTE}, d AS (SELECT a.query_id, b.value - a.value AS difference FROM {one('S')} a JOIN {one('E')} b USING (query_id)), g AS (SELECT d.*, v.label FROM d JOIN v ON v.doc_id = d.query_id) {tail}"


def _deltas(spark, sf_dir):
    hits = channels(spark, sf_dir).where("rank <= 10").join(qrels(spark, sf_dir), ["query_id", "doc_id"], "left").groupBy("channel", "query_id").agg((F.count("relevance") / 10.0).alias("value"))
    d = stats.paired(hits.where("channel = 'S'"), hits.where("channel = 'E'"))
    return d.join(corpus(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "label"), "query_id")


@query(_delta_sql("SELECT count(*) AS n, round(avg(difference), 6) AS mean_difference, count(CASE WHEN difference > 0 THEN 1 END) AS wins, count(CASE WHEN difference < 0 THEN 1 END) AS losses, count(CASE WHEN difference = 0 THEN 1 END) AS ties FROM d"))
def paired_channel_delta(spark, sf_dir):
    return stats.paired_summary(_deltas(spark, sf_dir))


@query(_delta_sql("SELECT label AS cluster, round(sum(difference), 6) AS total, count(*) AS n FROM g GROUP BY label"))
def cluster_totals(spark, sf_dir):
    return stats.cluster_totals(_deltas(spark, sf_dir), "label").select(F.col("label").alias("cluster"), F.round("total", 6).alias("total"), "n")


@query()
def cluster_bootstrap(spark, sf_dir):
    return stats.bootstrap(stats.cluster_totals(_deltas(spark, sf_dir), "label").withColumnRenamed("label", "cluster"), seed=42)


@query(_delta_sql("SELECT count(*) AS clusters, max(n) AS largest, CAST(sum(n) AS BIGINT) AS n, count(*) >= 2 AND 2 * max(n) <= sum(n) AS eligible FROM (SELECT label, count(*) AS n FROM g GROUP BY label)"))
def dominance_guard(spark, sf_dir):
    return stats.dominance(stats.cluster_totals(_deltas(spark, sf_dir), "label"))


@query(f"WITH {CTE}, x AS (SELECT DISTINCT doc_id AS query_id, query_id AS doc_id FROM rel), n AS (SELECT query_id, count(*) AS n_sources FROM x GROUP BY 1) SELECT x.query_id, x.doc_id, n.n_sources FROM x JOIN n USING (query_id)")
def reverse_relation(spark, sf_dir):
    back = qrels(spark, sf_dir).where("relevance > 0").select(F.col("doc_id").alias("query_id"), F.col("query_id").alias("doc_id")).distinct()
    return back.join(back.groupBy("query_id").agg(F.count("*").alias("n_sources")), "query_id")


@query(f"WITH {CTE}, o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id)  AS pos FROM rel) SELECT 'closed_book' AS condition, doc_id AS query_id, 0 AS n, '' AS ids FROM v WHERE doc_id % {EVERY} = 0 UNION ALL SELECT 'oracle', query_id, count(*), string_agg(doc_id, ',' ORDER BY pos) FROM o WHERE pos <= 5 GROUP BY query_id UNION ALL SELECT 'retrieved', query_id, count(*), string_agg(doc_id, ',' ORDER BY rank) FROM r WHERE channel = 'E' AND rank <= 5 GROUP BY query_id")
def evidence_conditions(spark, sf_dir):
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["doc_id"].cast("string")), ",")
    closed = asked(corpus(spark, sf_dir)).select(F.lit("closed_book").alias("condition"), "query_id", F.lit(0).cast("long").alias("n"), F.lit("").alias("ids"))
    oracle = ranking.ranked(qrels(spark, sf_dir).withColumn("score", F.lit(0.0)), 5).withColumn("condition", F.lit("oracle"))
    got = channel(spark, sf_dir, "E", 5).withColumn("condition", F.lit("retrieved"))
    both = oracle.select("condition", "query_id", "rank", "doc_id").unionByName(got.select("condition", "query_id", "rank", "doc_id"))
    return closed.unionByName(both.groupBy("condition", "query_id").agg(F.count("*").alias("n"), listed(F.struct("rank", "doc_id")).alias("ids")))


@query(f"""WITH {CTE}, g AS (SELECT query_id, list(doc_id ORDER BY doc_id) AS gold FROM rel GROUP BY 1), c AS (SELECT query_id, list(doc_id ORDER BY rank) AS cited FROM r WHERE channel = 'E' AND rank <= 5 GROUP BY 1)
SELECT query_id, CASE WHEN len(cited) > 0 THEN len(list_intersect(cited, gold)) / len(cited) ELSE 0.0 END AS precision, len(list_intersect(cited, gold)) / len(gold) AS recall, CAST(len(list_intersect(cited, gold)) > 0 AS INTEGER) * 1.0 AS hit FROM c JOIN g USING (query_id)""")
def citation_set_metrics(spark, sf_dir):
    gold = qrels(spark, sf_dir).groupBy("query_id").agg(F.collect_set("doc_id").alias("gold"))
    cited = channel(spark, sf_dir, "E", 5).groupBy("query_id").agg(F.collect_set("doc_id").alias("cited"))
    return metrics.citation_metrics(cited.join(gold, "query_id"))


@query(f"""WITH RECURSIVE {CTE}, e AS (SELECT DISTINCT query_id AS a, -1 - label AS b FROM rel JOIN v ON v.doc_id = rel.doc_id UNION SELECT query_id, doc_id FROM r WHERE channel = 'E' AND rank <= 2),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(node, reach) AS (SELECT a, a FROM b UNION SELECT c.node, b.b FROM c JOIN b ON c.reach = b.a)
SELECT node, min(reach) AS root FROM c GROUP BY node""")
def source_components(spark, sf_dir):
    from rankloom.operators.graph import components

    docs = corpus(spark, sf_dir).select("doc_id", "label")
    one = qrels(spark, sf_dir).join(docs, "doc_id").select(F.col("query_id").alias("a"), (-1 - F.col("label")).cast("long").alias("b")).distinct()
    two = channel(spark, sf_dir, "E", 2).select(F.col("query_id").alias("a"), F.col("doc_id").alias("b"))
    return components(one.unionByName(two))


@query(f"WITH {CTE}, m AS (SELECT cell, query_id, doc_id FROM (SELECT 'full' AS cell, query_id, doc_id FROM r WHERE channel = 'E' AND rank <= 10 UNION ALL SELECT 'half', query_id, doc_id FROM r WHERE channel = 'G' AND rank <= 10)) SELECT cell, count(DISTINCT query_id) AS queries, count(DISTINCT doc_id) AS documents, count(*) AS n FROM m GROUP BY cell")
def cell_coverage(spark, sf_dir):
    cell = F.when(F.col("channel") == "E", "full").when(F.col("channel") == "G", "half")
    return channels(spark, sf_dir).where("rank <= 10 AND channel IN ('E', 'G')").groupBy(cell.alias("cell")).agg(F.countDistinct("query_id").alias("queries"), F.countDistinct("doc_id").alias("documents"), F.count("*").alias("n"))


@query(f"WITH {CTE} SELECT query_id, coalesce(b.n, 0) AS n_pending FROM (SELECT doc_id AS query_id FROM v WHERE doc_id % {EVERY} = 0) a LEFT JOIN (SELECT e.query_id, count(*) AS n FROM (SELECT query_id, doc_id FROM r WHERE channel = 'E') e ANTI JOIN (SELECT query_id, doc_id FROM r WHERE channel = 'S') s ON e.query_id = s.query_id AND e.doc_id = s.doc_id GROUP BY 1) b USING (query_id)")
def resume_pending(spark, sf_dir):
    r = channels(spark, sf_dir)
    left = relations.pending(r.where("channel = 'E'"), r.where("channel = 'S'"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("n"))
    return asked(corpus(spark, sf_dir)).select("query_id").join(left, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_pending"))
