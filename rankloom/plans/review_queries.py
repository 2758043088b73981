"""Registered queries over reviews, groups, flags and sweeps, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import lexical, ranking, relations, stats
from rankloom.plans import ranking_queries as R
from rankloom.plans import text_queries as T
from rankloom.plans.tables import settle, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- reviews ----------------------------------------------------------------------------------------------------------

TASKS = "t AS (SELECT DISTINCT md5(text) AS task, rubric FROM documents, (SELECT unnest(['answer', 'support']) AS rubric)), v AS (SELECT task, rubric, CASE WHEN rubric = 'answer' THEN max(quality) ELSE min(1 - toxic) END AS verdict FROM t LEFT JOIN (SELECT md5(text) AS task, quality, toxic FROM documents JOIN labels USING (doc_id)) USING (task) GROUP BY 1, 2)"


def _reviewed(spark, sf_dir):
    """Tasks by content, under two rubrics, with their verdict where there is one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("task"))
    rubrics = F.broadcast(spark.createDataFrame([("answer",), ("support",)], "rubric string"))
    marks = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("task").agg(F.max("quality").alias("q"), F.min(1 - F.col("toxic")).alias("s"))
    return docs.select("task").distinct().join(rubrics).join(marks, "task", "left").select("task", "rubric", F.when(F.col("rubric") == "answer", F.col("q")).otherwise(F.col("s")).alias("verdict"))


@query(f"WITH {TASKS} SELECT lang AS variant, rubric, count(*) AS n, count(DISTINCT task) AS tasks, count(verdict) AS judged, CASE WHEN count(verdict) = count(*) THEN round(avg(verdict), 6) END AS rate, round(avg(verdict), 6) AS judged_rate FROM documents d JOIN v ON v.task = md5(d.text) GROUP BY 1, 2")
def review_rollup(spark, sf_dir):
    """Verdicts of distinct contents given to every row that has them, by variant and rubric; a rate only where all are judged."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("variant"), F.md5("text").alias("task")).join(_reviewed(spark, sf_dir), "task")
    rate = F.round(F.avg("verdict"), 6)
    return rows.groupBy("variant", "rubric").agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks"), F.count("verdict").alias("judged"), F.when(F.count("verdict") == F.count("*"), rate).alias("rate"), rate.alias("judged_rate"))


@query("SELECT md5(lang || text) AS request, doc_id AS alias, doc_id = min(doc_id) OVER (PARTITION BY lang, text) AS is_job FROM documents")
def request_aliases(spark, sf_dir):
    """Every row with the request it shares; the first of each is the job."""
    rows = table(spark, sf_dir, "documents").select(F.md5(F.concat("lang", "text")).alias("request"), "doc_id")
    first = rows.groupBy("request").agg(F.min("doc_id").alias("_first"))
    return rows.join(first, "request").select("request", F.col("doc_id").alias("alias"), (F.col("doc_id") == F.col("_first")).alias("is_job"))


@query("""WITH x AS (SELECT substr(sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 1, 24) AS text_hash, doc_id, text, coalesce(quality, 0) AS q FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT text_hash, count(*) AS n, arg_min(md5(text), doc_id) AS representative, CAST(sum(q) AS BIGINT) AS positives FROM x GROUP BY 1) SELECT doc_id, text_hash, n, representative, positives FROM x JOIN g USING (text_hash)""")
def transcript_members(spark, sf_dir):
    """Members of groups of equal normalised texts, with the first member's text and the positives of the group."""
    key = F.substring(F.sha2(X.collapse(F.lower("text")), 256), 1, 24)
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", key.alias("text_hash"), F.md5("text").alias("_m"), F.coalesce("quality", F.lit(0)).alias("_q"))
    groups = rows.groupBy("text_hash").agg(F.count("*").alias("n"), F.min_by("_m", "doc_id").alias("representative"), F.sum("_q").alias("positives"))
    return rows.join(groups, "text_hash").select("doc_id", "text_hash", "n", "representative", "positives")


PAIRS = "p AS (SELECT doc_id, lang, md5(text) AS task, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS a, CASE WHEN toxic = 0 THEN 'good' ELSE 'bad' END AS b FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {PAIRS} SELECT 'overall' AS kind, '' AS name, count(*) AS n, count(CASE WHEN a = b THEN 1 END) AS agree FROM p UNION ALL SELECT 'variant', lang, count(*), count(CASE WHEN a = b THEN 1 END) FROM p GROUP BY lang
UNION ALL SELECT 'unique', '', count(*), count(CASE WHEN a = b THEN 1 END) FROM (SELECT task, min(a) AS a, min(b) AS b FROM p GROUP BY task)""")
def judge_comparison(spark, sf_dir):
    """Agreement of two judges over all rows, by variant, and over distinct tasks."""
    good = lambda c: F.when(c, "good").otherwise("bad")
    p = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("task")), "doc_id").select("lang", "task", good(F.col("quality") == 1).alias("left"), good(F.col("toxic") == 0).alias("right"))
    p = settle(p)
    unique = p.groupBy("task").agg(F.min("left").alias("left"), F.min("right").alias("right"))
    parts = [(p, "overall", F.lit("")), (p, "variant", F.col("lang")), (unique, "unique", F.lit(""))]
    out = None
    for rows, kind, name in parts:
        one = stats.agreement(rows.withColumn("name", name), ["name"]).select(F.lit(kind).alias("kind"), "name", "n", "agree")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT coalesce(l.source, r.source) AS source, count(l.doc_id) AS left_only_or_both, count(r.doc_id) AS right_rows, count(CASE WHEN l.doc_id IS NULL OR r.doc_id IS NULL THEN 1 END) AS unpaired, count(CASE WHEN l.doc_id IS NULL OR r.doc_id IS NULL THEN 1 END) = 0 AS whole FROM (SELECT doc_id, source FROM documents WHERE doc_id % 7 <> 0 AND source <> 'src1') l FULL OUTER JOIN (SELECT doc_id, source FROM documents WHERE doc_id % 5 <> 0 OR source = 'src2') r ON l.doc_id = r.doc_id GROUP BY 1")
def judge_coverage(spark, sf_dir):
    """Whether two judges have judged the same tasks, by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    a, b = docs.where("doc_id % 7 <> 0 AND source <> 'src1'").withColumn("_a", F.lit(1)), docs.where("doc_id % 5 <> 0 OR source = 'src2'").withColumn("_b", F.lit(1))
    both = a.join(b, ["doc_id", "source"], "full_outer")
    open_ = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    return both.groupBy("source").agg(F.count("_a").alias("left_only_or_both"), F.count("_b").alias("right_rows"), open_.alias("unpaired"), (open_ == 0).alias("whole"))


@query("SELECT o_orderpriority AS condition, o_orderstatus AS representation, count(*) AS planned, count(CASE WHEN o_orderkey % 3 <> 0 THEN 1 END) AS completed, round(avg(CASE WHEN o_orderkey % 3 <> 0 AND o_orderstatus <> 'P' THEN o_totalprice END), 4) AS mean FROM orders GROUP BY 1, 2")
def completed_means(spark, sf_dir):
    """Means over completed tasks of each condition and representation, null where there is none."""
    done = F.col("o_orderkey") % 3 != 0
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("condition"), F.col("o_orderstatus").alias("representation")).agg(F.count("*").alias("planned"), F.count_if(done).alias("completed"), F.round(F.avg(F.when(done & (F.col("o_orderstatus") != "P"), F.col("o_totalprice"))), 4).alias("mean"))


@query("SELECT o_custkey AS run, CAST(sum(CASE WHEN o_orderkey % 4 <> 0 THEN 1 END) AS BIGINT) AS calls, CASE WHEN min(o_orderpriority) = max(o_orderpriority) THEN min(o_orderpriority) END AS priority, count(CASE WHEN o_totalprice > 200000 THEN 1 END) AS limited FROM orders GROUP BY 1")
def diagnostics_settings(spark, sf_dir):
    """Counts summed up, unknown ones left out; a setting where all rows agree; rows that hit a limit."""
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.sum(F.when(F.col("o_orderkey") % 4 != 0, F.lit(1).cast("long"))).alias("calls"), F.when(F.min(p) == F.max(p), F.min(p)).alias("priority"), F.count_if(F.col("o_totalprice") > 200000).alias("limited"))


@query("SELECT n_name AS parent, c_custkey AS child FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def pilot_complement(spark, sf_dir):
    """Exactly the children that the pilot doesn't have, with their parent."""
    pilot = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("c_custkey"))
    rest = table(spark, sf_dir, "customer").join(pilot, "c_custkey", "left_anti")
    return rest.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("parent"), F.col("c_custkey").alias("child"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS first_after_preparation, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS first_fresh FROM events")
def first_flags(spark, sf_dir):
    at = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("ts", "event_id")) == 1
    return table(spark, sf_dir, "events").select("event_id", at("user_id").alias("first_after_preparation"), at("user_id", "event_type").alias("first_fresh"))


@query("""WITH g AS (SELECT DISTINCT user_id, date_trunc('day', ts) + h * INTERVAL 6 HOUR AS ts FROM events, (SELECT unnest([0, 1, 2, 3]) AS h)), c AS (SELECT g.user_id, g.ts, event_id, row_number() OVER (PARTITION BY g.user_id, g.ts ORDER BY abs(epoch_us(e.ts) - epoch_us(g.ts)), e.ts, event_id) AS i FROM g JOIN events e ON e.user_id = g.user_id)
SELECT user_id, event_id AS point_id, count(*) AS ticks FROM c WHERE i = 1 GROUP BY 1, 2""")
def distinct_frames(spark, sf_dir):
    """Four ticks a day, each with its nearest event: distinct events, and how many ticks each stands for."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("point_id"))
    hours = F.explode(F.array(*[F.expr(f"INTERVAL {6 * h} HOURS") for h in range(4)]))
    grid = events.select("user_id", F.date_trunc("day", "ts").alias("day")).distinct().select("user_id", "day", hours.alias("h")).select("user_id", (F.col("day") + F.col("h")).alias("ts"))
    return relations.nearest_in_time(grid, events, "user_id", "ts").groupBy("user_id", "point_id").agg(F.count("*").alias("ticks"))


# --- rankings ---------------------------------------------------------------------------------------------------------


@query(f"WITH {R.CTE} SELECT query_id, doc_id, round(score, 1) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 1) DESC, -doc_id) AS INTEGER) AS rank FROM r WHERE channel = 'E' AND rank <= 40")
def ordinal_ties(spark, sf_dir):
    """Ties of a single channel go by the corpus' own order, here the opposite of the ids'."""
    lists = R.channel(spark, sf_dir, "E", 40).select("query_id", "doc_id", F.round("score", 1).alias("score"), (-F.col("doc_id")).alias("ordinal"))
    return ranking.ranked(lists, tie="ordinal").drop("ordinal")


@query("WITH " + T.BM25.replace("FROM documents)", "FROM (SELECT doc_id, trim(source || chr(10) || text) AS text FROM documents))", 1) + " SELECT * FROM br WHERE rank <= 10")
def bm25_titled(spark, sf_dir):
    """BM25 over title and text, the title being the source's name."""
    docs = T.docs(spark, sf_dir)
    scores = lexical.bm25(docs, X.lexical_input(F.col("source"), F.col("text")), T.asked(spark, sf_dir), F.col("question"), X.turkish_tokens)
    return ranking.ranked(scores, 10)


@query(f"""WITH {R.CTE}, w AS (SELECT 64 AS dim, 'E' AS channel UNION ALL SELECT 32, 'G'), f AS (SELECT dim, query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM w JOIN r ON r.channel IN (w.channel, 'S') WHERE rank <= 50 GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY dim, query_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT dim, round(avg(hits), 6) AS mean_hits_10 FROM (SELECT dim, o.query_id, count(CASE WHEN rank <= 10 AND l.relevance IS NOT NULL THEN 1 END) AS hits FROM o LEFT JOIN rel l USING (query_id, doc_id) GROUP BY 1, 2) GROUP BY dim""")
def fused_dimensions(spark, sf_dir):
    """Each size of vectors fused with the small channel."""
    lists, rel, out = R.channels(spark, sf_dir), R.qrels(spark, sf_dir), None
    for name, dim in (("E", 64), ("G", 32)):
        fused = ranking.fuse_channels(lists, [name, "S"], "per_channel", 50).join(rel, ["query_id", "doc_id"], "left")
        one = fused.groupBy("query_id").agg(F.count_if((F.col("rank") <= 10) & F.col("relevance").isNotNull()).alias("hits")).agg(F.round(F.avg("hits"), 6).alias("mean_hits_10")).select(F.lit(dim).alias("dim"), "mean_hits_10")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT source AS dataset, count(*) AS records, count(*) * 3 * 2 AS tasks, count(DISTINCT md5(text)) * 3 * 2 AS jobs, count(*) * 6 - count(DISTINCT md5(text)) * 6 AS reused FROM documents GROUP BY 1")
def task_plan(spark, sf_dir):
    """Tasks of three conditions and two representations, and the jobs that are left when equal requests are made once."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("records"), (F.count("*") * 6).alias("tasks"), (F.countDistinct(F.md5("text")) * 6).alias("jobs"), (F.count("*") * 6 - F.countDistinct(F.md5("text")) * 6).alias("reused"))


@query("SELECT split, doc_id, CAST(row_number() OVER (ORDER BY split, doc_id) AS BIGINT) AS place FROM (SELECT 'dev' AS split, doc_id FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'test', doc_id FROM documents WHERE doc_id % 10 = 1)")
def joined_splits(spark, sf_dir):
    """Two splits one after the other, each in order; places come from counts, not from a sort of all rows in one task."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    both = docs.where("doc_id % 10 = 0").select(F.lit("dev").alias("split"), "doc_id").unionByName(docs.where("doc_id % 10 = 1").select(F.lit("test").alias("split"), "doc_id"))
    return relations.numbered(both, ["split", "doc_id"])
