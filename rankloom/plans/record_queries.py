"""Registered queries over records, labels, logs and grids, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import audit, dense, records, relations, stats
from rankloom.plans import experiments
from rankloom.plans.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PERCENTILES = "count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(sum(value), 4) AS total"


@query(f"SELECT event_type, {PERCENTILES} FROM events GROUP BY event_type")
def latency_distribution(spark, sf_dir):
    return stats.distribution(table(spark, sf_dir, "events"), "value", ["event_type"])


@query(f"SELECT event_type, {PERCENTILES} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) WHERE i > 1 GROUP BY event_type")
def warmup_excluded(spark, sf_dir):
    """Without each user's first event."""
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    return stats.distribution(table(spark, sf_dir, "events").join(first.select("event_id"), "event_id", "left_anti"), "value", ["event_type"])


@query("SELECT o_orderpriority AS variant, o_orderstatus AS status, c_mktsegment AS segment, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, o_orderstatus), (o_orderpriority, c_mktsegment))")
def variant_breakdown(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderpriority").alias("variant"), F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("segment"), "o_totalprice")
    return stats.breakdown(rows, "variant", ["status", "segment"], [F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")])


@query("SELECT o_orderpriority AS variant, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finished, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY 1")
def variant_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variant"), "o_orderstatus", "o_totalprice")
    told = rows.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    return told.join(stats.percentiles(rows, "o_totalprice", ["variant"]).select("variant", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95")), "variant")


@query("SELECT o_orderpriority AS variant, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS \"F\", count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS \"O\", count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS \"P\" FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("variant")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


VERDICTS = "v AS (SELECT doc_id, source, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS l, CASE WHEN toxic = 0 THEN 'accept' ELSE 'reject' END AS r FROM labels JOIN documents USING (doc_id))"


def verdicts(spark, sf_dir):
    one = lambda c, good: F.when(F.col(c) == good, "accept").otherwise("reject")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "source", one("quality", 1).alias("left"), one("toxic", 0).alias("right"))


@query(f"WITH {VERDICTS} SELECT source, count(*) AS n, count(CASE WHEN l = r THEN 1 END) AS agree, round(avg(CAST(l = r AS INTEGER)), 6) AS rate FROM v GROUP BY source")
def judge_agreement(spark, sf_dir):
    return stats.agreement(verdicts(spark, sf_dir), ["source"])


@query(f"WITH {VERDICTS} SELECT l AS \"left\", r AS \"right\", count(*) AS n FROM v GROUP BY 1, 2")
def judge_confusion(spark, sf_dir):
    return stats.confusion(verdicts(spark, sf_dir))


@query("SELECT source, count(*) AS n, CASE WHEN count(quality) = count(*) THEN count(CASE WHEN quality = 1 THEN 1 END) / count(*) END AS rate, count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS both_good, round(avg(coalesce(quality, 0)), 6) AS zero_filled, round(avg(quality), 6) AS judged_only FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def conditional_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.col("quality") == 1
    return rows.groupBy("source").agg(F.count("*").alias("n"), stats.rate_if_all(good, F.col("quality").isNotNull()).alias("rate"), F.count_if(good & (F.col("toxic") == 0)).alias("both_good"), F.round(F.avg(F.coalesce("quality", F.lit(0))), 6).alias("zero_filled"), F.round(F.avg("quality"), 6).alias("judged_only"))


@query("WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_rows FROM events GROUP BY user_id) SELECT c_mktsegment AS split, coalesce(state, 'pending') AS state, count(*) AS n, CAST(sum(coalesce(n_rows, 0)) AS BIGINT) AS n_rows FROM customer LEFT JOIN l ON user_id = c_custkey GROUP BY 1, 2")
def ledger_progress(spark, sf_dir):
    state = relations.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    rows = table(spark, sf_dir, "customer").join(state, F.col("user_id") == F.col("c_custkey"), "left")
    return rows.groupBy(F.col("c_mktsegment").alias("split"), F.coalesce("event_type", F.lit("pending")).alias("state")).agg(F.count("*").alias("n"), F.sum(F.coalesce("n_rows", F.lit(0))).alias("n_rows"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n_rows FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    return relations.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH o AS (SELECT doc_id, lang, source, sha256('[42,["' || doc_id || '"]]') AS k FROM documents), t AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY k) AS turn FROM o)
SELECT doc_id, lang, source, turn, CAST(row_number() OVER (ORDER BY turn, source, lang) AS BIGINT) AS place FROM t""")
def stratified_round_robin(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return relations.round_robin(rows, ["source", "lang"], relations.hash_order(42, F.col("doc_id")))


@query()
def greedy_group_split(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("group_id")).agg(F.count("*").alias("n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    return relations.greedy_split(groups, total // 4, 42)


@query("""WITH g AS (SELECT DISTINCT user_id, date_trunc('day', ts) + INTERVAL 12 HOUR AS ts FROM events), c AS (SELECT g.user_id, g.ts, event_id, abs(epoch_us(e.ts) - epoch_us(g.ts)) AS micros, row_number() OVER (PARTITION BY g.user_id, g.ts ORDER BY abs(epoch_us(e.ts) - epoch_us(g.ts)), e.ts, event_id) AS i FROM g JOIN events e ON e.user_id = g.user_id)
SELECT user_id, ts, event_id AS point_id, micros FROM c WHERE i = 1""")
def asof_nearest_grid(spark, sf_dir):
    """For each user and active day, the event nearest to noon."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("point_id"))
    grid = events.select("user_id", (F.date_trunc("day", "ts") + F.expr("INTERVAL 12 HOURS")).alias("ts")).distinct()
    return relations.nearest_in_time(grid, events, "user_id", "ts")


@query("""WITH x AS (SELECT event_type AS group_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
p AS (SELECT DISTINCT group_id, CAST(round_even(j * (n - 1) / 15.0, 0) AS BIGINT) AS i FROM x, (SELECT unnest(range(0, 16)) AS j))
SELECT x.group_id, event_id, i AS place FROM x JOIN p USING (group_id, i)""")
def uniform_index_cap(spark, sf_dir):
    """Sixteen events of each type, evenly spread over their order."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("group_id"), "event_id")
    return dense.spread_rank(rows, "event_id", 16)


@query("SELECT user_id, bool_and(coalesce(d, 0) >= 0) AS monotonic, count(*) AS n FROM (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM events) GROUP BY user_id")
def monotonic_check(spark, sf_dir):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    step = F.timestamp_diff("MICROSECOND", before, F.col("ts"))
    return table(spark, sf_dir, "events").withColumn("d", step).groupBy("user_id").agg(F.bool_and(F.coalesce("d", F.lit(0)) >= 0).alias("monotonic"), F.count("*").alias("n"))


@query("""WITH q AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, l_quantity AS relevance FROM lineitem)
SELECT 'unknown_query' AS rule, count(*) AS n FROM q ANTI JOIN orders ON o_orderkey = query_id UNION ALL SELECT 'unknown_document', count(*) FROM q ANTI JOIN part ON p_partkey = doc_id
UNION ALL SELECT 'repeated_pair', count(*) FROM (SELECT query_id, doc_id FROM q GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'grade_out_of_range', count(CASE WHEN NOT relevance BETWEEN 0 AND 30 THEN 1 END) FROM q
UNION ALL SELECT 'query_without_positive', count(*) FROM orders ANTI JOIN q ON o_orderkey = query_id AND relevance > 0 UNION ALL SELECT 'excluded_positive', count(*) FROM q JOIN part ON p_partkey = doc_id WHERE p_size = 1 AND relevance > 0""")
def referential_integrity(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.col("l_quantity").alias("relevance"))
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "doc_id")
    out = q.join(part.where("p_size = 1"), "doc_id", "left_semi").select("query_id", "doc_id").distinct()
    return audit.qrel_violations(q, table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "query_id"), part, out)


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return audit.repeated_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT name, expected, actual, expected = actual AS ok FROM (SELECT 'region' AS name, CAST(5 AS BIGINT) AS expected, count(*) AS actual FROM region UNION ALL SELECT 'nation', 25, count(*) FROM nation UNION ALL SELECT 'benchmark', 40, count(*) FROM benchmark)")
def count_contract(spark, sf_dir):
    return audit.counts({n: table(spark, sf_dir, n) for n in ("region", "nation", "benchmark")}, {"region": 5, "nation": 25, "benchmark": 40})


@query("SELECT event_id AS task_id, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'label' WHEN p < 0 OR p > 1 OR q < 0 OR q > 1 THEN 'probability' WHEN abs(p + q - 1) > 0.001 THEN 'sum' WHEN (event_type = 'click' AND p < q) OR (event_type = 'view' AND q < p) THEN 'choice' END AS reason FROM (SELECT event_id, event_type, value / 100 AS p, 1 - value / 100 AS q FROM events)")
def verdict_problems(spark, sf_dir):
    p = F.col("value") / 100
    labels = ["click", "view", "purchase"]
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("choice"), F.create_map(F.lit("click"), p, F.lit("view"), 1 - p).alias("probabilities"))
    return audit.verdict_problems(rows, labels).select("task_id", "reason")


@query("SELECT abs(a.m - b.m) <= 1e-6 AS same, a.n FROM (SELECT avg(l_quantity) AS m, count(*) AS n FROM lineitem) a, (SELECT sum(s) / sum(c) AS m FROM (SELECT sum(l_quantity) AS s, count(*) AS c FROM lineitem GROUP BY l_returnflag)) b")
def aggregate_reproduces(spark, sf_dir):
    """A stored mean, made from parts, against the one recomputed from all rows."""
    rows = table(spark, sf_dir, "lineitem")
    parts = rows.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("s"), F.count("*").alias("c")).agg((F.sum("s") / F.sum("c")).alias("m"))
    return rows.agg(F.avg("l_quantity").alias("_m"), F.count("*").alias("n")).crossJoin(F.broadcast(parts)).select((F.abs(F.col("_m") - F.col("m")) <= 1e-6).alias("same"), "n")


@query("SELECT l_orderkey AS query_id, min_by(l_quantity, (l_shipdate, l_linenumber, l_quantity)) AS value, count(*) AS observations, count(DISTINCT l_quantity) > 1 AS conflict FROM lineitem GROUP BY 1")
def coalesced_observations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), "l_shipdate", "l_linenumber", F.col("l_quantity").alias("value"))
    return relations.coalesced(rows, ["query_id"], ["l_shipdate", "l_linenumber"], "value")


@query("SELECT conv_id, turn, role, text FROM (SELECT conv_id, turn, role, text FROM conversations WHERE turn <> 0 UNION ALL SELECT conv_id, turn, 'system', upper(role) FROM conversations WHERE turn = 0)")
def keyed_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    new = rows.where("turn = 0").select("conv_id", "turn", F.lit("system").alias("role"), F.upper("role").alias("text"))
    return relations.upsert(rows, new, ["conv_id", "turn"])


@query("SELECT n_name AS parent, c_custkey AS child, count(o_orderkey) AS labels FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def label_transfer(spark, sf_dir):
    """Children inherit their parent's name and count their own labels; children without any stay."""
    child = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return child.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("n_name").alias("parent"), F.col("c_custkey").alias("child")).agg(F.count("o_orderkey").alias("labels"))


@query("SELECT count(d.doc_id) AS kept, (SELECT count(*) FROM labels) - count(d.doc_id) AS dropped, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS uncovered FROM labels l JOIN documents d USING (doc_id)")
def availability_audit(spark, sf_dir):
    left, right = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id")
    kept = left.join(right, "doc_id", "left_semi").agg(F.count("*").alias("kept"))
    total = left.agg(F.count("*").alias("_n"))
    open_ = right.join(left, "doc_id", "left_anti").agg(F.count("*").alias("uncovered"))
    return kept.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(open_)).select("kept", (F.col("_n") - F.col("kept")).alias("dropped"), "uncovered")


@query("SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, l.doc_id IS NULL AS missing_left, d.doc_id IS NULL AS missing_right FROM labels l FULL OUTER JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL")
def reference_coverage(spark, sf_dir):
    left, right = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("r"))
    return left.join(right, "doc_id", "full_outer").where("l IS NULL OR r IS NULL").select("doc_id", F.col("l").isNull().alias("missing_left"), F.col("r").isNull().alias("missing_right"))


@query("SELECT (SELECT count(*) FROM documents) AS corpus, (SELECT count(*) FROM benchmark) AS queries, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM labels WHERE quality = 1) AS positives, (SELECT count(*) FROM documents WHERE trim(text) = '') AS empty_texts, (SELECT count(*) FROM documents WHERE text IS NULL) AS missing_texts")
def dataset_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("corpus"), F.count_if(F.trim("text") == "").alias("empty_texts"), F.count_if(F.col("text").isNull()).alias("missing_texts"))
    labels = table(spark, sf_dir, "labels").agg(F.count("*").alias("labels"), F.count_if(F.col("quality") == 1).alias("positives"))
    return docs.crossJoin(F.broadcast(labels)).crossJoin(F.broadcast(table(spark, sf_dir, "benchmark").agg(F.count("*").alias("queries"))))


@query("SELECT event_type, CAST(sum(CASE WHEN value > 0 THEN value * 100 ELSE 0 END) AS BIGINT) > 0 AS has_usage, min(user_id) = max(user_id) AS one_setting, count(*) AS n, count(value) AS measured FROM events GROUP BY event_type")
def diagnostics_merge(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg((F.sum(F.when(F.col("value") > 0, F.col("value") * 100).otherwise(0)).cast("long") > 0).alias("has_usage"), (F.min("user_id") == F.max("user_id")).alias("one_setting"), F.count("*").alias("n"), F.count("value").alias("measured"))


@query("SELECT r_name AS track, count(*) AS planned, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS completed, round(100.0 * count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*), 4) AS percent FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def matrix_progress(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    small = F.broadcast(t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "r_name"))
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(small, F.col("n_nationkey") == F.col("c_nationkey"))
    done = F.count_if(F.col("o_orderstatus") == "F")
    return rows.groupBy(F.col("r_name").alias("track")).agg(F.count("*").alias("planned"), done.alias("completed"), F.round(100.0 * done / F.count("*"), 4).alias("percent"))


@query("SELECT l_returnflag AS l, count(*) AS n, round(avg(b.q - a.q), 6) AS mean_difference, count(CASE WHEN b.q > a.q THEN 1 END) AS wins, count(CASE WHEN b.q < a.q THEN 1 END) AS losses, count(CASE WHEN b.q = a.q THEN 1 END) AS ties FROM (SELECT l_orderkey, max(l_returnflag) AS l_returnflag, avg(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a JOIN (SELECT l_orderkey, avg(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b USING (l_orderkey) GROUP BY 1")
def paired_delta_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "query_id")
    one = rows.where("l_linestatus = 'F'").groupBy("query_id").agg(F.max("l_returnflag").alias("l"), F.avg("l_quantity").alias("value"))
    two = rows.where("l_linestatus = 'O'").groupBy("query_id").agg(F.avg("l_quantity").alias("value"))
    return stats.paired_summary(stats.paired(one, two).join(one.select("query_id", "l"), "query_id"), ["l"])


CHANNELS = "(VALUES ('photo', 'BGENSJ'), ('document', 'BGENSJ'), ('environment_audio', 'BGENSJ'), ('speech', 'BGENJ'), ('video', 'BGENSJ'), ('code', 'BGE'), ('composed_image', 'BGENJ')) t(track, letters)"
SUBSETS = f"s AS (SELECT track, array_to_string(list_transform(list_filter(range(0, length(letters)), lambda i: (m >> i) & 1 = 1), lambda i: substr(letters, CAST(i + 1 AS INTEGER), 1)), '') AS channels FROM (SELECT track, letters, unnest(range(1, CAST(pow(2, length(letters)) AS BIGINT))) AS m FROM {CHANNELS})), r AS (SELECT unnest(['none', 'judge_text', 'cross_encoder_text', 'relevance_model']) AS reranker)"


@query(f"WITH {SUBSETS} SELECT track, channels, reranker FROM s, r")
def matrix_registry(spark, sf_dir):
    return experiments.families(spark)


@query(f"WITH {SUBSETS}, b AS (SELECT unnest(['per_channel', 'total']) AS budget), k AS (SELECT unnest([20, 50, 100]) AS candidates) SELECT track, channels, reranker, budget, CASE WHEN reranker <> 'none' THEN candidates END AS candidates, budget = 'per_channel' AND candidates = 50 AS \"primary\" FROM s, r, b, k WHERE reranker <> 'none' OR candidates = 50")
def matrix_cells(spark, sf_dir):
    return experiments.cells(spark)


@query("SELECT source AS dataset, count(*) * 3 * 2 AS tasks, count(DISTINCT lang) AS languages FROM documents GROUP BY source")
def qa_task_grid(spark, sf_dir):
    """Records times conditions times representations."""
    grid = spark.createDataFrame([(c, r) for c in ("closed_book", "oracle", "retrieved") for r in ("text", "media")], "condition string, representation string")
    return table(spark, sf_dir, "documents").crossJoin(F.broadcast(grid)).groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("tasks"), F.countDistinct("lang").alias("languages"))


@query("SELECT l_orderkey // 16 AS part, (l_linenumber - 1) // 5 AS block, (l_linenumber - 1) % 5 AS method, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def positional_checkpoint(spark, sf_dir):
    """Positions to (block, method) by division, orders to partitions of sixteen."""
    at = F.col("l_linenumber") - 1
    return table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 16).alias("part"), F.floor(at / 5).alias("block"), (at % 5).alias("method")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN code IN (429, 502, 503, 504) AND NOT started THEN 'retry' WHEN code >= 400 THEN 'fail' ELSE 'done' END AS outcome FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 504 ELSE 200 END AS code, page_id % 2 = 1 AS started FROM pages)")
def retry_classes(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, (429, 503, 404, 504, 200))), (F.col("page_id") % 5 + 1).cast("int"))
    started = F.col("page_id") % 2 == 1
    return table(spark, sf_dir, "pages").select("page_id", records.outcome(code, started).alias("outcome"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, list_aggregate(list(length(text) ORDER BY turn), 'max') AS longest FROM conversations GROUP BY conv_id")
def ordered_arrays(spark, sf_dir):
    """Rows to aligned arrays in order, and an array's largest value."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(listed.alias("x")).select("conv_id", F.size("x").cast("long").alias("turns"), F.array_join(F.transform("x", lambda e: e["role"]), ">").alias("roles"), F.array_max(F.transform("x", lambda e: e["n"])).cast("long").alias("longest"))


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id) UNION SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def set_operations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").union(docs.where("lang = 'fr'")).distinct()


@query("SELECT page_id, json_extract_string(j, '$.id') AS id, CAST(json_extract(j, '$.n') AS BIGINT) AS n FROM (SELECT page_id, json_object('id', url, 'n', length(html)) AS j FROM pages)")
def json_payloads(spark, sf_dir):
    """A JSON payload column written and read back."""
    payload = F.to_json(F.struct(F.col("url").alias("id"), F.length("html").alias("n")))
    return table(spark, sf_dir, "pages").select("page_id", F.from_json(payload, "id string, n long").alias("j")).select("page_id", "j.id", "j.n")


@query("SELECT page_id, sha256(title) AS title FROM (SELECT page_id, CASE WHEN regexp_matches(html, '<title>') THEN regexp_extract(html, '<title>([^<]*)', 1) ELSE 'query:' || page_id END AS title FROM pages)")
def synthesised_default(spark, sf_dir):
    title = F.when(F.contains("html", F.lit("<title>")), F.regexp_extract("html", "<title>([^<]*)", 1)).otherwise(F.concat(F.lit("query:"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(title, 256).alias("title"))


@query("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(doc_id) AS first_id FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang")
def language_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("de", "fr")).groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("doc_id").alias("first_id"))


@query("SELECT page_id, page_id % 3 = 0 OR page_id % 5 = 1 AS finite, sha256('{\"page_id\":' || page_id || ',\"url\":\"' || url || '\"}') AS identity FROM pages")
def content_identity(spark, sf_dir):
    i = F.col("page_id")
    value = F.when(i % 3 == 0, F.length("url")).when(i % 5 == 1, 0.0).when(i % 5 == 2, float("nan")).when(i % 5 == 3, float("-inf"))
    return table(spark, sf_dir, "pages").select("page_id", X.finite(value).alias("finite"), X.content_key("page_id", "url").alias("identity"))
