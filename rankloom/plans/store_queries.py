"""Registered queries that write tables as files and stores and read them back by the library's sources, and the SQL that checks what comes back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import vectors as V
from rankloom.operators import ranking
from rankloom.plans import ranking_queries as R
from rankloom.plans.tables import settle, shared_dir, table
from rankloom.sources import readers, writers
from rankloom.streaming import states

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"


def _texts(rows: DataFrame, spark: SparkSession, files: int = 8, **options: str) -> str:
    """Rows of one string column as files of a row each, or, with fewer files, of several."""
    at = _place(spark)
    rows.repartition(files).write.options(**options).text(at)
    return at


def _articles(spark, sf_dir) -> DataFrame:
    """Each nation's customers as an article: chunks are customers, questions ask for the nation."""
    rows = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    chunk = lambda i, content: F.struct(F.lit(i).alias("id"), content.alias("content"), F.lit(0).alias("start_char"), F.length(content).alias("end_char"))
    article = F.struct(key.alias("id"), F.col("n_name").alias("title"), F.concat(F.when(F.col("n_nationkey") % 2 == 0, "https://x.wikipedia.org/").otherwise("https://web.example/"), key).alias("url"), F.lit("en").alias("lang"))
    item = F.struct(F.concat(F.lit("where is "), "n_name").alias("question"), F.col("n_regionkey").cast("string").alias("answer"), F.lit("place").alias("category"), F.array(F.lit("c1"), F.lit("gone")).alias("related_chunk_ids"))
    whole = F.struct(article.alias("article"), F.array(chunk("c0", F.col("n_name")), chunk("c1", F.concat(F.lit("in region "), F.col("n_regionkey").cast("string")))).alias("chunks"), F.struct(F.array(item).alias("items"), F.lit(1).alias("total_questions")).alias("questions"))
    return readers.articles(spark, _texts(rows.select(F.concat(F.lit("\ufeff"), F.to_json(whole)).alias("value")), spark, 60))


ARTICLE = "a AS (SELECT n_nationkey AS k, n_name, n_regionkey AS g, CASE WHEN n_nationkey % 2 = 0 THEN 'wikipedia' ELSE 'web' END AS source FROM nation)"


@query(f"WITH {ARTICLE} SELECT source || ':' || k || '#c0' AS id, n_name AS text, n_name AS title, CAST(k AS VARCHAR) AS article_id, source FROM a UNION ALL SELECT source || ':' || k || '#c1', 'in region ' || g, n_name, CAST(k AS VARCHAR), source FROM a")
def article_chunks(spark, sf_dir):
    return readers.article_chunks(_articles(spark, sf_dir))


@query(f"WITH {ARTICLE} SELECT source || ':' || k || '#q0000' AS id, 'where is ' || n_name AS question, CAST(g AS VARCHAR) AS answer, source || ':' || k || '#c1' AS gold, 'gone' AS missing FROM a")
def article_questions(spark, sf_dir):
    return readers.article_questions(_articles(spark, sf_dir)).select("id", "question", F.get("answers", 0).alias("answer"), F.array_join("gold_ids", ",").alias("gold"), F.array_join("missing", ",").alias("missing"))


def _markdown(spark, sf_dir) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit('\ufeff---\ntitle: "N \\"'), "n_name", F.lit('\\""\nurl: http://n/'), key, F.lit("\nchar_count: "), F.length(F.concat(F.lit("body of "), "n_name")).cast("string"), F.lit("\n---\nbody of "), "n_name")
    return settle(readers.markdown(spark, _texts(table(spark, sf_dir, "nation").select(text.alias("value")), spark, 60, lineSep="\u0000")).withColumn("body", F.replace("body", F.lit("\u0000"), F.lit(""))))


@query("SELECT 'N \"' || n_name || '\"' AS title, 'http://n/' || n_nationkey AS url, CAST(length(n_name) + 8 AS BIGINT) AS char_count, 'body of ' || n_name AS body FROM nation")
def markdown_articles(spark, sf_dir):
    return _markdown(spark, sf_dir).drop("path")


@query("""WITH r AS (SELECT n_name, a, b FROM nation, (VALUES (0, 4), (8, 11), (5, 500), (3, 3)) x(a, b)) SELECT 'http://n/' || n_nationkey AS url, a AS start, b AS stop, CASE WHEN a < b AND b <= length(n_name) + 8 THEN substr('body of ' || n_name, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) END AS text, NOT (a < b AND b <= length(n_name) + 8) AS rejected,
CASE WHEN NOT (a < b AND b <= length(n_name) + 8) THEN 'out of range' END AS reason FROM r JOIN nation USING (n_name)""")
def article_spans(spark, sf_dir):
    """Published ranges of characters, some of them beyond the text or empty."""
    bodies = _markdown(spark, sf_dir)
    some = F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in ((0, 4), (8, 11), (5, 500), (3, 3))]))
    got = readers.spans(bodies.select("path", "body"), bodies.select("path", some.alias("r")).select("path", "r.*"))
    return got.join(bodies.select("path", "url"), "path").drop("path")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 3 = 0")
def json_lines(spark, sf_dir):
    at = _place(spark)
    writers.ordered(table(spark, sf_dir, "events").where("event_id % 3 = 0").select("event_id", "user_id", "event_type", "value"), at, ["event_id"])
    return readers.jsonl(spark, at, "event_id long, user_id long, event_type string, value double")


@query("SELECT 'v' || o_custkey AS variant_id, o_orderpriority AS budget, count(*) AS candidates, 'done, \"so\"' AS status, 'mean' AS metric, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2")
def matrix_file(spark, sf_dir):
    """A matrix as CSV of fixed columns, and back; texts with commas and quotes stay whole."""
    at = _place(spark)
    rows = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("variant_id"), F.col("o_orderpriority").alias("budget")).agg(F.count("*").alias("candidates"), F.round(F.avg("o_totalprice"), 2).alias("value"))
    rows.withColumns({"status": F.lit('done, "so"'), "metric": F.lit("mean")}).select(*writers.MATRIX).write.options(header=True, escape='"').csv(at)
    return readers.delimited(spark, at, "variant_id string, budget string, candidates long, status string, metric string, value double")


@query("SELECT r_regionkey AS key, '\"' || r_name AS name FROM region")
def tab_separated(spark, sf_dir):
    at = _texts(table(spark, sf_dir, "region").select(F.concat(F.col("r_regionkey").cast("string"), F.lit('\t"'), "r_name").alias("value")), spark)
    return readers.delimited(spark, at, "key long, name string", tabs=True)


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS name FROM customer")
def keyed_store(spark, sf_dir):
    """A store written once, added to, and written over by key."""
    at, rows = _place(spark), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    writers.store(rows.where("k % 2 = 0"), at, ["k"])
    writers.store(rows.where("k % 2 = 1"), at, ["k"])
    writers.store(rows.where("k % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name")), at, ["k"], replace=True)
    return writers.current(spark, at)


@query("SELECT vec_id // 256 AS block, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY 1")
def resumed_blocks(spark, sf_dir):
    """Vectors in blocks; a first run ended early, a second wrote what was missing, a third nothing."""
    at, rows = _place(spark), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), "embedding")
    for part in (rows.where("ordinal % 5 < 2"), rows, rows):
        writers.vector_blocks(part, at)
    return spark.read.parquet(at).groupBy(F.col("block").cast("long").alias("block")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


@query("SELECT sha256(text) AS sha256, CAST(ceil(octet_length(encode(text)) / 1000.0) AS BIGINT) AS pieces, octet_length(encode(text)) AS bytes FROM (SELECT DISTINCT text FROM documents WHERE text <> '')")
def content_blobs(spark, sf_dir):
    """Distinct contents in pieces of 1,000 bytes."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select(F.encode("text", "utf-8").alias("content"))
    return writers.blobs(docs, 1000).groupBy("sha256").agg(F.count("*").alias("pieces"), F.sum(F.octet_length("bytes")).alias("bytes"))


@query("SELECT n_name AS label, CAST(n_regionkey AS DOUBLE) / 2 AS value FROM nation WHERE NOT contains(n_name, ' ')")
def public_export(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").where(~F.contains("n_name", F.lit(" "))).select(F.col("n_name").alias("label"), (F.col("n_regionkey") / 2.0).alias("value"), F.lit("free text, which stays here").alias("note"))
    return writers.public(rows, ["label"], ["value"])


CELLS = "c AS (SELECT o_custkey AS run, 'v' || o_orderkey AS variant, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'open' END AS status, o_orderpriority < '3' AS \"primary\", o_orderkey % 7 AS n, o_totalprice AS value FROM orders)"


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("variant"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"), (F.col("o_orderpriority") < "3").alias("primary"), (F.col("o_orderkey") % 7).alias("n"), F.col("o_totalprice").alias("value"))


@query(f"WITH {CELLS} SELECT run, variant, n, value FROM c WHERE status = 'completed' AND \"primary\"")
def run_report(spark, sf_dir):
    return writers.run_report(_cells(spark, sf_dir))


@query(f"WITH {CELLS} SELECT run, count(*) AS cells, count(CASE WHEN status = 'completed' THEN 1 END) AS completed, count(CASE WHEN status = 'completed' AND \"primary\" THEN 1 END) AS primaries FROM c GROUP BY run")
def run_index(spark, sf_dir):
    return writers.run_index(_cells(spark, sf_dir))


@query("SELECT 'n/' || n_nationkey || '.txt' AS path, n_name AS text FROM nation")
def packed_bundle(spark, sf_dir):
    """Files packed into one tar with their hashes, and unpacked again."""
    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("path"), F.encode("n_name", "utf-8").alias("content"))
    at = _place(spark)
    writers.packed(files, at, "bundle")
    return writers.unpacked(spark.read.parquet(f"{at}/bundle")).select("path", F.decode("content", "utf-8").alias("text"))


@query("SELECT n_name AS line FROM nation")
def gzip_members(spark, sf_dir):
    at = _texts(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), spark, 3, compression="gzip")
    return readers.members(spark, at).select(F.explode(F.split(F.btrim(F.decode("content", "utf-8"), F.lit("\n")), "\n")).alias("line")).where("line <> ''")


@query("SELECT * FROM (VALUES ('changed', 1), ('missing', 1), ('not listed', 1)) t(reason, n)")
def manifest_problems(spark, sf_dir):
    """A folder of four files against a manifest in which one is changed, one isn't there and one isn't named."""
    at = _place(spark)
    table(spark, sf_dir, "region").where("r_regionkey < 4").select(F.col("r_name").alias("value"), (F.col("r_regionkey") % 4).alias("p")).repartitionByRange(4, "p").select("value").write.text(at)
    have = settle(readers.file_hashes(spark, at).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256"))
    names = [r.name for r in have.orderBy("name").limit(2).collect()]
    listed = have.where(F.col("name") != names[0]).withColumn("sha256", F.when(F.col("name") == names[1], F.lit("0" * 64)).otherwise(F.col("sha256")))
    listed = listed.unionByName(spark.createDataFrame([("no such file", "1" * 64)], "name string, sha256 string"))
    return readers.manifest_problems(spark, at, listed).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT 'corpus' AS part, count(*) AS n FROM part UNION ALL SELECT 'queries', count(DISTINCT o_custkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 UNION ALL SELECT 'qrels', count(*) FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1)")
def checked_bundle(spark, sf_dir):
    """A frozen dataset as JSON lines, read under its rules."""
    at, text = _place(spark), lambda c: F.col(c).cast("string")
    orders = table(spark, sf_dir, "orders")
    writers.jsonl(table(spark, sf_dir, "part").select(text("p_partkey").alias("id"), F.col("p_name").alias("text")), f"{at}/corpus.jsonl")
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    writers.jsonl(lines.select(text("o_custkey").alias("id")).distinct().withColumn("text", F.lit("q")), f"{at}/queries.jsonl")
    writers.jsonl(lines.select(text("o_custkey").alias("query_id"), text("l_partkey").alias("corpus_id")).distinct().withColumn("relevance", F.lit(1.0)), f"{at}/qrels.jsonl")
    out = None
    for name, df in readers.bundle(spark, at).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT n_nationkey AS id, CAST(p AS INTEGER) AS position, CASE p WHEN 0 THEN n_name WHEN 2 THEN 'r' || n_regionkey END AS caption FROM nation, (SELECT unnest([0, 2]) AS p) WHERE p = 0 OR n_regionkey > 1")
def wide_captions(spark, sf_dir):
    """Columns of captions as rows; empty ones are left out, places stay."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("a"), F.lit(" ").alias("b"), F.when(F.col("n_regionkey") > 1, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).otherwise("").alias("c"))
    return readers.wide_captions(rows, ["a", "b", "c"])


@query("SELECT 16 * (k // 16) + (k % 16) AS query, m AS method, 'd' || (k * 10 + m) AS first FROM (SELECT unnest(range(0, 48)) AS k), (SELECT unnest(range(0, 5)) AS m)")
def sealed_positions(spark, sf_dir):
    """Chunks of sixteen queries by five methods, keyed by position alone."""
    one = spark.range(240).select(F.floor(F.col("id") / 80).alias("chunk"), "id", F.concat(F.lit("d"), (F.floor(F.col("id") / 5) * 10 + F.col("id") % 5).cast("string")).alias("d"))
    chunks = one.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "d"))), lambda x: F.array(x["d"])).alias("rankings")).select((F.col("chunk") * 16).alias("first_query"), "rankings")
    return readers.positional(chunks).select("query", "method", F.get("ids", 0).alias("first"))


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def stream_once(spark, sf_dir):
    """A stream of events worked off twice, by two queries: every key is done once."""
    at = _place(spark)
    table(spark, sf_dir, "events").select("user_id", "event_id").repartition(3).write.parquet(f"{at}/in")
    for i in range(2):
        stream = spark.readStream.schema("user_id long, event_id long").parquet(f"{at}/in")
        states.settle_once(stream, f"{at}/done", ["user_id"], lambda d: d.select("user_id"), f"{at}/c{i}").awaitTermination()
    return spark.read.parquet(f"{at}/done").groupBy("user_id").agg(F.count("*").alias("n"))


# --- small operators that no other query reaches ------------------------------------------------------------------------


@query(f"WITH {R.CTE} SELECT query_id, doc_id, round(score, 3) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 3) DESC, doc_id) AS INTEGER) AS rank FROM r WHERE channel = 'E' AND rank <= 30 AND round(score, 3) >= 0.25")
def rerank_threshold(spark, sf_dir):
    lists = settle(R.channel(spark, sf_dir, "E", 30))
    return ranking.rerank(lists.drop("score", "channel"), lists.select("query_id", "doc_id", F.round("score", 3).alias("new_score")), threshold=0.25)


@query(f"WITH {R.CTE} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE channel = 'E' AND rank <= 30 AND (query_id + doc_id) % 3 <> 0")
def excluded_pairs(spark, sf_dir):
    """Excluded pairs leave their places to others."""
    lists = settle(R.channel(spark, sf_dir, "E", 30))
    return ranking.ranked(ranking.excluded(lists.select("query_id", "doc_id", "score"), lists.where("(query_id + doc_id) % 3 = 0")))


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS square FROM (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_transform(embedding, lambda x: 0.0) ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(1e-6, sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))) END AS v FROM embeddings)")
def floored_units(spark, sf_dir):
    """Vectors over their norms, zero ones staying zero."""
    v = V.doubles(F.col("embedding"))
    v = F.when(F.col("vec_id") % 10 == 0, F.transform(v, lambda x: F.lit(0.0))).otherwise(v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.dot(V.unit(v, 1e-6), V.unit(v, 1e-6)), 6).alias("square"))
