"""Registered queries over views, provenance, comparisons, models and prepared candidates, and the SQL that checks them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import analysis, dense, lexical, metrics, models, ranking, records
from rankloom.plans import ranking_queries as R
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


# --- texts ------------------------------------------------------------------------------------------------------------

WIDE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
WIDENED = "".join(chr(ord(c) + 0xFEE0) for c in WIDE)
PLAIN = r"trim(regexp_replace(regexp_replace({t}, '\p{{P}}', ' ', 'g'), '\s+', ' ', 'g'))"
FOLDED = "replace(lower({t}), 'ß', 'ss')"
TURKISH = "replace(lower(translate({t}, 'Iİ', 'ıi')), 'ß', 'ss')"


@query(f"""SELECT conv_id, turn, md5({PLAIN.format(t="lower(translate(text, 'Iİ', 'ıi'))")}) AS answer, md5({PLAIN.format(t=FOLDED.format(t='text'))}) AS lexical, md5({PLAIN.format(t=TURKISH.format(t='text'))}) AS lexical_tr,
md5(trim(regexp_replace({FOLDED.format(t='text')}, '\\s+', ' ', 'g'))) AS transcript, len(list_filter(string_split({PLAIN.format(t=FOLDED.format(t='text'))}, ' '), lambda w: w <> '')) AS error_words, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_key FROM conversations""")
def compatibility_forms(spark, sf_dir):
    """Texts with wide letters, ligature-like and decomposed characters have the keys of the plain ones."""
    wide = F.translate("text", WIDE, WIDENED)
    decomposed = F.replace(F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü")), F.lit("ö"), F.lit("ö"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(X.plain_answer(wide)).alias("answer"), F.md5(X.lexical_answer(wide, F.lit("de"))).alias("lexical"), F.md5(X.lexical_answer(wide, F.lit("tr"))).alias("lexical_tr"), F.md5(X.transcript(wide)).alias("transcript"),
        F.size(X.error_tokens(decomposed)).cast("long").alias("error_words"), F.md5(X.text_key(decomposed)).alias("text_key"),
    )


@query(f"""WITH t AS (SELECT conv_id * 1000 + turn AS query_id, {PLAIN.format(t=FOLDED.format(t="text || ' end'"))} AS r, {PLAIN.format(t=FOLDED.format(t="coalesce(CASE WHEN turn % 4 <> 3 THEN lag(text) OVER (PARTITION BY conv_id ORDER BY turn) END, '')"))} AS p FROM conversations),
w AS (SELECT query_id, p, r, list_filter(string_split(p, ' '), lambda x: x <> '') AS pt, list_filter(string_split(r, ' '), lambda x: x <> '') AS rt FROM t),
a AS (SELECT query_id, w AS word, count(*) AS c FROM (SELECT query_id, unnest(pt) AS w FROM w) GROUP BY 1, 2), b AS (SELECT query_id, w AS word, count(*) AS c FROM (SELECT query_id, unnest(rt) AS w FROM w) GROUP BY 1, 2),
s AS (SELECT query_id, sum(least(a.c, b.c)) AS s FROM a JOIN b USING (query_id, word) GROUP BY 1)
SELECT query_id, CAST(p <> '' AND p = r AS INTEGER) * 1.0 AS em, round(CASE WHEN p = '' THEN 0.0 ELSE coalesce(2.0 * s / (len(pt) + len(rt)), 0.0) END, 9) AS f1, p = '' AS nonanswer FROM w LEFT JOIN s USING (query_id)""")
def lexical_answers(spark, sf_dir):
    """Each turn as the answer to the next one, every fourth one silent: an empty answer scores nothing."""
    from rankloom.plans.text_queries import turns

    rows = turns(spark, sf_dir).withColumn("prediction", F.when(F.col("query_id") % 1000 % 4 != 3, F.col("prediction")))
    return metrics.lexical_metrics(rows.select("query_id", "prediction", F.array(F.concat("reference", F.lit(" end"))).alias("references"), F.lit("en").alias("language")))


# --- views and provenance ---------------------------------------------------------------------------------------------


def items(spark, sf_dir):
    """Pages as items: some have media, and some of these a surrogate."""
    i = F.col("page_id")
    return table(spark, sf_dir, "pages").select(i.alias("id"), F.md5("html").alias("text"), F.when(i % 3 == 0, F.col("url")).alias("media"), F.when(i % 6 == 0, F.concat(F.lit("said "), i.cast("string"))).alias("surrogate"))


@query("SELECT page_id AS id, CASE WHEN page_id % 6 = 0 THEN 'said ' || page_id ELSE md5(html) END AS text FROM pages")
def text_view(spark, sf_dir):
    return records.model_view(items(spark, sf_dir), text_only=True)


@query("SELECT page_id AS id, md5(html) AS text, CASE WHEN page_id % 3 = 0 THEN url END AS media FROM pages")
def media_view(spark, sf_dir):
    return records.model_view(items(spark, sf_dir))


@query("SELECT doc_id AS query_id, md5(text) AS question, lang AS language FROM documents")
def generation_view(spark, sf_dir):
    return records.generation_view(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.md5("text").alias("question"), F.col("lang").alias("language"), "source"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 25")
def split_selection(spark, sf_dir):
    return records.first_of_split(table(spark, sf_dir, "documents").withColumnRenamed("lang", "split"), "de", "doc_id", 25).select("doc_id", "source")


@query("SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN upper(md5(html)) ELSE md5(html) END AS text, CASE WHEN page_id % 3 = 0 THEN url END AS media, CASE WHEN page_id % 4 = 0 THEN 'asr' END AS text_source FROM pages")
def derived_text(spark, sf_dir):
    rows = items(spark, sf_dir)
    made = rows.where("id % 4 = 0").select("id", F.upper("text").alias("text"), F.lit("asr").alias("source"))
    return records.derived_text(rows.drop("surrogate"), made)


@query("""WITH x AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'OCR' WHEN 1 THEN 'human gold_caption v2' WHEN 2 THEN 'asr' END AS source, CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id % 7 = 1 END AS used, CASE WHEN page_id % 11 = 0 THEN NULL ELSE page_id % 11 <> 2 END AS free, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN ' ' ELSE 'x' END AS text FROM pages)
SELECT page_id, CASE WHEN used THEN 'labels used' WHEN NOT free THEN 'depends on the query' WHEN contains(lower(coalesce(source, '')), 'gold_caption') THEN 'labels as text' WHEN used IS NULL OR free IS NULL THEN 'provenance not stated' END AS reason,
CASE WHEN text IS NULL THEN 'missing' WHEN trim(text) = '' THEN CASE WHEN source = 'asr' OR page_id % 13 = 0 THEN 'valid empty' ELSE 'empty' END END AS gap FROM x""")
def provenance_checks(spark, sf_dir):
    i = F.col("page_id")
    source = F.when(i % 5 == 0, "OCR").when(i % 5 == 1, "human gold_caption v2").when(i % 5 == 2, "asr")
    used, free = F.when(i % 7 != 0, i % 7 == 1), F.when(i % 11 != 0, i % 11 != 2)
    text = F.when(i % 4 == 1, " ").when(i % 4 > 1, "x")
    return table(spark, sf_dir, "pages").select("page_id", records.leak(source, used, free).alias("reason"), records.text_gap(text, source, i % 13 == 0).alias("gap"))


@query("""WITH c AS (SELECT CAST(o_orderkey AS VARCHAR) AS identity, 'v' || o_custkey AS variant FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority < '3'), s AS (SELECT 'v' || c_custkey AS selector FROM customer UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 50 = 1)
SELECT selector, count(identity) AS n, CASE WHEN count(identity) = 1 THEN min(identity) END AS identity FROM s LEFT JOIN c ON selector = identity OR selector = variant GROUP BY selector""")
def primary_cells(spark, sf_dir):
    """Orders as cells, customers as variants: selectors that name no cell, one, or several."""
    orders = table(spark, sf_dir, "orders")
    cells = orders.select(F.col("o_orderkey").cast("string").alias("identity"), F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("variant"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"), (F.col("o_orderpriority") < "3").alias("primary"))
    selectors = table(spark, sf_dir, "customer").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("selector")).unionByName(orders.where("o_orderkey % 50 = 1").select(F.col("o_orderkey").cast("string").alias("selector")))
    return records.primary_cell(cells, selectors)


@query("""WITH a AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 9 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'xx' ELSE lang END AS lang, n_chars + CASE WHEN doc_id % 8 = 1 THEN 1 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 12 <> 5)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.lang, b.lang) AS lang, CASE WHEN a.doc_id IS NULL THEN 'not raw' WHEN b.doc_id IS NULL THEN 'not prepared' ELSE 'other n_chars' END AS reason FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.lang = b.lang WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.n_chars <> b.n_chars""")
def prepared_differences(spark, sf_dir):
    i, docs = F.col("doc_id"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    prepared = docs.where("doc_id % 12 <> 5").select("doc_id", F.when(i % 10 == 3, "xx").otherwise(F.col("lang")).alias("lang"), (F.col("n_chars") + F.when(i % 8 == 1, 1).otherwise(0)).alias("n_chars"))
    return records.prepared_rows(docs.where("doc_id % 9 <> 0"), prepared, ["doc_id", "lang"], ["n_chars"])


@query("SELECT p.page_id AS query_id, 'Reference: ' || r.url || chr(10) || 'Requested change: ' || p.page_id AS text FROM pages p JOIN pages r ON r.page_id = p.page_id // 2")
def reference_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    asked = pages.select(F.col("page_id").alias("query_id"), F.col("page_id").cast("string").alias("change"), F.floor(F.col("page_id") / 2).alias("reference_id"))
    return records.with_reference(asked, pages.select(F.col("page_id").alias("id"), F.col("url").alias("text")))


# --- numbers and parts ------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS calls, count(CASE WHEN event_id % 3 <> 0 THEN 1 END) AS succeeded, sum(CASE WHEN event_id % 3 <> 0 AND event_type <> 'click' THEN event_id % 100 END)::BIGINT AS tokens, round(sum(CASE WHEN event_id % 3 <> 0 THEN value / 1000 END), 6) AS cost FROM events GROUP BY 1")
def usage_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 3 != 0, "ok").otherwise("failed").alias("status"), F.when(F.col("event_type") != "click", F.col("event_id") % 100).alias("tokens"), (F.col("value") / 1000).alias("cost"))
    return records.usage(rows, ["event_type"])


@query("SELECT count(*) AS components, min(n) AS smallest, max(n) AS largest, round(max(n) / sum(n), 6) AS largest_share FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def component_summary(spark, sf_dir):
    return records.component_summary(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("root")))


@query("SELECT doc_id, w AS window_no, w * 700 AS start, least(w * 700 + 700, n_chars) AS stop FROM (SELECT doc_id, n_chars, unnest(range(0, CAST(ceil(n_chars / 700.0) AS BIGINT))) AS w FROM documents)")
def fixed_windows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(records.windows(F.col("n_chars"), 700)).alias("window_no", "w")).select("doc_id", F.col("window_no").cast("long").alias("window_no"), "w.start", "w.stop")


@query("""WITH p AS (SELECT user_id AS id, event_id AS ordinal, CASE WHEN user_id % 7 = 0 THEN 'same ' WHEN user_id % 11 = 0 THEN ' ' ELSE event_type || ' ' END AS delta, CASE WHEN user_id % 5 = 0 THEN 'length' ELSE 'stop' END AS finish, CASE WHEN user_id % 13 = 0 THEN 0 ELSE 1 END AS tokens FROM events),
o AS (SELECT id, trim(string_agg(delta, '' ORDER BY ordinal)) AS text, arg_max(finish, ordinal) AS finish, CAST(sum(tokens) AS BIGINT) AS tokens FROM p GROUP BY id),
x AS (SELECT id, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word, generate_subscripts(list_filter(string_split(text, ' '), lambda w: w <> ''), 1) AS pos FROM o),
r AS (SELECT id, max(n) AS run FROM (SELECT id, word, island, count(*) AS n FROM (SELECT id, word, pos - row_number() OVER (PARTITION BY id, word ORDER BY pos) AS island FROM x) GROUP BY ALL) GROUP BY id)
SELECT id, md5(text) AS text, finish, tokens, CASE WHEN finish <> 'stop' THEN 'not finished' WHEN text = '' THEN 'empty' WHEN tokens NOT BETWEEN 1 AND 4096 THEN 'token count' WHEN run > 20 THEN 'repeated word' END AS reason FROM o LEFT JOIN r USING (id)""")
def assembled_captions(spark, sf_dir):
    u = F.col("user_id")
    delta = F.when(u % 7 == 0, "same ").when(u % 11 == 0, " ").otherwise(F.concat("event_type", F.lit(" ")))
    parts = table(spark, sf_dir, "events").select(u.alias("id"), F.col("event_id").alias("ordinal"), delta.alias("delta"), F.when(u % 5 == 0, "length").otherwise("stop").alias("finish"), F.when(u % 13 == 0, 0).otherwise(1).alias("tokens"))
    return records.assembled(parts).withColumn("text", F.md5("text"))


@query("""SELECT source, '{"type":"object","properties":{"answer":{"type":"string"},"citations":{"type":"array","items":{"type":"string","enum":[' || string_agg(DISTINCT '"' || lang || '"', ',' ORDER BY '"' || lang || '"') || ']},"uniqueItems":true}},"required":["answer","citations"],"additionalProperties":false}' AS schema FROM documents GROUP BY source""")
def citation_schemas(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_list("lang").alias("ids")).select("source", records.citation_schema(F.col("ids")).alias("schema"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'keys' WHEN page_id % 4 = 3 THEN 'types' WHEN page_id % 4 = 2 THEN 'unknown citation' END AS reason, CASE WHEN page_id % 4 <> 1 THEN CASE WHEN page_id % 4 = 2 THEN 2 WHEN page_id % 4 = 3 THEN 0 ELSE 1 END ELSE 0 END AS cited FROM pages""")
def parsed_predictions(spark, sf_dir):
    """Answers with other keys, without citations, and with citations of what was never given."""
    i = F.col("page_id")
    body = F.when(i % 4 == 0, '"citations":["s1"]').when(i % 4 == 1, '"citations":[],"more":1').when(i % 4 == 2, '"citations":["s1","s9"]').otherwise('"citations":null')
    found = records.parsed_prediction(F.concat(F.lit('{"answer":"a",'), body, F.lit("}")), F.array(F.lit("s1"), F.lit("s2")))
    return table(spark, sf_dir, "pages").select("page_id", found.alias("x")).select("page_id", "x.reason", F.when(i % 4 != 1, F.coalesce(F.size("x.citations"), F.lit(0))).otherwise(0).alias("cited")).withColumn("cited", F.greatest(F.lit(0), F.col("cited")))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'b' ELSE 'a' END AS own, 'z' AS both, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) ELSE url END AS nested, [CAST(page_id AS VARCHAR), 'x y'] AS names, 2 AS pairs FROM pages")
def nested_values(spark, sf_dir):
    """Maps merged, a nested value with another to fall back on, lists written as text, arrays put side by side."""
    i = F.col("page_id").cast("string")
    a = F.create_map(F.lit("own"), F.lit("a"), F.lit("both"), F.lit("y"))
    b = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("own"), F.lit("b"), F.lit("both"), F.lit("z"))).otherwise(F.create_map(F.lit("both"), F.lit("z")))
    both = records.merged(a, b)
    meta = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"ref":{"id":"'), i, F.lit('"}}'))).otherwise(F.lit('{"ref":{}}'))
    names = records.listed(F.concat(F.lit("['"), i, F.lit("', 'x y']")))
    return table(spark, sf_dir, "pages").select("page_id", both["own"].alias("own"), both["both"].alias("both"), F.coalesce(F.get_json_object(meta, "$.ref.id"), F.col("url")).alias("nested"), names.alias("names"), F.size(records.aligned(names, F.array(F.lit(0.5), F.lit(0.25)))).alias("pairs"))


@query("SELECT method, reranked, method || CASE WHEN reranked THEN '_reranked' ELSE '' END AS variant, CASE WHEN reranked THEN 'p_relevant' WHEN method = 'bm25' THEN 'bm25' WHEN starts_with(method, 'hybrid') THEN 'rrf' ELSE 'cosine_similarity' END AS score_kind FROM (SELECT unnest(['bm25', 'dense_small', 'dense_large', 'hybrid_small', 'hybrid_large']) AS method), (SELECT unnest([FALSE, TRUE]) AS reranked)")
def method_variants(spark, sf_dir):
    """Five methods, each as it is and reranked, and what their scores are."""
    one = spark.createDataFrame([(m, r) for m in ("bm25", "dense_small", "dense_large", "hybrid_small", "hybrid_large") for r in (False, True)], "method string, reranked boolean")
    variant = F.concat("method", F.when(F.col("reranked"), "_reranked").otherwise(""))
    return one.select("method", "reranked", variant.alias("variant"), ranking.score_kind(variant).alias("score_kind"))


# --- rankings ---------------------------------------------------------------------------------------------------------


def _cells_sql() -> str:
    """All sets of the three channels under both budgets, cut at 20 and 50."""
    families = []
    for chosen in ranking.subsets(["G", "E", "S"]):
        for mode in ("per_channel", "total"):
            take = ranking.allocation(chosen, 60) if mode == "total" else dict.fromkeys(chosen, 60)
            families += [f"('{''.join(chosen)}-{mode}', '{c}', {n}, {len(chosen)})" for c, n in take.items()]
    return f"""t(family, channel, most, width) AS (VALUES {', '.join(families)}),
f AS (SELECT family, query_id, doc_id, round(sum(CASE WHEN width = 1 THEN score ELSE 1.0 / (60 + rank) END), 9) AS score FROM r JOIN t USING (channel) WHERE rank <= most GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY family, query_id ORDER BY score DESC, doc_id) AS rank FROM f), cells AS (SELECT family || '-k' || k AS cell, query_id, doc_id FROM o, (VALUES (20), (50)) c(k) WHERE rank <= k)"""


@query(f"""WITH {R.CTE}, {_cells_sql()}, u AS (SELECT DISTINCT query_id, doc_id FROM cells), z AS (SELECT u.query_id, u.doc_id, round(list_dot_product(q."E", d."E"), 6) AS score FROM u JOIN v q ON q.doc_id = u.query_id JOIN v d ON d.doc_id = u.doc_id),
n AS (SELECT cell, query_id, doc_id, row_number() OVER (PARTITION BY cell, query_id ORDER BY score DESC, doc_id) AS rank FROM cells JOIN z USING (query_id, doc_id))
SELECT cell, count(*) AS n, count(DISTINCT query_id) AS queries, round(avg(CASE WHEN rank <= 10 THEN CASE WHEN l.relevance IS NOT NULL THEN 1.0 ELSE 0.0 END END), 6) AS precision_10, CAST(sum(rank * (doc_id % 1000)) AS BIGINT) AS order_sum FROM n LEFT JOIN rel l USING (query_id, doc_id) GROUP BY cell""")
def every_cell_rescored(spark, sf_dir):
    """Every set of channels, both budgets, two cuts: each pair is scored once, and every cell's list is put in order of these scores."""
    lists = settle(ranking.every_cell(R.channels(spark, sf_dir), ["G", "E", "S"], 60, [20, 50]))
    pairs = lists.select("query_id", "doc_id").distinct()
    docs = R.corpus(spark, sf_dir)
    both = pairs.join(docs.select("doc_id", "v"), "doc_id").join(docs.select(F.col("doc_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scores = both.select("query_id", "doc_id", F.round(R.V.dot(F.col("q"), F.col("v")), 6).alias("score"))
    again = ranking.scatter(lists.select("cell", "query_id", "doc_id"), scores).join(R.qrels(spark, sf_dir), ["query_id", "doc_id"], "left")
    good = F.when(F.col("rank") <= 10, F.when(F.col("relevance").isNotNull(), 1.0).otherwise(0.0))
    return again.groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"), F.round(F.avg(good), 6).alias("precision_10"), F.sum(F.col("rank") * (F.col("doc_id") % 1000)).alias("order_sum"))


VARIANTS = {"n": "S", "s": "G", "e": "E", "g": "G", "b": "S"}
HITS = "h AS (SELECT channel, query_id, count(CASE WHEN rank <= 5 AND l.relevance IS NOT NULL THEN 1 END) / 5.0 AS p5, count(CASE WHEN rank <= 10 AND l.relevance IS NOT NULL THEN 1 END) / 10.0 AS p10 FROM r LEFT JOIN rel l USING (query_id, doc_id) GROUP BY 1, 2)"


def _variant_values(spark, sf_dir):
    hits = R.channels(spark, sf_dir).join(R.qrels(spark, sf_dir), ["query_id", "doc_id"], "left").groupBy("channel", "query_id").agg(*[(F.count_if((F.col("rank") <= k) & F.col("relevance").isNotNull()) / float(k)).alias(f"p{k}") for k in (5, 10)])
    names = F.broadcast(spark.createDataFrame([(f"photo__{v}__none", c) for v, c in VARIANTS.items()], "variant string, channel string"))
    return hits.join(names, "channel").unpivot(["variant", "query_id"], ["p5", "p10"], "metric", "value")


@query(f"""WITH {R.CTE}, {HITS}, l AS (UNPIVOT h ON p5, p10 INTO NAME metric VALUE value), c(contrast, a, b) AS (VALUES ('n-s', 'S', 'G'), ('b-g', 'S', 'G'), ('b-e', 'S', 'E'), ('g-e', 'G', 'E'))
SELECT contrast, x.metric, count(*) AS n, round(avg(x.value), 6) AS left_mean, round(avg(y.value), 6) AS right_mean, round(avg(y.value - x.value), 6) + 0.0 AS mean_difference, count(CASE WHEN y.value > x.value THEN 1 END) AS wins, count(CASE WHEN y.value < x.value THEN 1 END) AS losses, count(CASE WHEN y.value = x.value THEN 1 END) AS ties
FROM c JOIN l x ON x.channel = a JOIN l y ON y.channel = b AND y.query_id = x.query_id AND y.metric = x.metric GROUP BY 1, 2""")
def paired_contrasts(spark, sf_dir):
    """The contrasts of a track whose variants are there, over exactly the frozen queries."""
    frozen = R.asked(R.corpus(spark, sf_dir)).select("query_id")
    d = settle(analysis.contrasts(_variant_values(spark, sf_dir), "photo", frozen))
    return analysis.contrast_summary(d, frozen.withColumn("group", F.col("query_id") % 7), samples=200).drop("clusters", "eligible", "low", "high")


@query()
def contrast_intervals(spark, sf_dir):
    """The same with intervals over seven groups of queries."""
    frozen = R.asked(R.corpus(spark, sf_dir)).select("query_id")
    d = settle(analysis.contrasts(_variant_values(spark, sf_dir), "photo", frozen))
    return analysis.contrast_summary(d, frozen.withColumn("group", F.col("query_id") % 7))


STRATEGY_ROWS = "q AS (SELECT DISTINCT o_custkey AS query_id, o_custkey % 40 AS group_id, 1 + o_custkey % 9 AS reference_id FROM orders), p AS (SELECT o_custkey AS query_id, l_partkey AS doc_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND o_orderkey % 8 = 0), g AS (SELECT q.* FROM q WHERE query_id IN (SELECT query_id FROM p))"


def _strategy_sql() -> str:
    sources = {"media": "SELECT query_id, 'media:' || doc_id AS source FROM p", "function": "SELECT query_id, 'function:' || doc_id FROM p", "document": "SELECT query_id, 'document:' || (doc_id % 60) FROM p", "reference_and_target": "SELECT query_id, 'media:' || doc_id FROM p UNION SELECT query_id, 'media:' || reference_id FROM g"}
    parts = [f"SELECT DISTINCT '{s}' AS strategy, query_id, source FROM ({sql}) x(query_id, source)" for s, sql in sources.items()]
    return f"""WITH RECURSIVE {STRATEGY_ROWS}, e AS ({' UNION ALL '.join(parts)}),
b AS (SELECT DISTINCT x.strategy, x.query_id AS a, y.query_id AS b FROM e x JOIN e y ON x.strategy = y.strategy AND x.source = y.source),
r(strategy, node, reach) AS (SELECT strategy, a, a FROM b UNION SELECT r.strategy, r.node, b.b FROM r JOIN b ON r.strategy = b.strategy AND r.reach = b.a)
SELECT strategy, node AS query_id, min(reach) AS "group" FROM r GROUP BY 1, 2"""


@query(_strategy_sql())
def source_strategies(spark, sf_dir):
    """Customers as queries, parts as documents: groups by each way in which queries hang together."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    qrels = lines.where("l_linenumber = 1").join(orders.where("o_orderkey % 8 = 0"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.lit(1.0).alias("relevance")).distinct()
    queries = qrels.select("query_id").distinct().select("query_id", (F.col("query_id") % 40).alias("group_id"), (1 + F.col("query_id") % 9).alias("reference_id"))
    corpus = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 60).alias("source_id"), F.lit(None).cast("long").alias("group_id"))
    out = None
    for strategy in ("media", "function", "document", "reference_and_target"):
        one = analysis.source_groups(analysis.source_links(strategy, queries, corpus, qrels)).select(F.lit(strategy).alias("strategy"), "query_id", "group")
        out = one if out is None else out.unionByName(one)
    return out


HYBRID = f"""d AS (SELECT doc_id, regexp_extract_all(lower(translate(nfc_normalize(text), 'Iİ', 'ıi')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents), c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
p AS (SELECT doc_id, length, token, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS token FROM d) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM p GROUP BY token),
q AS (SELECT doc_id AS query_id, unnest(w[1:8]) AS token FROM d JOIN embeddings e ON e.vec_id = d.doc_id WHERE doc_id % {R.EVERY} = 0),
b AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM q JOIN p USING (token) JOIN df USING (token), c WHERE query_id <> doc_id GROUP BY 1, 2),
ch AS (SELECT 0 AS source, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0 UNION ALL SELECT 1, query_id, doc_id, rank FROM r WHERE channel = 'E' UNION ALL SELECT 2, query_id, doc_id, rank FROM r WHERE channel = 'S'),
pool AS (SELECT * FROM ch WHERE rank <= 100 AND query_id IN (SELECT query_id FROM q)), m(method, sources) AS (VALUES ('bm25', [0]), ('dense_small', [2]), ('dense_large', [1]), ('hybrid_small', [0, 2]), ('hybrid_large', [0, 1])),
f AS (SELECT method, query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min((CAST(source AS BIGINT) * 1000 + rank) * 10000000 + doc_id) AS tie FROM pool JOIN m ON list_contains(sources, source) GROUP BY 1, 2, 3)"""


@query(f"""WITH {R.CTE}, {HYBRID} SELECT method, query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY CASE WHEN method IN ('bm25', 'dense_small', 'dense_large') THEN 0 ELSE score END DESC, tie) AS rank FROM f) WHERE rank <= 50""")
def prepared_candidates(spark, sf_dir):
    """Three channels of 100 (words, large and small vectors) and the 50 candidates of five methods made of them, for the rows that have both a text and a vector."""
    texts, vectors = table(spark, sf_dir, "documents").select("doc_id", "text"), R.corpus(spark, sf_dir)
    tokens = X.turkish_tokens(F.col("text"))
    asked = settle(R.asked(vectors).select("query_id").join(texts.select(F.col("doc_id").alias("query_id"), F.slice(tokens, 1, 8).alias("w")), "query_id"))
    terms = settle(asked.select("query_id", F.explode("w").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times")))
    words = lexical.bm25_search(texts, F.col("text"), terms, X.turkish_tokens, 100, itself=False).select("query_id", F.lit(0).alias("source"), "rank", "doc_id")
    large, small = (R.channel(spark, sf_dir, name).select("query_id", F.lit(source).alias("source"), "rank", "doc_id") for name, source in (("E", 1), ("S", 2)))
    pool = settle(words.unionByName(large.unionByName(small).join(asked.where(F.size("w") > 0).select("query_id"), "query_id", "left_semi")))
    out = None
    for method, sources in {"bm25": [0], "dense_small": [2], "dense_large": [1], "hybrid_small": [0, 2], "hybrid_large": [0, 1]}.items():
        one = ranking.fuse_text(pool.where(F.col("source").isin(sources)), top=50).select(F.lit(method).alias("method"), "query_id", "doc_id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


# --- models -----------------------------------------------------------------------------------------------------------


class LetterEncoder:
    """A stand-in for a model: counts of a few letters."""

    identity, dimension = "letters", 4

    def encode(self, texts: list[str], role: str) -> np.ndarray:
        return np.array([[t.count(c) for c in "aeio"] for t in texts], float).reshape(len(texts), 4)

    def unload(self) -> None:
        pass


class SizeScorer:
    """A stand-in for a reranker: the nearer the sizes, the better."""

    identity = "sizes"

    def score(self, query: str, candidates: list[str]) -> list[float]:
        return [0.0 - abs(len(query) - len(c)) for c in candidates]


LETTERS = "[" + ", ".join(f"CAST(length(url) - length(replace(url, '{c}', '')) AS DOUBLE)" for c in "aeio") + "]"
NEAR = f"e AS (SELECT page_id, url, {LETTERS} AS v FROM pages), n AS (SELECT * FROM (SELECT q.page_id AS query_id, d.page_id AS doc_id, q.url AS query, d.url AS text, list_dot_product(q.v, d.v) AS score, CAST(row_number() OVER (PARTITION BY q.page_id ORDER BY list_dot_product(q.v, d.v) DESC, d.page_id) AS INTEGER) AS rank FROM e q JOIN e d ON q.page_id % 25 = 0) WHERE rank <= 12)"


def _encoded_lists(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"))
    docs = settle(models.encoded(pages, "doc_id", "text", LetterEncoder, "document"))
    asked = models.encoded(pages.where("doc_id % 25 = 0").withColumnRenamed("doc_id", "query_id"), "query_id", "text", LetterEncoder, "query")
    lists = dense.search(asked, docs, 12)
    return lists.join(pages, "doc_id").join(pages.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), "query_id")


@query(f"WITH {NEAR} SELECT query_id, doc_id, score, rank FROM n")
def encoder_search(spark, sf_dir):
    return _encoded_lists(spark, sf_dir).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {NEAR} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, CAST(-abs(length(query) - length(text)) AS DOUBLE) AS score FROM n)")
def pointwise_reranked(spark, sf_dir):
    lists = settle(_encoded_lists(spark, sf_dir))
    return ranking.rerank(lists.select("query_id", "doc_id", "rank"), models.pointwise(lists, SizeScorer))


@query(f"WITH {NEAR} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, rank, CAST(-abs(length(query) - length(text)) AS DOUBLE) AS score FROM n)")
def listwise_reranked(spark, sf_dir):
    lists = settle(_encoded_lists(spark, sf_dir))
    return ranking.rerank(lists.select("query_id", "doc_id", "rank"), models.listwise(lists, SizeScorer), "rank")


@query(f"WITH {NEAR}, p AS (SELECT query_id, doc_id, query, unnest(string_split(text, '/')) AS part FROM n) SELECT query_id, doc_id, CAST(max(-abs(length(query) - length(part))) AS DOUBLE) AS new_score FROM p GROUP BY 1, 2")
def scored_in_parts(spark, sf_dir):
    lists = settle(_encoded_lists(spark, sf_dir))
    got = models.in_parts(lists.select("query_id", "doc_id", "query", "text"), lambda t: F.split(t, "/"), lambda x: models.pointwise(x, SizeScorer))
    return got.select("query_id", "doc_id", "new_score")
