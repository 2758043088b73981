"""Registered queries over texts: tokens, BM25, answers, formats, segments, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.functions.code import segments
from rankloom.operators import audit, lexical, metrics, ranking
from rankloom.plans.tables import settle, spread, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TR = r"regexp_extract_all(lower(translate({t}, 'Iİ', 'ıi')), '[\p{{L}}\p{{N}}_]+')"
DOC_TOKENS = TR.format(t="nfc_normalize(text)")
LARGEST = (1 << 63) - 1
PLAIN = r"trim(regexp_replace(regexp_replace(lower(translate({t}, 'Iİ', 'ıi')), '\p{{P}}', ' ', 'g'), '\s+', ' ', 'g'))"


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@query(f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, list_min(w) AS least FROM (SELECT doc_id, {DOC_TOKENS} AS w FROM documents)")
def turkish_token_counts(spark, sf_dir):
    w = X.turkish_tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.array_min("w").alias("least"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract_all(url, '[\p{L}\p{N}_]+') AS a, regexp_extract_all(translate(regexp_replace(url, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' '), '[\p{L}\p{N}_]+') AS b FROM pages)
SELECT page_id, len(a) + len(b) AS n_tokens, lower(array_to_string(list_concat(a, b), ' ')) AS tokens FROM t""")
def code_token_lists(spark, sf_dir):
    t = X.code_tokens(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(f"SELECT conv_id, turn, sha256({PLAIN.format(t='text')}) AS answer, sha256(replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 'ß', 'ss')) AS transcript FROM conversations")
def normalized_answers(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(X.plain_answer(t), 256).alias("answer"), F.sha2(X.transcript(t), 256).alias("transcript"))


@query(f"SELECT (SELECT count(*) FROM documents) AS n, count(*) AS tokens, count(DISTINCT w) AS vocabulary, round(count(*) / (SELECT count(*) FROM documents), 6) AS mean_length FROM (SELECT unnest({DOC_TOKENS}) AS w FROM documents)")
def bm25_corpus(spark, sf_dir):
    terms = lexical.term_statistics(docs(spark, sf_dir), F.col("text"), X.turkish_tokens)
    size = lexical.statistics(docs(spark, sf_dir), F.col("text"), X.turkish_tokens).agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean_length"))
    return terms.agg(F.sum("cf").alias("tokens"), F.count("*").alias("vocabulary")).crossJoin(F.broadcast(size))


@query(f"SELECT w AS token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({DOC_TOKENS}) AS w FROM documents) GROUP BY w")
def bm25_term_statistics(spark, sf_dir):
    return lexical.term_statistics(docs(spark, sf_dir), F.col("text"), X.turkish_tokens)


BM25 = f"""d AS (SELECT doc_id, {DOC_TOKENS} AS w FROM documents), c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
p AS (SELECT doc_id, length, token, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS token FROM d) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM p GROUP BY token), q AS (SELECT item_id AS query_id, unnest({DOC_TOKENS}) AS token FROM benchmark),
b AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM q JOIN p USING (token) JOIN df USING (token), c GROUP BY 1, 2),
br AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM b WHERE score > 0) WHERE rank <= 50),
gold AS (SELECT item_id AS query_id, doc_id FROM benchmark x JOIN documents y ON contains(y.text, x.text))"""


def bm25_lists(spark, sf_dir, k=50):
    return ranking.ranked(lexical.bm25(docs(spark, sf_dir), F.col("text"), asked(spark, sf_dir), F.col("question"), X.turkish_tokens), k)


def gold(spark, sf_dir):
    """Documents that hold a benchmark text."""
    return lexical.holders(docs(spark, sf_dir), F.col("text"), asked(spark, sf_dir), F.col("question"))


@query(f"WITH {BM25} SELECT * FROM br WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    return bm25_lists(spark, sf_dir, 20)


def _binary_sql() -> str:
    out = []
    for k in (1, 5, 10, 50):
        out += [
            f"count(CASE WHEN h.rank <= {k} THEN 1 END) / max(s.n) AS recall_{k}", f"CAST(count(CASE WHEN h.rank <= {k} THEN 1 END) > 0 AS INTEGER) * 1.0 AS hit_{k}",
            f"CAST(count(CASE WHEN h.rank <= {k} THEN 1 END) = max(s.n) AS INTEGER) * 1.0 AS all_evidence_{k}", f"coalesce(max(CASE WHEN h.rank <= {k} THEN 1.0 / h.rank END), 0.0) AS mrr_{k}",
            f"round(coalesce(sum(CASE WHEN h.rank <= {k} THEN 1 / log2(h.rank + 1) END), 0.0) / list_sum(list_transform(range(1, least(max(s.n), {k}) + 1), lambda i: 1 / log2(i + 1))), 9) AS ndcg_{k}",
        ]
    return f"SELECT s.query_id, {', '.join(out)} FROM (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) s LEFT JOIN (SELECT br.* FROM br JOIN gold USING (query_id, doc_id)) h ON h.query_id = s.query_id GROUP BY s.query_id"


@query(f"WITH {BM25} {_binary_sql()}")
def bm25_metrics(spark, sf_dir):
    return metrics.binary(bm25_lists(spark, sf_dir), gold(spark, sf_dir))


@query(f"WITH {BM25} SELECT g.query_id, round(count(CASE WHEN b.rank <= 5 THEN 1 END) / count(*), 9) AS context_recall FROM gold g LEFT JOIN br b USING (query_id, doc_id) GROUP BY 1")
def context_recall(spark, sf_dir):
    return gold(spark, sf_dir).join(bm25_lists(spark, sf_dir), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.round(F.count_if(F.col("rank") <= 5) / F.count("*"), 9).alias("context_recall"))


@query(f"""WITH {BM25}, o AS (SELECT query_id, doc_id, count(DISTINCT token) AS score FROM q JOIN p USING (token) GROUP BY 1, 2),
orr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM o) WHERE rank <= 50),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min((source * 100 + rank) * CAST(100000000 AS BIGINT) + doc_id) AS tie FROM (SELECT 0 AS source, query_id, doc_id, rank FROM br UNION ALL SELECT 1, query_id, doc_id, rank FROM orr) GROUP BY 1, 2)
SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie) AS INTEGER) AS rank FROM f) WHERE rank <= 50""")
def hybrid_candidates(spark, sf_dir):
    """Null ids keep their rows, as in the SQL: they go through the searches as the largest number, the last of ties."""
    named = lambda df, c: df.withColumn(c, F.coalesce(c, F.lit(LARGEST)))
    back = lambda df, c: df.withColumn(c, F.nullif(F.col(c), F.lit(LARGEST)))
    terms = settle(lexical.tokens(named(asked(spark, sf_dir), "query_id"), F.col("question"), X.turkish_tokens, "query_id").groupBy("query_id", "token").agg(F.count("*").alias("times")))
    found, n, mean = lexical.term_counts(named(docs(spark, sf_dir), "doc_id"), F.col("text"), terms, X.turkish_tokens)  # both channels read them
    lists = [lexical.bm25_best(found, n, mean, terms, 50), lexical.shared_best(found, terms, 50)]
    lists = [one.select("query_id", F.lit(source).alias("source"), "rank", "doc_id") for source, one in enumerate(lists)]
    return back(ranking.fuse_text(back(settle(lists[0].unionByName(lists[1])), "doc_id"), top=50), "query_id")


TURNS = "t AS (SELECT conv_id * 1000 + turn AS query_id, text AS reference, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prediction FROM conversations)"


def turns(spark, sf_dir):
    """Each turn as the reference of the turn before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("reference"), before.alias("prediction"))


@query(f"""WITH {TURNS}, n AS (SELECT query_id, {PLAIN.format(t="coalesce(prediction, '')")} AS p, {PLAIN.format(t='reference')} AS r FROM t),
w AS (SELECT query_id, p, r, list_filter(string_split(p, ' '), lambda x: x <> '') AS pt, list_filter(string_split(r, ' '), lambda x: x <> '') AS rt FROM n),
a AS (SELECT query_id, w AS word, count(*) AS c FROM (SELECT query_id, unnest(pt) AS w FROM w) GROUP BY 1, 2), b AS (SELECT query_id, w AS word, count(*) AS c FROM (SELECT query_id, unnest(rt) AS w FROM w) GROUP BY 1, 2),
s AS (SELECT query_id, sum(least(a.c, b.c)) AS s FROM a JOIN b USING (query_id, word) GROUP BY 1)
SELECT query_id, CAST(p = r AS INTEGER) * 1.0 AS em, round(CASE WHEN len(pt) = 0 AND len(rt) = 0 THEN 1.0 ELSE coalesce(2.0 * s / (len(pt) + len(rt)), 0.0) END, 9) AS f1, p = '' AS nonanswer FROM w LEFT JOIN s USING (query_id)""")
def answer_em_f1(spark, sf_dir):
    return metrics.answer_metrics(turns(spark, sf_dir).withColumn("references", F.array("reference")), X.plain_answer)


@query()
def word_error_alignment(spark, sf_dir):
    words = lambda c: F.filter(F.split(X.plain_answer(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")
    rows = turns(spark, sf_dir).select(F.col("query_id").alias("id"), words(F.col("reference")).alias("reference"), words(F.col("prediction")).alias("prediction"))
    return metrics.alignment(rows)


@query()
def corpus_word_error_rate(spark, sf_dir):
    return metrics.corpus_rate(word_error_alignment(spark, sf_dir))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t-\r]+') AS ws FROM documents), x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
i AS (SELECT doc_id, word, pos - row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) AS island FROM x), r AS (SELECT doc_id, max(n) AS longest_run FROM (SELECT doc_id, word, island, count(*) AS n FROM i GROUP BY 1, 2, 3) GROUP BY 1)
SELECT doc_id, longest_run, longest_run > 20 AS rejected FROM r""")
def word_runs(spark, sf_dir):
    run = audit.longest_run(F.regexp_extract_all("text", F.lit("([^ \\t-\\r]+)"), F.lit(1)))
    return docs(spark, sf_dir).select("doc_id", run.cast("long").alias("longest_run")).where("longest_run > 0").withColumn("rejected", F.col("longest_run") > 20)


@query("""SELECT doc_id, 'title: ' || coalesce(nullif(trim(split_part(text, chr(10), 2)), ''), 'none') || ' | text: ' || source AS passage, 'task: search | query: ' || lang AS question,
CASE WHEN contains(source, 'src1') THEN 'a' ELSE 'b' END AS kind, source || ':' || CAST(doc_id AS VARCHAR) || '#' || CAST(n_chars AS VARCHAR) AS chunk, source || ':' || CAST(doc_id AS VARCHAR) || '#q' || lpad(CAST(doc_id % 100 AS VARCHAR), 4, '0') AS question_id FROM documents""")
def record_formats(spark, sf_dir):
    second = F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit(""))
    return docs(spark, sf_dir).select(
        "doc_id", X.passage_format(second, F.col("source")).alias("passage"), X.question_format("search", F.col("lang")).alias("question"),
        F.when(F.contains("source", F.lit("src1")), "a").otherwise("b").alias("kind"), X.chunk_id(F.col("source"), F.col("doc_id"), F.col("n_chars")).alias("chunk"), X.question_id(F.col("source"), F.col("doc_id"), F.col("doc_id") % 100).alias("question_id"),
    )


LABEL = r"(regexp_full_match({v}, '[A-Za-z0-9_][A-Za-z0-9_.:#/@+\-]{{0,255}}') AND NOT contains({v}, '..') AND (NOT contains({v}, '/') OR regexp_full_match({v}, '[A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+')))"
LABELS = {"url_ok": "url", "text_ok": "'free text of ' || page_id", "pair_ok": "'owner/name' || page_id", "up_ok": "'a..b' || page_id", "mark_ok": "'_id#' || page_id || CASE WHEN page_id % 3 = 0 THEN ' or so' ELSE '' END"}


@query("SELECT page_id, CASE WHEN contains(url, 'wikipedia.org/') THEN 'wikipedia' ELSE 'web' END AS kind, " + ", ".join(f"{LABEL.format(v=f'({v})')} AS {c}" for c, v in LABELS.items()) + ", NOT (starts_with(url, '/') OR contains(url, chr(92)) OR regexp_matches(url, '(^|/)\\.\\.(/|$)')) AND length(url) > 0 AS path_ok FROM pages")
def source_and_label_checks(spark, sf_dir):
    """Kinds of sources, and labels of which some are free text, climb up, or have a slash too many."""
    u, i = F.col("url"), F.col("page_id").cast("string")
    values = [u, F.concat(F.lit("free text of "), i), F.concat(F.lit("owner/name"), i), F.concat(F.lit("a..b"), i), F.concat(F.lit("_id#"), i, F.when(F.col("page_id") % 3 == 0, " or so").otherwise(""))]
    return table(spark, sf_dir, "pages").select("page_id", X.source_kind(u).alias("kind"), *[X.safe_label(v).alias(c) for c, v in zip(LABELS, values)], X.safe_path(u).alias("path_ok"))


@query("SELECT text_hash, n_members, first_id, n_positive FROM (SELECT substr(sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 1, 24) AS text_hash, count(*) AS n_members, min(doc_id) AS first_id, count(CASE WHEN quality = 1 THEN 1 END) AS n_positive FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)")
def transcript_groups(spark, sf_dir):
    key = F.substring(F.sha2(X.collapse(F.lower("text")), 256), 1, 24)
    rows = docs(spark, sf_dir).select("doc_id", key.alias("text_hash")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("text_hash").agg(F.count("*").alias("n_members"), F.min("doc_id").alias("first_id"), F.count_if(F.col("quality") == 1).alias("n_positive"))


@query("SELECT sha256('{\"lang\":\"' || lang || '\",\"text\":\"' || md5(text) || '\"}') AS request, count(*) AS aliases, min(doc_id) AS first_alias FROM documents GROUP BY 1")
def request_dedupe(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang", F.md5("text").alias("text"))
    return rows.groupBy(X.content_key("lang", "text").alias("request")).agg(F.count("*").alias("aliases"), F.min("doc_id").alias("first_alias"))


LINES = r"l AS (SELECT doc_id, len(parts) AS n, parts FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"


@query(f"WITH {LINES}, e AS (SELECT doc_id, i, list_sum(list_transform(parts[1:i], lambda p: length(p) + 1)) AS line_end FROM (SELECT doc_id, parts, unnest(range(1, n)) AS i FROM l)) SELECT d.doc_id, coalesce(max(CASE WHEN line_end <= 400 THEN line_end END), least(400, max(length(text)))) AS cut FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id")
def backward_asof_line_end(spark, sf_dir):
    """The last line end within 400 characters, else the character cap: a backward as-of lookup in each text's own line ends."""
    parts = F.split("text", "\n")
    start = F.struct(F.lit(0).alias("end"), F.lit(None).cast("int").alias("best"))
    step = lambda s, p: F.struct((s["end"] + F.length(p) + 1).alias("end"), F.when(s["end"] + F.length(p) + 1 <= 400, s["end"] + F.length(p) + 1).otherwise(s["best"]).alias("best"))
    best = F.aggregate(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), start, step, lambda s: s["best"])
    return docs(spark, sf_dir).withColumn("parts", parts).select("doc_id", F.coalesce(best, F.least(F.lit(400), F.length("text"))).cast("long").alias("cut"))


@query("""WITH s AS (SELECT doc_id, a AS start, least(a + 500, length(text)) - CASE WHEN doc_id % 7 = 0 AND a = 0 THEN 1 ELSE 0 END AS stop FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS a FROM documents) WHERE NOT (doc_id % 11 = 0 AND a = 500)),
j AS (SELECT doc_id, stop, stop <= start OR start <> coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start, stop), 0) AS bad FROM s),
p AS (SELECT doc_id, count(*) AS n, bool_or(bad) AS bad, max(stop) AS last FROM j GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_segments, CASE WHEN length(text) = 0 THEN n IS NULL ELSE coalesce(NOT bad AND last = length(text), FALSE) END AS tiles FROM documents d LEFT JOIN p USING (doc_id)""")
def segment_tiling(spark, sf_dir):
    """Pieces of 500 characters, of which some are a character short and some are missing."""
    size = F.length("text")
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(500)))
    pieces = docs(spark, sf_dir).select("doc_id", F.explode(starts).alias("start"), size.alias("length")).where("NOT (doc_id % 11 = 0 AND start = 500)")
    short = F.when((F.col("doc_id") % 7 == 0) & (F.col("start") == 0), 1).otherwise(0)
    pieces = pieces.select("doc_id", "start", (F.least(F.col("start") + 500, F.col("length")) - short).alias("stop"))
    return audit.tiling(pieces, docs(spark, sf_dir).select("doc_id", size.alias("length")))


@query("""WITH x AS (SELECT doc_id, text, lang, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS seen FROM documents)
SELECT coalesce(CASE WHEN trim(text) = '' THEN 'empty text' END, CASE WHEN seen > 1 THEN 'repeated text' END, CASE WHEN lang NOT IN ('en', 'fr', 'de', 'es') THEN 'unknown language' END, 'accepted') AS reason, count(*) AS n FROM x GROUP BY 1""")
def rejection_audit(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("_key", F.md5("text"))  # texts meet by a 128-bit hash
    rows = rows.join(rows.groupBy("_key").agg(F.min("doc_id").alias("_first")), "_key")
    found = audit.rejections(rows, [("empty text", F.trim("text") == ""), ("repeated text", F.col("doc_id") > F.col("_first")), ("unknown language", ~F.col("lang").isin("en", "fr", "de", "es"))])
    return found.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {BM25}, a AS (SELECT query_id, string_agg(doc_id || ':' || substr(md5(text), 1, 8), ',' ORDER BY rank) AS evidence FROM br JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1)
SELECT query_id, b.text || ' | ' || coalesce(evidence, '') AS prompt FROM (SELECT item_id AS query_id, text FROM benchmark) b LEFT JOIN a USING (query_id)""")
def context_assembly(spark, sf_dir):
    top = settle(bm25_lists(spark, sf_dir, 5))
    parts = docs(spark, sf_dir).join(top, "doc_id").select("query_id", "rank", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.substring(F.md5("text"), 1, 8)).alias("part"))
    listed = parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), ",").alias("evidence"))
    return asked(spark, sf_dir).join(listed, "query_id", "left").select("query_id", F.concat("question", F.lit(" | "), F.coalesce("evidence", F.lit(""))).alias("prompt"))


@query("SELECT doc_id, doc_id % 2 = 0 AS good, replace('see [' || source || '; ' || lang || '] and [' || source || ', x]', CASE WHEN doc_id % 2 = 0 THEN '[' || source || '; ' || lang || ']' ELSE chr(1) END, '') || '[' || source || chr(10) || ']' AS stripped FROM documents")
def citation_strip(spark, sf_dir):
    cited = F.concat(F.lit("see ["), F.col("source"), F.lit("; "), F.col("lang"), F.lit("] and ["), F.col("source"), F.lit(", x]["), F.col("source"), F.lit("\n]"))
    known = F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang")).otherwise(F.array("source"))
    return docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 2 == 0).alias("good"), X.strip_citations(cited, known).alias("stripped"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, list_sort(json_keys(props)) = ['k'] AS exact_keys FROM events")
def prediction_parse(spark, sf_dir):
    """A JSON payload with exactly the expected keys."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.array_sort(F.json_object_keys("props")) == F.array(F.lit("k"))).alias("exact_keys"))


@query()
def lossless_segments(spark, sf_dir):
    return segments(docs(spark, sf_dir)).select("doc_id", "segment", "start", "stop", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS covered, TRUE AS tiles FROM documents WHERE length(text) > 0")
def lossless_coverage(spark, sf_dir):
    found = segments(docs(spark, sf_dir)).select("doc_id", "start", "stop")
    judged = audit.tiling(found, docs(spark, sf_dir).select("doc_id", F.length("text").alias("length")))
    return judged.where("n_segments > 0").join(found.groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("covered")), "doc_id").select("doc_id", "covered", "tiles")
