"""Golden values and edge cases of the library's operators on small tables."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import audit, dense, graph, lexical, metrics, ranking, relations, stats
from rankloom.plans import experiments


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_turkish_tokens(spark):
    assert one(spark, X.turkish_tokens(F.lit("ILIK SİRKE, sıcak; ipek_3"))) == ["ılık", "sirke", "sıcak", "ipek_3"]
    assert one(spark, X.turkish_tokens(F.lit("cafe\u0301 I\u0307ZIN"))) == ["café", "izın"]  # composed first


def test_plain_answer_and_code_tokens(spark):
    assert one(spark, X.plain_answer(F.lit("KIRIK  Şişe; (İki)\u00a0ﬁş!"))) == "kırık şişe iki fiş"
    assert one(spark, X.plain_answer(F.lit("KIRIK"), False)) == "kirik"
    assert one(spark, X.code_tokens(F.lit("openStraße x_Y9"))) == ["openstrasse", "x_y9", "open", "strasse", "x", "y9"]
    assert one(spark, X.code_tokens(F.lit("--"))) == []


def test_lexical_forms(spark):
    texts = ["STRASSE IX", "Straße Ix.", "ΣΟΦΟΣ σοφος", "１２ Ⅻ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select(X.lexical_answer(t, F.lit("de")).alias("de"), X.lexical_answer(t, F.lit("tr_tr")).alias("tr"), X.transcript(t).alias("said"), X.error_tokens(t).alias("words")).collect()
    assert [r.de for r in got] == ["strasse ix", "strasse ix", "σοφοσ σοφοσ", "12 xii"]
    assert got[0].tr == "strasse ıx" and got[1].said == "strasse ix." and got[1].words == ["strasse", "ix"]
    assert one(spark, X.text_key(F.lit(" e\u0301 \n\u2003x "))) == "é x"


def test_citations(spark):
    known = F.array(F.lit("n1"), F.lit("n2"))
    cases = {"so [n1; n2] it [ n2 ] is": "so  it  is", "so [n1, other]": "so [n1, other]", "[n1\n]": "[n1\n]", "[]": "[]"}
    for text, want in cases.items():
        assert one(spark, X.strip_citations(F.lit(text), known)) == want


def test_unicode_forms(spark):
    df = spark.createDataFrame([("e\u0301", "ﬂ", "Maß"), ("x", "y", "Zé"), (None, None, None)], "a string, b string, c string")
    assert rows(df.select(X.nfc(F.col("a")).alias("a"), X.nfkc(F.col("b")).alias("b"), X.casefolded(F.col("c")).alias("c")), "a", "b", "c") == [("é", "fl", "mass"), ("x", "y", "zé"), (None, None, None)]


def test_unicode_masks_leave_nothing_out():
    """Every character that a form changes, alone or after a letter, is one that its mask finds."""
    import re
    import sys
    import unicodedata

    for pattern, change, plain in ((X._NFC, lambda c: unicodedata.normalize("NFC", c), lambda c: c), (X._NFKC, lambda c: unicodedata.normalize("NFKC", c), lambda c: c), (X._FOLD, str.casefold, str.lower)):
        python = re.compile(pattern.replace(r"\p{M}", "".join(re.escape(chr(i)) for i in range(0x110000) if unicodedata.category(chr(i))[0] == "M" and i < 0x10000)))
        missed = [hex(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and (change(chr(i)) != plain(chr(i)) or change("e" + chr(i)) != plain("e" + chr(i))) and not python.search(chr(i))]
        assert not missed


def test_front_matter_and_cells(spark):
    text = F.lit('\ufeff---\r\ntitle: "A \\"b\\" \\u00e9"\nurl: \'it\'\'s\'\nplain: 12 \n---\nfirst\n---\nlast')
    assert [one(spark, X.front_matter(text, k)) for k in ("title", "url", "plain", "none")] == ['A "b" é', "it's", "12", None]
    assert one(spark, X.body(text)) == "first\n---\nlast" and one(spark, X.body(F.lit("no head"))) == "no head"
    assert one(spark, X.table_cells(F.lit(r"| p \| q | r<br>s<br/> ||"))) == ["p | q", "r\ns\n"]


def test_labels(spark):
    good = ["a", "_x", "v1.2:3", "owner/name", "a#b", "x" * 256, "1@2"]
    bad = ["", "a b", "../x", "a/b/c", "/a", "a..b", "-a", "x" * 257, "a\\b", "é"]
    assert all(one(spark, X.safe_label(F.lit(v))) for v in good) and not any(one(spark, X.safe_label(F.lit(v))) for v in bad)


def test_paths(spark):
    bad = ["/a", "a/../b", "..", "a\\b", ""]
    assert [one(spark, X.safe_path(F.lit(p))) for p in bad] == [False] * 5 and one(spark, X.safe_path(F.lit("a/b..c")))


def test_text_fusion_golden(spark):
    schema = "query_id string, source int, rank int, doc_id string, score double"
    lists = spark.createDataFrame([("q", 0, 1, "m", 9.0), ("q", 0, 2, "m", 8.0), ("q", 0, 3, "n", 7.0), ("q", 1, 1, "o", 0.3), ("q", 1, 2, "n", 0.2), ("one", 1, 1, "u", 0.9), ("one", 1, 2, "u", 0.8), ("one", 1, 3, "t", 0.7)], schema)
    got = rows(ranking.fuse_text(lists).where("query_id = 'q'").orderBy("rank"), "doc_id", "score")
    assert [g[0] for g in got] == ["n", "m", "o"]  # the last two tie: the first source goes before
    assert np.allclose([g[1] for g in got], [1 / 63 + 1 / 62, 1 / 61, 1 / 61])
    assert rows(ranking.fuse_text(lists).where("query_id = 'one'").orderBy("rank"), "doc_id", "score") == [("u", 0.9), ("t", 0.7)]


def test_channel_fusion_budgets(spark):
    data = [("q", c, i + 1, d, 1.0 - i / 10) for c, ds in (("B", "abc"), ("G", "abd"), ("E", "bae")) for i, d in enumerate(ds)]
    lists = spark.createDataFrame(data, "query_id string, channel string, rank int, doc_id string, score double")
    assert rows(ranking.pool_sizes(lists, ["B", "G", "E"], "per_channel", 3), "raw", "unique") == [(9, 5)]
    assert rows(ranking.pool_sizes(lists, ["B", "G", "E"], "total", 3), "raw", "unique") == [(3, 2)]
    assert ranking.allocation(["E", "B", "G"], 100) == {"B": 34, "G": 33, "E": 33}
    tie = spark.createDataFrame([("q", "B", 1, "z", 1.0), ("q", "B", 2, "a", 0.5), ("q", "G", 1, "a", 1.0), ("q", "G", 2, "z", 0.5)], lists.schema)
    assert rows(ranking.fuse_channels(tie, ["B", "G"], "per_channel", 2).orderBy("rank"), "doc_id") == [("a",), ("z",)]
    alone = ranking.fuse_channels(lists, ["B"], "per_channel", 3).orderBy("rank")
    assert rows(alone, "doc_id", "score") == [("a", 1.0), ("b", 0.9), ("c", 0.8)]
    with pytest.raises(ValueError):
        ranking.fuse_channels(lists, ["B"], "other", 3)


def test_exact_search_with_exclusion(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "doc_id long, v array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, v array<double>")
    out = spark.createDataFrame([(7, 1)], "query_id long, doc_id long")
    assert rows(dense.search(queries, docs, 2, out).orderBy("query_id", "rank"), "query_id", "doc_id") == [(7, 2), (7, 3), (8, 3), (8, 1)]
    assert dense.search(queries, docs.limit(0), 2).count() == 0


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 5)), 1)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, v array<double>")
    got = dense.search(docs.where("doc_id % 7 = 0").withColumnRenamed("doc_id", "query_id"), docs, 9, segment_rows=50).collect()
    for q in range(0, 300, 7):
        s = np.round(x @ x[q], 6)
        want = sorted(range(300), key=lambda d: (-s[d], d))[:9]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_search_blocks_pools_and_late_interaction(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(90, 6)), 2)
    docs = spark.createDataFrame([(i, i // 4, v.tolist()) for i, v in enumerate(x)], "doc_id long, s long, v array<double>").repartition(3)
    asked = docs.where("doc_id < 12").select(F.col("doc_id").alias("query_id"), "v")
    out = asked.select("query_id", F.explode(F.sequence(F.col("query_id"), F.col("query_id") + 3)).alias("doc_id"))
    monkeypatch.setattr(dense, "BLOCK_NUMBERS", 60)
    late = lambda a, b, how: getattr(np.array([max(a[2 * p : 2 * p + 2] @ b[2 * j : 2 * j + 2] for j in range(3)) for p in range(3)]), how)()
    for kind in ("dot", "sum", "mean"):
        got = dense.search(asked, docs, 7, out, kind=kind, parts=3).collect()
        score = (lambda a, b: a @ b) if kind == "dot" else (lambda a, b, kind=kind: late(a, b, kind))
        for q in range(12):
            s = {d: round(float(score(x[q], x[d])), 6) for d in range(90) if not q <= d <= q + 3}
            assert [(r.doc_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == sorted(s.items(), key=lambda e: (-e[1], e[0]))[:7]
    got = dense.search(asked, docs, 5, out, pool="s").collect()
    for q in range(12):
        best = {}
        for d in range(90):
            if not q <= d <= q + 3:
                best[d // 4] = max(best.get(d // 4, -np.inf), round(float(x[q] @ x[d]), 6))
        assert [r.s for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [a for a, _ in sorted(best.items(), key=lambda e: (-e[1], e[0]))[:5]]
    with pytest.raises(ValueError):
        dense.search(asked, docs, 2, asked.crossJoin(spark.range(100)).select("query_id", F.col("id").alias("doc_id")))


def test_graded_metrics_golden(spark):
    r = spark.createDataFrame([("q", 1, "b"), ("q", 2, "b"), ("q", 3, "x"), ("q", 4, "a")], "query_id string, rank int, doc_id string")
    rel = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 1.0), ("p", "a", 1.0)], "query_id string, doc_id string, relevance double")
    got = {m.query_id: m for m in metrics.graded(r, rel, ks=(1, 3)).collect()}
    q = got["q"]
    assert (q.hit_1, q.recall_1, q.recall_3, q.mrr_3) == (1, 0.5, 1, 1)
    assert np.isclose(q.ndcg_1, 1 / 7) and np.isclose(q.ndcg_3, (1 + 7 / np.log2(4)) / (7 + 1 / np.log2(3))) and np.isclose(q.map_16, (1 + 2 / 3) / 2)
    assert got["p"].hit_3 == 0 and got["p"].map_16 == 0


def test_binary_metrics_golden(spark):
    r = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 3, "x"), ("q", 4, "b")], "query_id string, rank int, doc_id string")
    gold = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, doc_id string")
    m = metrics.binary(r, gold, ks=(1, 3)).first()
    assert (m.recall_1, m.hit_1, m.all_evidence_1, m.recall_3) == (0.5, 1, 0, 1)


def sparse_by_hand(queries, docs, k, positive=False, itself=True):
    """Top k by sums over shared tokens, pair by pair."""
    out = []
    for q in sorted({q for q, _, _ in queries}):
        sums = {}
        for d, tokens, weights in docs:
            for _, t, w in (x for x in queries if x[0] == q):
                for u, v in zip(tokens, weights, strict=True):
                    if t == u and (itself or d != q):
                        sums[d] = sums.get(d, 0.0) + w * v
        best = sorted((math.isnan(s) and -math.inf or -math.floor(s * 1e6 + 0.5) / 1e6, d) for d, s in sums.items())
        out += [(q, d, -s, r) for r, (s, d) in enumerate([x for x in best if not positive or x[0] < 0][:k], 1)]
    return out


@pytest.mark.parametrize(("numbers", "segment"), [(4_000_000, 1 << 20), (1_500, 40)])
def test_sparse_search(spark, monkeypatch, numbers, segment):
    """The same as pair by pair, in one block and in many: frequent and rare tokens, ties, repeated tokens and ids, documents that share nothing, halves."""
    monkeypatch.setattr(dense, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(dense, "SEGMENT_NUMBERS", segment)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    some = lambda n: [words[min(59, int(x))] for x in rng.exponential(9, n)]
    docs = [(i % 97, ts, [float(x) for x in rng.integers(1, 9, len(ts)) / 128]) for i in range(110) for ts in [some(int(rng.integers(0, 12)))]]  # 13 ids are repeated
    docs += [(200, ["alone", "w1"], [1e-200, 0.0078125]), (201, ["far"], [1.0]), (202, [], []), (203, None, None)]
    queries = [(q, t, float(w)) for q in (0, 5, 96, 200, 500) for t in some(6) for w in [rng.integers(1, 9) / 128]] + [(600, "alone", 1e-200), (600, "w1", 1e-9), (700, "nowhere", 1.0)]
    corpus, asked = spark.createDataFrame(docs, "doc_id long, tokens array<string>, weights array<double>").repartition(3), spark.createDataFrame(queries, "query_id long, token string, weight double")
    for k, positive, itself in ((4, False, True), (7, True, False), (200, False, False), (200, True, True)):
        got = dense.sparse_search(asked, corpus, k, positive=positive, itself=itself).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == sparse_by_hand(queries, [d for d in docs if d[1]], k, positive, itself)


def test_sparse_search_odd_weights(spark):
    """Zero sums of shared tokens are candidates, what is not finite ranks as in SQL, halves go up."""
    nan, inf = float("nan"), float("inf")
    docs = [(1, [1], [nan]), (2, [1], [inf]), (3, [1], [0.0078125]), (4, [1], [-0.0078125]), (5, [2], [1.0]), (6, [1], [1e-300]), (7, [1, 3], [None, 1.0])]
    corpus = spark.createDataFrame(docs, "doc_id int, tokens array<int>, weights array<double>").coalesce(1)
    got = dense.sparse_search(spark.createDataFrame([(9, 1, 1.0)], "query_id int, token int, weight double"), corpus, 9)
    assert str(rows(got.orderBy("rank"), "doc_id", "score")) == str([(1, nan), (2, inf), (3, 0.007813), (6, 0.0), (4, -0.007813)])
    assert got.dtypes == [("query_id", "int"), ("doc_id", "int"), ("score", "double"), ("rank", "int")]
    assert dense.sparse_search(spark.createDataFrame([], "query_id int, token int, weight double"), corpus, 9).count() == 0


def test_sparse_dot_shuffles_no_pairs(spark, sf_dir):
    import __spark_entry__ as entry

    plan = entry.queries()["sparse_dot"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_bm25_positive_only_and_ties(spark):
    docs = spark.createDataFrame([(1, "needle evidence"), (2, "needle evidence"), (3, "unrelated document")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "needle"), (2, "absentvocabulary"), (3, "!!!")], "query_id long, question string")
    got = ranking.ranked(lexical.bm25(docs, F.col("text"), q, F.col("question"), X.turkish_tokens))
    assert rows(got.orderBy("query_id", "rank"), "query_id", "doc_id") == [(1, 1), (1, 2)]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_bm25_search(spark, monkeypatch, most):
    """The lists of bm25's scores, also where terms are too many to be broadcast; ids are repeated, with equal and other lengths."""
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", most)
    rng = np.random.default_rng(8)
    some = lambda n: " ".join(f"w{min(40, int(x))}" for x in rng.exponential(7, n))
    docs = spark.createDataFrame([(i % 61, some(int(rng.integers(0, 20)))) for i in range(70)] + [(3, "w1 w2 w2"), (3, "w2 w1 w1"), (3, "w1"), (99, ""), (98, "!")], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(q, some(5)) for q in (0, 3, 60, 98, 700)] + [(701, "nowhere")], "query_id long, question string")
    terms = lexical.tokens(queries, F.col("question"), X.turkish_tokens, "query_id").groupBy("query_id", "token").agg(F.count("*").alias("times"))
    scores = lexical.bm25(docs, F.col("text"), queries, F.col("question"), X.turkish_tokens)
    for k, itself in ((5, False), (500, True)):
        want = ranking.ranked(scores if itself else scores.where("query_id <> doc_id"), k)
        got = lexical.bm25_search(docs, F.col("text"), terms, X.turkish_tokens, k, itself=itself)
        order = lambda x: rows(x.orderBy("query_id", "rank"), "query_id", "rank", "doc_id", "score")
        assert order(got) == order(want) and got.count() > 20
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_bm25_search_null_text(spark):
    """A null text is one of the documents, and the mean is that of the others."""
    docs = spark.createDataFrame([(1, "a b"), (2, "b c d d"), (3, None)], "doc_id long, text string")
    got = lexical.bm25_search(docs, F.col("text"), spark.createDataFrame([(1, "d", 1)], "query_id long, token string, times long"), X.turkish_tokens, 5)
    assert rows(got, "doc_id", "score") == [(2, round(math.log(1 + 2.5 / 1.5) * 2 / (2 + 1.5 * (0.25 + 0.75 * 4 / 3)), 6))]


def test_prepared_candidates_shuffle_no_pairs(spark, sf_dir, monkeypatch):
    from rankloom.plans import extra_queries

    plans = []
    monkeypatch.setattr(extra_queries, "settle", lambda df, settle=extra_queries.settle: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    extra_queries.prepared_candidates(spark, sf_dir)
    assert plans and not any(re.search(r"Join \[token", p) for p in plans)


def test_answers(spark):
    df = spark.createDataFrame([(1, "seven grey geese", ["geese"]), (2, "", ["x"]), (3, None, [""]), (4, "a b", ["b a", "a b"]), (5, "x x y", ["x x z z"])], "query_id long, prediction string, references array<string>")
    got = {r.query_id: r for r in metrics.answer_metrics(df, X.plain_answer).collect()}
    assert got[1].f1 == 0.5 and got[2].nonanswer and got[2].f1 == 0 and got[3].f1 == 1 and got[4].em == 1 and got[5].f1 == round(4 / 7, 9)
    two = {r.query_id: r for r in metrics.lexical_metrics(df.where("query_id <> 3").withColumn("language", F.lit("en"))).collect()}
    assert (two[2].em, two[2].f1, two[2].nonanswer) == (0, 0, True) and two[4].em == 1 and two[1].f1 == 0.5
    with pytest.raises(Exception, match="must not be empty"):
        metrics.lexical_metrics(df.withColumn("language", F.lit("en"))).collect()


def test_holders(spark):
    texts = ["zero one two three four", "one  two three", "xone two threex one two three", None, "hm"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one two three"), (2, "hm"), (3, "e t"), (4, "no such words")], "query_id long, question string")
    got = lexical.holders(docs, F.col("text"), asked, F.col("question")).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == sorted((q, i) for q, a in ((1, "one two three"), (2, "hm"), (3, "e t"), (4, "no such words")) for i, t in enumerate(texts) if t and a in t)


def test_word_errors():
    assert metrics.word_errors("a b c".split(), "a x c d".split()) == (2, 1, 0, 1)
    assert metrics.word_errors([], ["a"]) == (1, 0, 0, 1) and metrics.word_errors(["a"], []) == (1, 0, 1, 0)


def test_bootstrap_golden(spark):
    left = spark.createDataFrame([("k", 0.25), ("l", 0.5), ("m", 0.5), ("n", 1.0)], "query_id string, value double")
    right = spark.createDataFrame([("k", 0.75), ("l", 1.0), ("m", 0.5), ("n", 0.25)], "query_id string, value double")
    d = stats.paired(left, right)
    s = stats.paired_summary(d).first()
    assert (s.wins, s.losses, s.ties, s.mean_difference) == (2, 1, 1, 0.0625)
    groups = d.withColumn("cluster", F.when(F.col("query_id") < "m", "up").otherwise("down"))
    b = stats.bootstrap(stats.cluster_totals(groups, "cluster"), samples=500, seed=7).first()
    # draws are both up, both down, or one of each: 0.5, -0.375 or the mean
    assert (b.low, b.high, b.clusters) == (-0.375, 0.5, 2) and np.isclose(b.mean, 0.0625)
    same = stats.paired(left, right, frozen=left.select("query_id"))
    assert same.count() == 4
    with pytest.raises(Exception, match="query set"):
        stats.paired(left, right.where("query_id <> 'k'"), frozen=left.select("query_id")).collect()


def test_dominance_boundary(spark):
    at = lambda *n: stats.dominance(spark.createDataFrame([(x,) for x in n], "n long")).first().eligible
    assert at(2, 1, 1) and not at(3, 1) and not at(4)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 9), (1, 2), (7, 7)], "a long, b long")
    assert sorted(rows(graph.components(links), "node", "root")) == [(1, 1), (2, 1), (4, 4), (5, 4), (9, 4)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in graph.components(chain).collect()} == {0}
    assert graph.components(chain.limit(0)).count() == 0


def test_nearest_in_time(spark):
    points = spark.createDataFrame([("u", "2024-01-01 10:00:00", 1), ("u", "2024-01-01 14:00:00", 2)], "u string, t string, point_id long").withColumn("t", F.to_timestamp("t"))
    grid = spark.createDataFrame([("u", "2024-01-01 12:00:00"), ("u", "2024-01-01 13:00:00"), ("v", "2024-01-01 12:00:00")], "u string, t string").withColumn("t", F.to_timestamp("t"))
    got = rows(relations.nearest_in_time(grid, points, "u", "t").orderBy("u", "t"), "u", "point_id")
    assert got == [("u", 1), ("u", 2), ("v", None)]


def test_round_robin_and_split(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2 if i < 4 else 0]) for i in range(6)], "id long, s string")
    got = relations.round_robin(df, ["s"], F.col("id"), 4).orderBy("place")
    assert rows(got, "id", "place") == [(0, 1), (1, 2), (2, 3), (3, 4)]
    groups = spark.createDataFrame([(str(i), 10) for i in range(10)], "group_id string, n long")
    assert relations.greedy_split(groups, 25, 1).where("chosen").count() in (2, 3)


def test_audits(spark):
    seg = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 0, 4), (2, 5, 9)], "doc_id long, start int, stop int")
    size = spark.createDataFrame([(1, 9), (2, 9), (3, 0), (4, 3)], "doc_id long, length int")
    assert sorted(rows(audit.tiling(seg, size), "doc_id", "tiles")) == [(1, True), (2, False), (3, True), (4, False)]
    v = spark.createDataFrame([(1, "a", {"a": 0.7, "b": 0.3}), (2, "a", {"a": 0.3, "b": 0.7}), (3, "x", {"a": 1.0}), (4, "a", {"a": 0.5, "b": 0.3}), (5, "a", {"a": 1.5})], "task_id long, choice string, probabilities map<string,double>")
    assert sorted(rows(audit.verdict_problems(v, ["a", "b"]), "task_id", "reason")) == [(1, None), (2, "choice"), (3, "label"), (4, "sum"), (5, "probability")]
    runs = [audit.longest_run(F.array(*map(F.lit, t.split())).cast("array<string>")) for t in ("a a b b b a", "", "x", "q q")]
    assert [one(spark, r) for r in runs] == [3, 0, 1, 2]


def test_registry(spark):
    assert experiments.subsets(spark).count() == 321 and experiments.families(spark).count() == 1284


def test_rerank_ties(spark):
    lists = spark.createDataFrame([("q", "s", 1), ("q", "r", 2), ("q", "t", 3)], "query_id string, doc_id string, rank int")
    scores = spark.createDataFrame([("q", "r", 0.5), ("q", "s", 0.5), ("q", "t", 0.75)], "query_id string, doc_id string, new_score double")
    assert rows(ranking.rerank(lists, scores).orderBy("rank"), "doc_id") == [("t",), ("r",), ("s",)]
    assert rows(ranking.rerank(lists, scores, "rank").orderBy("rank"), "doc_id") == [("t",), ("s",), ("r",)]
    assert rows(ranking.rerank(lists, scores, threshold=0.6), "doc_id") == [("t",)]
    for bad in (scores.where("doc_id <> 'r'"), scores.withColumn("new_score", F.lit(float("nan")))):
        with pytest.raises(Exception, match="no score for q"):
            ranking.rerank(lists, bad).collect()
    cells = lists.select(F.lit("c").alias("cell"), "query_id", "doc_id")
    with pytest.raises(Exception, match="no score for q"):
        ranking.scatter(cells, scores.where("doc_id <> 'r'").withColumnRenamed("new_score", "score")).collect()


def test_every_cell(spark):
    """All sets of channels and budgets in one pass are the same as one after the other."""
    data = [(q, c, i + 1, d, 1.0 - i / 10) for q in "xy" for c, ds in (("B", "abcd"), ("G", "abde"), ("E", "baef")) for i, d in enumerate(ds)]
    lists = spark.createDataFrame(data, "query_id string, channel string, rank int, doc_id string, score double")
    got = ranking.every_cell(lists, ["B", "G", "E"], 4, [2, 3])
    for chosen in ranking.subsets(["B", "G", "E"]):
        for mode in ("per_channel", "total"):
            want = rows(ranking.fuse_channels(lists, chosen, mode, 4).where("rank <= 3").orderBy("query_id", "rank"), "query_id", "doc_id", "rank")
            assert rows(got.where(F.col("cell") == f"{''.join(chosen)}-{mode}-k3").orderBy("query_id", "rank"), "query_id", "doc_id", "rank") == want
    assert got.select("cell").distinct().count() == 28 and got.where("cell LIKE '%-k2'").agg(F.max("rank")).first()[0] == 2


def test_code_columns(spark):
    from rankloom.functions import code

    source = 'def f(x):\n    """what it does"""\n    y = "# kept"  # why\n    # alone\n    return y\n'
    assert code.without_comments(source) == 'def f(x):\n    pass\n    y = "# kept"\n    return y'
    assert code.without_comments("def g(): 'only this'") == "def g(): pass" and code.without_comments("x = (") is None
    compile(code.without_comments('class A:\n    "é"\n    def m(self):\n        "d"; return 1\n'), "s", "exec")
    count = lambda s: len(s.split())
    text = "a b c\r\n" * 30 + "x" * 50
    parts = code.cut(text, 40, 5, count)
    assert "".join(text[a:b] for a, b in parts) == text and all(count(text[a:b]) <= 5 for a, b in parts)
    assert code.cut("one two\nthree " * 9, 20, 100, count, hard=False) == [(0, 126)] and len(code.cut("one two\nthree " * 9, 20, 100, count)) > 1
    # halved ranges go back to a line end: 32 characters of four lines have 8 words, 16 have two lines
    assert code.cut("aa bb c\n" * 8, 32, 7, count)[0] == (0, 16)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id for r in code.segments(df).collect()} == {1}


def test_models_and_bound_vectors(spark):
    from rankloom.operators import models
    from rankloom.plans.extra_queries import LetterEncoder, SizeScorer

    class Broken(LetterEncoder):
        def encode(self, texts, role):
            return super().encode(texts, role)[:, :3]

    docs = spark.createDataFrame([(1, "aae"), (2, None), (3, "io")], "doc_id long, text string")
    assert {(r.doc_id, tuple(r.v)) for r in models.encoded(docs, "doc_id", "text", LetterEncoder, "document").collect()} == {(1, (2, 1, 0, 0)), (2, (0, 0, 0, 0)), (3, (0, 0, 1, 1))}
    with pytest.raises(Exception, match="letters gave"):
        models.encoded(docs, "doc_id", "text", Broken, "document").collect()
    pairs = spark.createDataFrame([(1, 1, "ab", "abc"), (1, 2, "ab", "abc"), (2, 1, "abcd", "x")], "query_id long, doc_id long, query string, text string")
    key = pairs.where("query_id = 2").select(F.sha2(F.to_json(F.struct("query", "text")), 256).alias("key"), F.lit(9.0).alias("new_score"))
    assert sorted(rows(models.pointwise(pairs, SizeScorer, key), "query_id", "doc_id", "new_score")) == [(1, 1, -1.0), (1, 2, -1.0), (2, 1, 9.0)]
    with pytest.raises(Exception, match="2 candidates"):
        models.listwise(pairs.withColumn("rank", F.col("doc_id")), SizeScorer, most=1).collect()
    got = models.direct(lambda d, q: d.join(q).select("query_id", "doc_id", F.length("text").cast("double").alias("score")), docs.fillna(""), pairs.select("query_id").distinct(), 1, pairs.where("query_id = 1").select("query_id", "doc_id"))
    assert sorted(rows(got, "query_id", "doc_id")) == [(1, 3), (2, 1)]
    items = spark.createDataFrame([(1,), (2,)], "id long")
    vectors = spark.createDataFrame([(1, [0.5], "d"), (2, [1.0], "d")], "id long, v array<double>, dataset string")
    assert models.bound(vectors, items, "d").count() == 2
    for bad in (vectors.where("id = 1"), vectors.withColumn("id", F.col("id") + 1)):
        with pytest.raises(Exception, match="this dataset"):
            models.bound(bad, items, "d").collect()
    with pytest.raises(Exception, match="this dataset"):
        models.bound(vectors, items, "e").collect()
    states = spark.createDataFrame([(1, 5, [1.0, 2.0]), (1, 5, [3.0, 0.0]), (1, 6, [-9.0, 0.0]), (1, 0, [9.0, 9.0])], "id long, token long, h array<double>")
    assert rows(models.projected(states, [1.0, 0.5], -1.0, [0, 1, 2, 3]), "token", "weight") == [(5, 2.0)]


def test_source_links_and_contrasts(spark):
    from rankloom.operators import analysis

    queries = spark.createDataFrame([(1, "g", 7), (2, "g", 8), (3, "h", 7)], "query_id long, group_id string, reference_id long")
    corpus = spark.createDataFrame([(10, "g", 1), (11, "g", 1), (12, "h", None)], "doc_id long, group_id string, source_id long")
    qrels = spark.createDataFrame([(1, 10, 1.0), (2, 11, 1.0), (3, 12, 2.0)], "query_id long, doc_id long, relevance double")
    group = lambda s: dict(rows(analysis.source_groups(analysis.source_links(s, queries, corpus, qrels)), "query_id", "group"))
    assert group("media") == {1: 1, 2: 2, 3: 3} and group("transcript") == {1: 1, 2: 1, 3: 3} and group("reference_and_target") == {1: 1, 2: 2, 3: 1}
    with pytest.raises(Exception, match="no document of query 3"):
        group("document")
    with pytest.raises(Exception, match="no positive of query 3"):
        analysis.source_links("media", queries, corpus, qrels.where("query_id < 3")).collect()
    with pytest.raises(ValueError):
        analysis.source_links("none", queries, corpus, qrels)
    links = analysis.source_links("media", queries, corpus, qrels)
    assert analysis.group_links(links).first().asDict() == {"queries": 3, "sources": 3, "associations": 3}
    values = spark.createDataFrame([("code__b__none", q, "p", q / 4) for q in (1, 2, 3)] + [("code__g__none", q, "p", 0.5) for q in (1, 2, 3)], "variant string, query_id long, metric string, value double")
    d = analysis.contrasts(values, "code", queries)
    assert sorted(rows(d, "contrast", "query_id", "difference")) == [("b-g", 1, 0.25), ("b-g", 2, 0.0), ("b-g", 3, -0.25)]
    s = analysis.contrast_summary(d, queries.select("query_id", F.col("query_id").alias("group")), samples=100).first()
    assert (s.n, s.wins, s.losses, s.ties, s.clusters, s.eligible) == (3, 1, 1, 1, 3, True) and s.low < 0 < s.high
    alone = analysis.contrast_summary(d, queries.select("query_id", F.lit(1).alias("group"))).first()
    assert not alone.eligible and alone.low is None
    with pytest.raises(Exception, match="frozen query set"):
        analysis.contrasts(values, "code", queries.where("query_id < 3")).collect()
    assert analysis.contrasts(values, "video", queries).count() == 0


def test_percentiles_and_places(spark):
    rnd = np.random.default_rng(9)
    data = [(None if i % 9 == 0 else int(rnd.integers(0, 3)), None if i % 7 == 0 else float(rnd.integers(0, 40)) / 4) for i in range(400)] + [(7, None), (8, 2.5)]
    df = spark.createDataFrame(data, "g long, v double").repartition(5)
    got = {r.g: (r.n, r.p50, r.p95) for r in stats.distribution(df, "v", ["g"]).collect()}
    for g in {g for g, _ in data}:
        v = [x for h, x in data if h == g and x is not None]
        want = (len(v), round(float(np.percentile(v, 50)), 6), round(float(np.percentile(v, 95)), 6)) if v else (0, None, None)
        assert got[g] == want
    places = relations.numbered(spark.range(1000).withColumn("k", F.col("id") % 10).repartition(7), ["k", "id"]).collect()
    assert [(r.k, r.id) for r in sorted(places, key=lambda r: r.place)] == [(k, i) for k in range(10) for i in range(k, 1000, 10)] and {r.place for r in places} == set(range(1, 1001))
    assert relations.numbered(spark.range(0), ["id"]).count() == 0


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from rankloom.plans.tables import shared_dir

    unset = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(cluster)
