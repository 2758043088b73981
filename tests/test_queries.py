"""Every registered query that has SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from rankloom.operators import dense, lexical
from rankloom.plans import text_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "~"
    if isinstance(v, (str, bytes)):
        return str(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


def canon(df):
    return sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


OWN = {name: sql for m in entry.MODULES for name, sql in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), duck.sql(OWN[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("questions", [["w1 w2 w2 w7", "w0", None, "", "w3 w4 w5 w6 w9", "nowhere"], [None]])
def test_hybrid_candidates_odd_tables(spark, tmp_path, questions):
    """Ids that are repeated, with equal and other lengths, or null, and texts that are null or empty."""
    rng = np.random.default_rng(3)
    some = lambda n: " ".join(f"w{min(30, int(x))}" for x in rng.exponential(5, n))
    texts = [(i % 140, some(int(rng.integers(0, 15)))) for i in range(170)] + [(3, "w1 w2 w2"), (3, "w2 w1 w1"), (3, "w1"), (None, "w1 w2 w7"), (None, "w0"), (None, "w3 w4"), (99, None), (None, None), (98, "")]
    asked = [(i, q) for i, q in enumerate(questions)] + [(0, "w2 w8"), (None, "w5 w1")] * (len(questions) > 1)
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = entry.queries()["hybrid_candidates"](spark, str(tmp_path)), c.sql(OWN["hybrid_candidates"])
    assert sorted(map(repr, map(tuple, got.select("query_id", "doc_id", "score", "rank").collect()))) == sorted(map(repr, want.fetchall()))


def test_hybrid_candidates_shuffle_no_pairs(spark, sf_dir, monkeypatch):
    """No plan joins the texts' terms with the queries' terms: its rows would be a queries' and texts' product."""
    plans = []
    for module in (text_queries, lexical, dense):
        monkeypatch.setattr(module, "settle", lambda df, settle=module.settle: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    got = entry.queries()["hybrid_candidates"](spark, sf_dir)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sum("MapInArrow" in p for p in plans) == 2 and not any("Join" in p and "doc_id" in p for p in plans[:-1])
    assert "token" not in plans[-1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
