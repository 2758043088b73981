"""Sources, sinks and streams on small files."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rankloom.sources import readers, writers
from rankloom.streaming import states


def test_articles(spark, tmp_path):
    a = {"article": {"id": "31", "title": "Bees", "url": "https://sv.wikipedia.org/bi", "lang": "sv"}, "chunks": [{"id": "p2", "content": "wings", "start_char": 4, "end_char": 9}], "questions": {"items": [{"question": "how many?", "answer": "four", "category": "count", "related_chunk_ids": ["gone", "p2"]}], "total_questions": 1}}
    (tmp_path / "a.json").write_text("\ufeff" + json.dumps(a), encoding="utf-8")
    rows = readers.articles(spark, str(tmp_path))
    assert readers.article_chunks(rows).first().asDict() == {"id": "wikipedia:31#p2", "text": "wings", "title": "Bees", "article_id": "31", "source": "wikipedia"}
    q = readers.article_questions(rows).first()
    assert (q.id, q.gold_ids, q.missing) == ("wikipedia:31#q0000", ["wikipedia:31#p2"], ["gone"])


def test_markdown_spans_and_tables(spark, tmp_path):
    (tmp_path / "m.md").write_text('\ufeff---\ntitle: "Two\\tparts"\nurl: \'http://m\'\nchar_count: 12\n---\nleft | right', encoding="utf-8")
    m = readers.markdown(spark, str(tmp_path))
    r = m.first()
    assert (r.title, r.url, r.char_count, r.body) == ("Two\tparts", "http://m", 12, "left | right")
    spans = [(0, 4, 4), (7, 12, 5), (7, 30, 23), (0, 4, 3), (3, 3, 0)]
    ranges = m.select("path", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(n).alias("length")) for a, b, n in spans])).alias("r")).select("path", "r.*")
    ranges = ranges.unionByName(spark.createDataFrame([("elsewhere", 0, 1, 1)], ranges.schema))
    got = readers.spans(m, ranges)
    assert {(x.start, x.stop, x.text, x.reason) for x in got.collect()} == {(0, 4, "left", None), (7, 12, "right", None), (7, 30, None, "out of range"), (0, 4, None, "other length"), (3, 3, None, "out of range"), (0, 1, None, "no body")}
    bad = readers.count_mismatches(got, m.select("path", F.lit(3).alias("chunks"))).collect()
    assert [(x.chunks, x.found) for x in bad] == [(3, 2)] and readers.count_mismatches(got, m.select("path", F.lit(2).alias("chunks"))).count() == 0


def test_gzip_config_manifest_and_packing(spark, tmp_path):
    (tmp_path / "gz").mkdir()
    (tmp_path / "gz/one.txt.gz").write_bytes(gzip.compress(b"plain"))
    assert [(r.member, bytes(r.content)) for r in readers.members(spark, str(tmp_path / "gz")).collect()] == [("one.txt", b"plain")]
    (tmp_path / "c.toml").write_text('corpus = "data/x"\ncandidates = 60\ncontext_k = 4\n')
    c = readers.config(str(tmp_path / "c.toml"))
    assert c.corpus == str(tmp_path / "data/x") and (c.candidates, c.context_k, c.seed) == (60, 4, 42)
    for bad in ('{"corpus": "x", "candidates": 49}', '{"corpus": "x", "context_k": 0}', '{"corpus": "x", "other": 1}'):
        (tmp_path / "c.json").write_text(bad)
        with pytest.raises(ValueError):
            readers.config(str(tmp_path / "c.json"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/corpus.jsonl").write_text("{}\n")
    (tmp_path / "d/new.txt").write_text("x")
    manifest = spark.createDataFrame([("corpus.jsonl", "0" * 64), ("lost", "1" * 64)], "name string, sha256 string")
    assert {(r.name, r.reason) for r in readers.manifest_problems(spark, str(tmp_path / "d"), manifest).collect()} == {("corpus.jsonl", "changed"), ("lost", "missing"), ("new.txt", "not listed")}
    with pytest.raises(ValueError):
        readers.verified(spark, str(tmp_path / "d"), manifest)
    files = spark.createDataFrame([("b/2", bytearray(b"two")), ("a", bytearray(b""))], "path string, content binary")
    digest = writers.packed(files, str(tmp_path), "t")
    assert digest == writers.packed(files.orderBy("path"), str(tmp_path), "u")
    tar = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r.path, bytes(r.content)) for r in writers.unpacked(tar).collect()) == [("a", b""), ("b/2", b"two")]
    broken = tar.select(F.unhex(F.replace(F.hex("content"), F.hex(F.lit("two")), F.hex(F.lit("owt")))).alias("content"))
    with pytest.raises(Exception, match="inventory"):
        writers.unpacked(broken).collect()


def test_converters(spark):
    rows = spark.createDataFrame([("m1", "x.jpg", ["a cat", "one cat"])], "id string, media string, captions array<string>")
    got = readers.joined_captions(rows, 2)
    assert [(r.query_id, r.corpus_id) for r in got["qrels"].orderBy("query_id").collect()] == [("m1#0", "m1"), ("m1#1", "m1")]
    with pytest.raises(Exception, match="captions of m1"):
        readers.joined_captions(rows, 5)["queries"].collect()
    made = readers.composed(spark.createDataFrame([("q", "r", "redder", ["t", "t"])], "id string, reference string, change string, targets array<string>"))
    assert made["qrels"].count() == 1 and made["exclusions"].first().corpus_id == "r"
    code = readers.code_pairs(spark.createDataFrame([("f", 'def f():\n    "adds"\n    return 1', "adds"), ("g", "def (", "x"), ("h", "x = 1", " ")], "id string, code string, docstring string"))
    assert [(r.id, r.text) for r in code["corpus"].collect()] == [("f", "def f():\n    pass\n    return 1")] and code["qrels"].count() == 1
    sealed = spark.createDataFrame([(16, [[f"{q}{m}"] for q in "ab" for m in range(5)])], "first_query long, rankings array<array<string>>")
    assert {(r["query"], r.method, r.ids[0]) for r in readers.positional(sealed).collect()} >= {(16, 0, "a0"), (17, 4, "b4")}


def test_delimited_projected_members(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"x,y"\n')
    (tmp_path / "x.tsv").write_text('1\t"q\n')
    assert readers.delimited(spark, str(tmp_path / "x.csv"), "a int, b string").first().b == "x,y"
    assert readers.delimited(spark, str(tmp_path / "x.tsv"), "a int, b string", tabs=True).first().b == '"q'
    spark.range(2).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        readers.projected(spark, str(tmp_path / "p"), ["id", "other"])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.txt", "hi")
    assert readers.members(spark, str(tmp_path / "z.zip")).first().member == "d/a.txt"


def test_bundle(spark, tmp_path):
    for name, lines in {"corpus": [{"id": "a", "text": "x"}], "queries": [{"id": "q", "text": "y"}], "qrels": [{"query_id": "q", "corpus_id": "a", "relevance": 2.0}]}.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    assert readers.bundle(spark, str(tmp_path))["qrels"].count() == 1
    (tmp_path / "qrels.jsonl").write_text(json.dumps({"query_id": "q", "corpus_id": "zz", "relevance": 2.0}))
    with pytest.raises(ValueError):
        readers.bundle(spark, str(tmp_path))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "k int, label string, value double")
    assert "| 2 | b | — |" in writers.report(df, "R")
    writers.store(df, str(tmp_path / "s"), ["k"])
    with pytest.raises(ValueError):
        writers.store(df, str(tmp_path / "s"), ["k"])
    writers.store(df.where("k = 1").withColumn("label", F.lit("z")), str(tmp_path / "s"), ["k"], replace=True)
    assert sorted(r.label for r in writers.current(spark, str(tmp_path / "s")).collect()) == ["b", "z"]
    (tmp_path / "s/v9").mkdir()  # what a crash leaves: a version that isn't whole
    assert sorted(r.label for r in writers.current(spark, str(tmp_path / "s")).collect()) == ["b", "z"]
    writers.store(df.where("k = 2").withColumn("k", F.lit(3)), str(tmp_path / "s"), ["k"])
    assert sorted(r.k for r in writers.current(spark, str(tmp_path / "s")).collect()) == [1, 2, 3]
    parts = writers.blobs(spark.createDataFrame([(bytearray(b"abcde"),), (bytearray(b"abcde"),)], "content binary"), 2).orderBy("ordinal").collect()
    assert [bytes(r.bytes) for r in parts] == [b"ab", b"cd", b"e"]
    assert writers.public(df, ["label"], ["value"]).count() == 2
    with pytest.raises(Exception, match="unsafe"):
        writers.public(df.withColumn("label", F.lit("free text?!")), ["label"], []).collect()
    for n in (300, 600, 600):
        writers.vector_blocks(spark.range(n).withColumnRenamed("id", "ordinal"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 600
    assert spark.read.parquet(str(tmp_path / "v")).select("block").distinct().count() == 3
    writers.jsonl(df, str(tmp_path / "j"))
    assert readers.jsonl(spark, str(tmp_path / "j"), "k int, label string, value double").count() == 2


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, state string").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k int, t int, state string").parquet(str(tmp_path / "in"))
    q = states.latest_states(stream(), "k", "t", "state").writeStream.format("memory").queryName("last").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("last").select("k", "state", "n_events").collect()) == [(1, "b", 2), (2, "c", 1)]
    for i in range(2):
        states.settle_once(stream(), str(tmp_path / "done"), ["k"], lambda d: d.select("k"), str(tmp_path / f"c{i}")).awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "done")).collect()) == [1, 2]
