"""Sources: article JSON and Markdown, JSONL, CSV and TSV, projected Parquet, archives, and verified bundles."""

from __future__ import annotations

import dataclasses
import gzip
import hashlib
import io
import json
import os
import tarfile
import tomllib
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as X

CORPUS = "id string, text string, title string, article_id string, source string"
QUESTIONS = "id string, question string, answers array<string>, gold_ids array<string>, article_id string, category string, source string"
ARTICLE = "article struct<id:string,title:string,url:string,lang:string>, chunks array<struct<id:string,content:string,start_char:long,end_char:long>>, questions struct<items:array<struct<question:string,answer:string,category:string,related_chunk_ids:array<string>>>,total_questions:long>"


def articles(spark: SparkSession, path: str) -> DataFrame:
    """One row per article file, UTF-8 with or without a byte-order mark."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.from_json(F.regexp_replace("value", "^﻿", ""), ARTICLE).alias("a")).select("a.*")


def article_chunks(rows: DataFrame) -> DataFrame:
    kind = X.source_kind(F.col("article.url"))
    one = rows.select("article", F.explode("chunks").alias("c"))
    return one.select(X.chunk_id(kind, F.col("article.id"), F.col("c.id")).alias("id"), F.col("c.content").alias("text"), F.col("article.title").alias("title"), F.col("article.id").alias("article_id"), kind.alias("source"))


def article_questions(rows: DataFrame) -> DataFrame:
    """Questions with their local chunk ids turned into global ones; the unresolved stay in `missing`."""
    kind = X.source_kind(F.col("article.url"))
    one = rows.select("article", F.transform("chunks", lambda c: c["id"]).alias("known"), F.posexplode("questions.items").alias("i", "q"))
    ids = lambda c: F.transform(c, lambda x: F.concat(kind, F.lit(":"), F.col("article.id"), F.lit("#"), x))
    return one.select(
        X.question_id(kind, F.col("article.id"), F.col("i")).alias("id"), F.col("q.question").alias("question"), F.array("q.answer").alias("answers"), ids(F.array_intersect("q.related_chunk_ids", "known")).alias("gold_ids"),
        F.col("article.id").alias("article_id"), F.col("q.category").alias("category"), kind.alias("source"), F.array_except("q.related_chunk_ids", "known").alias("missing"),
    )


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, title, url, declared length and body of Markdown articles with front matter, UTF-8 with or without a byte-order mark."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return raw.select("path", *[X.front_matter(F.col("value"), c).alias(c) for c in ("title", "url")], X.front_matter(F.col("value"), "char_count").cast("long").alias("char_count"), X.body(F.col("value")).alias("body"))


def spans(bodies: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunk texts by published character ranges (path, start, stop, and the length published, if there is one); ranges outside their body or of another length come back
    as rejected, with the reason, and so do those without a body."""
    joined = ranges.join(bodies, "path", "left")
    size = F.col("stop") - F.col("start")
    reason = F.coalesce(
        F.when(F.col("body").isNull(), "no body"), F.when(~((F.col("start") >= 0) & (size > 0) & (F.col("stop") <= F.length("body"))), "out of range"),
        F.when(F.col("length") != size, "other length") if "length" in ranges.columns else F.lit(None).cast("string"),
    )
    return joined.select("path", "start", "stop", F.when(reason.isNull(), F.substring("body", F.col("start") + 1, size)).alias("text"), reason.isNotNull().alias("rejected"), reason.alias("reason"))


def count_mismatches(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Paths whose number of chunks isn't the declared one (path, chunks): such articles are rejected whole."""
    per = found.where("NOT rejected").groupBy("path").agg(F.count("*").alias("found"))
    return declared.join(per, "path", "left").where(F.coalesce("found", F.lit(0)) != F.col("chunks")).select("path", "chunks", F.coalesce("found", F.lit(0)).alias("found"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema; blank lines are skipped, broken ones fail."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def projected(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a Parquet table, all of which have to be there."""
    df = spark.read.parquet(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    return df.select(*columns)


def delimited(spark: SparkSession, path: str, schema: str, tabs: bool = False) -> DataFrame:
    """CSV with a header, or TSV without header and quotes; rows of another width fail."""
    options = {"sep": "\t", "quote": "", "header": False} if tabs else {"header": True, "multiLine": True, "escape": '"'}
    return spark.read.schema(schema).options(mode="FAILFAST", **options).csv(path)


def _is_tar(raw: bytes) -> bool:
    return raw[257:262] == b"ustar"


def members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content) of zip, tar, compressed tar and gzip files; unsafe member paths fail."""

    def run(batches):
        for batch in batches:
            for where, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                names, contents = [], []
                if zipfile.is_zipfile(io.BytesIO(raw)):
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for i in z.infolist():
                            if not i.is_dir():
                                names.append(i.filename)
                                contents.append(z.read(i))
                elif raw[:2] == b"\x1f\x8b" and not _is_tar(gzip.decompress(raw)):
                    names.append(where.rstrip("/").rpartition("/")[2].removesuffix(".gz"))
                    contents.append(gzip.decompress(raw))
                else:
                    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                        for i in t:
                            if i.isfile():
                                names.append(i.name)
                                contents.append(t.extractfile(i).read())
                if bad := [n for n in names if n.startswith("/") or "\\" in n or ".." in n.split("/")]:
                    raise ValueError(f"unsafe members {bad[:3]}")
                for lo in range(0, len(names), 64):
                    part = slice(lo, lo + 64)
                    yield pa.RecordBatch.from_arrays([pa.array([where] * len(names[part]), pa.string()), pa.array(names[part], pa.string()), pa.array(contents[part], pa.binary())], ["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, content binary")


def wide_captions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Wide caption columns to rows (id, position, caption), empty ones left out."""
    return rows.select("id", F.posexplode(F.array(*columns)).alias("position", "caption")).where("trim(caption) <> ''")


def bundle(spark: SparkSession, path: str, qrel_schema: str = "query_id string, corpus_id string, relevance double") -> dict[str, DataFrame]:
    """corpus, queries and qrels of a frozen dataset; raises if ids repeat, labels point nowhere or a query has no positive."""
    item = "id string, text string, metadata map<string,string>"
    out = {"corpus": jsonl(spark, f"{path}/corpus.jsonl", item), "queries": jsonl(spark, f"{path}/queries.jsonl", item), "qrels": jsonl(spark, f"{path}/qrels.jsonl", qrel_schema)}
    from rankloom.operators.audit import qrel_violations, repeated_keys

    q = out["qrels"].withColumnRenamed("corpus_id", "doc_id")
    empty = q.select("query_id", "doc_id").limit(0)
    broken = qrel_violations(q, out["queries"].withColumnRenamed("id", "query_id"), out["corpus"].withColumnRenamed("id", "doc_id"), empty).where("n > 0").collect()
    if broken or any(repeated_keys(out[t], ["id"]).take(1) for t in ("corpus", "queries")):
        raise ValueError(f"dataset breaks its rules: {[tuple(r) for r in broken]}")
    return out


@dataclasses.dataclass(frozen=True)
class Config:
    """A run's settings; paths are relative to the file that names them."""

    corpus: str
    candidates: int = 100
    context_k: int = 5
    seed: int = 42

    def __post_init__(self) -> None:
        if self.candidates < 50:
            raise ValueError("candidates must be 50 or more")
        if not 1 <= self.context_k <= self.candidates:
            raise ValueError("context_k must be from 1 to candidates")


def config(path: str) -> Config:
    """A TOML or JSON file as checked settings; unknown names raise."""
    with open(path, "rb") as f:
        raw = json.load(f) if path.endswith(".json") else tomllib.load(f)
    if unknown := set(raw) - {f.name for f in dataclasses.fields(Config)}:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    raw["corpus"] = os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(path)), raw["corpus"]))
    return Config(**raw)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below a folder, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def manifest_problems(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files (name, reason) that differ from a manifest of (name, sha256): changed, missing or not listed. Names are relative to the folder."""
    have = file_hashes(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("_have"))
    both = manifest.join(have, "name", "full_outer")
    reason = F.when(F.col("_have").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when(F.col("sha256") != F.col("_have"), "changed")
    return both.withColumn("reason", reason).where("reason IS NOT NULL").select("name", "reason")


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> dict[str, DataFrame]:
    """The bundle of a folder all of whose files are as the manifest says."""
    if bad := manifest_problems(spark, path, manifest).limit(4).collect():
        raise ValueError(f"files differ from the manifest: {[tuple(r) for r in bad]}")
    return bundle(spark, path)


def jdbc(spark: SparkSession, url: str, name: str, ordinal: str, pages: int, **options: str) -> DataFrame:
    """A database table in `pages` ranges of a numeric column, each read by a task of its own; the bounds come from the table."""
    low, high = spark.read.options(**options).jdbc(url, f"(SELECT min({ordinal}) AS low, max({ordinal}) AS high FROM {name}) AS bounds").first()
    return spark.read.options(**options).jdbc(url, name, column=ordinal, lowerBound=low or 0, upperBound=(high or 0) + 1, numPartitions=pages)


def positional(chunks: DataFrame, methods: int = 5) -> DataFrame:
    """Rankings (query, method, ids) of sealed chunks (first_query, rankings: an array of all methods of each query in turn), keyed by position."""
    one = chunks.select("first_query", F.posexplode("rankings").alias("at", "ids"))
    return one.select((F.col("first_query") + F.floor(F.col("at") / methods)).alias("query"), (F.col("at") % methods).alias("method"), "ids")


def joined_captions(rows: DataFrame, per: int) -> dict[str, DataFrame]:
    """corpus, queries and qrels of media rows (id, media, captions): every caption is a query for its media; ones without `per` captions raise when read."""
    good = F.when(F.size("captions") == per, F.col("captions")).otherwise(F.raise_error(F.concat(F.lit("captions of "), F.col("id"))))
    one = rows.select("id", F.posexplode(good).alias("at", "text"))
    query = F.concat("id", F.lit("#"), F.col("at").cast("string"))
    return {"corpus": rows.select("id", "media"), "queries": one.select(query.alias("id"), "text"), "qrels": one.select(query.alias("query_id"), F.col("id").alias("corpus_id"), F.lit(1.0).alias("relevance"))}


def composed(rows: DataFrame) -> dict[str, DataFrame]:
    """queries, qrels and exclusions of composed retrieval (id, reference, change, targets): the reference never is a result."""
    return {
        "queries": rows.select("id", F.col("change").alias("text"), F.create_map(F.lit("reference_id"), F.col("reference")).alias("metadata")),
        "qrels": rows.select(F.col("id").alias("query_id"), F.explode(F.array_distinct("targets")).alias("corpus_id")).withColumn("relevance", F.lit(1.0)),
        "exclusions": rows.select(F.col("id").alias("query_id"), F.col("reference").alias("corpus_id")),
    }


def code_pairs(rows: DataFrame) -> dict[str, DataFrame]:
    """corpus, queries and qrels of documented functions (id, code, docstring): the docstring asks for the code, which has none left; undocumented and unreadable ones stay out."""
    from rankloom.functions.code import comment_free

    held = rows.select("id", F.trim("docstring").alias("text"), comment_free("code").alias("code")).where("text <> '' AND code IS NOT NULL")
    return {"corpus": held.select("id", F.col("code").alias("text")), "queries": held.select(F.concat(F.lit("q:"), F.col("id")).alias("id"), "text"), "qrels": held.select(F.concat(F.lit("q:"), F.col("id")).alias("query_id"), F.col("id").alias("corpus_id"), F.lit(1.0).alias("relevance"))}
