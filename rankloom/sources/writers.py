"""Sinks: JSON lines, CSV matrix, Markdown report, keyed store, vector blocks, content-addressed blobs, public export."""

from __future__ import annotations

import hashlib
import io
import json
import re
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators.relations import upsert

#: The columns of a published matrix, in order.
MATRIX = ["variant_id", "budget", "candidates", "status", "metric", "value"]


def jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; the commit protocol makes the folder appear whole or not."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def matrix(df: DataFrame, path: str) -> None:
    """A report-sized CSV of fixed columns in one file."""
    df.select(*MATRIX).orderBy(*MATRIX[:3], "metric").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A summary table as Markdown, missing values as a dash. Summaries are small; more than `most` rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    show = lambda v: "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(lines + [f"| {' | '.join(map(show, r))} |" for r in rows]) + "\n"


def _files(spark, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def current(spark, path: str) -> DataFrame | None:
    """The rows of the newest whole version of a keyed store; None before the first."""
    files, at = _files(spark, path)
    versions = [int(f.getPath().getName()[1:]) for f in (files.listStatus(at) if files.exists(at) else []) if re.fullmatch(r"v\d+", f.getPath().getName()) and files.exists(_files(spark, f"{f.getPath()}/_SUCCESS")[1])]
    return spark.read.parquet(f"{path}/v{max(versions)}") if versions else None


def store(df: DataFrame, path: str, keys: list[str], replace: bool = False) -> None:
    """Adds rows to a keyed Parquet store: rows with stored keys raise, or replace them. Every call writes a version beside the others, which counts once it is
    whole, so that a crash loses nothing; versions before the last are deleted afterwards."""
    spark, old = df.sparkSession, current(df.sparkSession, path)
    if df.groupBy(*keys).count().where("count > 1").take(1):
        raise ValueError("keys are given more than once")
    if old is not None and not replace and old.join(df, keys, "left_semi").take(1):
        raise ValueError("keys are stored already")
    files, at = _files(spark, path)
    number = max([int(f.getPath().getName()[1:]) for f in (files.listStatus(at) if files.exists(at) else []) if re.fullmatch(r"v\d+", f.getPath().getName())], default=0)
    whole = df if old is None else upsert(old, df.select(*old.columns), keys)
    whole.write.parquet(f"{path}/v{number + 1}")
    for i in range(1, number):
        files.delete(_files(spark, f"{path}/v{i}")[1], True)


def vector_blocks(df: DataFrame, path: str, rows: int = 256) -> None:
    """Vectors in blocks by ordinal, added to what is there: a resumed run writes the missing ordinals only."""
    spark = df.sparkSession
    files, at = _files(spark, path)
    if files.exists(at) and files.globStatus(_files(spark, f"{path}/block=*")[1]):
        df = df.join(spark.read.parquet(path).select("ordinal"), "ordinal", "left_anti")
    df.withColumn("block", F.floor(F.col("ordinal") / rows)).write.mode("append").partitionBy("block").parquet(path)


def jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    """Rows into a database table; each task's rows are one transaction."""
    df.write.mode(mode).options(**options).jdbc(url, name)


def ordered(df: DataFrame, path: str, keys: list[str]) -> None:
    """JSON lines in order of keys over all files: file names and lines sort alike."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def packed(files: DataFrame, folder: str, name: str) -> str:
    """A tar of (path, content) rows with an inventory of hashes, the same bytes for the same files. For bundles that fit a machine; returns its sha256."""
    rows = sorted((r.path, bytes(r.content)) for r in files.select("path", "content").collect())
    if bad := [p for p, _ in rows if p.startswith("/") or "\\" in p or ".." in p.split("/")]:
        raise ValueError(f"unsafe paths {bad[:3]}")
    inventory = json.dumps({p: hashlib.sha256(c).hexdigest() for p, c in rows}, sort_keys=True).encode()
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for path, content in [("inventory.json", inventory), *rows]:
            info = tarfile.TarInfo(path)
            info.size, info.mode = len(content), 0o644
            t.addfile(info, io.BytesIO(content))
    one = files.sparkSession.createDataFrame([(out.getvalue(),)], "content binary")
    digest = hashlib.sha256(out.getvalue()).hexdigest()
    one.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
    return digest


def unpacked(files: DataFrame) -> DataFrame:
    """(path, content) of tars in a column `content`; a file whose hash isn't the inventory's raises."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                    held = {i.name: t.extractfile(i).read() for i in t if i.isfile()}
                inventory = json.loads(held.pop("inventory.json"))
                if {p: hashlib.sha256(c).hexdigest() for p, c in held.items()} != inventory:
                    raise ValueError("files differ from the inventory")
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.binary())], ["path", "content"])

    return files.select("content").mapInArrow(run, "path string, content binary")


def blobs(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """(sha256, ordinal, bytes) of distinct contents, in pieces."""
    one = df.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    count = F.greatest(F.ceil(F.octet_length("content") / size).cast("int"), F.lit(1))
    return one.select("sha256", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("ordinal")).select("sha256", "ordinal", F.substring("content", F.col("ordinal") * size + 1, F.lit(size)).alias("bytes"))


def public(df: DataFrame, labels: list[str], numbers: list[str]) -> DataFrame:
    """Allow-listed columns only; a label that isn't a plain identifier or a number that isn't finite raises when it is read."""
    return df.select(
        *[F.when(X.safe_label(F.col(c)), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"unsafe {c}: "), F.coalesce(F.col(c), F.lit("null"))))).alias(c) for c in labels],
        *[F.when(F.col(c).isNull() | X.finite(F.col(c).cast("double")), F.col(c)).otherwise(F.raise_error(F.lit(f"not finite: {c}"))).alias(c) for c in numbers],
    )


def run_report(cells: DataFrame) -> DataFrame:
    """The completed primary cells of (run, variant, status, primary, n, value), in order: what a report may show."""
    return cells.where((F.col("status") == "completed") & F.col("primary")).select("run", "variant", "n", "value").orderBy("run", "variant")


def run_index(cells: DataFrame) -> DataFrame:
    """One row per run: cells by status and completed primaries; nothing is pooled."""
    return cells.groupBy("run").agg(F.count("*").alias("cells"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if((F.col("status") == "completed") & F.col("primary")).alias("primaries"))
