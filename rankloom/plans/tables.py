"""Input tables, the folder that a cluster shares, and written tables that cut lineage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_collected = 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan over as many tasks as there are cores, where it has fewer: a small table in one file would be one task's work. Larger tables stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where all run on one machine, one is made where it
    is unset; on a cluster that is an error, as each machine would write to a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='rankloom-')}"
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def settle(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there, and a lost executor loses none of it."""
    global _collected
    spark = df.sparkSession
    if time.monotonic() - _collected > 2:  # seldom where tables are small and many
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # Spark's cleaner then drops the shuffle files of earlier plans that nothing refers to
        _collected = time.monotonic()
    at = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.settled_at = at
    return out


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.settled_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
