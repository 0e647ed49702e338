"""Session construction and the few cluster settings operators depend on."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "docketspark", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's own settings win."""
    cpus = cpus or os.cpu_count() or 4
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; make a local one only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="docketspark-ckpt-")
        atexit.register(shutil.rmtree, shared, True)
    sc.setCheckpointDir(shared)


_made: list[tuple] = []  # (file system, path) of the tables written by cut()


def scratch(spark: SparkSession, kind: str = "cut") -> str:
    """A new path in the shared checkpoint folder; deleted by release(), or when the driver's JVM ends."""
    ensure_checkpoint_dir(spark)
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(f"{sc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(sc.hadoopConfiguration())
    fs.deleteOnExit(path)
    _made.append((fs, path))
    return path.toString()


def release() -> None:
    """Delete everything written by cut() so far; frames that still read it must be done with."""
    while _made:
        fs, path = _made.pop()
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """Write a frame as a table in the shared checkpoint folder and read it back.

    Lost executors re-read the files; the plan above starts from a scan with true sizes, so
    the planner's estimates do not compound over the rounds of an iterative operator.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_in_order(df: DataFrame) -> DataFrame:
    """checkpoint(): as cut(), but partitions and their row order stay as they are."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_parallelism(spark: SparkSession) -> int:
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


_SHUFFLES = re.compile(r"\b(?:Aggregate|Join|Sort|Window|Distinct|Deduplicate|Intersect|Except|Repartition\w*|Rebalance\w*|GlobalLimit|FlatMap\w*Groups\w*|CoGroup\w*)\b")


def spread(df: DataFrame, least: int = 32 << 10) -> DataFrame:
    """``df`` in as many partitions as there are cores, where its files give fewer; for scans before costly row-wise work.

    A small file of one row group is one task whatever its work.  Frames of enough partitions, as all large
    tables are, stay as they are; no partition is made for less than ``least`` bytes of input.  Frames that shuffle
    are left alone, as counting their partitions would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    run = df._jdf.queryExecution()
    if _SHUFFLES.search(run.optimizedPlan().toString()):
        return df
    want = min(cores, int(str(run.optimizedPlan().stats().sizeInBytes())) // least)
    return df.repartition(want) if want > 1 and run.toRdd().getNumPartitions() < want else df
