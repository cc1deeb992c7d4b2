"""Session helpers shared by the entry point, the benchmark and the tests."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "strandloom", cores: str | None = None, partitions: int = 8) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STRANDLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def measured_broadcasts(spark: SparkSession) -> None:
    """From now on, joins of this session broadcast what was measured to be small, not what was estimated to be.

    Spark's estimate is the size of the files read, whatever strings and windows are made of their rows, so that a few MB of keys can stand for GB that the driver
    would have to hold. The session's own limit goes on to hold for sizes measured after a shuffle; broadcasts that are asked for stay.
    """
    estimated, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if (limit := spark.conf.get(estimated)) != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, limit)
        spark.conf.set(estimated, "-1")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder, so that a lost executor costs a reread and not the whole loop."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later reads neither repeat the work nor need the executors that did it."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession, pause: float = 0.4) -> None:
    """Lets Spark remove the shuffles of frames that are no longer held, once after a large step: one collection frees their plans, a second one the shuffles behind them."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


class Scratch:
    """Named tables of a loop in the shared folder.

    A table that takes the name of an older one replaces it, so disk holds one of each name. Shuffle files of
    finished jobs are let go as well: Spark removes them once the driver collects its garbage, which is done twice a second at most.
    """

    EVERY, last = 0.5, 0.0

    def __init__(self, spark: SparkSession, title: str):
        self.spark, self.title, self.paths = spark, title, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, f"{self.title}-{name}")
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for name in names:
            if name in self.paths:
                path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
        if time.monotonic() - Scratch.last > self.EVERY:
            gc.collect()
            jvm.System.gc()
            Scratch.last = time.monotonic()

    def keep_only(self, *names: str) -> None:
        self.drop(*(set(self.paths) - set(names)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
