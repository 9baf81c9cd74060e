"""The session that tests and the benchmark use; on a cluster the caller brings its own."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension table may be broadcast.
SMALL_ROWS = 10_000


def build(cores: int | str = "*", app: str = "corvane", memory: str = "12g", **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution, right-biased map merges, shuffle partitions as many as cores."""
    n = str(cores) if str(cores) != "*" else "8"
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": n,
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key if its files give fewer partitions than there are cores: a small table in one file.

    A table large enough to fill the cores is left as it is, so nothing large is ever shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate results, spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on a cluster, whose machines share no such folder, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corvane-ckpt-"))
    return sc.getCheckpointDir()


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
