"""Session helpers: reliable checkpoints, table loading, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a frame may have to be broadcast or handled by one task; beyond it every operator takes a shuffled way.
ONE_TASK_ROWS = 1_000_000
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names; set for the context at first use.

    Where spark.checkpoint.dir is unset and the master is local, a temporary folder is used until the
    process ends; a cluster without the setting is an error, since a machine's own folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master or "").startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint; the partitions keep their number and order."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def round_checkpoint(df: DataFrame) -> DataFrame:
    """A written table for loops that join a frame with itself; partitions are not kept.

    A checkpoint keeps the size estimate of its plan, and that of a join is the product of its sides: in
    such a loop its digits would double each round, and planning soon take longer than the work. A table
    has the size of its files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a frame whose row count was measured; beyond the limit the join is left to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def session(app: str = "graphloom", cpus: str | int | None = None) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
