"""Session settings the engine relies on, and the size check behind broadcasts."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "rapport", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``conf`` adds or overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(prepare(builder.getOrCreate()))


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the Python workers, which do not look where the driver found it."""
    package = Path(__file__).resolve().parent
    if package.name not in (Path(f).stem for f in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='spark-package-')}/{package.name}", "zip", package.parent, package.name))
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the one setting results depend on: timestamps are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder. Only a local session without one gets
    a temporary folder; a cluster without it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` holds no more than ``rows`` rows (reads at most rows + 1)."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """Give a bare scan at least one partition per core before heavy per-row work.

    A scan that already has enough partitions (any table of more than a few
    files or row groups) comes back unchanged, so large tables are never
    shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
