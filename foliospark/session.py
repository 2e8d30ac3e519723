"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench. A cluster brings its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("foliospark")
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh local one only where none is set, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    made = tempfile.mkdtemp(prefix="foliospark-")
    sc.setCheckpointDir(made)
    return made


def cut(df: DataFrame, costly: bool = True) -> DataFrame:
    """Writes the frame to the shared checkpoint folder and returns it with its lineage cut.

    A checkpoint runs the frame once to see it and once to write it, from its last exchange on. Where that is costly, what is kept on disk in
    between spares the second run.
    """
    checkpoint_dir(df.sparkSession)
    if not costly:
        return df.checkpoint()
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        return kept.checkpoint()
    finally:
        kept.unpersist()
