"""Session settings, the shared folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from txguard.config import SparkConfig


def spark_session(config: SparkConfig | None = None, master: str | None = None) -> SparkSession:
    """A session with the settings every job here relies on."""
    config = config or SparkConfig()
    builder = (
        SparkSession.builder.appName(config.app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Checkpoints of finished work are removed.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # The JVM does not compile larger methods; beyond it, expressions are generated in smaller ones.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    if config.packages:
        builder = builder.config("spark.jars.packages", config.packages)
    if config.shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(config.shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local session gets a temporary folder; on a cluster
    that is an error, since other machines could not read such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="txguard-"))
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written intermediate table."""
    return f"{shared_folder(spark).rstrip('/')}/txguard/{name}-{uuid.uuid4().hex}"


def reliable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
