"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


#: HotSpot leaves longer methods interpreted, as those of stages with many columns would be.
SMALL_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(app: str = "heliofleet", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are designed for.

    ``master`` stays unset on a cluster, where the submitter decides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # rolling windows are heavy on little data: do not merge them to a few tasks
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # one call per expression instead of several while wide feature sets are declared
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        **SMALL_METHODS,
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Readings are naive local times; UTC keeps them free of clock changes. Wide stages are compiled in parts."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for key, value in SMALL_METHODS.items():
        spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster, or a private one in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    private = tempfile.mkdtemp(prefix="heliofleet-")
    spark.sparkContext.setCheckpointDir(private)
    return private


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, never cleared."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
