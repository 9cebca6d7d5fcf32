"""Session settings and the one way lineage is cut."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "laneward", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every result depends on (UTC, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    """How many tasks a shuffle has in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share, set up on first use."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="laneward-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and read on from there.

    Used where one physical evaluation must serve several later reads (row
    placement by range) and between rounds of an iteration. The files survive
    the loss of executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
