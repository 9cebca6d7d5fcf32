"""Versioned state tables: a version is written once per batch, never in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose write has finished (they carry the commit marker)."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(done) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def load_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Newest finished version, or the newest one below ``before``; None if none.

    A replayed batch passes its own version as ``before`` and so never reads
    what its first attempt wrote.
    """
    usable = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={usable[-1]}") if usable else None


def save_state(state: DataFrame, path: str, version: int | None = None) -> int:
    """Write a version (the next one by default) and return its number.

    Writing the same version again replaces it: a replay gives the same rows.
    """
    if version is None:
        known = _versions(state.sparkSession, path)
        version = known[-1] + 1 if known else 1
    state.write.mode("overwrite").parquet(f"{path}/version={version}")
    return version
