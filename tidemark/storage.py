"""Shared storage of a running application: where lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where they are one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_scratch: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


@atexit.register
def _delete() -> None:
    for spark, path in _scratch:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
