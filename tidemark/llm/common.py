"""Shared plumbing of the training-data operators: table access, Arrow batches, shared storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.shipping import ship

#: Rows worked on at once. Spark bounds the batch they come in by bytes (64 MiB by default).
BATCH_ROWS = 256

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any store Spark can reach will do."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where driver and executors are one process (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str, into: list[str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    The files survive the loss of any executor. Their path is added to ``into``, for :func:`forget`; what is
    left is removed when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written[path] = spark
    if into is not None:
        into.append(path)
    return spark.read.schema(schema).parquet(path)


def forget(paths: list[str]) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for path in paths:
        if (spark := _written.pop(path, None)) is not None:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    paths.clear()


@atexit.register
def _forget_at_exit() -> None:
    try:
        forget(list(_written))
    except Exception:  # noqa: BLE001  the JVM may be gone already
        _written.clear()


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, rows: int = BATCH_ROWS
) -> DataFrame:
    """``mapInArrow`` with one function per batch of at most ``rows`` rows."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]
