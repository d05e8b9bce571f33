"""A change stream applied by Structured Streaming, exactly once per transaction.

Each micro-batch appends version rows to a folder of its own and then a marker; state is reduced from
the folders markers name. A batch that runs again overwrites its own folder, and transactions that
came before (same position and hash) are left out, so a restart changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.changes import unapplied


class StreamApply:
    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        """``schema``: of the stream's rows; must hold lsn, ord, sha256 (of the transaction) and deleted."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def applied(self) -> DataFrame:
        if not self._exists(f"{self.path}/markers"):
            return self.spark.createDataFrame([], "batch bigint, lsn bigint, sha256 string")
        return self.spark.read.schema("lsn bigint, sha256 string, batch bigint").parquet(f"{self.path}/markers")

    def apply_batch(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            low, high = batch.agg(F.min("lsn"), F.max("lsn")).first()
            done = self.applied().where((F.col("batch") != batch_id) & F.col("lsn").between(low, high))  # the others' row groups are skipped
            transactions = unapplied(batch.select("lsn", "sha256").distinct(), done)
            rows = batch.join(transactions.select("lsn"), "lsn", "left_semi")
            rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
            transactions.write.mode("overwrite").parquet(f"{self.path}/markers/batch={batch_id}")  # the commit point
        finally:
            batch.unpersist()

    def start(self, source: DataFrame, checkpoint: str, **trigger):
        """``trigger``: of writeStream, such as availableNow=True or processingTime="250 milliseconds"."""
        return source.writeStream.foreachBatch(self.apply_batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def rows(self) -> DataFrame:
        """Version rows of every marked batch."""
        if not self._exists(f"{self.path}/markers"):
            return self.spark.createDataFrame([], self.schema)
        from pyspark.sql.types import StructType

        full = StructType.fromDDL(self.schema + ", batch bigint")
        marked = self.applied().select("batch").distinct()
        return self.spark.read.schema(full).parquet(f"{self.path}/rows").join(marked, "batch", "left_semi").drop("batch")

    def applied_lsn(self) -> int:
        return self.applied().agg(F.max("lsn")).first()[0] or 0
