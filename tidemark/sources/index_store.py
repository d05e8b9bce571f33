"""A stored search index: postings sorted by term, one narrow row a document, and a watermark.

The index is fed from a versioned table in batches; every batch is one commit that moves the
watermark, so a batch that is applied again does nothing. Postings keep the interval of their
document version; versions that end later are masked by (key, position), as in tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.lsn import HEAD
from tidemark.operators.search import SEPARATORS, Index, build_index, key_text, synthetic_key
from tidemark.schema import LSN, LSN_TO, ORD
from tidemark.sources.store import MASK_ROWS, TableStore

POSTINGS = f"key string, {LSN} bigint, {LSN_TO} bigint, field string, len int, term string, at array<int>"
#: Texts of so many stored bytes are indexed by one task: what it sorts by term stays in memory.
PART_BYTES = 8 << 20
ENDED = f"key string, {LSN} bigint, at bigint"


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, fields: list[str], separators: str = SEPARATORS) -> None:
        self.spark, self.path, self.fields, self.separators = spark, path.rstrip("/"), list(fields), separators
        self.commits = TableStore(spark, path)

    @property
    def applied_lsn(self) -> int:
        """The watermark: everything up to here is indexed."""
        return self.commits.manifest()["applied_lsn"]

    def _key(self, table: TableStore, versions: DataFrame) -> Column:
        key = [c.name for c in table.columns if c.is_key]
        return key_text(key) if key else synthetic_key([c for c in versions.columns if c not in (ORD, LSN_TO, LSN)])

    def apply(self, table: TableStore) -> IndexStore:
        """Index what the table has applied since the watermark."""
        m, to = self.commits.manifest(), table.applied_lsn
        mark = m["applied_lsn"]
        if to <= mark:
            return self
        versions = table.versions()
        key = self._key(table, versions)
        index = build_index(versions.where(F.col(LSN) > mark), key, self.fields, self.separators, max(1, -(-table.stored_bytes(mark) // PART_BYTES)))
        name = f"part-{uuid.uuid4().hex}"
        index.docs.write.parquet(f"{self.path}/{name}/docs")
        # Sorted inside each part: a filter on terms is decided by page bounds, and no term lies in one file alone.
        by_term = index.postings.select(*[c.split()[0] for c in POSTINGS.split(", ")]).sortWithinPartitions("term")
        by_term.write.option("compression", "zstd").parquet(f"{self.path}/{name}/postings")
        m["segments"].append({"name": name})
        if mark:
            ended = versions.where((F.col(LSN) <= mark) & (F.col(LSN_TO) > mark) & (F.col(LSN_TO) < HEAD))
            done = f"ended-{uuid.uuid4().hex}"
            ended.select(key.alias("key"), LSN, F.col(LSN_TO).alias("at")).write.parquet(f"{self.path}/{done}")
            if n := self.spark.read.schema(ENDED).parquet(f"{self.path}/{done}").count():
                m["closed"].append({"name": done, "rows": n})
        self.commits._commit(m | {"applied_lsn": to})
        return self

    def _masked(self, rows: DataFrame, m: dict) -> DataFrame:
        if not m["closed"]:
            return rows
        ended = self.spark.read.schema(ENDED).parquet(*[f"{self.path}/{c['name']}" for c in m["closed"]])
        ended = F.broadcast(ended) if sum(c["rows"] for c in m["closed"]) <= MASK_ROWS else ended
        joined = rows.join(ended.withColumnRenamed("at", "__ended"), ["key", LSN], "left")
        return joined.withColumn(LSN_TO, F.least(LSN_TO, F.coalesce("__ended", F.lit(HEAD)))).select(*rows.columns)

    def index(self) -> Index:
        m = self.commits.manifest()
        names = [f"{self.path}/{s['name']}" for s in m["segments"]]
        docs_ddl = f"key string, {LSN} bigint, {LSN_TO} bigint, " + ", ".join(f"`{f}_len` int" for f in self.fields)
        if not names:
            return Index(self.spark.createDataFrame([], docs_ddl), self.spark.createDataFrame([], POSTINGS), tuple(self.fields))
        docs = self.spark.read.schema(docs_ddl).parquet(*[f"{n}/docs" for n in names])
        postings = self.spark.read.schema(POSTINGS).parquet(*[f"{n}/postings" for n in names])
        return Index(self._masked(docs, m), self._masked(postings, m), tuple(self.fields))
