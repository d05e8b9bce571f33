"""Versioned tables on disk: immutable Parquet segments and numbered manifests, the only commit points.

Files are resolved from the newest manifest, never by listing. A manifest is written in full under a
draft's name and then renamed to the next number, which fails where that number exists: readers see all of a
commit or none of it, a crash leaves the manifest before it in force, and a second writer is told.
(The rename must be atomic, as it is on HDFS and on local disks.)

New rows land in small open segments that every scan includes at once; when they hold ``flush_rows``
rows they are rewritten into one sorted segment. Versions that end later than their segment was
written are closed by a small dataset of (file, row, position), masked at reading and folded in by ``compact``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.lsn import HEAD
from tidemark.operators.changes import ChangeError, versions_of
from tidemark.operators.versions import visible_at
from tidemark.schema import LSN, LSN_TO, ORD, ColumnSpec, struct_of

#: Closings of at most this many rows are broadcast; their number is known from the manifest.
MASK_ROWS = 1_000_000
PLACE = "file string, row bigint, at bigint"


class CommitConflict(RuntimeError):
    """Another writer has committed since the table was read."""


class TableStore:
    def __init__(self, spark: SparkSession, path: str, flush_rows: int = 100_000) -> None:
        self.spark, self.path, self.flush_rows = spark, path.rstrip("/"), flush_rows

    # Manifests go through Hadoop's file systems, so they can live wherever the data can.

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm, target, target.getFileSystem(conf), conf

    def _newest(self) -> tuple[int, str | None]:
        _, folder, fs, _ = self._hadoop(f"{self.path}/manifests")
        if not fs.exists(folder):
            return 0, None
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json")]
        return (max(numbers), f"{self.path}/manifests/{max(numbers):020d}.json") if numbers else (0, None)

    def manifest(self) -> dict:
        number, path = self._newest()
        if path is None:
            return {"number": 0, "columns": [], "applied_lsn": 0, "rows": 0, "segments": [], "open": [], "closed": [], "schema": None}
        _, target, fs, _ = self._hadoop(path)
        stream = fs.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"number": number}
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        number = manifest["number"] + 1
        jvm, draft, fs, conf = self._hadoop(f"{self.path}/manifests/{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest | {"number": number}).encode()))
        out.close()
        self._rename(jvm, draft, jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{number:020d}.json"), conf)

    def _rename(self, jvm, draft, final, conf) -> None:
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(conf).getUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, final, options)  # without OVERWRITE
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"{final.getName()} was committed by another writer") from e
            raise

    def create(self, name: str, columns: list[ColumnSpec]) -> TableStore:
        schema = T.StructType([*struct_of(columns).fields, *_helpers()])
        self._commit(self.manifest() | {"table": name, "columns": [[c.name, c.type_oid, c.is_key] for c in columns], "schema": json.loads(schema.json())})
        return self

    @property
    def columns(self) -> list[ColumnSpec]:
        return [ColumnSpec(*c) for c in self.manifest()["columns"]]

    @property
    def applied_lsn(self) -> int:
        return self.manifest()["applied_lsn"]

    # Writing

    def _segment(self, versions: DataFrame, kind: str) -> dict:
        """Write version rows (zstd and sorted by position for pruning, unless they are open rows)."""
        name = f"{kind}-{uuid.uuid4().hex}"
        if kind == "segment":
            versions = versions.sortWithinPartitions(LSN)
        versions.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        found = self.spark.read.schema(versions.schema).parquet(f"{self.path}/{name}")
        n, low, high, last, alive = found.agg(F.count(F.lit(1)), F.min(LSN), F.max(LSN), F.max(LSN_TO), F.count_if(F.col(LSN_TO) == HEAD)).first()
        return {"name": name, "rows": n, "lsn_min": low, "lsn_max": high, "ends_max": last, "alive": alive}

    def append(self, versions: DataFrame, applied_lsn: int) -> None:
        """Add version rows as one sorted segment."""
        m = self.manifest()
        m["schema"] = json.loads(versions.schema.json())
        self._added(m, self._segment(versions, "segment"), "segments")
        self._commit(m | {"applied_lsn": max(m["applied_lsn"], applied_lsn)})

    def append_open(self, versions: DataFrame, applied_lsn: int) -> None:
        """Add version rows that scans see at once; flushed when enough have come together."""
        m = self.manifest()
        m["schema"] = m["schema"] or json.loads(versions.schema.json())
        self._added(m, self._segment(versions, "open"), "open")
        self._commit(self._flushed(m) | {"applied_lsn": max(m["applied_lsn"], applied_lsn)})

    @staticmethod
    def _added(m: dict, segment: dict, where: str) -> None:
        if segment["rows"]:
            m[where].append(segment)
            m["rows"] += segment["alive"]

    def _flushed(self, m: dict, force: bool = False) -> dict:
        """Open segments as one sorted one, with the closings of their rows folded in."""
        if not m["open"] or not force and sum(s["rows"] for s in m["open"]) < self.flush_rows:
            return m
        rows = self._masked(m, m["open"])
        done = self._segment(rows.select(*T.StructType.fromJson(m["schema"]).names).coalesce(1), "segment")
        return m | {"segments": [*m["segments"], done], "open": []}

    def flush(self) -> None:
        self._commit(self._flushed(self.manifest(), force=True))

    def _close(self, m: dict, ends: DataFrame) -> None:
        name = f"closed-{uuid.uuid4().hex}"
        ends.select("file", "row", "at").write.parquet(f"{self.path}/{name}")
        n = self.spark.read.schema(PLACE).parquet(f"{self.path}/{name}").count()
        if n:
            m["closed"].append({"name": name, "rows": n})
            m["rows"] -= n

    def close(self, ends: DataFrame, key: list[str], applied_lsn: int) -> None:
        """Close the open versions of keys. ``ends``: key columns, at."""
        m = self.manifest()
        rows = self._alive(m).select(*key, LSN, "file", "row")
        self._close(m, rows.join(ends, key).where(F.col(LSN) <= F.col("at")))
        self._commit(m | {"applied_lsn": max(m["applied_lsn"], applied_lsn)})

    def apply(self, changes: DataFrame, applied_lsn: int, strict: bool = True) -> None:
        """Apply the changes beyond what is applied: new versions and closings of stored ones in one commit,
        so that applying a log again, or from any earlier place on, changes nothing."""
        m = self.manifest()
        specs = [ColumnSpec(*c) for c in m["columns"]]
        names, key = [c.name for c in specs], [c.name for c in specs if c.is_key]
        if missing := set(names) - set(changes.columns):
            raise ChangeError(f"the table's shape has changed: no column {sorted(missing)}")
        fresh = changes.where(F.col("lsn") > m["applied_lsn"])
        if "unchanged" not in fresh.columns:
            fresh = fresh.withColumn("unchanged", F.array().cast("array<string>"))
        for k in key:
            if f"old_{k}" not in fresh.columns:
                fresh = fresh.withColumn(f"old_{k}", F.lit(None).cast(fresh.schema[k].dataType))
        wanted = ["lsn", "ord", "op", *names, *[f"old_{k}" for k in key], "unchanged"]
        drafts: list[str] = []
        try:
            fresh = self._draft(fresh.select(*wanted), drafts)
            alive = self._alive(m)
            truncate = fresh.where("op = 'T'").select("lsn", "ord").orderBy("lsn", "ord").first()
            if truncate is None:
                alive = self._draft(self._touched(alive, fresh, key), drafts) if key else alive.where("false")
            m = self._applied(m, alive, fresh, names, key, wanted, truncate, strict)
            self._commit(self._flushed(m) | {"applied_lsn": max(m["applied_lsn"], applied_lsn)})
        finally:
            for path in drafts:
                _, folder, fs, _ = self._hadoop(path)
                fs.delete(folder, True)

    def _draft(self, rows: DataFrame, drafts: list[str]) -> DataFrame:
        """The same rows, evaluated once: written beside the segments until the commit is over."""
        drafts.append(f"{self.path}/draft-{uuid.uuid4().hex}")
        rows.write.parquet(drafts[-1])
        return self.spark.read.schema(rows.schema).parquet(drafts[-1])

    @staticmethod
    def _touched(alive: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
        """The open versions of the keys in a batch of changes; the table is not shuffled for a batch that can be broadcast."""
        rows = fresh.where("op <> 'T'")
        touched = rows.select(*key).unionByName(rows.select(*[F.coalesce(f"old_{k}", k).alias(k) for k in key])).distinct()
        return alive.join(F.broadcast(touched) if fresh.count() <= MASK_ROWS // 2 else touched, key, "left_semi")

    def _applied(self, m: dict, alive: DataFrame, fresh: DataFrame, names: list[str], key: list[str], wanted: list[str], truncate, strict: bool) -> dict:
        """The manifest with a batch's new versions and closings."""
        same = [F.lit(None).cast(fresh.schema[f"old_{k}"].dataType).alias(f"old_{k}") for k in key]
        before = alive.select(F.col(LSN).alias("lsn"), F.col(ORD).alias("ord"), F.lit("I").alias("op"), *names, *same, F.array().cast("array<string>").alias("unchanged"))
        versions = versions_of(before.select(*wanted).unionByName(fresh), key, names, strict)
        ends = versions.where((F.col(LSN) <= m["applied_lsn"]) & (F.col(LSN_TO) < HEAD))
        places = [*key, LSN, ORD]
        if key:
            self._close(m, alive.select(*places, "file", "row").join(ends.select(*places, F.col(LSN_TO).alias("at")), places))
        elif truncate is not None:
            self._close(m, alive.select("file", "row", F.lit(truncate["lsn"]).alias("at")))
        schema = T.StructType.fromJson(m["schema"])
        new = versions.where(F.col(LSN) > m["applied_lsn"]).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        self._added(m, self._segment(new, "open"), "open")
        return m

    # Reading

    def _rows(self, m: dict, segments: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s['name']}" for s in segments])

    def _mask(self, m: dict) -> DataFrame | None:
        if not m["closed"]:
            return None
        found = self.spark.read.schema(PLACE).parquet(*[f"{self.path}/{c['name']}" for c in m["closed"]])
        return F.broadcast(found) if sum(c["rows"] for c in m["closed"]) <= MASK_ROWS else found

    @staticmethod
    def _placed(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))

    def _masked(self, m: dict, segments: list[dict]) -> DataFrame:
        rows, mask = self._rows(m, segments), self._mask(m)
        if mask is None or not segments:
            return rows
        joined = self._placed(rows).join(mask, ["file", "row"], "left")
        return joined.withColumn(LSN_TO, F.least(F.col(LSN_TO), F.coalesce("at", F.lit(HEAD)))).select(*rows.columns)

    def _alive(self, m: dict) -> DataFrame:
        """Open versions with their places."""
        segments = [s for s in [*m["segments"], *m["open"]] if s["alive"]]
        rows, mask = self._rows(m, segments), self._mask(m)
        if not segments:
            return rows.withColumns({"file": F.lit(""), "row": F.lit(0).cast("bigint")})
        rows = self._placed(rows).where(F.col(LSN_TO) == HEAD)
        return rows if mask is None else rows.join(mask.select("file", "row"), ["file", "row"], "left_anti")

    def versions(self, lsn: int = HEAD) -> DataFrame:
        """Every version that begins by ``lsn``, open rows included, with later closings applied; whole
        segments are skipped by their bounds."""
        m = self.manifest()
        return self._masked(m, [s for s in [*m["segments"], *m["open"]] if s["lsn_min"] <= lsn])

    def scan(self, lsn: int = HEAD - 1) -> DataFrame:
        """The versions alive at a position. Both comparisons are on stored columns, so both reach the scan;
        rows closed later are masked by their places."""
        m = self.manifest()
        segments = [s for s in [*m["segments"], *m["open"]] if s["lsn_min"] <= lsn < s["ends_max"]]
        rows, mask = self._rows(m, segments).where(visible_at(lsn)), self._mask(m)
        if mask is None or not segments:
            return rows
        placed = self._placed(self._rows(m, segments)).where(visible_at(lsn))
        return placed.join(mask.where(F.col("at") <= lsn), ["file", "row"], "left_anti").select(*rows.columns)

    def at(self, lsn: int = HEAD - 1) -> DataFrame:
        return self.scan(lsn).drop(ORD, LSN_TO)

    def compact(self, files: int) -> None:
        """Rewrite into few sorted files with all closings folded in."""
        m = self.manifest()
        done = self._segment(self._masked(m, [*m["segments"], *m["open"]]).repartitionByRange(files, LSN), "segment")
        self._commit(m | {"segments": [done] if done["rows"] else [], "open": [], "closed": [], "rows": done["alive"]})

    def stored_bytes(self, after: int = 0) -> int:
        """Size of the files of the segments with versions that begin beyond ``after``."""
        m, total = self.manifest(), 0
        for s in [*m["segments"], *m["open"]]:
            if s["lsn_max"] > after:
                _, folder, fs, _ = self._hadoop(f"{self.path}/{s['name']}")
                total += fs.getContentSummary(folder).getLength()
        return total

    def visible_rows(self) -> int:
        """Rows alive now: a counter of the manifest, not a scan."""
        return self.manifest()["rows"]


def _helpers() -> list[T.StructField]:
    return [T.StructField(ORD, T.IntegerType()), T.StructField(LSN_TO, T.LongType()), T.StructField(LSN, T.LongType())]
