"""From a frame log to answers: a streaming source over frame files, and tables that follow it.

The source's offset is a place in the log right behind a commit frame, so a micro-batch holds whole
transactions only; each poll reads on from there. Tables apply a batch in one commit each and know how far
they have come, so a batch that is run again, whole or in part, changes nothing.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.schema import ColumnSpec
from tidemark.shipping import ship
from tidemark.sources.frames import FrameError, Message, changes_of, ddl_events, decode_frame, frame_end, parse_message, table_changes
from tidemark.sources.store import TableStore

FORMAT = "tidemark_frames"
SCHEMA = "segment string, seq bigint, lsn_start bigint, lsn_end bigint, txn_complete boolean, kind string, relid bigint, message binary"
START = {"file": "", "at": 0, "seq": 0, "lsn": 0}


class Stretch(InputPartition):
    """Bytes of one segment file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class FrameReader(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self.folder, self.known = Path(folder), dict(START)

    def initialOffset(self) -> dict:  # noqa: N802
        return dict(START)

    def latestOffset(self) -> dict:  # noqa: N802
        """Behind the last commit frame there is. Reads heads only, from the last known place on."""
        at = self.known
        for path in self._files(at["file"]):
            with open(path, "rb") as f:
                place = at["at"] if path.name == at["file"] else 0
                while (found := frame_end(f, place)) is not None:
                    seq, lsn, done, place = found
                    if done:
                        self.known = {"file": path.name, "at": place, "seq": seq, "lsn": lsn}
        return self.known

    def _files(self, first: str) -> list[Path]:
        return [p for p in sorted(self.folder.glob("*.frames")) if p.name >= first]

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path in self._files(start["file"]):
            if path.name <= end["file"]:
                low = start["at"] if path.name == start["file"] else 0
                high = end["at"] if path.name == end["file"] else path.stat().st_size
                if low < high:
                    out.append(Stretch(str(path), low, high))
        return out

    def read(self, partition: Stretch):
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            data, at = f.read(partition.end - partition.start), 0
        while at < len(data):
            frame, at = decode_frame(data, at)
            m = parse_message(frame.payload)
            yield (Path(partition.path).name, frame.seq, frame.lsn_start, frame.lsn_end, frame.txn_complete, m.kind, m.relid, frame.payload)


class FrameSource(DataSource):
    """``readStream.format("tidemark_frames").load(folder)``; the folder must be one that all executors see."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FrameReader:  # noqa: N802
        return FrameReader(self.options["path"])


def snapshot_versions(rows: DataFrame, lsn: int) -> DataFrame:
    """A consistent copy of a table as of a position, as version rows that begin there."""
    from tidemark.lsn import HEAD
    from tidemark.schema import LSN, LSN_TO, ORD

    return rows.select("*", F.lit(0).alias(ORD), F.lit(HEAD).alias(LSN_TO), F.lit(lsn).cast("bigint").alias(LSN))


class Ingest:
    """Tables under ``root`` that follow a frame log: {name: columns}."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, list[ColumnSpec]], strict: bool = True, flush_rows: int = 100_000) -> None:
        self.spark, self.strict, self.stores = spark, strict, {}
        self.shapes: list[Message] = []
        for name, columns in tables.items():
            store = TableStore(spark, f"{root.rstrip('/')}/{name}", flush_rows)
            self.stores[name] = store if store.columns else store.create(name, columns)

    def snapshot(self, name: str, rows: DataFrame, lsn: int) -> None:
        """Load a table's first state; from then on only changes behind ``lsn`` count."""
        if self.stores[name].applied_lsn < lsn:
            self.stores[name].append(snapshot_versions(rows, lsn), lsn)

    def apply_batch(self, parsed: DataFrame, batch_id: int = 0) -> None:
        """Whole transactions into every table. Each table leaves out what it has already."""
        parsed = parsed.persist()
        try:
            last = parsed.where("kind = 'C'").agg(F.max("lsn_end")).first()[0]
            if last is not None:
                changes = changes_of(parsed, self.shapes).persist()
                for name, store in self.stores.items():
                    if store.applied_lsn < last:
                        store.apply(table_changes(changes, name, store.columns), last, self.strict)
                self._remember(parsed)
                changes.unpersist()
        finally:
            parsed.unpersist()

    def _remember(self, parsed: DataFrame) -> None:
        for r in parsed.where("kind = 'R'").orderBy("seq").select("message").collect():  # shapes, bounded as in changes_of
            self.shapes.append(parse_message(bytes(r["message"])))

    def start(self, folder: str, checkpoint: str, **trigger):
        """Follow the log; ``trigger``: of writeStream, such as availableNow=True or processingTime="250 milliseconds"."""
        ship(self.spark)
        self.spark.dataSource.register(FrameSource)
        self.shapes = shapes_before(folder, self.applied_lsn)
        source = self.spark.readStream.format(FORMAT).load(folder)
        return source.writeStream.foreachBatch(self.apply_batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    @property
    def applied_lsn(self) -> int:
        return min((s.applied_lsn for s in self.stores.values()), default=0)


def shapes_before(folder: str, lsn: int) -> list[Message]:
    """Descriptions that a restarted follower has to know: those of committed transactions up to a position."""
    from tidemark.sources.framelog import read_segment

    out, pending = [], []
    for path in sorted(Path(folder).glob("*.frames")) if lsn else []:
        for frame in read_segment(path, allow_torn_tail=True)[0]:
            if frame.lsn_end > lsn and frame.txn_complete:
                return out
            if frame.payload[:1] == b"R":
                pending.append(parse_message(frame.payload))
            if frame.txn_complete:
                out, pending = out + pending, []
    return out


__all__ = ["FrameError", "FrameSource", "Ingest", "ddl_events", "snapshot_versions"]
