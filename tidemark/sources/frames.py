"""Change-stream frames and messages: binary codecs and their distributed decoding.

A frame is magic, sequence number, start and end positions, a commit flag, the payload's length, the
payload and a Castagnoli checksum, all big-endian. A payload is one logical-replication message.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import ColumnSpec, from_text
from tidemark.shipping import ship

MAGIC = 0x47444246
_HEAD = struct.Struct(">IQQQBI")


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _table()


def crc32c(data: bytes, crc: int = 0) -> int:
    crc ^= 0xFFFFFFFF
    for byte in data:
        crc = _CRC[(crc ^ byte) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


class FrameError(ValueError):
    """A damaged frame or message."""


@dataclass(frozen=True)
class Frame:
    seq: int
    lsn_start: int
    lsn_end: int
    txn_complete: bool
    payload: bytes


def encode_frame(f: Frame) -> bytes:
    body = _HEAD.pack(MAGIC, f.seq, f.lsn_start, f.lsn_end, f.txn_complete, len(f.payload)) + f.payload
    return body + struct.pack(">I", crc32c(body))


def decode_frame(data: bytes, at: int = 0) -> tuple[Frame, int]:
    """A frame and where the next one begins."""
    if len(data) - at < _HEAD.size:
        raise FrameError("truncated header")
    magic, seq, start, end, done, size = _HEAD.unpack_from(data, at)
    if magic != MAGIC:
        raise FrameError("bad magic")
    stop = at + _HEAD.size + size
    if len(data) < stop + 4:
        raise FrameError("truncated payload")
    if struct.unpack_from(">I", data, stop)[0] != crc32c(data[at:stop]):
        raise FrameError("checksum mismatch")
    return Frame(seq, start, end, bool(done), data[at + _HEAD.size : stop]), stop + 4


def frame_end(file, at: int) -> tuple[int, int, bool, int] | None:
    """seq, end position, whether it commits, and where the next frame begins; None for a torn or missing frame."""
    file.seek(at)
    head = file.read(_HEAD.size)
    if len(head) < _HEAD.size:
        return None
    magic, seq, _, lsn, done, size = _HEAD.unpack(head)
    if magic != MAGIC:
        raise FrameError("bad magic")
    file.seek(0, 2)
    end = at + _HEAD.size + size + 4
    return None if file.tell() < end else (seq, lsn, bool(done), end)


@dataclass(frozen=True)
class Message:
    """One replication message; ``kind`` is its tag, the rest depends on it."""

    kind: str
    lsn: int = 0
    end_lsn: int = 0
    xid: int = 0
    relid: int = 0
    relids: tuple[int, ...] = ()
    name: str = ""
    identity: str = ""
    columns: tuple[tuple[str, int, bool], ...] = ()
    new: tuple | None = None
    old: tuple | None = None
    old_kind: str = ""


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, code: str):
        s = struct.Struct(">" + code)
        if self.at + s.size > len(self.data):
            raise FrameError("truncated message")
        (value,) = s.unpack_from(self.data, self.at)
        self.at += s.size
        return value

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FrameError("truncated message")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise FrameError("unterminated text")
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out

    def tag(self) -> str:
        return chr(self.take("B"))

    def cells(self) -> tuple:
        """(kind, text) per column: n null, u unchanged, t text, b binary."""
        out = []
        for _ in range(self.take("H")):
            kind = self.tag()
            if kind not in "nutb":
                raise FrameError(f"unknown cell kind {kind!r}")
            out.append((kind, self.raw(self.take("I")).decode("utf-8" if kind == "t" else "latin-1") if kind in "tb" else None))
        return tuple(out)


def parse_message(payload: bytes) -> Message:
    r = _Reader(payload)
    kind = r.tag()
    if kind == "B":
        return Message("B", lsn=r.take("Q"), xid=(r.take("q"), r.take("I"))[1])
    if kind == "C":
        r.take("B")
        return Message("C", lsn=r.take("Q"), end_lsn=r.take("Q"))
    if kind == "R":
        relid, space, name, identity = r.take("I"), r.text(), r.text(), r.tag()
        cols = []
        for _ in range(r.take("H")):
            key = bool(r.take("B") & 1)
            cols.append((r.text(), r.take("I"), key))
            r.take("i")
        return Message("R", relid=relid, name=f"{space or 'pg_catalog'}.{name}", identity=identity, columns=tuple(cols))
    if kind == "I":
        relid = r.take("I")
        if r.tag() != "N":
            raise FrameError("an insert without a new image")
        return Message("I", relid=relid, new=r.cells())
    if kind in "UD":
        relid, tag, old, old_kind = r.take("I"), r.tag(), None, ""
        if tag in "KO":
            old, old_kind = r.cells(), tag
            tag = r.tag() if kind == "U" else ""
        if kind == "U":
            if tag != "N":
                raise FrameError("an update without a new image")
            return Message("U", relid=relid, new=r.cells(), old=old, old_kind=old_kind)
        if old is None:
            raise FrameError("a delete without an old image")
        return Message("D", relid=relid, old=old, old_kind=old_kind)
    if kind == "T":
        n = r.take("I")
        r.take("B")
        return Message("T", relids=tuple(r.take("I") for _ in range(n)))
    if kind in "OYM":  # origin, type, logical message: read and passed over
        return Message(kind)
    raise FrameError(f"unknown message tag {kind!r}")


@dataclass
class Decoder:
    """Frames to committed changes. Every change of a transaction gets its commit's end position."""

    relations: dict[int, Message] = field(default_factory=dict)
    shapes: list[tuple[int, int, Message]] = field(default_factory=list)
    expected: int | None = None
    buffer: list[dict] | None = None
    last_commit_seq: int | None = None
    pending: list[Message] = field(default_factory=list)

    def abort_open(self) -> None:
        """The log was rewound to its last commit: what is open will come again."""
        self.buffer, self.pending = None, []
        self.expected = None if self.last_commit_seq is None else self.last_commit_seq + 1

    def feed(self, frames: list[Frame]) -> list[dict]:
        out: list[dict] = []
        for f in frames:
            if self.expected is not None and f.seq != self.expected:
                raise FrameError(f"sequence gap: expected {self.expected}, found {f.seq}")
            self.expected = f.seq + 1
            m = parse_message(f.payload)
            if m.kind == "B":
                self.buffer, self.xid = [], m.xid
            elif m.kind == "R":
                self.relations[m.relid] = m
                self.pending.append(m)
            elif m.kind == "C":
                if self.buffer is None:
                    raise FrameError("a commit outside a transaction")
                for shape in self.pending:
                    known = next((s for _, r, s in reversed(self.shapes) if r == shape.relid), None)
                    if known is None or (known.name, known.columns) != (shape.name, shape.columns):
                        self.shapes.append((m.end_lsn, shape.relid, shape))
                for n, change in enumerate(self.buffer, 1):
                    out.append({"lsn": m.end_lsn, "ord": n, "xid": self.xid, **change})
                self.buffer, self.pending, self.last_commit_seq = None, [], f.seq
            elif m.kind in "IUDT":
                if self.buffer is None:
                    raise FrameError("a change outside a transaction")
                for relid in m.relids or (m.relid,):
                    r = self.relations.get(relid)
                    if r is None:
                        raise FrameError(f"a change to relation {relid} before its description")
                    names = [c for c, _, _ in r.columns]
                    image = lambda cells, names=names: None if cells is None else dict(zip(names, cells, strict=True))
                    self.buffer.append({"seq": f.seq, "table": r.name, "op": m.kind, "new": image(m.new), "old": image(m.old)})
        return out


PARSED = "seq bigint, lsn_start bigint, lsn_end bigint, txn_complete boolean, kind string, relid bigint, message binary"


def parse_frames(frames: DataFrame) -> DataFrame:
    """Check and tag frames in parallel. ``frames``: raw binary, one encoded frame a row."""
    ship(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [decode_frame(raw)[0] for raw in batch.column(0).to_pylist()]
            parsed = [parse_message(f.payload) for f in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([getattr(f, k) for f in rows], kind) for k, kind in (("seq", pa.int64()), ("lsn_start", pa.int64()), ("lsn_end", pa.int64()), ("txn_complete", pa.bool_()))),
                    pa.array([m.kind for m in parsed]),
                    pa.array([m.relid for m in parsed], pa.int64()),
                    pa.array([f.payload for f in rows], pa.binary()),
                ],
                ["seq", "lsn_start", "lsn_end", "txn_complete", "kind", "relid", "message"],
            )

    return frames.select("raw").mapInArrow(run, PARSED)


#: Frames of a stretch, where a log does not say which segment a frame is in.
STRETCH = 1 << 20


def _segmented(parsed: DataFrame) -> DataFrame:
    """With a column ``segment`` that rises with seq, so that no task gets a whole log."""
    return parsed if "segment" in parsed.columns else parsed.withColumn("segment", (F.col("seq") / STRETCH).cast("bigint"))


def _carried(parsed: DataFrame, **values) -> DataFrame:
    """segment and, under each name, the greatest of an expression's values in all segments before: one row a segment."""
    ends = parsed.groupBy("segment").agg(F.min("seq").alias("__first"), *[F.max(v).alias(k) for k, v in values.items()])
    before = Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("segment", *[F.max(k).over(before).alias(k) for k in values])


def log_problems(parsed: DataFrame) -> DataFrame:
    """seq and problem: gaps in the sequence and commit positions that fall, across segments too."""
    parsed = _segmented(parsed)
    order = Window.partitionBy("segment").orderBy("seq")
    commit = F.when(F.col("txn_complete"), F.col("lsn_end"))
    joined = parsed.join(F.broadcast(_carried(parsed, last_seq=F.col("seq"), last_lsn=commit)), "segment")  # one row a segment
    before = F.coalesce(F.lag("seq").over(order), F.col("last_seq"))
    highest = F.greatest(F.max(commit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("last_lsn"))
    problem = F.when(F.col("seq") - before != 1, "gap").when(F.col("txn_complete") & (highest > F.col("lsn_end")), "commit position falls")
    return joined.select("seq", problem.alias("problem")).where("problem is not null")


def transactions(parsed: DataFrame) -> DataFrame:
    """Committed rows with their transaction's commit position and 1-based place; open tails wait.

    A row belongs to the last begin before it. Segments are ordered on their own; the begin that is still open
    at a segment's end is carried into the next, so a transaction may span any number of them.
    """
    parsed = _segmented(parsed)
    begin = F.when(F.col("kind") == "B", F.col("seq"))
    order = Window.partitionBy("segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = parsed.join(F.broadcast(_carried(parsed, open_at=begin)), "segment")  # one row a segment
    numbered = joined.withColumn("txn", F.coalesce(F.max(begin).over(order), F.col("open_at"))).drop("open_at")
    numbered = numbered.withColumn("lsn", F.max(F.when(F.col("kind") == "C", F.col("lsn_end"))).over(Window.partitionBy("txn")))
    changes = numbered.where("lsn is not null and kind in ('I', 'U', 'D', 'T')")
    return changes.withColumn("ord", F.row_number().over(Window.partitionBy("txn").orderBy("seq")))


CHANGES = (
    "lsn bigint, ord int, seq bigint, table string, op string, new map<string, string>, old map<string, string>, old_kind string, unchanged array<string>"
)
#: Descriptions of relations (one each time a shape is first used) that the driver will hold.
MOST_SHAPES = 100_000


def changes_of(parsed: DataFrame, known: list[Message] | None = None) -> DataFrame:
    """Committed changes of parsed frames, one row a change and table: the whole way from a log to named values.

    ``known``: descriptions from before these frames. A change takes the newest description of its relation
    before it; the descriptions, few and bounded by ``MOST_SHAPES``, travel to the workers.
    """
    ship(parsed.sparkSession)
    found = parsed.where("kind = 'R'").select("seq", "message").limit(MOST_SHAPES + 1).collect()
    if len(found) > MOST_SHAPES:
        raise FrameError("too many relation descriptions in one batch")
    shapes: dict[int, list[tuple[int, Message]]] = {}
    for m in known or []:
        shapes.setdefault(m.relid, []).append((-1, m))
    for r in sorted(found, key=lambda r: r["seq"]):
        m = parse_message(bytes(r["message"]))
        shapes.setdefault(m.relid, []).append((r["seq"], m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                m = parse_message(row["message"])
                for n, relid in enumerate(m.relids or (m.relid,)):
                    of = [s for seq, s in shapes.get(relid, []) if seq < row["seq"]]
                    if not of:
                        raise FrameError(f"a change to relation {relid} before its description")
                    out.append(_named(m, of[-1]) | {"lsn": row["lsn"], "ord": row["ord"] + n, "seq": row["seq"]})
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    spaced = transactions(parsed).select("lsn", (F.col("ord") * 1024).alias("ord"), "seq", "message")  # room for a truncate of many tables
    return spaced.mapInArrow(run, CHANGES)


_TEXTS = pa.map_(pa.string(), pa.string())
_ARROW = pa.schema(
    [("lsn", pa.int64()), ("ord", pa.int32()), ("seq", pa.int64()), ("table", pa.string()), ("op", pa.string()), ("new", _TEXTS), ("old", _TEXTS), ("old_kind", pa.string()), ("unchanged", pa.list_(pa.string()))]
)


def _named(m: Message, shape: Message) -> dict:
    names = [c for c, _, _ in shape.columns]
    for cells in (m.new, m.old):
        if cells is not None and len(cells) != len(names):
            raise FrameError(f"{shape.name} has {len(names)} columns, its change {len(cells)}")
        if any(kind == "b" for kind, _ in cells or ()):
            raise FrameError(f"a binary value in {shape.name}")
    image = lambda cells: None if cells is None else [(c, v) for c, (_, v) in zip(names, cells, strict=True)]
    unchanged = [c for c, (kind, _) in zip(names, m.new or [("n", None)] * len(names), strict=True) if kind == "u"]
    return {"table": shape.name, "op": m.kind, "new": image(m.new), "old": image(m.old), "old_kind": m.old_kind, "unchanged": unchanged}


def table_changes(changes: DataFrame, name: str, specs: list[ColumnSpec]) -> DataFrame:
    """One table's changes in the form that versions are made from: typed columns, ``old_`` keys, unchanged."""
    mine = changes.where((F.col("table") == name) | F.col("table").isNull())
    strange = F.array_except(F.map_keys("new"), F.array(*[F.lit(s.name) for s in specs]))
    drift = F.when(F.size(strange) > 0, F.raise_error(F.concat(F.lit(f"the shape of {name} has changed: "), F.array_join(strange, ", "))))
    of = lambda image, s: from_text(F.col(image)[s.name], s)
    values = [F.when(F.col("op") == "D", of("old", s)).otherwise(of("new", s)).alias(s.name) for s in specs]
    old = [F.when(F.col("op") == "U", of("old", s)).alias(f"old_{s.name}") for s in specs if s.is_key]
    unchanged = F.when(drift.isNull(), F.col("unchanged"))
    return mine.select("lsn", "ord", "op", *values, *old, unchanged.alias("unchanged"))


def ddl_events(changes: DataFrame, log_table: str = "tidemark.ddl_log") -> DataFrame:
    """Schema statements that the source records as inserts into a table of its own; the inserts stay changes too."""
    wanted = ("kind", "command_tag", "object_identity", "ddl_text")
    return changes.where((F.col("table") == log_table) & (F.col("op") == "I")).select("lsn", "ord", *[F.col("new")[c].alias(c) for c in wanted])
