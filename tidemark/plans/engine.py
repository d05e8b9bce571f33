"""SQL at a consistency class: resolve the position, register the tables as of it, run Spark SQL."""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.lsn import HEAD, format_lsn, parse_lsn
from tidemark.operators.search import Index, build_index, key_text, search, synthetic_key
from tidemark.operators.versions import state_at
from tidemark.schema import LSN, LSN_TO, ORD
from tidemark.sources.index_store import IndexStore
from tidemark.sources.store import TableStore

LAG_BYTES_PER_SECOND = 1_000_000
STATUS = "stat_replication"


class StalenessError(RuntimeError):
    """A bound on staleness does not hold."""


@dataclass(frozen=True)
class LsnProof:
    """Which log position an answer reflects."""

    target_lsn: int | None
    received_lsn: int
    shapes: tuple[tuple[str, int], ...]

    @property
    def visible_lsn(self) -> int:
        return min((at for _, at in self.shapes), default=self.received_lsn)

    def render(self) -> str:
        target = "head" if self.target_lsn is None else format_lsn(self.target_lsn)
        parts = [f"{name}@{format_lsn(at)}" for name, at in self.shapes]
        return " ".join([f"LSN proof: target={target}", f"received={format_lsn(self.received_lsn)}", *parts])


@dataclass
class Table:
    """``source`` gives version rows or a stored table; ``stored_index`` an index of it, if there is one."""

    source: Callable[[], DataFrame | TableStore]
    applied_lsn: int
    key: tuple[str, ...] = ()
    search_fields: tuple[str, ...] = ()
    stored_index: Callable[[], IndexStore] | None = None

    def at(self, lsn: int) -> DataFrame:
        found = self.source()
        return found.at(lsn) if isinstance(found, TableStore) else state_at(found, lsn)

    def versions(self) -> DataFrame:
        found = self.source()
        return found.versions() if isinstance(found, TableStore) else found


#: Functions under the names that queries may use, and Spark's.
FUNCTIONS = {
    "approx_distinct": "approx_count_distinct", "approx_percentile_cont": "approx_percentile", "unnest": "explode", "array_length": "size",
    "starts_with": "startswith", "ends_with": "endswith", "strpos": "instr", "json_extract_string": "get_json_object", "array_to_string": "array_join",
}
_FUNCTION = re.compile(r"(?<![\w.])(" + "|".join(FUNCTIONS) + r")(?=\s*\()", re.I)
#: What is more than a name: text in, hexadecimal text out.
DEFINED = [f"CREATE TEMPORARY FUNCTION sha{n}(x STRING) RETURNS STRING RETURN sha2(x, {n})" for n in (224, 256, 384, 512)]


_PARTS = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", re.S)
_SEARCH = re.compile(r"\bsearch\s*\(\s*\x00(\d+)\x00\s*,\s*\x00(\d+)\x00\s*\)", re.I)
_ANY_SEARCH = re.compile(r"\bsearch\s*\(", re.I)


@dataclass
class Engine:
    """Read-only. Tables are named ``schema.table``; each query gets a session of its own."""

    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)
    received_lsn: int = 0
    history_floor: int | None = None
    status_schema: str = "tidemark"
    refresh: Callable[[], None] | None = None
    events: deque = field(default_factory=lambda: deque(maxlen=200))
    queries: int = 0
    errors: int = 0
    last_error: str = ""
    started: float = field(default_factory=time.time)

    def attach(
        self, name: str, source: DataFrame | TableStore | Callable[[], DataFrame | TableStore], applied_lsn: int | None = None,
        key: tuple[str, ...] = (), search_fields: tuple[str, ...] = (), index: IndexStore | Callable[[], IndexStore] | None = None,
    ) -> Engine:
        """A table from version rows or a store (then position and key are its own), searched through a stored
        index or one that is built for the query."""
        if isinstance(source, TableStore):
            applied_lsn = source.applied_lsn if applied_lsn is None else applied_lsn
            key = key or tuple(c.name for c in source.columns if c.is_key)
        if applied_lsn is None:
            raise ValueError(f"up to which position are the versions of {name} applied?")
        make = source if callable(source) else lambda: source
        stored = index if index is None or callable(index) else lambda: index
        if isinstance(index, IndexStore):
            search_fields = search_fields or tuple(index.fields)
        self.tables[name] = Table(make, applied_lsn, tuple(key), tuple(search_fields), stored)
        self.received_lsn = max(self.received_lsn, applied_lsn)
        self.note(f"attached {name} at {format_lsn(applied_lsn)}")
        return self

    def note(self, event: str) -> None:
        """The event log: newest first, with the time, the last 200."""
        self.events.appendleft((int(time.time() * 1000), event))

    def refresh_stored(self, received_lsn: int | None = None) -> None:
        """Take over how far stored tables and their indexes have come."""
        for name, t in self.tables.items():
            found = t.source()
            if isinstance(found, TableStore) and found.applied_lsn != t.applied_lsn:
                t.applied_lsn = found.applied_lsn
                self.note(f"applied {name} up to {format_lsn(t.applied_lsn)}")
                if t.stored_index is not None:
                    t.stored_index().apply(found)
        self.received_lsn = max([self.received_lsn, received_lsn or 0, *(t.applied_lsn for t in self.tables.values())])

    @property
    def applied_lsn(self) -> int:
        return min((t.applied_lsn for t in self.tables.values()), default=0)

    # Consistency classes

    def resolve(self, cls: str = "", strict: bool = True, timeout: float = 60.0) -> int | None:
        """eventual, target_lsn=X/Y, bounded(Ns), strong, read_your_writes(X/Y)."""
        cls = cls.strip()
        if cls in ("", "eventual"):
            return None
        if cls.startswith("target_lsn="):
            lsn = parse_lsn(cls.partition("=")[2])
            if strict and lsn > self.applied_lsn:
                raise StalenessError(f"{format_lsn(lsn)} is not applied yet; applied is {format_lsn(self.applied_lsn)}")
            if self.history_floor is not None and lsn < self.history_floor:
                raise StalenessError(f"{format_lsn(lsn)} is older than the kept history")
            return lsn
        if m := re.fullmatch(r"bounded\((.*?)s?\)", cls):
            seconds = int(m[1]) if m[1].isdigit() else 5
            lag = self.received_lsn - self.applied_lsn
            if lag > seconds * LAG_BYTES_PER_SECOND:
                raise StalenessError(f"{lag} bytes behind; {seconds} s allow {seconds * LAG_BYTES_PER_SECOND}")
            return self.applied_lsn
        if cls == "strong":
            return max(self.wait_applied(self.received_lsn, timeout), self.received_lsn)
        if m := re.fullmatch(r"read_your_writes\((.+)\)", cls):
            return self.wait_applied(parse_lsn(m[1]), timeout)
        raise ValueError(f"unknown consistency class {cls!r}")

    def wait_applied(self, lsn: int, timeout: float = 60.0) -> int:
        """Wait until a position is applied; ``refresh`` moves the tables forward."""
        end = time.monotonic() + timeout
        while self.applied_lsn < lsn:
            if self.refresh is not None:
                self.refresh()
            if self.applied_lsn >= lsn:
                break
            if time.monotonic() > end:
                raise StalenessError(f"{format_lsn(lsn)} was not applied in {timeout} s")
            time.sleep(0.1)
        return self.applied_lsn

    # Queries

    def query(self, sql: str, cls: str = "", **options) -> tuple[DataFrame, LsnProof]:
        self.queries += 1
        try:
            return self._query(sql, cls, **options)
        except Exception as e:
            self.errors += 1
            self.last_error = str(e).splitlines()[0] if str(e) else type(e).__name__
            self.note(f"query failed: {self.last_error}")
            raise

    def _query(self, sql: str, cls: str, **options) -> tuple[DataFrame, LsnProof]:
        target = self.resolve(cls, **options)
        session = self.spark.newSession()
        for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
            session.conf.set(k, self.spark.conf.get(k))
        rewritten, searches = self._rewrite(sql)
        lsn = HEAD - 1 if target is None else target
        used = set(re.findall(r"\w+", rewritten))
        for name, t in self.tables.items():
            if self._view(name) in used:
                self._bind(session, t.at(lsn), self._view(name))
        if (status := self._view(f"{self.status_schema}.{STATUS}")) in used:
            self._bind(session, self.status(), status)
        for view, (name, text) in searches.items():
            self._bind(session, self.search(name, text), view)
        for define in DEFINED:
            if re.search(rf"\b{define.split('(')[0].split()[-1]}\s*\(", rewritten, re.I):
                session.sql(define)
        df = session.sql(rewritten)
        shapes = [(f"columnar:{n}", t.applied_lsn) for n, t in self.tables.items()]
        shapes += [(f"search:{n}", t.applied_lsn) for n, t in self.tables.items() if t.search_fields]
        return df, LsnProof(target, self.received_lsn, tuple(sorted(shapes)))

    @staticmethod
    def _view(name: str) -> str:
        return name.replace(".", "__")

    @staticmethod
    def _bind(session: SparkSession, df: DataFrame, view: str) -> None:
        """Register a plan of the engine's session as a view of the query's."""
        frame = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.logicalPlan())
        frame.createOrReplaceTempView(view)

    def _rewrite(self, sql: str) -> tuple[str, dict[str, tuple[str, str]]]:
        """Table names to views, VARCHAR to STRING, search('t', 'q') to a view; never inside quotes or comments."""
        held: list[str] = []

        def hold(part: str) -> str:
            held.append(part)
            return f"\x00{len(held) - 1}\x00"

        flat = "".join(hold(p) if k % 2 else p for k, p in enumerate(_PARTS.split(sql)))
        words = re.sub(r"\x00\d+\x00", " ", flat)
        if not re.match(r"\s*\(*\s*(select|with|values|explain|show|table|from|describe)\b", words, re.I):
            raise ValueError("only queries are accepted")
        searches: dict[str, tuple[str, str]] = {}

        def found(m: re.Match) -> str:
            name, text = (held[int(m[k])] for k in (1, 2))
            if name[0] != "'" or text[0] != "'":
                raise ValueError("search() takes two text literals")
            view = f"__search_{len(searches)}"
            searches[view] = (name[1:-1].replace("''", "'"), text[1:-1].replace("''", "'"))
            return view

        flat = _SEARCH.sub(found, flat)
        if _ANY_SEARCH.search(flat):
            raise ValueError("search() takes two text literals")
        for name in sorted([*self.tables, f"{self.status_schema}.{STATUS}"], key=len, reverse=True):
            flat = re.sub(rf"(?<![\w.]){re.escape(name)}(?![\w(])", self._view(name), flat)
        flat = re.sub(r"\bVARCHAR\b(?!\s*\()", "STRING", flat, flags=re.I)
        flat = _FUNCTION.sub(lambda m: FUNCTIONS[m[1].lower()], flat)
        return re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], flat), searches

    def search(self, name: str, text: str, lsn: int | None = None) -> DataFrame:
        """key, score, applied_lsn. Head by default, as of any position on demand."""
        index = self.index(name)
        at = self.tables[name].applied_lsn
        found = search(index, text, lsn=HEAD - 1 if lsn is None else lsn)
        return found.select("key", F.col("score").cast("float").alias("score"), F.lit(format_lsn(at)).alias("applied_lsn"))

    def index(self, name: str) -> Index:
        """The stored index, else one over all versions. A table without a key gets a synthetic one."""
        t = self.tables.get(name)
        if t is None or not t.search_fields:
            raise ValueError(f"no search index on {name!r}")
        if t.stored_index is not None:
            return t.stored_index().index()
        versions = t.versions()
        key: Column = key_text(t.key) if t.key else synthetic_key([c for c in versions.columns if c not in (ORD, LSN_TO, LSN)])
        return build_index(versions, key, list(t.search_fields))

    # Status

    def status(self) -> DataFrame:
        rows = []
        for name, t in sorted(self.tables.items()):
            for shape in ("columnar", "search") if t.search_fields else ("columnar",):
                rows.append((f"{shape}:{name}", format_lsn(self.received_lsn), format_lsn(t.applied_lsn), max(0, self.received_lsn - t.applied_lsn)))
        return self.spark.createDataFrame(rows, "shape string, received_lsn string, applied_lsn string, apply_lag_bytes bigint")


    def state(self) -> dict:
        """The status record: positions, lag, shapes, counters and the newest events."""
        lag = max(0, self.received_lsn - self.applied_lsn)
        shapes = {f"columnar:{n}": format_lsn(t.applied_lsn) for n, t in self.tables.items()}
        shapes |= {f"search:{n}": format_lsn(t.applied_lsn) for n, t in self.tables.items() if t.search_fields}
        return {
            "uptime_s": int(time.time() - self.started), "received_lsn": format_lsn(self.received_lsn), "applied_lsn": format_lsn(self.applied_lsn),
            "apply_lag_bytes": lag, "apply_lag_s": lag / LAG_BYTES_PER_SECOND, "history_floor": None if self.history_floor is None else format_lsn(self.history_floor),
            "tables": {n: {"key": list(t.key), "append_only": not t.key, "search_fields": list(t.search_fields)} for n, t in self.tables.items()},
            "shapes": shapes, "queries": self.queries, "errors": self.errors, "last_error": self.last_error,
            "events": [{"at_ms": at, "event": event} for at, event in self.events],
        }


def budget_rung(retained: int, budget: int, warn: float = 0.5, shed: float = 0.7) -> int:
    """0 below the warning share of a log budget, 1 from it, 2 from the shedding share."""
    return 2 if retained >= shed * budget else 1 if retained >= warn * budget else 0
