"""A deterministic dataset and workload: every value is a pure function of (seed, table, id, salt)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shipping import ship

TABLES = ("tenants", "customers", "orders", "order_events")
#: Rows of a cycle; the ids of cycle c begin at c * 100.
PER_CYCLE = {"tenants": 1, "customers": 5, "orders": 20, "order_events": 60}
_TAG = {t: np.uint64(k) for k, t in enumerate(TABLES, 1)}


def _choices(text: str) -> tuple[tuple[str, int], ...]:
    parts = text.split()
    return tuple(zip(parts[::2], map(int, parts[1::2]), strict=True))


#: Values by weight.
WEIGHTED = {
    "region": _choices("us-east 46 us-west 27 eu-west 18 ap-south 9"),
    "plan": _choices("free 70 pro 23 enterprise 7"),
    "segment": _choices("consumer 55 smb 29 mid-market 12 enterprise 4"),
    "domain": _choices("example.com 58 mail.test 25 corp.test 12 acme.test 5"),
    "status": _choices("paid 46 shipped 27 pending 15 cancelled 8 refunded 4"),
    "channel": _choices("web 61 mobile 31 partner 8"),
    "event": _choices("created 42 paid 30 fulfilled 17 cancelled 7 returned 4"),
}
#: Long-tailed amounts in cents: (weight, least, most), both included; and lengths of labels: (weight, length).
CENTS = ((55, 100, 2_499), (27, 2_500, 9_999), (12, 10_000, 49_999), (5, 50_000, 249_999), (1, 250_000, 2_000_000))
LABELS = ((55, 3), (27, 16), (12, 64), (6, 128))
ZIPF_RANKS = 64
YEAR = 31_536_000


def mix64(z):
    """A step of splitmix64, wrapping at 64 bits."""
    with np.errstate(over="ignore"):
        z = np.asarray(z, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _rotl(x, k: int):
    return x << np.uint64(k) | x >> np.uint64(64 - k)


def draw(seed: int, table: str, ids, salt: int):
    ids = np.asarray(ids, np.uint64)
    return mix64(np.uint64(seed) ^ _TAG[table] ^ _rotl(ids, 17) ^ _rotl(np.full_like(ids, salt), 41))


def weighted(values, choices) -> np.ndarray:
    edges = np.cumsum([w for _, w in choices])
    return np.array([c for c, _ in choices], object)[np.searchsorted(edges, np.asarray(values, np.uint64) % np.uint64(edges[-1]), side="right")]


def long_tail_cents(bucket, value) -> np.ndarray:
    edges = np.cumsum([w for w, _, _ in CENTS])
    k = np.searchsorted(edges, np.asarray(bucket, np.uint64) % np.uint64(edges[-1]), side="right")
    low, high = (np.array([c[j] for c in CENTS], np.uint64)[k] for j in (1, 2))
    return (low + np.asarray(value, np.uint64) % (high - low + np.uint64(1))).astype(np.int64)


def zipf_rank(values, ranks=ZIPF_RANKS) -> np.ndarray:
    """1..ranks with weights 10000 / rank; ``ranks`` may differ from value to value."""
    edges = np.cumsum(10_000 // np.arange(1, ZIPF_RANKS + 1, dtype=np.uint64))
    total = edges[np.asarray(ranks, np.int64) - 1]
    return np.searchsorted(edges, np.asarray(values, np.uint64) % total, side="right").astype(np.int64) + 1


def pseudo_timestamp(seconds) -> list[str]:
    """A fixed rendering by integer arithmetic: years of 365 days, months of 30, days 1 to 28."""
    s = np.asarray(seconds, np.int64)
    return [f"{1970 + x // 31536000:04d}-{1 + x // 2592000 % 12:02d}-{1 + x // 86400 % 28:02d} 00:00:00+00" for x in s.tolist()]


def cycle_ranges(cycles: int) -> dict[str, tuple[int, int]]:
    return {t: (0, cycles * n) for t, n in PER_CYCLE.items()}


def ids_of(table: str, index) -> np.ndarray:
    n = PER_CYCLE[table]
    index = np.asarray(index, np.int64)
    return index // n * 100 + index % n + 1


def _cycle(ids: np.ndarray) -> np.ndarray:
    return (ids - 1) // 100


def _metadata(values, kind: str) -> list[str]:
    length = np.searchsorted(np.cumsum([w for w, _ in LABELS]), (values % np.uint64(100)).astype(int), side="right")
    ranks = zipf_rank(values)
    out = []
    for v, n, r in zip(values.tolist(), length.tolist(), ranks.tolist(), strict=True):
        made = {"kind": kind, "payload": v % 1000, "schema_version": 1, "tags": {"bucket": v % 8, "label": "x" * LABELS[n][1]}}
        out.append(json.dumps(made | ({"activity_rank": r} if kind == "tenant" else {}), sort_keys=True, separators=(",", ":")))
    return out


def rows(table: str, index, seed: int) -> dict[str, list]:
    """Columns of rows by their index. A foreign key points to a row of its own cycle, a tenant to one of the first
    64 that are loaded; orders and events have the tenant of their customer. Times crowd towards the recent end."""
    ids = ids_of(table, index)
    d = lambda salt: draw(seed, table, ids, salt)
    age = (d(2) % np.uint64(YEAR)).astype(np.int64)
    created = 1_609_459_200 + YEAR - age * age // YEAR
    at = pseudo_timestamp(created)
    pick = lambda salt, name: weighted(d(salt), WEIGHTED[name]).tolist()
    if table == "tenants":
        return {"tenant_id": ids.tolist(), "region": pick(3, "region"), "plan": pick(4, "plan"), "created_at": at, "settings": _metadata(d(5), "tenant")}
    order = ids if table == "orders" else _cycle(ids) * 100 + 1 + (d(3) % np.uint64(20)).astype(np.int64)
    customer = ids if table == "customers" else _cycle(order) * 100 + 1 + (draw(seed, "orders", order, 7) % np.uint64(5)).astype(np.int64)
    tenant = (zipf_rank(draw(seed, "customers", customer, 11), np.minimum(_cycle(customer) + 1, ZIPF_RANKS)) - 1) * 100 + 1
    if table == "customers":
        return {
            "customer_id": ids.tolist(), "tenant_id": tenant.tolist(), "segment": pick(3, "segment"), "email_domain": pick(4, "domain"),
            "profile": _metadata(d(5), "customer"), "created_at": at,
        }
    if table == "orders":
        return {
            "order_id": ids.tolist(), "tenant_id": tenant.tolist(), "customer_id": customer.tolist(), "status": pick(3, "status"), "channel": pick(4, "channel"),
            "amount_cents": long_tail_cents(d(5), d(9)).tolist(), "created_at": at, "updated_at": pseudo_timestamp(created + (d(6) % np.uint64(86_400)).astype(np.int64)),
            "attributes": _metadata(d(8), "order"),
        }
    return {"event_id": ids.tolist(), "order_id": order.tolist(), "tenant_id": tenant.tolist(), "event_type": pick(4, "event"), "event_at": at, "metadata": _metadata(d(5), "event")}


def generate(spark: SparkSession, table: str, cycles: int, seed: int, first: int = 0) -> DataFrame:
    """The table's rows, made where they are used: a range split over the cluster, no data shipped."""
    ship(spark)
    example = rows(table, [0], seed)
    schema = ", ".join(f"{c} {'bigint' if isinstance(v[0], int) else 'string'}" for c, v in example.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(rows(table, batch.column(0).to_numpy(), seed))

    return spark.range(first * PER_CYCLE[table], (first + cycles) * PER_CYCLE[table]).mapInArrow(run, schema)


def load_until(spark: SparkSession, path: str, seed: int, least_bytes: int, step: int = 1000) -> dict[str, int]:
    """Write whole cycles of every table under ``path`` until they take ``least_bytes``; rows by table.

    The size is measured after each round; rounds grow to about a sixteenth of the goal, so there are few."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = lambda: fs.getContentSummary(target).getLength() if fs.exists(target) else 0
    done = 0
    while (held := size()) < least_bytes:
        if done:
            step = max(1, int(done * max(1.0, least_bytes / 16) / max(held, 1)))
        for t in TABLES:
            generate(spark, t, step, seed, done).write.mode("append").parquet(f"{path}/{t}")
        done += step
    return {t: n for t, (_, n) in cycle_ranges(done).items()}


def batch_hashes(df: DataFrame, order: str, size: int = 100_000) -> DataFrame:
    """batch, rows and sha256 of bulk-load batches of at most ``size`` consecutive ids: tab-separated lines, escaped."""
    text = lambda c: F.col(c).cast("string")
    for raw, mark in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = lambda c, inner=text, raw=raw, mark=mark: F.replace(inner(c), F.lit(raw), F.lit(mark))
    line = F.concat(F.concat_ws("\t", *[F.coalesce(text(c), F.lit("\\N")) for c in df.columns]), F.lit("\n"))
    lines = df.select(((F.col(order) - 1) / size).cast("bigint").alias("batch"), F.struct(F.col(order).alias("at"), line.alias("line")).alias("x"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "")
    return lines.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.sha2(whole, 256).alias("sha256"))


# Workload

def transaction_rows(values) -> np.ndarray:
    """Rows of a transaction by its draw: 95 % one, 4 % ten, 0.9 % a hundred, 0.1 % a thousand."""
    x = np.asarray(values, np.uint64) % np.uint64(10_000)
    return np.select([x < 9500, x < 9900, x < 9990], [1, 10, 100], 1000)


def transaction_size(seed: int, sequence) -> np.ndarray:
    return transaction_rows(mix64(np.uint64(seed) ^ _rotl(np.asarray(sequence, np.uint64), 17)))


def operation(k: int) -> tuple[str, str]:
    """(operation, table) of the k-th row: of fifty, 45 inserts, four updates and a delete."""
    place, cycle = k % 50, k // 50
    if place < 45:
        n = (cycle * 45 + place) % 20
        return "insert", "order_events" if n < 12 else "orders" if n < 19 else "customers"
    if place < 49:
        return "update", "customers" if (cycle * 4 + place - 45) % 10 == 9 else "orders"
    return "delete", "order_events" if cycle % 5 == 4 else "orders"


def plan_sha256(operations: list[dict]) -> str:
    return hashlib.sha256(json.dumps(operations, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def schedule(seed: int, ordinal: int, queries: int = 5) -> int:
    return int(mix64(np.uint64(seed ^ ordinal)) % np.uint64(queries))


def query_parameters(seed: int, sequence: int, lsn: int) -> dict:
    """What the five queries ask at a checkpoint, whatever the clock says."""
    tenant = lambda n: 1 + int(mix64(np.uint64(seed ^ n)) % np.uint64(10_000))
    end = 1_609_459_200 + int(mix64(np.uint64(seed ^ sequence ^ lsn)) % np.uint64(YEAR))
    return {"window_end": end, "tenant_id": tenant(sequence), "tenant_set": [tenant(sequence + k) for k in range(8)]}


_PARAMETER = re.compile(r"'(?:[^']|'')*'|::|:([A-Za-z_]\w*)")


def render_sql(sql: str, parameters: dict) -> str:
    """Named parameters (:window_end, :tenant_id, :tenant_set) as literals; one that is unknown is an error."""

    def put(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        if m[1] not in parameters:
            raise ValueError(f"unresolved named parameter :{m[1]}")
        v = parameters[m[1]]
        return f"timestamp_seconds({v})" if m[1] == "window_end" else ", ".join(map(str, v)) if isinstance(v, list) else str(v)

    return _PARAMETER.sub(put, sql)


class TokenBucket:
    """Permits at a rate; ``take`` returns the seconds to wait, by the caller's clock."""

    def __init__(self, rate: float, burst: float) -> None:
        self.rate, self.burst, self.level, self.at = rate, burst, burst, 0.0

    def take(self, n: float, now: float) -> float:
        self.level = min(self.burst, self.level + (now - self.at) * self.rate)
        self.at = now
        self.level -= n
        return max(0.0, -self.level / self.rate)
