"""Histories as deterministic functions of plain tables: change logs, and their closed form in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.changes import versions_of
from tidemark.plans.engine import Engine
from tidemark.schema import ColumnSpec
from tidemark.sources.index_store import IndexStore
from tidemark.sources.store import TableStore
from tidemark.storage import scratch

ORDER_KEY, ORDER_COLUMNS = ["id"], ["id", "customer_id", "status", "amount_cents", "channel", "created_at"]
EVENT_COLUMNS = ["event_id", "user_id", "event_type", "event_at", "metadata"]
APPLIED = 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def _exploded(base: DataFrame, changes: list, columns: list[str]) -> DataFrame:
    """Rows with an array of possible changes (struct or null) to one row a change."""
    out = base.withColumn("c", F.explode(F.filter(F.array(*changes), lambda c: c.isNotNull())))
    return out.select("c.lsn", "c.ord", "c.op", *[F.col(f"c.{k}") if k in ("status", "amount_cents") else F.col(k) for k in columns])


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill, late inserts, two rounds of updates, deletes, and rows that live for no position at all."""
    orders = table(spark, sf_dir, "orders")
    base = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status0"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents0"), F.col("o_orderpriority").alias("channel"), F.col("o_orderdate").alias("created_at"),
    )
    k = F.col("id")

    def change(lsn, ord_, op, status, cents):
        return F.struct(F.lit(lsn).cast("bigint").alias("lsn") if isinstance(lsn, int) else lsn.cast("bigint").alias("lsn"), F.lit(ord_).alias("ord"), F.lit(op).alias("op"), status.alias("status"), cents.alias("amount_cents"))

    more = F.col("cents0") + F.when(k % 97 == 0, 100).otherwise(0)
    changes = [
        change(F.when(k % 10 == 9, 200 + k % 50).otherwise(100), 0, "I", F.col("status0"), F.col("cents0")),
        F.when(k % 97 == 0, change(300, 1, "U", F.lit("reprocessed"), F.col("cents0") + 100)),
        F.when((k % 131 == 0) & (k % 97 != 0), change(400, 1, "D", F.col("status0"), F.col("cents0"))),
        F.when(k % 291 == 0, change(500, 1, "U", F.lit("re-reprocessed"), more)),
        F.when((k % 1009 == 0) & (k % 131 != 0), change(600, 1, "U", F.lit("ephemeral"), more)),
        F.when((k % 1009 == 0) & (k % 131 != 0), change(600, 2, "D", F.lit("ephemeral"), more)),
    ]
    return _exploded(base, changes, ORDER_COLUMNS)


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions_of(order_changes(spark, sf_dir), ORDER_KEY, ORDER_COLUMNS, strict=False, truncates=False)


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("event_at"), F.col("props").alias("metadata"))
    change = lambda lsn, op: F.struct(lsn.cast("bigint").alias("lsn"), F.lit(0).alias("ord"), F.lit(op).alias("op"))
    return _exploded(e, [change(1000 + F.col("event_id"), "I"), F.when(F.col("event_id") % 53 == 0, change(F.lit(20_000_000), "D"))], EVENT_COLUMNS)


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions_of(event_changes(spark, sf_dir), ["event_id"], EVENT_COLUMNS, strict=False, truncates=False)


def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text0"))
    change = lambda lsn, op, text: F.struct(F.lit(lsn).cast("bigint").alias("lsn"), F.lit(0).alias("ord"), F.lit(op).alias("op"), text.alias("text"))
    longer = F.concat("text0", F.lit(" xylophone"))
    out = d.withColumn("c", F.explode(F.filter(F.array(
        change(100, "I", F.col("text0")), F.when(F.col("doc_id") % 41 == 0, change(300, "U", longer)), F.when(F.col("doc_id") % 37 == 0, change(400, "D", F.col("text0")))
    ), lambda c: c.isNotNull())))
    return versions_of(out.select("doc_id", "c.*"), ["doc_id"], ["doc_id", "text"], strict=False, truncates=False)


def customer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the nation as tenant and its region, all since position 100."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    rows = rows.select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("tenant_id"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"))
    changes = rows.withColumns({"lsn": F.lit(100).cast("bigint"), "ord": F.lit(0), "op": F.lit("I")})
    return versions_of(changes, ["customer_id"], ["customer_id", "tenant_id", "segment", "region"], strict=False, truncates=False)


#: name -> (versions, applied position, columns with their type ids, key)
HISTORIES = {
    "orders": (order_versions, APPLIED, (("id", 20), ("customer_id", 20), ("status", 25), ("amount_cents", 20), ("channel", 25), ("created_at", 1114)), ("id",)),
    "customers": (customer_versions, 500, (("customer_id", 20), ("tenant_id", 20), ("segment", 25), ("region", 25)), ("customer_id",)),
    "events": (event_versions, 20_000_000, (("event_id", 20), ("user_id", 20), ("event_type", 25), ("event_at", 1114), ("metadata", 25)), ("event_id",)),
    "documents": (document_versions, 400, (("doc_id", 20), ("text", 25)), ("doc_id",)),
}
_stores: dict[tuple[str, str, str], TableStore] = {}
_indexes: dict[tuple[str, str], IndexStore] = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> TableStore:
    """A history as a stored table, written once per application and folder; all that query it scan its segments."""
    at = (spark.sparkContext.applicationId, str(sf_dir), name)
    if at not in _stores:
        versions, applied, columns, key = HISTORIES[name]
        store = TableStore(spark, scratch(spark, name)).create(f"app.{name}", [ColumnSpec(c, oid, c in key) for c, oid in columns])
        store.append(versions(spark, sf_dir), applied)
        _stores[at] = store
    return _stores[at]


def stored_index(spark: SparkSession, sf_dir: str) -> IndexStore:
    """The index over app.documents, likewise."""
    at = (spark.sparkContext.applicationId, str(sf_dir))
    if at not in _indexes:
        _indexes[at] = IndexStore(spark, scratch(spark, "index"), ["text"], separators="[^a-z0-9]+").apply(stored(spark, sf_dir, "documents"))
    return _indexes[at]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Tables are written when a query first names them."""
    out = Engine(spark)
    for name, (_, applied, _, key) in HISTORIES.items():
        search = {"search_fields": ("text",), "index": lambda: stored_index(spark, sf_dir)} if name == "documents" else {}
        out.attach(f"app.{name}", lambda name=name: stored(spark, sf_dir, name), applied, key, **search)
    return out


def orders_sql(lsn: int) -> str:
    """The state of app.orders at a position, in closed form."""
    return f"""(SELECT o_orderkey AS id, o_custkey AS customer_id,
  CASE WHEN o_orderkey % 291 = 0 AND {lsn} >= 500 THEN 're-reprocessed' WHEN o_orderkey % 97 = 0 AND {lsn} >= 300 THEN 'reprocessed' ELSE o_orderstatus END AS status,
  CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 97 = 0 AND {lsn} >= 300 THEN 100 ELSE 0 END AS amount_cents,
  o_orderpriority AS channel, o_orderdate AS created_at,
  CAST(CASE WHEN o_orderkey % 291 = 0 AND {lsn} >= 500 THEN 500 WHEN o_orderkey % 97 = 0 AND {lsn} >= 300 THEN 300
    WHEN o_orderkey % 10 = 9 THEN 200 + o_orderkey % 50 ELSE 100 END AS BIGINT) AS __lsn
  FROM orders WHERE (CASE WHEN o_orderkey % 10 = 9 THEN 200 + o_orderkey % 50 ELSE 100 END) <= {lsn}
  AND NOT (o_orderkey % 131 = 0 AND o_orderkey % 97 <> 0 AND {lsn} >= 400) AND NOT (o_orderkey % 1009 = 0 AND o_orderkey % 131 <> 0 AND {lsn} >= 600))"""


CUSTOMERS_SQL = """(SELECT c_custkey AS customer_id, c_nationkey AS tenant_id, c_mktsegment AS segment, r_name AS region, CAST(100 AS BIGINT) AS __lsn
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def events_sql(lsn: int) -> str:
    return f"""(SELECT event_id, user_id, event_type, ts AS event_at, props AS metadata, 1000 + event_id AS __lsn FROM events
  WHERE 1000 + event_id <= {lsn} AND NOT (event_id % 53 = 0 AND {lsn} >= 20000000))"""


def documents_sql(lsn: int) -> str:
    return f"""(SELECT doc_id, CASE WHEN doc_id % 41 = 0 AND {lsn} >= 300 THEN text || ' xylophone' ELSE text END AS text,
  CAST(CASE WHEN doc_id % 41 = 0 AND {lsn} >= 300 THEN 300 ELSE 100 END AS BIGINT) AS __lsn FROM documents WHERE {lsn} >= 100 AND NOT (doc_id % 37 = 0 AND {lsn} >= 400))"""
