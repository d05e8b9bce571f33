"""Registered queries of the engine's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import generator
from tidemark.lsn import format_lsn, lsn_column, lsn_text
from tidemark.operators import changes as C
from tidemark.operators import versions as V
from tidemark.operators.search import search, tokens
from tidemark.plans import generated_sql
from tidemark.plans import histories as H
from tidemark.schema import ColumnSpec, as_of_join, schema_at, schema_versions
from tidemark.sources.store import TableStore
from tidemark.storage import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL at a position, through the engine: name -> (position, text over app.* tables). Sums are cast: engines widen differently.
SQL: dict[str, tuple[int, str]] = {
    "q1_spend_by_customer": (500, "SELECT customer_id, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n FROM app.orders WHERE created_at >= TIMESTAMP '2001-07-01 00:00:00' - INTERVAL '90' DAY GROUP BY customer_id"),
    "q2_tenant_by_status": (500, "SELECT o.status, count(*) AS n FROM app.orders o JOIN app.customers c ON o.customer_id = c.customer_id WHERE c.tenant_id = 7 GROUP BY o.status"),
    "q3_join_regions": (400, "SELECT c.region, o.channel, o.status, CAST(sum(o.amount_cents) AS BIGINT) AS cents, count(*) AS n FROM app.orders o JOIN app.customers c ON o.customer_id = c.customer_id GROUP BY c.region, o.channel, o.status"),
    "q4_events_of_users": (20_000_000, "SELECT event_type, count(*) AS n FROM app.events WHERE user_id IN (1, 2, 3, 5, 8, 13, 21, 34) AND event_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL '24' HOUR AND event_at < TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type"),
    "q5_by_status": (400, "SELECT status, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM app.orders GROUP BY status"),
    "q5_at_backfill": (100, "SELECT status, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM app.orders GROUP BY status"),
    "q5_mid_stream": (225, "SELECT status, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM app.orders GROUP BY status"),
    "q5_at_head": (600, "SELECT status, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM app.orders GROUP BY status"),
    "b1_sum_cast": (500, "SELECT customer_id, round(sum(CAST(amount_cents AS DOUBLE)), 2) AS total, count(*) AS n FROM app.orders GROUP BY customer_id"),
    "b2_modulo": (500, "SELECT status, count(*) AS n FROM app.orders WHERE customer_id % 100 = 17 GROUP BY status"),
    "b3_global": (500, "SELECT count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM app.orders"),
    "d1_count_before": (99, "SELECT count(*) AS n FROM app.orders"),
    "d2_point_lookup": (300, "SELECT id, status, amount_cents FROM app.orders WHERE id = 97"),
    "d2_point_lookup_later": (500, "SELECT id, status, amount_cents FROM app.orders WHERE id = 291"),
    "d5_order_by_count": (500, "SELECT channel, count(*) AS n FROM app.orders GROUP BY channel ORDER BY n DESC, channel"),
    "k9_row_positions": (500, "SELECT id, __lsn FROM app.orders WHERE id % 97 = 0 OR id % 10 = 9"),
    "m1_greatest_of_maxima": (500, "SELECT greatest((SELECT max(__lsn) FROM app.orders), (SELECT max(__lsn) FROM app.customers)) AS applied"),
    "m2_duplicates": (500, "SELECT status, count(*) - count(DISTINCT customer_id) AS duplicates, count(*) - count(DISTINCT id) AS repeated_ids FROM app.orders GROUP BY status"),
    "sql_left_join": (500, "SELECT c.customer_id, count(o.id) AS n FROM app.customers c LEFT JOIN app.orders o ON o.customer_id = c.customer_id AND o.status = 'F' GROUP BY c.customer_id"),
    "sql_full_join": (500, "SELECT count(*) AS n, count(a.id) AS l, count(b.id) AS r FROM (SELECT id FROM app.orders WHERE id % 2 = 0) a FULL OUTER JOIN (SELECT id FROM app.orders WHERE id % 3 = 0) b ON a.id = b.id"),
    "sql_semi_exists": (500, "SELECT c.customer_id FROM app.customers c WHERE EXISTS (SELECT 1 FROM app.orders o WHERE o.customer_id = c.customer_id AND o.amount_cents > 40000000)"),
    "sql_anti_not_exists": (500, "SELECT c.customer_id FROM app.customers c WHERE NOT EXISTS (SELECT 1 FROM app.orders o WHERE o.customer_id = c.customer_id)"),
    "sql_using": (500, "SELECT segment, count(*) AS n FROM app.orders JOIN app.customers USING (customer_id) GROUP BY segment"),
    "sql_theta_join": (500, "SELECT count(*) AS n FROM (SELECT DISTINCT tenant_id FROM app.customers) a JOIN (SELECT DISTINCT tenant_id FROM app.customers) b ON a.tenant_id < b.tenant_id"),
    "sql_cross_join": (500, "SELECT a.region, b.segment FROM (SELECT DISTINCT region FROM app.customers) a CROSS JOIN (SELECT DISTINCT segment FROM app.customers) b"),
    "sql_cube": (500, "SELECT status, channel, count(*) AS n, grouping(status) AS g FROM app.orders GROUP BY CUBE (status, channel)"),
    "sql_rollup": (500, "SELECT region, segment, count(*) AS n FROM app.customers GROUP BY ROLLUP (region, segment)"),
    "sql_grouping_sets": (500, "SELECT status, channel, CAST(sum(amount_cents) AS BIGINT) AS cents FROM app.orders GROUP BY GROUPING SETS ((status), (channel), ())"),
    "sql_having_filter": (500, "SELECT customer_id, count(*) FILTER (WHERE status = 'O') AS n_open, count(*) AS n FROM app.orders GROUP BY customer_id HAVING count(*) > 12"),
    "sql_min_max_avg": (500, "SELECT channel, min(amount_cents) AS low, max(amount_cents) AS high, round(avg(amount_cents), 4) AS mean, count(DISTINCT customer_id) AS people FROM app.orders GROUP BY channel"),
    "sql_stats": (500, "SELECT channel, round(stddev_samp(CAST(amount_cents AS DOUBLE)), 2) AS sd, round(corr(CAST(amount_cents AS DOUBLE), CAST(id AS DOUBLE)), 6) AS r, median(amount_cents) AS mid FROM app.orders GROUP BY channel"),
    "sql_rank": (500, "SELECT * FROM (SELECT id, channel, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS quarter FROM app.orders WINDOW w AS (PARTITION BY channel ORDER BY amount_cents DESC, id)) t WHERE rn <= 5"),
    "sql_percent_rank": (500, "SELECT id, round(percent_rank() OVER (PARTITION BY status ORDER BY amount_cents, id), 9) AS pr, round(cume_dist() OVER (PARTITION BY status ORDER BY amount_cents, id), 9) AS cd FROM app.orders"),
    "sql_lag_lead": (500, "SELECT id, lag(amount_cents) OVER w AS before, lead(amount_cents, 2) OVER w AS later, first_value(id) OVER w AS first_id, nth_value(id, 2) OVER w AS second_id FROM app.orders WINDOW w AS (PARTITION BY customer_id ORDER BY id)"),
    "sql_frames": (500, "SELECT id, CAST(sum(amount_cents) OVER (PARTITION BY customer_id ORDER BY id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last3, count(*) OVER (PARTITION BY customer_id ORDER BY id RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM app.orders"),
    "sql_limit_offset": (500, "SELECT id, amount_cents FROM app.orders ORDER BY amount_cents DESC, id LIMIT 10 OFFSET 5"),
    "sql_union": (500, "SELECT customer_id FROM app.orders WHERE status = 'F' UNION SELECT customer_id FROM app.customers WHERE region = 'ASIA'"),
    "sql_union_all": (500, "SELECT status AS s, count(*) AS n FROM app.orders GROUP BY status UNION ALL SELECT segment, count(*) FROM app.customers GROUP BY segment"),
    "sql_intersect": (500, "SELECT customer_id FROM app.orders INTERSECT SELECT customer_id FROM app.customers WHERE segment = 'BUILDING'"),
    "sql_except": (500, "SELECT customer_id FROM app.customers EXCEPT SELECT customer_id FROM app.orders"),
    "sql_distinct": (500, "SELECT DISTINCT status, channel FROM app.orders"),
    "sql_scalar_subquery": (500, "SELECT id FROM app.orders WHERE amount_cents > (SELECT 1.9 * avg(amount_cents) FROM app.orders)"),
    "sql_in_subquery": (500, "SELECT id FROM app.orders WHERE customer_id IN (SELECT customer_id FROM app.customers WHERE tenant_id = 3) AND status NOT IN ('O')"),
    "sql_correlated": (500, "SELECT o.id FROM app.orders o WHERE o.amount_cents = (SELECT max(i.amount_cents) FROM app.orders i WHERE i.customer_id = o.customer_id)"),
    "sql_cte": (500, "WITH big AS (SELECT customer_id, sum(amount_cents) AS cents FROM app.orders GROUP BY customer_id), top AS (SELECT * FROM big WHERE cents > 200000000) SELECT count(*) AS n FROM top"),
    "sql_recursive_cte": (500, "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 12) SELECT n, (SELECT count(*) FROM app.orders) AS orders FROM s"),
    "sql_case_coalesce": (500, "SELECT CASE WHEN amount_cents > 20000000 THEN 'high' WHEN amount_cents > 5000000 THEN 'mid' ELSE 'low' END AS band, count(nullif(status, 'F')) AS not_f, count(coalesce(status, 'x')) AS n FROM app.orders GROUP BY 1"),
    "sql_math": (500, "SELECT id, abs(id - 500) AS a, id % 7 AS m, round(sqrt(CAST(id AS DOUBLE)), 6) AS s, floor(CAST(id AS DOUBLE) / 3) AS f, round(ln(CAST(id + 1 AS DOUBLE)), 6) AS l, round(power(CAST(id % 10 AS DOUBLE), 2), 3) AS p FROM app.orders"),
    "sql_strings": (500, "SELECT id, lower(channel) AS lo, upper(status) AS up, substr(channel, 3, 4) AS part, length(channel) AS n, concat(status, '-', channel) AS both, split_part(channel, '-', 1) AS head, replace(channel, '-', '_') AS r, trim('  a ') AS t FROM app.orders"),
    "sql_like_between": (500, "SELECT id FROM app.orders WHERE channel LIKE '%-%' AND id BETWEEN 100 AND 900 AND status IS NOT NULL AND NOT status <> 'F'"),
    "sql_regexp": (500, "SELECT id, regexp_replace(channel, '[aeiouAEIOU]', '') AS bare FROM app.orders"),
    "sql_dates": (500, "SELECT date_trunc('month', created_at) AS month, count(*) AS n, min(extract(YEAR FROM created_at)) AS y FROM app.orders GROUP BY 1"),
    "sql_string_agg": (500, "SELECT region, listagg(segment, ',') WITHIN GROUP (ORDER BY segment) AS segments FROM (SELECT DISTINCT region, segment FROM app.customers) t GROUP BY region"),
    "sql_hashing": (500, "SELECT id, md5(status) AS m, sha256(channel) AS s FROM app.orders"),
    "sql_approx_distinct": (500, "SELECT channel, approx_distinct(status) AS kinds, count(*) AS n FROM app.orders GROUP BY channel"),
    "sql_unnest": (500, "SELECT part, count(*) AS n FROM (SELECT unnest(array_agg(DISTINCT status)) AS part FROM app.orders GROUP BY channel) t GROUP BY part"),
    "sql_array_agg": (500, "SELECT customer_id, array_to_string(array_sort(array_agg(id)), ',') AS ids FROM app.orders GROUP BY customer_id"),
    "sql_json": (20_000_000, "SELECT json_extract_string(metadata, '$.k') AS k, count(*) AS n FROM app.events GROUP BY 1"),
    "sql_values": (500, "SELECT v.a, count(*) AS n FROM (VALUES (1), (2), (3)) AS v(a) JOIN app.orders o ON o.id % 3 = v.a - 1 GROUP BY v.a"),
    "sql_varchar_cast": (500, "SELECT CAST(id AS VARCHAR) AS k, status FROM app.orders"),
}


def _oracle_text(lsn: int, sql: str) -> str:
    out = sql.replace("app.orders", H.orders_sql(lsn)).replace("app.customers", H.CUSTOMERS_SQL).replace("app.events", H.events_sql(lsn))
    out = re.sub(r"listagg\((\w+), ','\) WITHIN GROUP \(ORDER BY (\w+)\)", r"string_agg(\1, ',' ORDER BY \2)", out)
    out = out.replace("array_sort(", "list_sort(").replace("approx_distinct(", "count(DISTINCT ")
    out = out.replace("regexp_replace(channel, '[aeiouAEIOU]', '')", "regexp_replace(channel, '[aeiouAEIOU]', '', 'g')")
    # A derived table must be named before a comma or a clause in some places only; names are always safe here.
    return re.sub(r"(FROM|JOIN) (\(SELECT (?:o_orderkey|c_custkey|event_id, user_id)[\s\S]*?(?:>= 600\)\)|r_regionkey\)|20000000\)\)))(?=( [a-z]\b)?)", lambda m: f"{m[1]} {m[2]}" + ("" if m[3] else " AS base_"), out)


for _name, (_lsn, _sql) in SQL.items():

    def _run(spark: SparkSession, sf_dir: str, lsn: int = _lsn, sql: str = _sql) -> DataFrame:
        df, _ = H.engine(spark, sf_dir).query(sql, f"target_lsn={format_lsn(lsn)}", strict=False)
        return df

    QUERIES[_name] = _run
    ORACLES[_name] = _oracle_text(_lsn, _sql)


def query(name: str, sql: str | None = None):
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def _state(rows: DataFrame) -> DataFrame:
    return rows.select("id", "status", "amount_cents")


@query("v1_interval_state", f"SELECT id, status, amount_cents FROM {H.orders_sql(500)} s")
def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(H.stored(spark, sf_dir, "orders").at(500))


@query("v2_closings_masked", f"SELECT id, status, amount_cents, CAST(as_of AS BIGINT) AS as_of FROM (SELECT *, 450 AS as_of FROM {H.orders_sql(450)} a UNION ALL SELECT *, 600 FROM {H.orders_sql(600)} b) s")
def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table fed in three steps: versions that end later than their segment was written are masked by place."""
    changes = H.order_changes(spark, sf_dir)
    store = TableStore(spark, scratch(spark, "steps")).create("app.orders", [ColumnSpec(c, 25, c == "id") for c in H.ORDER_COLUMNS])
    first = C.versions_of(changes.where("lsn <= 300"), H.ORDER_KEY, H.ORDER_COLUMNS, strict=False, truncates=False)
    store.append(first, 300)
    for lsn in (450, 600):
        store.apply(changes.where(F.col("lsn") <= lsn), lsn)
    return _state(store.at(450)).withColumn("as_of", F.lit(450).cast("bigint")).unionByName(_state(store.at(600)).withColumn("as_of", F.lit(600).cast("bigint")))


@query("v3_newest_version_state", f"SELECT id, status, amount_cents FROM {H.orders_sql(600)} s")
def v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(V.latest_at(C.version_rows(H.order_changes(spark, sf_dir), H.ORDER_KEY, H.ORDER_COLUMNS, truncates=False), ["id"], 600))


@query("v5_reduce_then_join", f"SELECT c.region, count(*) AS n FROM {H.orders_sql(450)} o JOIN {H.CUSTOMERS_SQL} c ON o.customer_id = c.customer_id GROUP BY c.region")
def v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.latest_at(C.version_rows(H.order_changes(spark, sf_dir), H.ORDER_KEY, H.ORDER_COLUMNS, truncates=False), ["id"], 450)
    customers = H.stored(spark, sf_dir, "customers").at(450)
    return orders.join(customers, "customer_id").groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("v6_log_to_intervals", f"SELECT id, status, amount_cents FROM {H.orders_sql(400)} s")
def v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.version_rows(H.order_changes(spark, sf_dir), H.ORDER_KEY, H.ORDER_COLUMNS, truncates=False)
    return _state(V.state_at(V.intervals(rows, ["id"]), 400))


@query("v7_version_uniqueness", "SELECT event_type, CAST(sum(1 + CASE WHEN event_id % 53 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS versions, CAST(sum(1 + CASE WHEN event_id % 53 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS different FROM events GROUP BY event_type")
def v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind as many different (key, position, place) as version rows."""
    rows = C.version_rows(H.event_changes(spark, sf_dir), ["event_id"], H.EVENT_COLUMNS, truncates=False)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("event_id", "_lsn", "_ord").alias("different"))


@query("v8_first_keys", f"SELECT k.id, s.status FROM (SELECT o_orderkey AS id FROM orders WHERE (CASE WHEN o_orderkey % 10 = 9 THEN 200 + o_orderkey % 50 ELSE 100 END) <= 400 ORDER BY o_orderkey LIMIT 300) k LEFT JOIN {H.orders_sql(400)} s ON s.id = k.id")
def v8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sample_at(H.stored(spark, sf_dir, "orders").versions(400), ["id"], 400, 300).select("id", "status")


@query("o7_compare_states", f"SELECT a.id, CASE WHEN b.id IS NULL THEN 'missing' ELSE 'changed' END AS kind FROM {H.orders_sql(300)} a LEFT JOIN {H.orders_sql(500)} b ON a.id = b.id WHERE b.id IS NULL OR a.status <> b.status OR a.amount_cents <> b.amount_cents")
def o7(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = H.stored(spark, sf_dir, "orders")
    return V.difference(_state(orders.at(300)), _state(orders.at(500)), ["id"]).select("id", "kind")


@query("c5_contradictions", """SELECT CAST(700 AS BIGINT) AS lsn, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN 'insert of a key that is open' ELSE 'update of an unknown key' END AS problem
  FROM orders WHERE o_orderkey % 1009 = 0 AND o_orderkey % 131 <> 0 AND o_orderkey % 3 = 0
  UNION ALL SELECT CAST(700 AS BIGINT), o_orderkey, 'insert of a key that is open' FROM orders WHERE o_orderkey % 3 = 1
  AND NOT (o_orderkey % 131 = 0 AND o_orderkey % 97 <> 0) AND NOT (o_orderkey % 1009 = 0 AND o_orderkey % 131 <> 0)
  UNION ALL SELECT CAST(700 AS BIGINT), o_orderkey, 'update of an unknown key' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 131 = 0 AND o_orderkey % 97 <> 0""")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound log, to which inserts of some keys and updates of others are added: right only where the key is gone or open."""
    log = H.order_changes(spark, sf_dir)
    late = H.table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 2").select(
        F.lit(700).cast("bigint").alias("lsn"), F.col("o_orderkey").cast("int").alias("ord"), F.when(F.col("o_orderkey") % 3 == 1, "I").otherwise("U").alias("op"), F.col("o_orderkey").alias("id")
    )
    found = C.violations(log.unionByName(late, allowMissingColumns=True), H.ORDER_KEY, H.ORDER_COLUMNS)
    return found.select("lsn", F.col("ord").cast("bigint").alias("id"), "problem")


@query("c12_moves_onto_open_keys", "SELECT c_custkey + 1 AS id, 'update onto a key that is open' AS problem FROM customer WHERE c_custkey % 4 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _customers(spark, sf_dir)
    moved = base.where("id % 4 = 0").withColumns({"old_id": F.col("id"), "id": F.col("id") + 1, "ord": (F.col("id") + 1).cast("int"), "lsn": F.lit(200).cast("bigint"), "op": F.lit("U")})
    return C.violations(base.unionByName(moved), ["id"], ["id", "name"]).select(F.col("ord").cast("bigint").alias("id"), "problem")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer inserted at 100."""
    return H.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(100).cast("bigint").alias("lsn"), F.lit(0).alias("ord"), F.lit("I").alias("op"), F.lit(None).cast("bigint").alias("old_id")
    )


@query("c11_keyless_append", "SELECT role, count(*) AS n FROM conversations WHERE 100 + conv_id <= 150 GROUP BY role")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.table(spark, sf_dir, "conversations").withColumns({"lsn": 100 + F.col("conv_id"), "ord": F.lit(0), "op": F.lit("I")})
    return V.state_at(C.versions_of(rows, [], ["conv_id", "turn", "role", "text"]), 150).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("c14_truncate", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 9 AND 200 + o_orderkey % 50 > 220")
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.order_changes(spark, sf_dir).where("op = 'I'")
    cut = rows.limit(1).withColumns({"lsn": F.lit(220).cast("bigint"), "ord": F.lit(0), "op": F.lit("T")})
    return V.state_at(C.versions_of(rows.unionByName(cut), H.ORDER_KEY, H.ORDER_COLUMNS), 300).select("id")


@query("c15_unchanged_columns", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = H.table(spark, sf_dir, "conversations").withColumns({"lsn": F.lit(100).cast("bigint"), "ord": F.lit(0), "op": F.lit("I"), "unchanged": F.array().cast("array<string>")})
    later = base.withColumns({"lsn": F.lit(200).cast("bigint"), "op": F.lit("U"), "text": F.lit(None).cast("string"), "unchanged": F.array(F.lit("text"))})
    rows = C.versions_of(base.unionByName(later), ["conv_id", "turn"], ["conv_id", "turn", "role", "text"], strict=False)
    return V.state_at(rows, 200).select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n"))


@query("c15_after_moved_key", "SELECT c_custkey + 10000000 * (c_custkey % 3) AS id, c_name AS name FROM customer")
def c15_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that change their key none, one or two times with an unchanged name, and then once more in place."""
    base = _customers(spark, sf_dir).withColumn("unchanged", F.array().cast("array<string>"))
    change = lambda rows, lsn, step: rows.withColumns({
        "old_id": F.col("id") + step - 10_000_000 if lsn < 400 else F.lit(None).cast("bigint"), "id": F.col("id") + step, "lsn": F.lit(lsn).cast("bigint"), "op": F.lit("U"),
        "name": F.lit(None).cast("string"), "unchanged": F.array(F.lit("name")),
    })
    once, twice = change(base.where("id % 3 >= 1"), 200, 10_000_000), change(base.where("id % 3 = 2"), 300, 20_000_000)
    last = [change(base.where(f"id % 3 = {n}"), 400, n * 10_000_000) for n in range(3)]
    log = base
    for more in (once, twice, *last):
        log = log.unionByName(more)
    return V.state_at(C.versions_of(log, ["id"], ["id", "name"]), 400).select("id", "name")


@query("c16_changed_keys", "SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS id, c_name AS name FROM customer")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _customers(spark, sf_dir)
    moved = base.where("id % 5 = 0").withColumns({"old_id": F.col("id"), "id": F.col("id") + 10_000_000, "lsn": F.lit(200).cast("bigint"), "op": F.lit("U")})
    return V.state_at(C.versions_of(base.unionByName(moved), ["id"], ["id", "name"]), 200).select("id", "name")


@query("c22_truncate_in_both_forms", "SELECT form, o_orderkey AS id FROM orders, (VALUES ('intervals'), ('rows')) f(form) WHERE o_orderkey % 10 = 9 AND 200 + o_orderkey % 50 > 220")
def c22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a truncate the interval form and the raw form reduce to the same state."""
    rows = H.order_changes(spark, sf_dir).where("op = 'I'")
    log = rows.unionByName(rows.limit(1).withColumns({"lsn": F.lit(220).cast("bigint"), "ord": F.lit(0), "op": F.lit("T")}))
    spans = V.state_at(C.versions_of(log, H.ORDER_KEY, H.ORDER_COLUMNS), 300)
    raw = V.latest_at(C.version_rows(log, H.ORDER_KEY, H.ORDER_COLUMNS), ["id"], 300)
    return spans.select(F.lit("intervals").alias("form"), "id").unionByName(raw.select(F.lit("rows").alias("form"), "id"))


@query("c20_unapplied_transactions", "SELECT event_id AS lsn, md5(CAST(event_id AS VARCHAR)) AS sha256 FROM events WHERE event_id % 3 <> 0")
def c20(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = H.table(spark, sf_dir, "events").select(F.col("event_id").alias("lsn"), F.md5(F.col("event_id").cast("string")).alias("sha256"))
    return C.unapplied(every, every.where("lsn % 3 = 0"))


@query("c23_ordinals", "SELECT l_orderkey AS lsn, max(n) AS n FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) t GROUP BY l_orderkey")
def c23(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lsn"), F.col("l_linenumber").alias("seq"))
    return C.change_ordinals(rows).groupBy("lsn").agg(F.max("ord").cast("bigint").alias("n"))


@query("c8_schema_at", """WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_id <= 6000)
  SELECT user_id AS relid, max(event_id) AS valid_from_lsn, arg_max(event_type, event_id) AS column_name FROM e WHERE before IS NULL OR before <> event_type GROUP BY user_id""")
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user a relation, every event a description of it with one column named after its type: the shape at 6000."""
    shapes = H.table(spark, sf_dir, "events").select(F.col("user_id").alias("relid"), F.lit("app.c").alias("name"), F.col("event_id").alias("valid_from_lsn"), F.array("event_type").alias("columns"))
    return schema_at(schema_versions(shapes), 6000).select("relid", "valid_from_lsn", F.col("columns")[0].alias("column_name"))


@query("c8_as_of_join", "SELECT l.o_orderkey AS id, max(r.o_orderdate) AS before FROM orders l LEFT JOIN orders r ON r.o_custkey = l.o_custkey AND r.o_orderkey % 4 = 0 AND r.o_orderdate <= l.o_orderdate GROUP BY l.o_orderkey")
def c8_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = H.table(spark, sf_dir, "orders")
    left = o.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    right = o.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("since"), F.col("o_orderdate").alias("before"))
    return as_of_join(left, right, "k", "at", "since", ["before"]).select("id", "before")


@query("lsn_text_round_trip", "SELECT event_id AS id, event_id * 4294967 AS lsn FROM events")
def lsn_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = H.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return e.select("id", lsn_column(lsn_text(F.col("id") * 4294967)).alias("lsn"))


@query("k8_status", "SELECT * FROM (VALUES ('columnar:app.customers', '0/1312D00', '0/1F4', CAST(19999500 AS BIGINT)), ('columnar:app.documents', '0/1312D00', '0/190', CAST(19999600 AS BIGINT)), ('columnar:app.events', '0/1312D00', '0/1312D00', CAST(0 AS BIGINT)), ('columnar:app.orders', '0/1312D00', '0/258', CAST(19999400 AS BIGINT)), ('search:app.documents', '0/1312D00', '0/190', CAST(19999600 AS BIGINT))) t(shape, received_lsn, applied_lsn, apply_lag_bytes)")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.engine(spark, sf_dir).query("SELECT * FROM tidemark.stat_replication ORDER BY shape")[0]


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '' AND length(t) <= 40)"
BM25_SQL = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM {H.documents_sql(350)} s),
st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT doc_id, len(w) AS dl, t.term, len(list_filter(w, lambda x: x = t.term)) AS tf FROM d, (VALUES ('xylophone'), ('thatin')) t(term)),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term)
SELECT CAST(doc_id AS VARCHAR) AS key, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 5) AS score
FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY doc_id"""


@query("f8_bm25", BM25_SQL)
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(H.stored_index(spark, sf_dir).index(), "xylophone thatin", lsn=350).select("key", F.round("score", 5).alias("score"))


@query("f9_required_and_banned", f"SELECT CAST(doc_id AS VARCHAR) AS key FROM (SELECT doc_id, {_TOKENS} AS w FROM {H.documents_sql(350)} s) d WHERE list_contains(w, 'thatin') AND NOT list_contains(w, 'ononst')")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(H.stored_index(spark, sf_dir).index(), "+thatin -ononst", lsn=350).select("key")


@query("f12_num_docs", f"SELECT count(*) AS n FROM {H.documents_sql(450)} s")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.stored_index(spark, sf_dir).index().num_docs(450)


@query("d3_search_join", f"SELECT doc_id, __lsn AS at FROM {H.documents_sql(400)} s WHERE doc_id % 41 = 0")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT c.doc_id, c.__lsn AS at FROM search('app.documents', 'xylophone') s JOIN app.documents c ON CAST(c.doc_id AS VARCHAR) = s.key"
    return H.engine(spark, sf_dir).query(sql)[0]


@query("f9_groups_and_phrases", f"""WITH q AS (SELECT ' ' || w[1] || ' ' || w[2] || ' ' AS p FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) t WHERE len(w) >= 2 ORDER BY doc_id LIMIT 1)
  SELECT CAST(doc_id AS VARCHAR) AS key FROM (SELECT doc_id, {_TOKENS} AS w FROM {H.documents_sql(350)} s) d, q
  WHERE (list_contains(w, 'thatin') OR list_contains(w, 'xylophone')) AND NOT contains(' ' || array_to_string(w, ' ') || ' ', p)""")
def f9_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(one OR other) without a phrase: the first two words of the first document that has two."""
    cut = tokens(F.col("text"), "[^a-z0-9]+")
    first = H.table(spark, sf_dir, "documents").select("doc_id", F.slice(cut, 1, 2).alias("w")).where(F.size("w") == 2).orderBy("doc_id").limit(1).first()
    phrase = " ".join(first["w"]) if first else "none at all"
    return search(H.stored_index(spark, sf_dir).index(), f'(thatin OR xylophone) -"{phrase}"', lsn=350).select("key")


@query("d6_search_top_k", f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM {H.documents_sql(400)} s), m AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
  h AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'xylophone')) AS tf FROM d), f AS (SELECT count(*) AS df FROM h WHERE tf > 0),
  s AS (SELECT CAST(doc_id AS VARCHAR) AS key, CAST(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)) AS FLOAT) AS score FROM h, m, f WHERE tf > 0)
  SELECT key, row_number() OVER (ORDER BY score DESC, key) AS place FROM s ORDER BY place LIMIT 10""")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT key, row_number() OVER (ORDER BY score DESC, key) AS place FROM (SELECT key, score FROM search('app.documents', 'xylophone') ORDER BY score DESC, key LIMIT 10) t"
    return H.engine(spark, sf_dir).query(sql)[0]


@query("o1_multiset_difference", "SELECT CAST(count(*) AS BIGINT) AS differing FROM orders WHERE o_orderkey % 97 = 0")
def o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, keep = H.stored(spark, sf_dir, "orders"), ["id", "status"]
    a, b = (orders.at(lsn).select(*keep) for lsn in (299, 300))
    return b.exceptAll(a).where("status = 'reprocessed'").agg(F.count(F.lit(1)).alias("differing"))


_ROW_MD5 = "md5(concat(" + ", ".join(f"length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR || ';'" for c in ("id", "status", "amount_cents")) + "))"


@query("o1_state_digest", f"SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(m, 1, 15) AS BIGINT)) AS DECIMAL(38, 0)) AS h, CAST(sum(CAST('0x' || substr(m, 16, 15) AS BIGINT)) AS DECIMAL(38, 0)) AS g FROM (SELECT {_ROW_MD5} AS m FROM {H.orders_sql(500)} s) t")
def o1_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.multiset_digest(_state(H.stored(spark, sf_dir, "orders").at(500)))


@query("o3_projection_multiset", f"SELECT status, channel, CAST(count(*) AS BIGINT) AS n FROM {H.orders_sql(500)} s GROUP BY status, channel")
def o3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.projection_multiset(H.stored(spark, sf_dir, "orders").at(500), ["status", "channel"])


@query("e1_nearest_rank", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


def freshness(at: DataFrame, commits: DataFrame) -> DataFrame:
    """Each row of ``at`` (at) with the greatest id of ``commits`` (ts, id) not after it, or null.

    As-of within the hour, with the greatest id of earlier hours carried in: the only window without
    partition has one row an hour. Distinct times meet the commits, so repeated ones cost one row.
    """
    hour = lambda c: F.date_trunc("hour", c)
    times = at.where("at is not null").select(F.col("at").cast("timestamp").alias("at")).distinct().withColumn("hour", hour(F.col("at")))
    ids = commits.where("ts is not null").groupBy(F.col("ts").cast("timestamp").alias("since")).agg(F.max("id").alias("id")).withColumn("hour", hour(F.col("since")))
    within = Window.partitionBy("hour").orderBy("since")
    steps = ids.select("hour", "since", F.max("id").over(within).alias("in_hour"))
    hours = ids.select("hour", "id").unionByName(times.select("hour", F.lit(None).cast(ids.schema["id"].dataType).alias("id"))).groupBy("hour").agg(F.max("id").alias("id"))
    before = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    earlier = hours.select("hour", F.max("id").over(before).alias("earlier"))
    known = as_of_join(times, steps, "hour", "at", "since", ["in_hour"]).join(earlier, "hour")
    known = known.select(F.col("at").alias("__at"), F.greatest("in_hour", "earlier").alias("newest"))
    return at.join(known, at["at"].cast("timestamp") == F.col("__at"), "left").select("at", "newest")


@query("o12_freshness", "SELECT l_shipdate AS at, CAST(newest AS BIGINT) AS newest FROM lineitem ASOF LEFT JOIN (SELECT DISTINCT ts, max(event_id) OVER (ORDER BY ts) AS newest FROM events WHERE ts IS NOT NULL) e ON l_shipdate >= e.ts")
def o12(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = H.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("at"))
    return freshness(at, H.table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("id")))


@query("n3_generated_orders", generated_sql.orders(200, 20260901))
def n3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.generate(spark, "orders", 200, 20260901)


@query("n9_batch_hashes", generated_sql.order_batches(100, 20260901, 2000))
def n9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.batch_hashes(generator.generate(spark, "orders", 100, 20260901), "order_id", 2000)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q5_by_status"](spark, sf_dir)


