"""Committed changes to row versions.

A change is a row of: lsn, ord (position in its transaction), op (I, U, D, T), the new image's columns,
``old_<key>`` columns (null without an old image) and ``unchanged`` (names of columns whose
value the source left out because it did not change; null or empty otherwise).

* An insert opens a version, a delete closes one, an update closes the old image's key (the new one's
  where there is no old image) and opens the new image's; so a changed key leaves no ghost.
* A truncate closes everything older, in tables with and without a key.
* A column in ``unchanged`` takes the row's value before, through every change of its key; a true null
  is not filled.
* Loud errors: an update or delete of a key that is not open, an insert of one that is, a move onto one that
  is, an update or delete without a key, an unchanged column without a value before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.lsn import HEAD
from tidemark.schema import LSN, LSN_TO, ORD
from tidemark.storage import cut


class ChangeError(ValueError):
    """A change log that contradicts itself."""


def _events(changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Opens and closes by key. sub orders a change's close before its open."""
    if "unchanged" not in changes.columns:
        changes = changes.withColumn("unchanged", F.array().cast("array<string>"))
    for k in key:
        if f"old_{k}" not in changes.columns:
            changes = changes.withColumn(f"old_{k}", F.lit(None).cast(changes.schema[k].dataType))
    has_old = reduce(lambda a, b: a | b, [F.col(f"old_{k}").isNotNull() for k in key], F.lit(False))
    moved = has_old & reduce(lambda a, b: a | b, [~F.col(f"old_{k}").eqNullSafe(F.col(k)) for k in key], F.lit(False))
    rows = changes.where("op <> 'T'").withColumn("moved", (F.col("op") == "U") & moved)
    plain = [c for c in columns if c not in key]
    opens = F.when(F.col("op").isin("I", "U"), F.struct(F.lit(1).alias("sub"), *key))
    closes = F.when((F.col("op") == "D") | F.col("moved"), F.struct(F.lit(0).alias("sub"), *[F.when(has_old, F.col(f"old_{k}")).otherwise(F.col(k)).alias(k) for k in key]))
    both = rows.withColumn("side", F.explode(F.filter(F.array(opens, closes), lambda s: s.isNotNull())))
    return both.select("lsn", "ord", "side.sub", "op", "moved", *[f"side.{k}" for k in key], *plain, "unchanged", F.struct(*key).alias("__to"))


def _truncates(changes: DataFrame):
    """One value: the positions of all truncates, ascending. Truncates are statements, so few."""
    return changes.where("op = 'T'").agg(F.array_sort(F.collect_list(F.struct("lsn", "ord"))).alias("truncates"))


def versions_of(changes: DataFrame, key: list[str], columns: list[str], strict: bool = True, truncates: bool = True) -> DataFrame:
    """Version rows (columns, __ord, __lsn_to, __lsn) of a change log. ``truncates`` false: it has none, which
    saves the pass that looks for them; likewise a log without the column ``unchanged`` is not filled."""
    if strict and not (wrong := violations(changes, key, columns)).isEmpty():
        first = wrong.first()
        raise ChangeError(f"{first['problem']} at position {first['lsn']}, change {first['ord']}")
    after = F.expr("filter(truncates, t -> t.lsn > lsn or (t.lsn = lsn and t.ord > ord))")
    if not key:
        rows = changes.where("op = 'I'").crossJoin(F.broadcast(_truncates(changes)))
        end = F.coalesce(F.get(after, F.lit(0))["lsn"], F.lit(HEAD))
        return rows.select(*columns, F.col("ord").alias(ORD), end.alias(LSN_TO), F.col("lsn").alias(LSN))
    order = Window.partitionBy(*key).orderBy("lsn", "ord", "sub")
    filled = _filled(_events(changes, key, columns), key, columns, "unchanged" in changes.columns, _may_move(changes, key))
    rows = filled.withColumn("next", F.lead("lsn").over(order)).where("sub = 1")
    if not truncates:
        return rows.select(*columns, F.col("ord").alias(ORD), F.coalesce("next", F.lit(HEAD)).alias(LSN_TO), F.col("lsn").alias(LSN))
    rows = rows.crossJoin(F.broadcast(_truncates(changes)))
    end = F.least(F.coalesce("next", F.lit(HEAD)), F.coalesce(F.get(after, F.lit(0))["lsn"], F.lit(HEAD)))
    return rows.select(*columns, F.col("ord").alias(ORD), end.alias(LSN_TO), F.col("lsn").alias(LSN))


def _lineages(events: DataFrame, key: list[str]) -> DataFrame:
    """events with ``__row``: where the row they belong to was inserted, through all changes of its key.

    A stretch is what happens to a key from an insert or an arrival on; an arrival's stretch continues the one
    its departure belongs to. Stretches are followed to their first by doubling, so a chain of n moves
    takes about log2(n) rounds, each over the moves alone.
    """
    place, arrived = F.struct(*key, "lsn", "ord"), F.struct(*[F.col(f"__to.{k}").alias(k) for k in key], "lsn", "ord")
    began = F.when((F.col("sub") == 1) & ((F.col("op") == "I") | F.col("moved")), place)
    before = Window.partitionBy(*key).orderBy("lsn", "ord", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("__row", F.coalesce(F.last(began, ignorenulls=True).over(before), place))
    moves = cut(events.where("moved and sub = 0").select(arrived.alias("child"), F.col("__row").alias("first")))
    while True:
        further = moves.select(F.col("child").alias("first"), F.col("first").alias("further"))
        if moves.join(further, "first", "left_semi").isEmpty():
            break
        moves = cut(moves.join(further, "first", "left").select("child", F.coalesce("further", "first").alias("first")))
    firsts = moves.select(F.col("child").alias("__row"), "first")
    return events.join(firsts, "__row", "left").withColumn("__row", F.coalesce("first", "__row")).drop("first")


def _filled(events: DataFrame, key: list[str], columns: list[str], fill: bool, may_move: bool) -> DataFrame:
    """Unchanged columns take the last known value of their row. Without moves a row is its key."""
    if not fill:
        return events.drop("__to")
    row = key
    if may_move:
        events, row = _lineages(events, key), ["__row"]
    before = Window.partitionBy(*row).orderBy("lsn", "ord", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = [c for c in columns if c not in key]
    gone = {c: F.coalesce(F.array_contains("unchanged", c), F.lit(False)) for c in plain}
    known = {c: F.last(F.when((F.col("sub") == 1) & ~gone[c], F.struct(F.col(c).alias("v"))), ignorenulls=True).over(before) for c in plain}
    out = events.select("*", *[known[c].alias(f"__{c}") for c in plain])
    out = out.withColumns({c: F.when(gone[c], F.col(f"__{c}")["v"]).otherwise(F.col(c)) for c in plain})
    return out.drop(*[f"__{c}" for c in plain], "__row", "__to")


def _may_move(changes: DataFrame, key: list[str]) -> bool:
    return any(f"old_{k}" in changes.columns for k in key)


def violations(changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """lsn, ord and problem of every change that contradicts the state before it."""
    if not key:
        return changes.where("op in ('U', 'D')").select("lsn", "ord", F.lit("update or delete in a table without a key").alias("problem"))
    events = _events(changes, key, columns).crossJoin(F.broadcast(_truncates(changes)))
    order = Window.partitionBy(*key).orderBy("lsn", "ord", "sub")
    before = F.lag(F.struct("sub", "lsn", "ord")).over(order)
    seen = events.withColumn("before", before)
    cut = F.expr("exists(truncates, t -> (t.lsn > before.lsn or (t.lsn = before.lsn and t.ord > before.ord)) and (t.lsn < lsn or (t.lsn = lsn and t.ord < ord)))")
    opened = F.coalesce((F.col("before.sub") == 1) & ~cut, F.lit(False))
    lost = (F.size(F.coalesce("unchanged", F.array().cast("array<string>"))) > 0) & ~F.col("moved")
    problem = (
        F.when((F.col("op") == "D") & ~opened, "delete of an unknown key")
        .when(F.col("moved") & (F.col("sub") == 0) & ~opened, "update of an unknown key")
        .when((F.col("op") == "U") & ~F.col("moved") & ~opened, "update of an unknown key")
        .when((F.col("op") == "I") & opened, "insert of a key that is open")
        .when(F.col("moved") & (F.col("sub") == 1) & opened, "update onto a key that is open")
        .when((F.col("op") == "I") & lost, "unchanged column without a value before")
    )
    return seen.select("lsn", "ord", problem.alias("problem")).where("problem is not null")


def version_rows(changes: DataFrame, key: list[str], columns: list[str], truncates: bool = True) -> DataFrame:
    """The raw form: one immutable row per change and a tombstone for every key that ends: the old key of a
    moved row, and each key that a truncate finds open. Columns plus _lsn, _ord, _deleted.
    ``truncates`` false: the log has none."""
    if not key:
        raise ChangeError("version rows need a key")
    filled = _filled(_events(changes, key, columns), key, columns, "unchanged" in changes.columns, _may_move(changes, key))
    place = lambda lsn, n, deleted: [F.col(lsn).alias("_lsn"), n.alias("_ord"), deleted.alias("_deleted")]
    rows = filled.select(*columns, *place("lsn", F.col("ord") * 2 + F.col("sub"), F.col("sub") == 0))
    if not truncates:
        return rows
    order = Window.partitionBy(*key).orderBy("lsn", "ord", "sub")
    open_ = filled.withColumn("next", F.lead(F.struct("lsn", "ord")).over(order)).where("sub = 1").crossJoin(F.broadcast(_truncates(changes)))
    ends = F.expr("filter(truncates, t -> (t.lsn > lsn or (t.lsn = lsn and t.ord > ord)) and (next is null or t.lsn < next.lsn or (t.lsn = next.lsn and t.ord < next.ord)))")
    ended = open_.withColumn("end", F.get(ends, F.lit(0))).where("end is not null")
    return rows.unionByName(ended.select(*columns, *place("end.lsn", F.col("end.ord") * 2, F.lit(True))))


def change_ordinals(changes: DataFrame) -> DataFrame:
    """1-based positions within each transaction, in sequence order."""
    return changes.withColumn("ord", F.row_number().over(Window.partitionBy("lsn").orderBy("seq")))


def composite_key(*columns: str):
    """One text for a composite key: each part length-prefixed, so that no two keys share one; null has none."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns])


def unapplied(transactions: DataFrame, applied: DataFrame) -> DataFrame:
    """Transactions not applied yet, by (lsn, sha256). A known position with another hash is an error."""
    known = applied.select("lsn", F.col("sha256").alias("known"))
    joined = transactions.join(known, "lsn", "left")
    clash = F.when(F.col("known") != F.col("sha256"), F.raise_error(F.concat(F.lit("transaction differs from the one applied at "), F.col("lsn").cast("string"))).cast("boolean"))
    return joined.where(F.coalesce(clash, F.col("known").isNull())).drop("known")


def content_token(table: str, boundary: str, body: str) -> str:
    """A deduplication token over length-prefixed parts."""
    import hashlib

    return hashlib.sha256(b"".join(len(p).to_bytes(8, "big") + p for p in (x.encode() for x in (table, boundary, body)))).hexdigest()
